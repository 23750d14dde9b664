"""The playoff: pots, their balance, the draw, the first round and its hosts, and the second selection."""

from __future__ import annotations

import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pennant.operators.coefficients import ranked

# Pots by rank of the conference and finish in it; finishes not named are in pot 2.
POTS = {1: {1: 0, 2: 0, 3: 1}, 2: {1: 0, 2: 0, 3: 1}, 3: {1: 0, 2: 1, 3: 1}, 4: {1: 0, 2: 1, 3: 1}, 5: {1: 0, 2: 1}, 6: {1: 0}}
YEAR1_POTS = {**POTS, 6: {1: 0, 2: 1}}
POT_SIZE, SEED = 8, 20250101
TIER_BIDS = [4, 4, 4, 4, 3, 1, 1, 1, 1, 1]


def pot_of(rank: Column, finish: Column, rules: dict[int, dict[int, int]] | None = None) -> Column:
    """The pot of a finish in a ranked conference."""
    pot = F.lit(2)
    for r, finishes in (rules or POTS).items():
        for f, value in finishes.items():
            pot = F.when((rank == r) & (finish == f), value).otherwise(pot)
    return pot


def pots(qualified: DataFrame, strength: DataFrame, teams: DataFrame, rules: dict | None = None) -> DataFrame:
    """qualified with pot, rolling strength (0 where a team has none) and name."""
    rows = qualified.join(strength.select("season_year", "team_id", "total_points_5yr", "points_per_game_5yr"), ["season_year", "team_id"], "left")
    rows = rows.join(teams, "team_id").fillna(0.0, ["total_points_5yr", "points_per_game_5yr"])
    pot = pot_of(F.coalesce("conf_coe_rank", F.lit(999)), F.coalesce("conf_rank", F.lit(999)), rules)
    return rows.withColumn("pot", pot).withColumn("moved", F.lit(0))


def nit_override(potted: DataFrame, nit: DataFrame) -> DataFrame:
    """Move teams of nit (season_year, team_id): to pot 1 from a conference ranked 1-6, else to pot 2, and then the
    champion of the seventh conference to pot 1."""
    marked = potted.join(nit.select("season_year", "team_id", F.lit(True).alias("nit")), ["season_year", "team_id"], "left")
    low = F.max(F.coalesce("nit", F.lit(False)) & F.col("conf_coe_rank").between(7, 10)).over(Window.partitionBy("season_year"))
    pot = F.when(F.col("nit"), F.when(F.col("conf_coe_rank") <= 6, 1).otherwise(2)).when(low & (F.col("conf_coe_rank") == 7) & (F.col("conf_rank") == 1), 1).otherwise(F.col("pot"))
    return marked.withColumn("pot", pot).drop("nit")


def balance(potted: DataFrame, size: int = POT_SIZE) -> DataFrame:
    """Promote the strongest of pot 2 while pot 1 is short, or demote the weakest of pot 1 while it is long.

    `moved` numbers the teams that changed their pot; they stand last in it.
    """
    season = Window.partitionBy("season_year")
    rows = potted.withColumns({"p1": F.count_if(F.col("pot") == 1).over(season), "p2": F.count_if(F.col("pot") == 2).over(season)})
    up = F.greatest(F.least(size - F.col("p1"), F.col("p2") - size), F.lit(0))
    down = F.greatest(F.least(F.col("p1") - size, size - F.col("p2")), F.lit(0))
    in_pot = Window.partitionBy("season_year", "pot")
    best = in_pot.orderBy(F.desc("total_points_5yr"), F.desc("points_per_game_5yr"), "conf_coe_rank", "conf_rank", F.desc("team_name"), F.desc("team_id"))
    worst = in_pot.orderBy("total_points_5yr", "points_per_game_5yr", "conf_coe_rank", "conf_rank", "team_name", "team_id")
    rows = rows.withColumns({"best": F.row_number().over(best), "worst": F.row_number().over(worst), "up": up, "down": down})
    rises, falls = (F.col("pot") == 2) & (F.col("best") <= F.col("up")), (F.col("pot") == 1) & (F.col("worst") <= F.col("down"))
    rows = rows.withColumn("moved", F.when(rises, F.col("best")).when(falls, F.col("worst")).otherwise(0))
    return rows.withColumn("pot", F.when(rises, 1).when(falls, 2).otherwise(F.col("pot"))).drop("p1", "p2", "best", "worst", "up", "down")


def shuffles(sizes: tuple[int, ...], seed: int = SEED) -> list[list[int]]:
    """The places that one seeded generator draws for lists of these sizes, one after the other."""
    generator = random.Random(seed)
    drawn = []
    for size in sizes:
        places = list(range(size))
        generator.shuffle(places)
        drawn.append(places)
    return drawn


def draw(balanced: DataFrame, seed: int = SEED, strict: bool = False) -> DataFrame:
    """slot 1-24: the pots one after the other, each in the order that the seed draws from (moved, conference, team_id).

    If strict, a season without 24 teams, 8 byes and two pots of 8 is an error, before and after the draw.
    """
    if strict:
        return slots_filled(draw(complete(balanced), seed))
    listed = ranked(balanced, "place", "moved", "conference", "team_id", by=("season_year", "pot"))
    season = Window.partitionBy("season_year")
    sizes = [F.count_if(F.col("pot") == p).over(season).alias(f"n{p}") for p in range(3)]
    listed = listed.select("*", *sizes)
    kinds = [tuple(r) for r in listed.select("n0", "n1", "n2").distinct().collect()]  # a few field sizes
    rows = [(*kind, pot, old + 1, sum(kind[:pot]) + new + 1) for kind in kinds for pot, places in enumerate(shuffles(kind, seed)) for new, old in enumerate(places)]
    drawn = balanced.sparkSession.createDataFrame(rows, "n0 long, n1 long, n2 long, pot int, place int, slot int")
    return listed.join(F.broadcast(drawn), ["n0", "n1", "n2", "pot", "place"]).drop("n0", "n1", "n2", "place").withColumn("draw_seed", F.lit(seed))


def _matching(season: pd.DataFrame) -> pd.DataFrame:
    first, second = (season[season["pot"] == p].sort_values("slot", ignore_index=True) for p in (1, 2))
    chosen: list[int] = []

    def search(k: int) -> bool:
        if k == len(first):
            return True
        for j in sorted(range(len(second)), key=lambda j: (j != k, j)):
            if j not in chosen and first["conference"][k] != second["conference"][j]:
                chosen.append(j)
                if search(k + 1):
                    return True
                chosen.pop()
        return False

    if len(first) > len(second) or not search(0):
        raise ValueError(f"no first round without a conference's own pair in {season['season_year'].iloc[0]}")
    return pd.DataFrame({"season_year": season["season_year"].iloc[0], "game_no": range(1, len(first) + 1), "team_a": first["team_id"], "team_b": second["team_id"].iloc[chosen].to_numpy()})


def round_of_24(bracket: DataFrame) -> DataFrame:
    """Pairs of pots 1 and 2 without a conference's own, preferring the team across; at most 24 rows a season and task."""
    rows = bracket.where("pot > 0").select("season_year", "slot", "pot", "team_id", "conference")
    return rows.groupBy("season_year").applyInPandas(_matching, "season_year int, game_no int, team_a long, team_b long")


def hosts(pairs: DataFrame, bracket: DataFrame) -> DataFrame:
    """The stronger team is home: rolling points, then points per game, then the name that sorts first."""
    info = bracket.select("season_year", F.col("team_id").alias("id"), F.struct(F.col("total_points_5yr").alias("tp"), F.col("points_per_game_5yr").alias("ppg"), "team_name", "team_id", "slot", "pot").alias("t"))
    a, b = info.withColumnRenamed("t", "a").withColumnRenamed("id", "team_a"), info.withColumnRenamed("t", "b").withColumnRenamed("id", "team_b")
    rows = pairs.join(a, ["season_year", "team_a"]).join(b, ["season_year", "team_b"])
    by = F.when(F.col("a.tp") != F.col("b.tp"), "total_points_5yr").when(F.col("a.ppg") != F.col("b.ppg"), "points_per_game_5yr").otherwise("team_name")
    first = F.when(by == "total_points_5yr", F.col("a.tp") > F.col("b.tp")).when(by == "points_per_game_5yr", F.col("a.ppg") > F.col("b.ppg")).otherwise(F.col("a.team_name") <= F.col("b.team_name"))
    home, away = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    rows = rows.withColumns({"h": home, "v": away, "home_is_host_by": by})
    return rows.select("season_year", F.lit("R24").alias("round"), "game_no", *[F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in (("h", "home"), ("v", "away")) for c in ("team_id", "slot", "pot")], "home_is_host_by")


def slot_bracket(bracket: DataFrame) -> DataFrame:
    """The first ruleset's play-ins, slots 9-16 against those that make 33, the host by strength and then lower slot,
    and the bye that waits for each."""
    cols = ["slot", "team_id", "total_points_5yr", "points_per_game_5yr"]
    a = bracket.where("slot between 9 and 16").select("season_year", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = bracket.where("slot between 17 and 24").select("season_year", (33 - F.col("slot")).alias("a_slot"), *[F.col(c).alias(f"b_{c}") for c in cols])
    rows = a.join(b, ["season_year", "a_slot"])
    key = lambda s: F.struct(F.col(f"{s}_total_points_5yr"), F.col(f"{s}_points_per_game_5yr"), -F.col(f"{s}_slot"))
    host = F.when(key("a") > key("b"), F.col("a_team_id")).otherwise(F.col("b_team_id"))
    return rows.select("season_year", F.col("a_slot").alias("slot"), F.col("b_slot").alias("other_slot"), F.col("a_team_id").alias("team_a"), F.col("b_team_id").alias("team_b"), host.alias("host_team_id"), (17 - F.col("a_slot")).alias("bye_slot"))


def tiers(conference_seasons: DataFrame, independents: str, strict: bool = False) -> DataFrame:
    """The ten best conferences of a season by points per game, independents left out; if strict, fewer are an error."""
    rows = conference_seasons.where(F.col("conference") != independents)
    best = ranked(rows, "tier", F.desc("points_per_game"), "conference").where("tier <= 10").select("season_year", "conference", "tier")
    return at_least(best, 10, "tiers") if strict else best


def select_field(tiered: DataFrame, members: DataFrame, standings: DataFrame, team_ranks: DataFrame, independents: str, champions: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """The second selection: each tier's bids go to its champion and its best ranks, then its best coefficients; two
    independents follow by coefficient. field_size tells how many the season has; if strict, other than 24 is an error."""
    champions = champions if champions is not None else standings.where("conf_rank = 1")
    rows = members.join(standings.select("season_year", "conference", "team_id", "conf_rank"), ["season_year", "conference", "team_id"], "left")
    rows = rows.join(team_ranks.select("season_year", "team_id", "coe_rank"), ["season_year", "team_id"], "left")
    rows = rows.join(champions.select("season_year", "conference", "team_id", F.lit(True).alias("champion")), ["season_year", "conference", "team_id"], "left")
    order = [F.coalesce("champion", F.lit(False)).desc(), F.coalesce("conf_rank", F.lit(999)), F.coalesce("coe_rank", F.lit(999999)), F.col("team_id")]
    chosen = ranked(rows.join(tiered, ["season_year", "conference"]), "slot", *order, by=("season_year", "conference"))
    chosen = chosen.where(F.col("slot") <= F.get(F.array(*map(F.lit, TIER_BIDS)), F.col("tier") - 1))
    chosen = chosen.withColumn("pot", pot_of(F.col("tier"), F.col("slot")))
    bid = F.when(F.col("pot") == 0, "bye").when(F.col("champion"), "champion").otherwise("at_large")
    alone = ranked(rows.where((F.col("conference") == independents) & F.col("coe_rank").isNotNull()), "slot", "coe_rank", "team_id").where("slot <= 2")
    out = ["season_year", "conference", "team_id", "tier", "slot", "pot", "bid_type"]
    field = chosen.withColumn("bid_type", bid).select(out).unionByName(alone.withColumns({"tier": F.lit(None).cast("int"), "pot": F.col("slot"), "bid_type": F.lit("at_large")}).select(out))
    field = field.withColumn("field_size", F.count("*").over(Window.partitionBy("season_year")))
    return sized(field) if strict else field


def at_least(rows: DataFrame, n: int, what: str) -> DataFrame:
    """rows; reading a season that has fewer than n of them is an error that names it."""
    return _all_seasons(rows, {"n": F.count("*")}, lambda c: c["n"] >= n, f"fewer than {n} {what}")


def sized(field: DataFrame, n: int = 24) -> DataFrame:
    """The field; reading a season that does not have n teams is an error that names it."""
    return _all_seasons(field, {"n": F.count("*")}, lambda c: c["n"] == n, f"not {n} teams")


def complete(potted: DataFrame, n: int = 24, byes: int = 8) -> DataFrame:
    """A field with pots; reading a season without n teams, the byes and two pots of equal size is an error that names it."""
    of = lambda p: F.count_if(F.col("pot") == p)
    holds = lambda c: (c["n"] == n) & (c["p0"] == byes) & (c["p1"] == (n - byes) // 2) & (c["p2"] == (n - byes) // 2)
    return _all_seasons(potted, {"n": F.count("*"), **{f"p{p}": of(p) for p in range(3)}}, holds, f"not {n} teams with {byes} byes and two equal pots")


def slots_filled(bracket: DataFrame, n: int = 24) -> DataFrame:
    """A drawn bracket; reading a season whose slots are not 1 to n, each once and in its pot's range, is an error that names it."""
    third = F.floor((F.col("slot") - 1) / (n // 3))
    counts = {"n": F.count("*"), "low": F.min("slot"), "high": F.max("slot"), "sum": F.sum("slot"), "odd": F.count_if(third != F.col("pot"))}
    return _all_seasons(bracket, counts, lambda c: (c["n"] == n) & (c["low"] == 1) & (c["high"] == n) & (c["sum"] == n * (n + 1) // 2) & (c["odd"] == 0), f"not slots 1 to {n} by pots")


def _all_seasons(rows: DataFrame, counts: dict[str, Column], holds: Callable[[dict[str, Column]], Column], fault: str) -> DataFrame:
    """rows with a check on counts of a season that runs when they are read: no job of its own, and a season has few rows."""
    season = Window.partitionBy("season_year")
    marked = rows.withColumns({f"_check_{name}": c.over(season) for name, c in counts.items()})
    found = {name: F.col(f"_check_{name}") for name in counts}
    stop = F.raise_error(F.concat(F.lit(f"{fault} in "), F.col("season_year").cast("string"))).cast("boolean")
    return marked.where(F.when(holds(found), F.lit(True)).otherwise(stop)).drop(*[f"_check_{name}" for name in counts])
