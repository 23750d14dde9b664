"""Iterative strength ratings of a season, their decayed windows, and the twelve-team field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pennant.functions.scoring import DECAY, phase_weight
from pennant.operators.store import settled

# Rounds of the iteration, share of the rating that a loser gets, size of the field.
ROUNDS, LOSER_SHARE, FIELD, AUTOMATIC, BYES = 15, 0.15, 12, 5, 4
#: Distinct pairings of a season that a task holds at most (a Python worker had 677 MB at 8.2 million, its arrays of teams included).
IN_TASK = 10_000_000
#: Pairings that a round works on at once.
CHUNK = 1 << 20


def _places(ids: np.ndarray, chunks: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The places in ids of the team_ids in chunks, in arrays of CHUNK; the chunks go on the way."""
    chunks.reverse()
    while chunks:
        taken, n = [], 0
        while chunks and n < CHUNK:
            taken.append(np.searchsorted(ids, chunks.pop()).astype(np.int32))
            n += len(taken[-1])
        yield np.concatenate(taken)


def _rate(rounds: int, loser_share: float):
    """Rates a season from its pairings, batch by batch; 24 bytes a decided one are held, 16 once all teams are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, fresh, waiting = np.empty(0, np.int64), [], 0
        winners, losers, weights = [], [], []
        for batch in batches:
            year = batch.column("season_year")[0].as_py()
            home, away, sign, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("home_team_id", "away_team_id", "sign", "weight"))
            fresh.append(np.unique(np.concatenate([home, away])))
            waiting += len(fresh[-1])
            if waiting > max(CHUNK, len(ids)):
                ids, fresh, waiting = np.unique(np.concatenate([ids, *fresh])), [], 0
            home_won, decided = sign > 0, (sign > 0) | (sign < 0)
            winners.append(np.where(home_won, home, away)[decided])
            losers.append(np.where(home_won, away, home)[decided])
            weights.append(weight[decided])
        ids, fresh = np.unique(np.concatenate([ids, *fresh])), []
        n = len(ids)
        won, lost = list(_places(ids, winners)), list(_places(ids, losers))
        weights, ends = np.concatenate(weights), np.cumsum([len(w) for w in won])[:-1]
        links = list(zip(won, lost, np.split(weights, ends), strict=True))
        rating = np.ones(n)
        for _ in range(rounds):
            gained = np.zeros(n)
            for winner, loser, weight in links:
                gained += np.bincount(winner, rating[loser] * weight, n)
                gained += np.bincount(loser, rating[winner] * weight * loser_share, n)
            total = gained.sum()
            if total <= 0:
                break
            rating = gained * (n / total)
        for start in range(0, n, CHUNK):
            part = slice(start, start + CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids[part]), year, np.int32)), pa.array(ids[part]), pa.array(rating[part])], ["season_year", "team_id", "rating"])

    return run


def iterative_ratings(games: DataFrame, rounds: int = ROUNDS, loser_share: float = LOSER_SHARE, in_task: int = IN_TASK) -> DataFrame:
    """season_year, team_id, rating: each round a winner gains the loser's rating times the game's weight, the loser a share.

    Ratings of a season add up to its teams. A season's games are first added up for each winner and loser. Seasons of at
    most `in_task` such pairings run beside each other, each in a task; larger ones round by round over all tasks, see
    spread_ratings(). Both give the same ratings but for rounding. Games without a season or a team count for nothing.
    The ratings are a table, so what reads them several times does not rate again.
    """
    decided = F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    sign = F.when(decided, F.signum(F.col("home_score") - F.col("away_score")))
    sound = games.where("season_year is not null and home_team_id is not null and away_team_id is not null")
    pairs = settled(sound.groupBy("season_year", "home_team_id", "away_team_id", sign.alias("sign")).agg(F.sum(phase_weight(F.col("game_phase"))).alias("weight")))
    large = [r["season_year"] for r in pairs.groupBy("season_year").agg(F.count("*").alias("n")).where(F.col("n") > in_task).collect()]  # one row a season at most
    rows = pairs.where(~F.col("season_year").isin(large)).select(F.col("season_year").cast("int").alias("season_year"), F.col("home_team_id").cast("long").alias("home_team_id"), F.col("away_team_id").cast("long").alias("away_team_id"), F.col("sign").cast("double").alias("sign"), F.col("weight").cast("double").alias("weight"))
    rated = settled(rows.groupBy("season_year").applyInArrow(_rate(rounds, loser_share), "season_year int, team_id long, rating double"))
    return rated.unionByName(spread_ratings(pairs.where(F.col("season_year").isin(large)), rounds, loser_share)) if large else rated


def spread_ratings(pairs: DataFrame, rounds: int = ROUNDS, loser_share: float = LOSER_SHARE, together: int = 3) -> DataFrame:
    """The ratings of pairs (season_year, home_team_id, away_team_id, sign, weight) by rounds over all tasks.

    A round joins the ratings to the links they flow along and adds up what each team gets; sums are formed before the
    shuffle, so a team that a third of all games name is one row a task. As a round is linear, ratings are only brought
    back to their sum every `together` rounds, when they are written. A season without a decided game keeps its ones.
    """
    home_won = F.col("sign") > 0
    winner, loser = F.when(home_won, F.col("home_team_id")).otherwise(F.col("away_team_id")), F.when(home_won, F.col("away_team_id")).otherwise(F.col("home_team_id"))
    won = pairs.where("sign <> 0").select("season_year", winner.alias("w"), loser.alias("l"), "weight")
    flows = F.explode(F.array(F.struct(F.col("w").alias("to"), F.col("l").alias("source"), F.col("weight").alias("f")), F.struct(F.col("l").alias("to"), F.col("w").alias("source"), (F.col("weight") * loser_share).alias("f"))))
    links = settled(won.select("season_year", flows.alias("x")).groupBy("season_year", "x.to", "x.source").agg(F.sum("x.f").alias("f")))
    teams = settled(pairs.select("season_year", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).distinct())
    ratings, done = teams.withColumn("rating", F.lit(1.0)), 0
    while done < rounds:
        now = min(together, rounds - done)
        gained = ratings
        for _ in range(now):
            gained = links.join(gained.withColumnRenamed("team_id", "source"), ["season_year", "source"]).groupBy("season_year", F.col("to").alias("team_id")).agg(F.sum(F.col("rating") * F.col("f")).alias("rating"))
        gained = settled(teams.join(gained, ["season_year", "team_id"], "left").fillna(0.0, ["rating"]))
        sums = F.broadcast(gained.groupBy("season_year").agg(F.count("*").alias("n"), F.sum("rating").alias("total")))  # one row a season
        ratings = gained.join(sums, "season_year").select("season_year", "team_id", F.when(F.col("total") > 0, F.col("rating") * F.col("n") / F.col("total")).otherwise(1.0).alias("rating"))
        done += now
    return ratings.select(F.col("season_year").cast("int").alias("season_year"), "team_id", "rating")


def decayed(ratings: DataFrame, window: int = 5, decay: float = DECAY) -> DataFrame:
    """Sums of decay ** age over full windows only; a season without a rating adds nothing."""
    seasons = ratings.select("season_year").distinct()
    dealt = seasons.withColumn("end_year", F.explode(F.sequence(F.col("season_year"), F.col("season_year") + window - 1)))
    full = dealt.groupBy("end_year").agg(F.count("*").alias("n")).where(F.col("n") == window).select("end_year")
    rows = ratings.withColumn("end_year", F.explode(F.sequence(F.col("season_year"), F.col("season_year") + window - 1))).join(F.broadcast(full), "end_year")
    age = F.col("end_year") - F.col("season_year")
    return rows.groupBy("end_year", "team_id").agg(F.sum(F.col("rating") * F.pow(F.lit(decay), age)).alias("coeff_5yr")).select(
        "end_year", (F.col("end_year") - window + 1).alias("window_start"), "team_id", "coeff_5yr",
    )


def champions(rated: DataFrame) -> DataFrame:
    """The best-rated team of each conference (season_year, conference, team_id, rating), ties by team_id."""
    best = Window.partitionBy("season_year", "conference").orderBy(F.desc("rating"), "team_id")
    return rated.where("conference is not null").withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def field_of_twelve(rated: DataFrame) -> DataFrame:
    """seed and bid_type: the best champions get in, the best others fill up; the first seeds are champions."""
    order = [F.desc("rating"), F.asc("team_id")]
    by_season = Window.partitionBy("season_year")
    best = champions(rated).withColumn("auto_rank", F.row_number().over(by_season.orderBy(*order))).where(F.col("auto_rank") <= AUTOMATIC)
    rows = rated.join(best.select("season_year", "team_id", "auto_rank"), ["season_year", "team_id"], "left")
    open_rank = F.row_number().over(Window.partitionBy("season_year", F.col("auto_rank").isNull()).orderBy(*order))
    counted = rows.withColumn("open_rank", open_rank).where(F.col("auto_rank").isNotNull() | (F.col("open_rank") <= FIELD - AUTOMATIC))
    bye = F.col("auto_rank") <= BYES
    seed = F.row_number().over(by_season.orderBy(F.coalesce(bye, F.lit(False)).desc(), F.when(bye, F.col("auto_rank")), *order))
    return counted.select("season_year", seed.alias("seed"), "team_id", "conference", F.when(F.col("auto_rank").isNotNull(), "auto").otherwise("at_large").alias("bid_type"), "rating")


def first_round_of_twelve(field: DataFrame) -> DataFrame:
    """The pairs whose seeds add up to 17."""
    high = field.where("seed between 5 and 8").select("season_year", F.col("seed").alias("high_seed"), F.col("team_id").alias("high_team"))
    low = field.select("season_year", (17 - F.col("seed")).alias("high_seed"), F.col("seed").alias("low_seed"), F.col("team_id").alias("low_team"))
    return high.join(low, ["season_year", "high_seed"])
