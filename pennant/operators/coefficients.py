"""Points-based coefficients of teams and conferences: components, seasons, rolling windows, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pennant.functions.scoring import PARTICIPATION, PLAYOFF_GAME, played, ratio, result_points

VERSION = "v0"


def _component(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumns({"component": F.lit(name), "formula_version": F.lit(VERSION)})


def _base(rows: DataFrame, name: str) -> DataFrame:
    return _component(rows.groupBy("season_year", "team_id").agg(F.sum(result_points()).alias("points"), F.count_if(played()).alias("games_counted")), name)


def team_nonconference(sides: DataFrame) -> DataFrame:
    """Points of each team in games between conferences."""
    return _base(sides.where("is_nonconference = 1"), "nonconf_base")


def team_conference(sides: DataFrame) -> DataFrame:
    """Points of each team in games within its conference."""
    return _base(sides.where("is_nonconference = 0"), "conf_base")


def team_playoff(sides: DataFrame) -> DataFrame:
    """Points for taking part in the playoff, once a team, and for each playoff game."""
    games = sides.where("game_phase = 'cfp'").groupBy("season_year", "team_id").agg(F.count("*").alias("n"))
    once = games.select("season_year", "team_id", F.lit(PARTICIPATION).alias("points"), F.lit(1).cast("long").alias("games_counted"))
    each = games.select("season_year", "team_id", (F.col("n") * PLAYOFF_GAME).alias("points"), F.col("n").alias("games_counted"))
    return _component(once, "playoff_participation").unionByName(_component(each, "playoff_games"))


def team_components(sides: DataFrame) -> DataFrame:
    """All components of teams, one row each."""
    return team_nonconference(sides).unionByName(team_conference(sides)).unionByName(team_playoff(sides))


def conference_components(sides: DataFrame) -> DataFrame:
    """All components of conferences, one row each, from one aggregation.

    Base points count games between two known conferences, whether or not their scores are known; a conference that
    only played within itself has a row with no games.
    """
    known = F.col("is_nonconference") == 1
    in_playoff = F.col("game_phase") == "cfp"
    sums = sides.where("conference is not null").groupBy("season_year", "conference").agg(
        F.sum(F.when(known, result_points()).otherwise(0.0)).alias("points"),
        F.count_if(known).alias("games"),
        F.count_distinct(F.when(in_playoff, F.col("team_id"))).alias("participants"),
        F.count_if(in_playoff).alias("playoff_games"),
    )
    part = lambda name, points, games: F.struct(F.lit(name).alias("component"), points.alias("points"), games.alias("games_counted"))
    participants, playoff = F.col("participants"), F.col("playoff_games")
    rows = sums.select("season_year", "conference", "playoff_games", F.explode(F.array(
        part("nonconf_base", F.col("points"), F.col("games")),
        part("playoff_participation", participants * PARTICIPATION, participants),
        part("playoff_games", playoff * PLAYOFF_GAME, playoff),
    )).alias("c"))
    rows = rows.where((F.col("c.component") == "nonconf_base") | (F.col("playoff_games") > 0))
    return rows.select("season_year", "conference", "c.*", F.lit(VERSION).alias("formula_version"))


def by_season(components: DataFrame, key: str) -> DataFrame:
    """Totals of a season; conferences do not count participations as games, teams do."""
    counted = F.col("games_counted") if key == "team_id" else F.when(F.col("component") != "playoff_participation", F.col("games_counted")).otherwise(0)
    totals = components.groupBy("season_year", key, "formula_version").agg(F.sum("points").alias("total_points"), F.sum(counted).cast("long").alias("games_counted"))
    return totals.withColumn("points_per_game", ratio("total_points", "games_counted"))


def rolling(totals: DataFrame, key: str, window: int = 5) -> DataFrame:
    """Sums over the last `window` seasons for every season there is, also for those who are missing in that season.

    Every row is dealt to the seasons it counts for, so one aggregation does it; a frame would lose absent ones.
    """
    seasons = totals.select("season_year").distinct()
    dealt = totals.withColumn("season_year", F.explode(F.sequence(F.col("season_year"), F.col("season_year") + window - 1)))
    sums = dealt.join(F.broadcast(seasons), "season_year").groupBy("season_year", key, "formula_version").agg(
        F.sum("total_points").alias("total_points_5yr"), F.sum("games_counted").alias("games_counted_5yr"),
    )
    return sums.withColumns({
        "window_start_year": F.col("season_year") - (window - 1),
        "window_end_year": F.col("season_year"),
        "points_per_game_5yr": ratio("total_points_5yr", "games_counted_5yr"),
    })


def ranked(rows: DataFrame, name: str, *order, by: tuple[str, ...] = ("season_year",)) -> DataFrame:
    """rows with a gapless rank over `order` within `by`."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def conference_ranks(rolling_conferences: DataFrame) -> DataFrame:
    """conf_coe_rank by rolling points, then points per game, then name."""
    return ranked(rolling_conferences, "conf_coe_rank", F.desc("total_points_5yr"), F.desc("points_per_game_5yr"), "conference")


def season_ranks(totals: DataFrame, key: str) -> DataFrame:
    """coe_rank of a single season by points per game, then key."""
    return ranked(totals, "coe_rank", F.desc("points_per_game"), key)
