"""Games with their conferences and outcomes, and one row for each side of a game."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pennant.functions import parsing
from pennant.operators import names


def enrich(games: DataFrame, membership: DataFrame) -> DataFrame:
    """games with home_conference, away_conference, is_nonconference, winner, home_ot_loss and away_ot_loss.

    The membership of all seasons is small beside the games, but it is left to Spark whether to broadcast it.
    """
    side = lambda s: membership.select(F.col("team_id").alias(f"{s}_team_id"), "season_year", F.col("conference").alias(f"{s}_conference"))
    rows = games.join(side("home"), ["home_team_id", "season_year"], "left").join(side("away"), ["away_team_id", "season_year"], "left")
    home, away = F.col("home_score"), F.col("away_score")
    return rows.withColumns({
        "is_nonconference": (F.col("home_conference") != F.col("away_conference")).cast("int"),
        "winner": F.when(home > away, "home").when(away > home, "away").when(home == away, "tie"),
        "home_ot_loss": F.when(home.isNotNull() & away.isNotNull(), ((F.col("went_ot") == 1) & (home < away)).cast("int")),
        "away_ot_loss": F.when(home.isNotNull() & away.isNotNull(), ((F.col("went_ot") == 1) & (away < home)).cast("int")),
    })


def sides(enriched: DataFrame) -> DataFrame:
    """One row for each side of a game: team and opponent, their conferences, scores and the game's flags; one scan."""

    def side(me: str, other: str):
        return F.struct(
            F.lit(me).alias("side"),
            F.col(f"{me}_team_id").alias("team_id"), F.col(f"{other}_team_id").alias("opponent_id"),
            F.col(f"{me}_conference").alias("conference"), F.col(f"{other}_conference").alias("opponent_conference"),
            F.col(f"{me}_score").alias("points_for"), F.col(f"{other}_score").alias("points_against"),
        )

    both = enriched.select("season_year", "game_id", "went_ot", "game_phase", "is_nonconference", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s"))
    return both.select("season_year", "game_id", "went_ot", "game_phase", "is_nonconference", "s.*")


def load(rows: DataFrame, teams: DataFrame, aliases: DataFrame, existing: DataFrame) -> DataFrame:
    """Typed rows of the games file (strings) with `disposition`: inserted, repeated, unknown team, or what is wrong.

    A row is repeated if its game_id is in `existing` or came before in the order of (date, home, away); rows without a
    game_id are never repeated.
    """
    flag = lambda c: parsing.flag_from_text(F.col(c)).alias(c)
    part = lambda c: F.lower(F.trim(F.col(c))).alias(c)
    number = lambda c: F.col(c).try_cast("int").alias(c)
    typed = rows.select(
        F.col("game_id").try_cast("long").alias("game_id"), number("season_year"), parsing.week_number(F.col("week")).alias("week"), F.col("date").try_cast("date").alias("game_date"),
        "home_team", "away_team", number("home_score"), number("away_score"), flag("went_ot"), flag("neutral_site"), part("game_type"), part("game_phase"),
        F.nullif(F.trim(F.col("notes")), F.lit("")).alias("game_phase_check"),
    )
    for side in ("home", "away"):
        named = names.resolve(typed.withColumnRenamed(f"{side}_team", "name"), teams, aliases)
        typed = named.withColumnsRenamed({"name": f"{side}_team", "team_id": f"{side}_team_id"})
    fault = parsing.row_fault(F.col("game_type"), F.col("game_phase"), F.col("went_ot"), F.col("neutral_site"), week=F.col("week"))
    fault = F.coalesce(fault, F.when(F.col("season_year").isNull() | F.col("game_date").isNull() | F.col("home_score").isNull() | F.col("away_score").isNull(), "number or date"))
    unknown = F.col("home_team_id").isNull() | F.col("away_team_id").isNull()
    judged = typed.withColumn("disposition", F.coalesce(fault, F.when(unknown, "unknown team")))
    # rows that are set aside do not make later ones repeated
    order = Window.partitionBy("game_id", F.col("disposition").isNull()).orderBy("game_date", "home_team_id", "away_team_id")
    judged = judged.join(existing.select("game_id", F.lit(True).alias("known")).distinct(), "game_id", "left").withColumn("k", F.row_number().over(order))
    again = F.col("game_id").isNotNull() & (F.col("known") | (F.col("k") > 1))
    return judged.withColumn("disposition", F.coalesce("disposition", F.when(again, "repeated"), F.lit("inserted"))).drop("known", "k")


def load_counts(loaded: DataFrame) -> DataFrame:
    """Rows of each disposition."""
    return loaded.groupBy("disposition").agg(F.count("*").alias("n"))
