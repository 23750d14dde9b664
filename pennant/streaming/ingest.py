"""Games that arrive as files: each batch is checked, appended once a game, and its seasons' coefficients are replaced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pennant.operators.store import Stored, settled

GAMES = "game_id long, season_year int, game_date date, home_team_id long, away_team_id long, home_score int, away_score int, went_ot int, game_phase string"


def game_stream(spark: SparkSession, path: str, late: str = "7 days") -> DataFrame:
    """Games from JSON files as they arrive, each game_id once within the time that rows may be late."""
    rows = spark.readStream.schema(GAMES).json(path)
    timed = rows.withColumn("event_time", F.col("game_date").cast("timestamp")).withWatermark("event_time", late)
    return timed.dropDuplicatesWithinWatermark(["game_id"])


def keep_up(stream: DataFrame, table: str, checkpoint: str, refresh: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Add each batch's games to the stored table at `table`, see Stored; games that it has are left out.

    So a batch that is tried again, and a game that comes again after any time, change nothing. Of a batch's rows with one
    game_id the first by date stays; rows without a game_id come in as often as they are given, but once for a batch that
    is tried again after it was stored. refresh(games) recomputes what hangs on the seasons of the new games; it is called
    after they are stored, and again if it failed, so it must bear repetition.
    """

    def write(batch: DataFrame, number: int) -> None:
        stored = Stored(batch.sparkSession, table, f"{GAMES}, batch long")
        last = stored.read().agg(F.max("batch")).first()[0]
        # read whole once, so that the stream's state is kept also where nothing is stored
        rows = settled(batch.drop("event_time").withColumn("batch", F.lit(number).cast("long")))
        if last is None or last < number:
            stored.append_keep_first(rows, ["game_id"], "game_date")
        if refresh is not None:
            refresh(stored.read().where(F.col("batch") == number).drop("batch"))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
