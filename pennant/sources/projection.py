"""The league's base tables as a projection of the driver's star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """team_id, team_name."""
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("team_id"), F.col("c_name").alias("team_name"))


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The season years that have games."""
    return _table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("season_year")).distinct()


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """team_id, season_year, conference; a segment of the teams has no conference and so no row."""
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("conference"))
    rows = _table(spark, sf_dir, "customer").where("c_mktsegment <> 'HOUSEHOLD'")
    rows = rows.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # a dimension of 25 rows
    return rows.crossJoin(F.broadcast(seasons(spark, sf_dir))).select(F.col("c_custkey").alias("team_id"), "season_year", "conference")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a game, with null scores for some."""
    count = teams(spark, sf_dir).agg(F.count("*").alias("n"))  # one row
    played = F.col("o_orderkey") % 97 != 0
    january = F.month("o_orderdate") == 1
    return _table(spark, sf_dir, "orders").crossJoin(F.broadcast(count)).select(
        F.col("o_orderkey").alias("game_id"),
        F.year("o_orderdate").alias("season_year"),
        F.to_date("o_orderdate").alias("game_date"),
        F.col("o_custkey").alias("home_team_id"),
        ((F.col("o_custkey") + 1 + F.col("o_orderkey") % (F.col("n") - 1)) % F.col("n")).alias("away_team_id"),
        F.when(played, F.floor("o_totalprice") % 50).cast("int").alias("home_score"),
        F.when(played, F.floor(F.col("o_totalprice") / 50) % 50).cast("int").alias("away_score"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("went_ot"),
        F.when(january & (F.col("o_orderpriority") == "1-URGENT"), "cfp").when(january, "bowl").otherwise("regular").alias("game_phase"),
    )
