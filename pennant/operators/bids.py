"""Bids of conferences by rank, with exceptions, balanced to the size of the field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bids by rank of both rulesets, caps and names of the exceptions.
BIDS = {"year1": [4, 4, 4, 4, 3, 2, 1, 1, 1, 1], "year2": [4, 4, 4, 4, 3, 1, 1, 1, 1, 1]}
FIELD, CAP, INDEPENDENT_CAP = 24, 4, 2
INDEPENDENTS, PROTECTED = "FBS Independents", "Mid-American"


def bids_by_rank(rank: Column, ruleset: str = "year2") -> Column:
    """The ruleset's bids of a rank, 0 beyond its last."""
    return F.coalesce(F.get(F.array(*map(F.lit, BIDS[ruleset])), rank - 1), F.lit(0))


def with_exceptions(bids: Column, conference: Column, independents: str = INDEPENDENTS, protected: str = PROTECTED) -> Column:
    """At most two bids for independents, at least one for the protected conference."""
    return F.when(conference == independents, F.least(bids, F.lit(INDEPENDENT_CAP))).when(conference == protected, F.greatest(bids, F.lit(1))).otherwise(bids)


def allocate(ranks: DataFrame, ruleset: str = "year2", independents: str = INDEPENDENTS, protected: str = PROTECTED, field: int = FIELD) -> DataFrame:
    """base_bids, and bids after the exceptions and the balancing of each season to `field`.

    Too many: the last ranks give back all but one, the protected conference nothing. Too few: the first ranks fill up
    to their caps. Taking one at a time always empties one conference before the next, so running sums say it all.
    """
    base = bids_by_rank(F.col("conf_coe_rank"), ruleset)
    rows = ranks.select("season_year", "conference", "conf_coe_rank", base.alias("base_bids"), with_exceptions(base, F.col("conference"), independents, protected).alias("b"))
    season = Window.partitionBy("season_year")
    give = F.when((F.col("b") > 1) & (F.col("conference") != protected), F.col("b") - 1).otherwise(0)
    take = F.greatest(F.when(F.col("conference") == independents, INDEPENDENT_CAP).otherwise(CAP) - F.col("b"), F.lit(0))
    after = season.orderBy("conf_coe_rank").rowsBetween(1, Window.unboundedFollowing)
    before = season.orderBy("conf_coe_rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"total": F.sum("b").over(season), "give": give, "take": take})
    rows = rows.withColumns({"given": F.coalesce(F.sum("give").over(after), F.lit(0)), "taken": F.coalesce(F.sum("take").over(before), F.lit(0))})
    less = F.least(F.greatest(F.col("total") - field - F.col("given"), F.lit(0)), F.col("give"))
    more = F.least(F.greatest(field - F.col("total") - F.col("taken"), F.lit(0)), F.col("take"))
    return rows.select("season_year", "conference", "conf_coe_rank", "base_bids", (F.col("b") - less + more).cast("int").alias("bids"))


def qualifiers(allocated: DataFrame, standings: DataFrame) -> DataFrame:
    """The first teams of each conference, as many as it has bids; a conference without a first team has none."""
    rows = standings.join(allocated.where("bids > 0"), ["season_year", "conference"])
    rows = rows.withColumn("has_first", F.max(F.col("conf_rank") == 1).over(Window.partitionBy("season_year", "conference")))
    chosen = rows.where(F.col("has_first") & (F.col("conf_rank") <= F.col("bids")))
    return chosen.select("season_year", "conference", "team_id", "conf_rank", "conf_coe_rank", F.when(F.col("conf_rank") == 1, "champion").otherwise("at_large").alias("bid_type"))
