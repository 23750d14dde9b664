"""Points, guarded ratios and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points and weights of the formula.
WIN, OVERTIME_LOSS, PARTICIPATION, PLAYOFF_GAME = 2.0, 1.0, 6.0, 1.5
PHASE_WEIGHTS = {"regular": 1.0, "bowl": 2.0, "cfp": 3.0}
DECAY = 0.92


def played() -> Column:
    """Whether both scores of a side's row are known."""
    return F.col("points_for").isNotNull() & F.col("points_against").isNotNull()


def result_points() -> Column:
    """A win's or an overtime loss's points; nothing for other results or unknown scores."""
    won, lost = F.col("points_for") > F.col("points_against"), F.col("points_for") < F.col("points_against")
    return F.when(won, WIN).when((F.col("went_ot") == 1) & lost, OVERTIME_LOSS).otherwise(0.0)


def ratio(above: Column | str, below: Column | str) -> Column:
    """above / below, 0 where below is 0 or something is null."""
    above, below = (F.col(x) if isinstance(x, str) else x for x in (above, below))
    return F.coalesce(F.try_divide(above.cast("double"), below.cast("double")), F.lit(0.0))


def phase_weight(phase: Column) -> Column:
    """The weight of a game's phase; unknown phases weigh as a regular game."""
    name = F.lower(F.trim(F.coalesce(phase, F.lit("regular"))))
    weight = F.lit(1.0)
    for known, value in PHASE_WEIGHTS.items():
        weight = F.when(name == known, value).otherwise(weight)
    return weight
