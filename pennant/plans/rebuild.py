"""The derived tables as stored partitions: what hangs on a changed season, and writing just that anew."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pennant.operators import store
from pennant.plans.queries import League


@dataclass(frozen=True)
class Derived:
    """A table of the League that is kept in partitions of `key`; a season's rows hang on the `back` seasons before it."""

    key: tuple[str, ...] = ("season_year", "formula_version")
    back: int = 0
    season: str = "season_year"


#: Every stored table, by its name in the League. Rolling tables and what is chosen by them look four seasons back.
CATALOGUE: dict[str, Derived] = {
    "team_parts": Derived(("season_year", "formula_version", "component")),
    "conf_parts": Derived(("season_year", "formula_version", "component")),
    "team_seasons": Derived(),
    "conf_seasons": Derived(),
    "team_rolling": Derived(back=4),
    "conf_rolling": Derived(back=4),
    "records": Derived(("season_year",)),
    "standings": Derived(("season_year",)),
    "bids2": Derived(("season_year",), back=4),
    "qualified2": Derived(("season_year",), back=4),
    "balanced": Derived(("season_year",), back=4),
    "bracket": Derived(("season_year",), back=4),
    "pairs": Derived(("season_year",), back=4),
    "ratings": Derived(("season_year",)),
}


def touched(changed: Iterable[int], table: str, known: Iterable[int]) -> list[int]:
    """The seasons of a table that hang on the changed ones: each of them and, among the known ones, those that look back on it."""
    back = CATALOGUE[table].back
    return sorted({s for s in {*known, *changed} for c in changed if c <= s <= c + back})


def save(league: League, root: str, changed: Iterable[int] | None = None, tables: Iterable[str] | None = None, dry_run: bool = False) -> DataFrame:
    """Write the tables under root, one folder each: all seasons, or those that the changed ones touch; (table, season_year, n).

    A season's rows replace what was stored of it, in all its partitions, also where none are left; other partitions are
    not written. Only the games of the seasons that count are read. n is the number of rows of each season touched. A dry
    run returns the same and writes nothing.
    """
    spark = league.spark
    known = [r["season_year"] for r in league.seasons.collect()]  # one row a season
    done = []
    for name in tables or CATALOGUE:
        kind = CATALOGUE[name]
        seasons = sorted(known) if changed is None else touched(list(changed), name, known)
        if not seasons:
            continue
        source = League(spark, league.sf_dir)
        source.games = league.games.where(F.col("season_year").between(min(seasons) - kind.back, max(seasons)))
        # a rolling window looks at seasons, so those outside the read games must not be targets
        rows = getattr(source, name).where(F.col("season_year").isin(seasons))
        rows = store.settled(rows)
        asked = spark.createDataFrame([(s,) for s in seasons], "season_year int")
        if not dry_run:
            path = f"{root.rstrip('/')}/{name}"
            system, target = store.files_of(spark, path)
            stored = spark.read.parquet(path).select(*kind.key).distinct().join(asked, "season_year") if system.exists(target) else None
            store.replace_partitions(rows, path, list(kind.key), stored)
        counts = rows.groupBy("season_year").agg(F.count("*").alias("n"))
        done.append(asked.join(counts, "season_year", "left").select(F.lit(name).alias("table"), "season_year", F.coalesce("n", F.lit(0)).alias("n")))
    out = done[0] if done else spark.createDataFrame([], "table string, season_year int, n long")
    for more in done[1:]:
        out = out.unionByName(more)
    return out
