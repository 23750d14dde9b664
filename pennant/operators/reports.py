"""Reports over the computed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def between_seasons(rows: DataFrame, year: int | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """One season, or those from start to end; each bound is optional."""
    for bound, test in ((year, "season_year = {}"), (start, "season_year >= {}"), (end, "season_year <= {}")):
        rows = rows if bound is None else rows.where(test.format(int(bound)))
    return rows


def like_names(rows: DataFrame, column: str, part: str, most: int = 8) -> DataFrame:
    """Names that contain `part`, whatever its case; the first few."""
    return rows.where(F.contains(F.lower(column), F.lit(part.lower()))).select(column).orderBy(column).limit(most)


def top(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows."""
    return rows.orderBy(*order).limit(n)


def seed_list(qualified: DataFrame, strength: DataFrame, teams: DataFrame) -> DataFrame:
    """Qualifiers by rolling points, then points per game, then name; the first eight have a bye."""
    from pennant.operators.coefficients import ranked

    rows = qualified.join(strength.select("season_year", "team_id", "total_points_5yr", "points_per_game_5yr"), ["season_year", "team_id"], "left").join(teams, "team_id")
    rows = rows.fillna(0.0, ["total_points_5yr", "points_per_game_5yr"])
    seeded = ranked(rows, "seed", F.desc("total_points_5yr"), F.desc("points_per_game_5yr"), "team_name")
    return seeded.select("season_year", "seed", "team_id", "team_name", "total_points_5yr", "points_per_game_5yr", (F.col("seed") <= 8).cast("int").alias("is_bye"))


def bids_snapshot(allocated: DataFrame) -> DataFrame:
    """Bids with a mark where they differ from the rank's own."""
    return allocated.withColumn("mark", F.when(F.col("bids") != F.col("base_bids"), "*").otherwise(""))


def field_flags(bid_type: Column, pot: Column) -> dict[str, Column]:
    """is_bye and is_champion of a field's row."""
    return {"is_bye": (pot == 0).cast("int"), "is_champion": (F.lower(bid_type) == "champion").cast("int")}


def field_view(field: DataFrame, teams: DataFrame, strength: DataFrame) -> DataFrame:
    """The field with names, flags and strength, byes first."""
    rows = field.join(teams, "team_id").join(strength.select("season_year", "team_id", "total_points_5yr"), ["season_year", "team_id"], "left")
    rows = rows.withColumns(field_flags(F.col("bid_type"), F.col("pot")))
    order = F.when(F.col("pot") == 0, 0).otherwise(1)
    return rows.withColumn("sort_group", order).select("season_year", "team_id", "team_name", "conference", "pot", "bid_type", "is_bye", "is_champion", "sort_group", "total_points_5yr")


def field_counts(field: DataFrame) -> DataFrame:
    """Byes, champions and teams of each season."""
    rows = field.withColumns(field_flags(F.col("bid_type"), F.col("pot")))
    return rows.groupBy("season_year").agg(F.sum("is_bye").alias("byes"), F.sum("is_champion").alias("champions"), F.count("*").alias("teams"))


def season_report(year: int, teams: DataFrame, standings: DataFrame, team_seasons: DataFrame, conference_seasons: DataFrame, field: DataFrame, best: int = 25, formula_version: str | None = None) -> dict[str, DataFrame]:
    """The four tables of a season in their order: standings, the best teams, conferences, the playoff field; of one
    formula version, where it is asked for and a table has versions."""
    version = lambda rows: rows if formula_version is None or "formula_version" not in rows.columns else rows.where(F.col("formula_version") == formula_version)
    of = lambda rows: between_seasons(version(rows), year=year)
    named = lambda rows: of(rows).drop("team_name").join(teams.select("team_id", "team_name"), "team_id")
    counts = [c for c in ("overall_wins", "overall_losses", "conf_wins", "conf_losses") if c in standings.columns]
    seen = [c for c in ("conference", "pot", "seed", "slot", "rank", "is_champion") if c in field.columns]
    return {
        "standings": named(standings).select("conference", "conf_rank", "team_name", *counts).orderBy("conference", "conf_rank", "team_name"),
        "teams": top(named(team_seasons), best, F.desc("points_per_game"), F.desc("total_points"), "team_name").select("team_name", "total_points", "games_counted", "points_per_game"),
        "conferences": of(conference_seasons).select("conference", "total_points", "points_per_game").orderBy(F.desc("points_per_game"), F.desc("total_points"), "conference"),
        "field": named(field).select("team_name", *seen).orderBy(*[c for c in ("seed", "pot", "conference") if c in seen], "team_name"),
    }


# Tables in the order they are looked for, and parts of the names of others like them.
TEAM_TABLES, CONFERENCE_TABLES = ["team_coefficient_by_year"], [
    "conference_coefficient_by_year", "conference_coefficient_rolling_5yr", "conference_coefficient_by_year_rolling_5yr", "conference_coefficient", "conference_ratings_by_year",
]


def find_table(tables: list[str], wanted: list[str], *parts: list[str]) -> str | None:
    """The first wanted name among the tables, else the first table that has one of each list of parts in its name."""
    exact = next((w for w in wanted if w in tables), None)
    return exact or (next((t for t in tables if all(any(x in t for x in some) for some in parts)), None) if parts else None)


def coefficient_tables(spark: SparkSession) -> tuple[str, str | None]:
    """The catalog's tables of team and conference coefficients; none for teams is an error."""
    tables = sorted(t.name for t in spark.catalog.listTables())
    team = find_table(tables, TEAM_TABLES, ["team_coefficient"])
    if team is None:
        raise ValueError("no table of team coefficients")
    return team, find_table(tables, CONFERENCE_TABLES, ["conference", "league"], ["coefficient", "coe", "rating"])


def table_columns(spark: SparkSession, table: str) -> list[str]:
    """The columns of a table of the catalog, none if there is no such table."""
    return spark.table(table).columns if spark.catalog.tableExists(table) else []


def section(title: str) -> str:
    """A title over a rule of its length."""
    return f"\n{title}\n{'=' * len(title)}"


def console(rows: DataFrame, most: int = 200, formats: dict[str, str] | None = None) -> str:
    """The first rows as a fixed-width table with a rule below its head; a last line tells of more rows.

    Null is nothing; floats have the format of their column (three places if none is given) without trailing zeros.
    """

    def text(column: str, value) -> str:
        if value is None or not isinstance(value, float):
            return "" if value is None else str(value)
        shown = format(value, (formats or {}).get(column, ".3f"))
        return shown.rstrip("0").rstrip(".") if "." in shown else shown

    columns = rows.columns
    read = [[text(c, v) for c, v in zip(columns, row, strict=True)] for row in rows.limit(most + 1).collect()]
    widths = [max(len(r[k]) for r in [columns, *read[:most]]) for k in range(len(columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)) for r in [columns, ["-" * w for w in widths], *read[:most]]]
    return "\n".join([*lines, f"... more than {most} rows"] if len(read) > most else lines)
