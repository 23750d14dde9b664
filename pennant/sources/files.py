"""Readers of landed files: games and ratings as CSV, lines of text, payloads as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pennant.functions import parsing
from pennant.functions.text import team_key, trimmed

# Columns of the files, and spellings of the ratings' columns.
REQUIRED = ["season_year", "week", "date", "home_team", "away_team", "home_score", "away_score", "went_ot", "game_type", "game_phase"]
OPTIONAL = ["game_id", "neutral_site", "notes"]
RATING_NAMES = {"season_year": ["season_year", "year", "season"], "team_name": ["team_name", "team", "school"], "rating": ["rating", "score", "value", "team_rating"]}
RANKINGS = "season int, seasonType string, week int, polls array<struct<poll:string, ranks:array<struct<rank:int, school:string, team:string, name:string>>>>"
COUNTS = "struct<wins:int, losses:int, ties:int>"
RECORDS = f"year int, team string, conference string, conferenceGames {COUNTS}, total {COUNTS}"
TEAMS = "school string, conference string, classification string"
GAMES = (
    "id long, game_id long, gameId long, season int, week int, seasonType string, season_type string, startDate string, start_date string, "
    "homeTeam string, home_team string, awayTeam string, away_team string, homePoints int, home_points int, awayPoints int, away_points int, "
    "homeClassification string, home_classification string, awayClassification string, away_classification string, "
    "neutralSite string, neutral_site string, playoff string, is_playoff string, isPlayoff string, overtime string, overtimes string, notes string"
)
NORMALISED = "game_id season_year week date season_type home_team away_team home_score away_score went_ot game_type game_phase neutral_site notes".split()
SCHOOL_NAMES = ["school", "team", "name"]
#: Seasons (first and last) in which two of the top four make a playoff game.
TOP_FOUR_SEASONS = (2014, 2023)
COMMITTEE_POLLS = ["cfp", "college football playoff"]


def games_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the games file as strings, optional columns null where the file has none; missing columns are an error."""
    rows = spark.read.csv(path, header=True, mode="FAILFAST")
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"the games file lacks {', '.join(missing)}")
    return rows.select(*REQUIRED, *[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in OPTIONAL])


def pick_column(columns: list[str], wanted: list[str], contains: bool = False) -> str | None:
    """The first wanted name among columns, whatever its case; with `contains`, else the first column that has one in it."""
    lower = {c.lower(): c for c in reversed(columns)}
    exact = next((lower[w.lower()] for w in wanted if w.lower() in lower), None)
    return exact or (next((c for w in wanted for c in columns if w.lower() in c.lower()), None) if contains else None)


def clean_ratings(rows: DataFrame) -> DataFrame:
    """season_year, team_name, rating of rows under any spelling; malformed rows go, the last of a key stays.

    Rows are dealt by their key before they are sorted: most keys have one row, so sorting each task's own rows first
    would hold them all and leave none out.
    """
    names = {name: pick_column(rows.columns, spellings) for name, spellings in RATING_NAMES.items()}
    if None in names.values():
        raise ValueError(f"the ratings lack {', '.join(k for k, v in names.items() if v is None)}")
    typed = rows.select(
        F.col(names["season_year"]).try_cast("int").alias("season_year"), trimmed(F.col(names["team_name"])).alias("team_name"),
        F.col(names["rating"]).try_cast("double").alias("rating"), (F.col("_order") if "_order" in rows.columns else F.monotonically_increasing_id()).alias("k"),
    )
    sound = typed.where("season_year is not null and team_name <> '' and rating is not null").repartition("season_year", "team_name")
    last = F.row_number().over(Window.partitionBy("season_year", "team_name").orderBy(F.desc("k")))
    return sound.withColumn("last", last).where("last = 1").select("season_year", "team_name", "rating")


def ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """clean_ratings() of CSV files; of equal keys the last in the file stays, that of the last file by name. None is an error."""
    read = spark.read.csv(path, header=True)
    # the place of a row's split in its file, then the row's number within the split
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    rows = clean_ratings(read.withColumn("_order", order))
    if rows.isEmpty():
        raise ValueError("the ratings have no sound row")
    return rows


def names_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not blank, trimmed."""
    return spark.read.text(path).select(trimmed(F.col("value")).alias("name")).where("name <> ''")


def payload_json(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Landed JSON payloads (arrays of objects) under one of the schemas above; broken files are left out, see landed_json()."""
    return landed_json(spark, paths, schema)[0].drop("file", "year")


def landed_json(spark: SparkSession, paths: list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken) of landed answers, each file one JSON array of objects, or one object.

    rows: the schema's columns, file, and year: the last number from 1900 to 2099 that stands alone in the file's path, as
    in teams_2014.json or year=2014/teams.json; null if there is none. Under GAMES they also have over_time, the value of
    overTime, which Spark's names do not tell from overtime. broken: file and text of the files that are no JSON of that
    form. A file is one answer of the API and is read as one row first.
    """
    text = F.trim("value")
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").where(text != "")
    listed = F.when(F.startswith(text, F.lit("[")), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    parsed = whole.withColumn("objects", F.from_json(listed, f"array<struct<{_typed(schema)}>>", {"mode": "PERMISSIVE"}))
    other = F.from_json(listed, "array<struct<overTime:string>>") if schema == GAMES else F.col("objects")
    good = F.col("objects").isNotNull() & ~F.exists("objects", lambda x: x.isNull())
    year = F.regexp_extract("file", r"^.*(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1).try_cast("int")
    rows = parsed.where(good).select("file", year.alias("year"), F.explode(F.arrays_zip(F.col("objects").alias("g"), other.alias("o"))).alias("x"))
    own = [F.col(f"x.g.{c}").alias(c) for c in parsed.schema["objects"].dataType.elementType.names if c != "year"]
    more = [F.col("x.o.overTime").alias("over_time")] if schema == GAMES else []
    year = F.coalesce(F.col("x.g.year"), F.col("year")).alias("year") if "year" in parsed.schema["objects"].dataType.elementType.names else F.col("year")
    return rows.select(*own, *more, "file", year), parsed.where(~F.coalesce(good, F.lit(False))).select("file", F.col("value").alias("text"))


def _typed(schema: str) -> str:
    """The fields of a schema string in the form they have within a struct."""
    return StructType.fromDDL(schema).simpleString().removeprefix("struct<").removesuffix(">")


def fbs_members(landed: DataFrame, teams: DataFrame) -> DataFrame:
    """team_id, season_year, conference, is_fbs of landed teams (TEAMS with year): the top division's, known by name, once a year.

    Of several answers for a team and year the conference that sorts first stays; those without a year, a school or a
    conference go.
    """
    rows = landed.where("year is not null and school <> '' and conference <> '' and lower(classification) = 'fbs'")
    rows = rows.join(teams.select("team_id", F.col("team_name").alias("school")), "school")
    return rows.groupBy("team_id", F.col("year").alias("season_year")).agg(F.min("conference").alias("conference")).withColumn("is_fbs", F.lit(1))


def top_four(rankings: DataFrame, first_week: int = 10, last_week: int = 16) -> DataFrame:
    """season, team (its team_key()) of the last week of the regular season whose playoff poll has ranks 1-4.

    The first of a week's polls counts that is by name the playoff committee's and has just four such ranks with a school.
    """
    weeks = rankings.where(F.col("week").between(first_week, last_week) & (F.coalesce("seasonType", F.lit("regular")) == "regular"))
    polls = weeks.select("season", "week", F.posexplode("polls").alias("at", "p"))
    name = F.lower(F.trim(F.coalesce("p.poll", F.lit(""))))
    polls = polls.where((F.contains(name, F.lit("playoff")) & F.contains(name, F.lit("committee"))) | name.isin(COMMITTEE_POLLS))
    given = [c for c in SCHOOL_NAMES if c in rankings.schema["polls"].dataType.elementType["ranks"].dataType.elementType.names]
    schools = F.transform("p.ranks", lambda r: F.struct(r["rank"].alias("rank"), F.coalesce(*[r[c] for c in given]).alias("school")))
    ranked = F.filter(schools, lambda r: r["rank"].between(1, 4) & (r["school"] != ""))
    found = polls.select("season", "week", "at", ranked.alias("r")).where(F.size("r") == 4)
    last = found.groupBy("season").agg(F.max_by("r", F.struct("week", -F.col("at"))).alias("r"))
    return last.select("season", F.explode("r.school").alias("school")).select("season", team_key(F.col("school")).alias("team")).distinct()


def api_games(payload: DataFrame, best: DataFrame, best_seasons: tuple[int, int] = TOP_FOUR_SEASONS, refused: bool = False) -> DataFrame:
    """NORMALISED columns of a payload's games (GAMES, or any of its columns), with the playoff rules of top_four() `best`.

    Regular season and postseason may be given together. Games of lower divisions go, and so do those without both
    teams and both scores. The top four only make playoff games in the seasons from the first to the last of best_seasons.
    Games whose date is no date are set aside: they are returned instead of the others, without a date, if `refused`.
    """

    def first(*spellings: str) -> Column:
        found = [F.col(c) for c in spellings if c in payload.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    flag = lambda *spellings: parsing.flag_from_api(first(*spellings))
    rows = payload.where(parsing.is_top_division(first("homeClassification", "home_classification"), first("awayClassification", "away_classification"), first("notes")))
    rows = rows.select(
        first("id", "game_id", "gameId").cast("long").alias("game_id"), F.col("season").alias("season_year"), F.coalesce(first("week").cast("string"), F.lit("")).alias("week"),
        parsing.game_date(first("start_date", "startDate")).cast("string").alias("date"), parsing.season_part(first("season_type", "seasonType")).alias("season_type"),
        first("home_team", "homeTeam").alias("home_team"), first("away_team", "awayTeam").alias("away_team"),
        first("home_points", "homePoints").cast("int").alias("home_score"), first("away_points", "awayPoints").cast("int").alias("away_score"),
        flag("overtime", "overtimes", "over_time").alias("went_ot"), flag("neutral_site", "neutralSite").alias("neutral_site"), F.coalesce(first("notes"), F.lit("")).alias("notes"),
        (flag("playoff", "is_playoff", "isPlayoff") == 1).alias("flagged"),
    ).where("home_team is not null and away_team is not null and home_score is not null and away_score is not null")
    rows = rows.where(F.col("date").isNull() if refused else F.col("date").isNotNull())
    teams = best.groupBy("season").agg(F.collect_set("team").alias("best"))  # four a season
    rows = rows.join(F.broadcast(teams), rows["season_year"] == teams["season"], "left")
    in_best = lambda c: F.col("season_year").between(*best_seasons) & F.array_contains("best", F.lower(F.trim(F.col(c))))
    rows = rows.withColumn("game_type", parsing.game_type(F.col("season_type"), F.col("flagged"), F.col("notes"), in_best("home_team") & in_best("away_team")))
    return rows.withColumn("game_phase", parsing.game_phase(F.col("season_type"), F.col("game_type"))).select(*NORMALISED)


def filtered_or_all(filtered: DataFrame, everything: DataFrame) -> DataFrame:
    """The answer to a filtered call, or that to the unfiltered one if the first has no rows; none at all is an error."""
    for rows in (filtered, everything):
        if not rows.isEmpty():
            return rows
    raise ValueError("no records were returned")


def flat_records(records: DataFrame) -> DataFrame:
    """Wins, losses and ties out of nested records, 0 where missing."""
    part = lambda group, name, to: F.coalesce(F.col(f"{group}.{name}"), F.lit(0)).alias(f"{to}_{name}")
    return records.select("year", "team", "conference", *[part(g, n, to) for g, to in (("conferenceGames", "conf"), ("total", "overall")) for n in ("wins", "losses", "ties")])
