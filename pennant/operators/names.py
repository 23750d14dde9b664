"""Resolving raw names to teams, conferences by season, and suggestions for unknown names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pennant.functions.text import HIGH, MEDIUM, OVERLAP_WEIGHT, SEQUENCE_WEIGHT, SORTED_WEIGHT, confidence, loose_key, similarity, trimmed
from pennant.operators.store import settled

# The score a name of up to four characters needs, and the length from which a word must be the team's too.
SHORT_SCORE, SHORT_NAME, LONG_WORD = 0.95, 4, 4
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: A word of at most so many teams is rare: all teams that have it are compared with the names that have it.
RARE_TEAMS = 64
#: Numbers of groups of letters that keys are made for; names that differ more often meet by length alone.
GROUPS = (1, 2, 3, 5, 8, 13, 20, 37)
#: The bounds of the search after the first.
FALLING = (0.75, 0.6, 0.45, 0.3, 0.15)
#: Room for rounding in bounds.
SLACK = 1e-9


def resolve(names: DataFrame, teams: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (name) with team_id: the team of that name, else the alias's team, else null."""
    raw = names.withColumn("key", trimmed(F.col("name")))
    direct = teams.select(F.col("team_name").alias("key"), F.col("team_id").alias("own"))
    meant = aliases.join(teams, "team_name").select(F.col("alias").alias("key"), F.col("team_id").alias("by_alias"))
    return raw.join(direct, "key", "left").join(meant, "key", "left").select(*names.columns, F.coalesce("own", "by_alias").alias("team_id"))


def canonical(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (name) with the alias's team name first, else the name itself."""
    known = aliases.select(trimmed(F.col("alias")).alias("key"), F.col("team_name").alias("meant"))
    return names.withColumn("key", trimmed(F.col("name"))).join(known, "key", "left").select(*names.columns, F.coalesce("meant", "key").alias("team_name"))


def conference_map(members: DataFrame, alignment: DataFrame, seasons: DataFrame) -> DataFrame:
    """The season's members first; teams without one by their latest alignment from before or in the season.

    Members count if their conference is not blank and, where there is an is_fbs, it is 1 or null; alignments if theirs is
    not blank. Conferences come trimmed.

    An as-of join: an alignment (of one team and year, that whose conference sorts last) holds until the team's next one,
    and stands for the seasons of that stretch; no alignment is compared with a season that it does not hold in.
    Alignments without a team, a year or a conference, and seasons without a year, meet nothing.
    """
    known = alignment.where("team_id is not null and effective_year_start is not null and trim(conference_name) <> ''")
    turns = known.groupBy("team_id", F.col("effective_year_start").alias("year")).agg(F.max(F.trim("conference_name")).alias("conference"))
    span = seasons.agg(F.min("season_year").alias("first"), F.max("season_year").alias("last")).first()
    until = F.lead("year").over(Window.partitionBy("team_id").orderBy("year")) - 1
    held = turns.withColumns({"from": F.greatest("year", F.lit(span["first"])), "to": F.least(until, F.lit(span["last"]))}).where(F.col("from") <= F.col("to"))
    dated = held.select(F.explode(F.sequence(F.col("from").cast("int"), F.col("to").cast("int"))).alias("season_year"), "team_id", "conference")
    latest = dated.join(F.broadcast(seasons.select("season_year").distinct()), "season_year", "left_semi")  # few; a shuffle would deal by season
    top = members.where("coalesce(is_fbs, 1) = 1") if "is_fbs" in members.columns else members
    # dealt by key first: members seldom repeat, so each task would hold all its rows to find that none is the same
    dealt = top.where("trim(conference) <> ''").select("season_year", "team_id", F.trim("conference").alias("conference")).repartition("season_year", "team_id")
    return dealt.distinct().unionByName(latest.join(dealt, ["season_year", "team_id"], "left_anti"))


def unknown(names: DataFrame, teams: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct names that are neither a team nor an alias nor an alias's team."""
    known = teams.select(F.col("team_name").alias("name")).union(aliases.select("alias")).union(aliases.select("team_name"))
    return names.select(trimmed(F.col("name")).alias("name")).where("name <> ''").distinct().join(known, "name", "left_anti")


def _letters(key: str) -> Column:
    """How often each of the characters that a loose key can have stands in the column `key`."""
    return F.expr(f"array({', '.join(f"length({key}) - length(replace({key}, '{c}', ''))" for c in LETTERS)})")


def _words(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, " "), lambda w: w != ""))


def _spread(teams: DataFrame) -> list[int]:
    """The letters' places, those whose counts differ most between teams first; one row reaches the driver."""
    row = teams.agg(F.expr(f"array({', '.join(f'coalesce(variance(get(cb, {i})), 0)' for i in range(len(LETTERS)))})").alias("v")).first()
    return sorted(range(len(LETTERS)), key=lambda i: (-row["v"][i], i))


def _groups(counts: str, length: str, order: list[int], n: int) -> Column:
    """A key for each of n groups of letters: the group's counts and the whole length. With n = 0, of the length alone.

    Letters are dealt to the groups in turn, so that each group has its share of those that tell names apart.
    """
    if n == 0:
        return F.expr(f"array(xxhash64(-1, {length}))")
    keys = [f"xxhash64({n}, {g}, {length}, {', '.join(f'get({counts}, {i})' for i in order[g::n])})" for g in range(n)]
    return F.expr(f"array({', '.join(keys)})")


def _within(asked: DataFrame, teams: DataFrame, order: list[int], lengths: tuple[int, int]) -> DataFrame:
    """alias, a and a team's columns for all pairs whose letters differ little enough for the score `floor` of asked.

    The matched share of two strings is at most twice the letters they have in common over all letters, that is
    1 - d / (la + lb) for letters that differ d times, and a team has at most the share `most_overlap` of the words.
    If d differences fall on more than d groups of letters, one group has none: pairs meet by an equi-join on it.
    """
    # a score above zero needs a letter in common, so the share is never quite zero
    share = F.greatest((F.col("floor") - SLACK - OVERLAP_WEIGHT * F.col("most_overlap")) / (SEQUENCE_WEIGHT + SORTED_WEIGHT), F.lit(SLACK))
    # d is at least the difference of the lengths
    low = F.greatest(F.ceil(F.col("la") * share / (2 - share) - SLACK), F.lit(lengths[0])).cast("int")
    high = F.least(F.floor(F.col("la") * (2 - share) / share + SLACK), F.lit(lengths[1])).cast("int")
    dealt = asked.withColumns({"low": low, "high": high, "share": share}).where("low <= high").withColumn("lb", F.explode(F.sequence("low", "high")))
    dealt = dealt.withColumn("most", F.floor((F.col("la") + F.col("lb")) * (1 - F.col("share")) + SLACK).cast("int")).where(F.abs(F.col("la") - F.col("lb")) <= F.col("most"))
    enough = F.coalesce(*[F.when(F.col("most") < n, n) for n in GROUPS], F.lit(0))
    dealt = settled(dealt.select("alias", "a", "ca", "lb", "most", enough.alias("groups")))
    used = sorted(r["groups"] for r in dealt.select("groups").distinct().collect())  # at most as many as GROUPS and one
    if not used:
        return asked.sparkSession.createDataFrame([], f"alias string, a string, team_id {dict(teams.dtypes)['team_id']}, team_name string, b string")
    keyed = dealt.withColumn("key", F.explode(F.coalesce(*[F.when(F.col("groups") == n, _groups("ca", "lb", order, n)) for n in used])))
    posted = teams.withColumn("key", F.explode(F.concat(*[_groups("cb", "length(b)", order, n) for n in used])))
    apart = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.abs(x - y)), F.lit(0), lambda total, x: total + x)
    met = keyed.join(posted, "key").where((F.length("b") == F.col("lb")) & (apart <= F.col("most")))
    return met.select("alias", "a", "team_id", "team_name", "b").dropDuplicates(["alias", "team_id"])  # few; one may meet in several groups


def best_teams(names: DataFrame, teams: DataFrame, least: float = 0.0) -> DataFrame:
    """alias, a (its loose key), team_name, b, score: the best team of each of names (alias, a), the first by team_id of
    equal ones. Names whose best score is below `least` may come with a null team; with 0, all have their best.

    A search by falling bounds, without comparing all pairs. First each name meets the teams that share one of its rare
    words. What any other team can score is bounded by its letters and by the common words, see _within(); a round looks up
    the teams that can still reach the name's best score or the round's bound, whichever is higher, and settles the names
    that have such a best. The bounds fall from `least` (or the threshold) on, so that names with a near team never look
    at far ones; only names like no team at all meet many.
    """
    keyed = teams.select("team_id", "team_name", loose_key(F.col("team_name")).alias("b"))
    teams = settled(keyed.where("b <> ''").withColumn("cb", _letters("b")))
    first = keyed.agg(F.min_by(F.struct("team_name", "b"), F.col("team_id")).alias("first")).first()["first"]  # one row
    bounds = teams.agg(F.min(F.length("b")).alias("low"), F.max(F.length("b")).alias("high")).first()
    words = names.where("a <> ''").select("alias", "a", F.explode(_words(F.col("a"))).alias("word"))
    in_teams = teams.select("team_id", F.explode(_words(F.col("b"))).alias("word"))
    held = in_teams.groupBy("word").agg(F.count("*").alias("n"))
    rare, common = held.where(F.col("n") <= RARE_TEAMS).select("word"), held.where(F.col("n") > RARE_TEAMS).select("word")
    shared = words.join(common, "word", "left_semi").groupBy("alias").agg(F.count("*").alias("common"))
    near = words.join(in_teams.join(rare, "word", "left_semi"), "word").select("alias", "a", "team_id").distinct().join(teams.drop("cb"), "team_id")
    columns = ["alias", "team_id", "team_name", "b", "score"]
    scored = lambda pairs: pairs.withColumn("score", similarity(F.col("a"), F.col("b"))).select(columns)

    def best_of(rows: DataFrame) -> DataFrame:
        return settled(rows.groupBy("alias").agg(F.max_by(F.struct("team_id", "team_name", "b", "score"), F.struct("score", -F.col("team_id"))).alias("t")).select("alias", "t.*"))

    best = best_of(scored(near))
    size = F.size(_words(F.col("a")))
    open_names = names.where("a <> ''").join(shared, "alias", "left").select("alias", "a", _letters("a").alias("ca"), F.length("a").alias("la"), F.try_divide(F.coalesce("common", F.lit(0)).cast("double"), size).alias("most_overlap"))
    open_names = settled(open_names)
    order = _spread(teams)
    start = least or MEDIUM
    for level in [] if bounds["low"] is None else [start, *[x for x in FALLING if least < x < start], *([] if least else [0.0])]:
        asked = open_names.join(best.select("alias", "score"), "alias", "left").withColumn("floor", F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(level), F.lit(2 * SLACK)))
        best = best_of(best.unionByName(scored(_within(asked, teams, order, (bounds["low"], bounds["high"])))))
        open_names = settled(open_names.join(best.where(F.col("score") >= level).select("alias"), "alias", "left_anti"))
        if open_names.isEmpty():
            break
    # a name that shares no letter with any team has the first one
    rows = names.select("alias", "a").join(best.drop("team_id"), "alias", "left")
    if least:
        return rows
    if first is None:
        return rows
    return rows.select("alias", "a", *[F.coalesce(c, F.when(F.col("score").isNull(), first[c])).alias(c) for c in ("team_name", "b")], F.coalesce("score", F.lit(0.0)).alias("score"))


def suggest(
    names: DataFrame, teams: DataFrame, aliases: DataFrame | None = None, manual: dict[str, str] | None = None, threshold: float = MEDIUM, explain: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(matches, skipped) for unknown names (name), each name once.

    matches: alias, team_name, score, confidence, reason, order by in_order(). A manual entry wins, under its own or its
    loose key; else it is the best team, see best_teams(), unless it is suspicious or below the threshold.

    skipped: alias, reason, team_name, score, missing. The reason is the first that holds: it is an alias already, there
    are no teams, the name is too short for such a score, long words of it (missing, sorted) are not the team's, the score
    is too low. team_name and score are those of the best team. With explain=False the search ends at the threshold, and
    weaker names have the reason of a low score without a team.
    """
    keyed = names.select(F.col("name").alias("alias")).distinct().select("alias", loose_key(F.col("alias")).alias("a"))
    if aliases is None:
        aliases = names.select(F.col("name").alias("alias")).limit(0)
    known = keyed.join(aliases.select("alias").distinct(), "alias", "left_semi")
    rest = keyed.join(aliases.select("alias").distinct(), "alias", "left_anti")
    exact, loose = F.lit(None).cast("string"), F.lit(None).cast("string")
    for alias, team in (manual or {}).items():
        exact = F.when(F.col("alias") == alias, team).otherwise(exact)
        loose = F.when(F.col("a") == loose_key(F.lit(alias)), team).otherwise(loose)
    rest = rest.withColumns({"exact": exact, "loose": loose})
    given = rest.where("exact is not null or loose is not null").select(
        "alias", F.coalesce("exact", "loose").alias("team_name"), F.lit(1.0).alias("score"), F.lit("HIGH").alias("confidence"),
        F.when(F.col("exact").isNotNull(), "manual override (exact key)").otherwise("manual override (normalized key)").alias("reason"),
    )
    best = best_teams(settled(rest.where("exact is null and loose is null").select("alias", "a")), teams, 0.0 if explain else threshold)
    missing = F.array_sort(F.filter(_words(F.col("a")), lambda w: (F.length(w) >= LONG_WORD) & ~F.array_contains(_words(F.col("b")), w)))
    weak = (
        F.when(F.col("team_name").isNull(), "no teams to compare" if explain else "score below the threshold")
        .when((F.length("a") <= SHORT_NAME) & (F.col("score") < SHORT_SCORE), "alias too short for non-exact match")
        .when((F.size("missing") > 0) & (F.col("score") < HIGH), "missing token")
        .when(F.col("score") < threshold, "score below the threshold")
    )
    judged = best.withColumn("missing", missing).withColumn("weak", weak)
    found = judged.where("weak is null").select("alias", "team_name", "score", confidence(F.col("score")).alias("confidence"), F.lit("fuzzy match").alias("reason"))
    skipped = judged.where("weak is not null").select("alias", F.col("weak").alias("reason"), "team_name", "score", F.when(F.col("weak") == "missing token", F.col("missing")).alias("missing"))
    already = known.select("alias", F.lit("already in team_aliases").alias("reason"), F.lit(None).cast("string").alias("team_name"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("array<string>").alias("missing"))
    return given.unionByName(found), already.unionByName(skipped)


def in_order(matches: DataFrame) -> DataFrame:
    """Matches as they are listed: HIGH ones first, then by falling score and name."""
    return matches.orderBy(F.col("confidence") != "HIGH", F.desc("score"), "alias")
