"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its distinct five-word shingles, or its whole word sequence if it has fewer words; lines with equal
token sets are one class. Two lines with a Jaccard similarity of 0.75 share COMMON tokens among the first quarter of
their tokens and COMMON - 1 more, in any one order. In the order of the hashes this is asked of all lines first, which
leaves out those that resemble no other. The tokens of the others are ordered by rarity (the count of the token's bucket
in a table of bounded size, then the hash); tokens in the prefixes of two classes propose pairs, the length and position
filters drop those that cannot be similar enough, and full sets verify the rest. A class is first held against the
earliest classes of its tokens; only a class that these do not settle, and that has a token with more classes before it,
is held against all earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pennant.llm.common import drop, id_in, small, written

#: Matches a line with a word.
WORD = r"[^ \t\n\x0B\f\r]"
#: Blanks that part words beside the space.
BLANKS = ["\t", "\x0b", "\f", "\r"]
#: Buckets of the rarity table, and the earliest classes of each of its tokens that a class is held against first.
BUCKETS, FIRST = 1 << 16, 8
#: Tokens that the prefixes of two similar sets have in common at least, or all that must be common if that is less.
COMMON = 3
#: Rows of a few numbers (40 bytes at most) that are broadcast at most; more are shuffled.
NARROW_ROWS = 1_000_000


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, h (the text's hash), pos and line of each line, in lower case and with spaces for all blanks.

    The outer form of explode gives the same rows, as no text is without a line; before the plain one Spark puts a filter
    on the list's size, for which each text would be lowered and split once more.
    """
    read = docs.select(id_in(), F.coalesce("text", F.lit("")).alias("text"))
    read = read.select("doc_id", F.xxhash64("text").alias("h"), F.lower("text").alias("text"))
    other = F.lit(False)
    for blank in BLANKS:
        other = other | F.contains("text", F.lit(blank))
    plain = F.when(other, F.regexp_replace("text", r"[\t\x0B\f\r]", " ")).otherwise(F.col("text"))
    return read.select("doc_id", "h", F.posexplode_outer(F.split(plain, "\n", -1)).alias("pos", "line"))


def _tokens(each: DataFrame, names: list[str]) -> DataFrame:
    """The columns named and the tokens of `line`, null without a word.

    A filter on what is computed here would make Spark compute it twice, so there is none.
    """
    n = F.size("w")
    words = each.select(*names, F.array_remove(F.transform(F.split("line", " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))).alias("w"))
    next_ = lambda k, by: F.get("w", k + by)
    shingles = F.transform(F.slice("w", F.lit(1), n - 4), lambda w, k: F.xxhash64(w, next_(k, 1), next_(k, 2), next_(k, 3), next_(k, 4)))
    return words.select(*names, F.when(n >= 5, F.array_distinct(shingles)).when(n > 0, F.array(F.xxhash64("w"))).alias("tokens"))


def _bucket(token: Column) -> Column:
    return token.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _rarity(sets: DataFrame) -> DataFrame:
    """One row with `tiers`, BUCKETS numbers: the binary logarithm of how many sets' tokens fall into each bucket."""
    counts = sets.select(F.explode("tokens").alias("token")).groupBy(_bucket(F.col("token")).alias("bucket")).agg(F.floor(F.log2(F.count("*"))).cast("byte").alias("tier"))
    every = counts.unionByName(sets.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("byte").alias("tier")))
    table = every.groupBy("bucket").agg(F.max("tier").alias("tier"))
    return written(table.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "tier"))), lambda x: x["tier"]).alias("tiers")), "rarity")


def _in_prefix(n: Column, percent: int) -> Column:
    """The least number of tokens in the prefix of a set of n that are also in the prefix of one similar to it."""
    return F.least(F.ceil(n * percent / 100).cast("int"), F.lit(COMMON))


def _prefix_size(n: Column, percent: int) -> Column:
    """Before the last of the first k common tokens lie at most as many others as may be missing in the other set."""
    return n - F.ceil(n * percent / 100).cast("int") + _in_prefix(n, percent)


def _needed(n: Column, m: Column, percent: int) -> Column:
    """The least intersection with which sets of n and m tokens are similar enough."""
    return F.ceil((n + m) * percent / (100 + percent)).cast("int")


def _possible(n: Column, i: Column, m: Column, k: Column, percent: int) -> Column:
    """The length filter, and the position filter for a common token at i of n and k of m.

    From a pair's first common tokens on, all but the COMMON - 1 before may be left.
    """
    similar_length = (m * 100 >= n * percent) & (n * 100 >= m * percent)
    return similar_length & (F.least(n - i, m - k) >= _needed(n, m, percent) - (COMMON - 1))


def _proposed(met: DataFrame, percent: int) -> DataFrame:
    """(c, d) of met (c, d, n, i, dn, di: one row a common token) that share enough tokens and could be similar."""
    told = met.groupBy("c", "d").agg(F.count("*").alias("common"), F.max("i").alias("i"), F.max("di").alias("di"), F.max("n").alias("n"), F.max("dn").alias("dn"))
    # beyond the last token that both prefixes have, all that is left could be common
    most = F.col("common") + F.least(F.col("n") - F.col("i"), F.col("dn") - F.col("di")) - 1
    enough = F.col("common") >= F.least(_in_prefix(F.col("n"), percent), _in_prefix(F.col("dn"), percent))
    return told.where(enough & (most >= _needed(F.col("n"), F.col("dn"), percent))).select("c", "d")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The c of those (c, d) of pairs whose full sets are similar enough, as a table."""
    pairs = written(pairs, "pairs")
    with_c = sets.select("c", F.col("tokens").alias("ct")).join(small(pairs, NARROW_ROWS), "c")
    both = with_c.join(sets.select(F.col("c").alias("d"), F.col("tokens").alias("dt")), "d")
    common = F.size(F.array_intersect("ct", "dt"))
    done = written(both.where(100 * common >= percent * (F.size("ct") + F.size("dt") - common)).select("c").distinct(), "settled")
    drop(pairs)
    return done


def _settled(known: DataFrame, docs: DataFrame, percent: int) -> list[DataFrame]:
    """Tables of the c of known (c, f: the first place) that are similar to an earlier one."""
    # their full sets, from the texts again; a repeated row gives the same set again
    asked = known.select("c", "f", F.col("f.doc_id").alias("doc_id"), F.col("f.h").alias("h"), F.col("f.pos").alias("pos"))
    held = docs.withColumns({"_doc_id": id_in(), "_h": F.xxhash64(F.coalesce("text", F.lit("")))})
    held = held.join(small(asked.select(F.col("doc_id").alias("_doc_id"), F.col("h").alias("_h")).distinct(), NARROW_ROWS), ["_doc_id", "_h"], "left_semi")
    chosen = _lines(held.select("doc_id", "text")).join(small(asked, NARROW_ROWS), ["doc_id", "h", "pos"]).select("c", "f", "line")
    sets = written(_tokens(chosen, ["c", "f"]), "sets")
    if sets.count() > known.count():
        repeated, sets = sets, written(sets.dropDuplicates(["c"]), "sets")
        drop(repeated)
    tiers = _rarity(sets)

    # postings in the order of rarity, and the first classes of their tokens
    mask = (1 << 57) - 1
    key = lambda s: F.shiftleft(F.get("tiers", _bucket(s)).cast("long"), 57).bitwiseOR(s.bitwiseAND(F.lit(mask)))
    n = F.size("t")
    ordered = sets.join(F.broadcast(tiers)).select("c", "f", F.sort_array(F.transform("tokens", key)).alias("t"))  # one row, of bounded size
    # outer as in _lines(): no list is empty, and a filter on their size would sort each set once more
    posted = ordered.select("c", "f", n.alias("n"), F.posexplode_outer(F.slice("t", F.lit(1), _prefix_size(n, percent))).alias("i", "token"))
    of_token = Window.partitionBy("token").orderBy("f")
    ranked = posted.select("*", F.row_number().over(of_token).alias("rank"), F.lead("c").over(of_token).alias("next"))
    postings = written(ranked.where("rank > 1 or next is not null").select("token", "c", "f", "n", "i", "rank"), "postings")
    head = postings.select("token", F.col("c").alias("d"), F.col("rank").alias("before"), F.col("n").alias("dn"), F.col("i").alias("di")).where(F.col("before") <= FIRST)
    met = postings.join(head, "token").where((F.col("before") < F.col("rank")) & (F.col("c") != F.col("d")) & _possible(F.col("n"), F.col("i"), F.col("dn"), F.col("di"), percent))
    early = _verified(_proposed(met, percent), sets, percent)

    # classes with more before them than these, which are not settled
    deep = postings.where(F.col("rank") > FIRST + 1).select("c").distinct()
    open_ = written(deep.join(early, "c", "left_anti"), "open")
    found = [early]
    if not open_.isEmpty():
        later = postings.select("token", "c", "f", "n", "i").join(small(open_, NARROW_ROWS), "c")
        earlier = postings.select("token", F.col("c").alias("d"), F.col("f").alias("df"), F.col("n").alias("dn"), F.col("i").alias("di"))
        both = later.join(earlier, "token").where((F.col("df") < F.col("f")) & _possible(F.col("n"), F.col("i"), F.col("dn"), F.col("di"), percent))
        found.append(_verified(_proposed(both, percent), sets, percent))
    drop(sets, tiers, postings, open_)
    return found


def later_lines(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, h, pos) of the lines that are similar to an earlier one, in the order of (doc_id, h, pos), as a table."""
    place = ["doc_id", "h", "pos"]
    n = F.size("tokens")
    tokens = _tokens(_lines(docs), place).select(*place, F.sort_array("tokens").alias("tokens"))
    # sets of one or two are similar to their equals only
    prefix = F.when(n > 2, F.slice("tokens", F.lit(1), _prefix_size(n, percent)))
    placed = written(tokens.select(*place, F.when(n > 0, F.xxhash64("tokens")).alias("c"), n.alias("n"), prefix.alias("prefix")), "lines")
    worded = placed.where("c is not null")
    firsts = written(worded.groupBy("c").agg(F.min(F.struct(*place)).alias("f"), F.count("*").alias("times"), F.max("n").alias("n")), "classes")

    # classes with enough tokens in their prefixes that other classes have there too; both sides of the join read one
    # shuffle, which Spark would not see if it were a semi-join, as it pushes that below the repartition
    posted = worded.where("prefix is not null").select("c", F.explode("prefix").alias("token")).repartition("token")
    shared = posted.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("token")
    alive = written(posted.join(shared.hint("shuffle_hash"), "token").groupBy("c").agg(F.count("*").alias("hits")), "alive")
    known = written(firsts.join(alive, "c").where(F.col("hits") >= _in_prefix(F.col("n"), percent) * F.col("times")).select("c", "f"), "known")
    drop(alive)
    found = _settled(known, docs, percent)
    settled = found[0]
    for more in found[1:]:
        settled = settled.unionByName(more)
    gone = firsts.join(settled.withColumn("gone", F.lit(True)), "c", "left").where("gone or times > 1").select("c", "f", "gone")
    judged = worded.select(*place, "c").join(small(written(gone, "gone"), NARROW_ROWS), "c")
    removed = written(judged.where((F.struct(*place) != F.col("f")) | F.col("gone")).select(*place).distinct(), "removed")
    drop(placed, firsts, known, *found)
    return removed


def rewrite_lines(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs with all their columns, the text without the lines of later_lines(), and _removed, the numbers of those lines."""
    places = later_lines(docs.select("doc_id", "text"), percent)
    removed = places.groupBy(F.col("doc_id").alias("_doc_id"), F.col("h").alias("_h")).agg(F.sort_array(F.collect_list("pos")).alias("_removed"))
    few = places.limit(NARROW_ROWS + 1).count() <= NARROW_ROWS  # which bounds the arrays too
    read = docs.withColumns({"_doc_id": id_in(), "_h": F.xxhash64(F.coalesce("text", F.lit("")))})
    joined = read.join(F.broadcast(removed) if few else removed, ["_doc_id", "_h"], "left")
    rest = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, k: ~F.array_contains("_removed", k)), "\n")
    names = [F.when(F.col("_removed").isNotNull(), rest).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return joined.select(*names, F.coalesce("_removed", F.array().cast("array<int>")).alias("_removed"))


def dedup_lines(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Remove from docs (doc_id, text) the lines whose token sets have at least `percent` of the union with an earlier line.

    Earlier means before it in the order of (doc_id, text hash, line number); case does not count. Lines with one to four
    words are one token, so they go if an earlier line has the same words; lines without a word stay. Returns doc_id,
    text (the other lines, joined by line ends again; null stays null), n_lines (of the text as it was), n_removed and
    removed (their numbers from 0, ascending). Rows with equal doc_id and text count as one document and come out alike;
    a null doc_id stays null and counts as the first; an empty table gives no rows; texts and lines may be of any length
    that a row can hold; other columns are ignored. Tokens are told apart by 64-bit hashes.
    """
    read = docs.select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    done = rewrite_lines(read, percent)
    return done.select("doc_id", "text", "n_lines", F.size("_removed").cast("long").alias("n_removed"), F.col("_removed").alias("removed"))


#: DuckDB SQL with dedup_lines()' columns: every pair of lines that share a token is compared.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, text FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(string_split(t, chr(10))))) AS pos, string_split(lower(t), chr(10)) AS ls FROM d),
w AS (SELECT doc_id, pos, regexp_extract_all(ls[pos + 1], '[^ \t\n\x0B\f\r]+') AS ws FROM l),
s AS (SELECT DISTINCT doc_id, pos, array_to_string(ws[k : k + 4], ' ') AS token
      FROM (SELECT doc_id, pos, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS k FROM w WHERE len(ws) > 0)),
c AS (SELECT doc_id, pos, count(*) AS n FROM s GROUP BY doc_id, pos),
p AS (SELECT a.doc_id, a.pos, b.doc_id AS bd, b.pos AS bp, count(*) AS common FROM s a JOIN s b ON a.token = b.token AND (b.doc_id, b.pos) < (a.doc_id, a.pos) GROUP BY ALL),
r AS (SELECT DISTINCT p.doc_id, p.pos FROM p JOIN c x ON x.doc_id = p.doc_id AND x.pos = p.pos JOIN c y ON y.doc_id = bd AND y.pos = bp
      WHERE 100 * common >= 75 * (x.n + y.n - common)),
g AS (SELECT doc_id, list(CAST(pos AS INTEGER) ORDER BY pos) AS removed FROM r GROUP BY doc_id)
SELECT d.doc_id,
       CASE WHEN g.removed IS NULL THEN d.text
            ELSE array_to_string(list_filter(string_split(t, chr(10)), lambda x, i: NOT list_contains(g.removed, CAST(i - 1 AS INTEGER))), chr(10)) END AS text,
       CAST(len(string_split(t, chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(len(g.removed), 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
