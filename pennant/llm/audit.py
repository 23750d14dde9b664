"""How filters for documents interact: what each removes, in every order, and what it alone would miss.

Each document is tested once against five filters. The documents are counted for each part and each pattern of failures,
and a CUBE over the five flags and the part adds these counts up: the row of a grouping set whose selected flags are all
false tells how many documents survive that set of filters. Every step of every order is then the difference of two sets
that are one filter apart.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pennant.llm.common import small, written

FILTERS = "ABCDE"
#: Rows of one text from which on its digest is looked up apart; there are at most rows / HOT such digests.
HOT = 500
#: The blanks between words.
_BLANKS = "\t\n\x0b\f\r"


def failures(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part and the flags A to E (true: fails) of docs (doc_id, text, the part's column).

    A: under 200 words. B: under half of the words are distinct. C: over 2 of 100 characters are capitals. D: it holds one
    of #$%&*|. E: its text is also that of a smaller doc_id; rows without a doc_id neither fail E nor make others fail.

    Texts are compared by SHA-256, so only digests are shuffled, and of these only those found more than once are joined
    back. The first doc_id of each is found by partial aggregation; digests of more than HOT rows are looked up where the
    rows are, which then go to the other join by their doc_id, so a text of a third of all rows lies on no single task.
    Null texts count as empty; null parts are the empty string; repeated rows are counted each.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(F.translate(text, _BLANKS, " " * len(_BLANKS)), " "), "")
    read = docs.select(F.col("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("_text"), words.alias("_words"))
    capitals = F.char_length("_text") - F.char_length(F.regexp_replace("_text", "[A-Z]+", ""))
    tested = read.select(
        "doc_id", "part", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_digest"),
        (F.size("_words") < 200).alias("A"),
        (100 * F.size(F.array_distinct("_words")) < 50 * F.size("_words")).alias("B"),
        (100 * capitals.cast("long") > 2 * F.char_length("_text")).alias("C"),
        F.col("_text").rlike(r"[#$%&*|]").alias("D"),
    )
    kept = written(tested, "tested")
    firsts = written(kept.groupBy("_digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1"), "firsts")
    hot = small(firsts.where(F.col("_n") > HOT).select("_digest", F.col("_first").alias("_hot")))
    looked_up = kept.join(hot, "_digest", "left")
    own = F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")  # as long as no digest
    dealt = looked_up.withColumn("_digest", F.when(F.col("_hot").isNull(), F.col("_digest")).otherwise(own))
    rest = firsts.where(F.col("_n") <= HOT).select("_digest", "_first")
    again = F.col("doc_id") > F.coalesce("_hot", "_first")
    return dealt.join(rest, "_digest", "left").select("doc_id", "part", "A", "B", "C", "D", F.coalesce(again, F.lit(False)).alias("E"))


def survivors(failed: DataFrame, counts: dict[str, Column], flags: Iterable[str] = FILTERS) -> DataFrame:
    """part, mask, and the sums of `counts` over the documents that pass all filters of the mask.

    mask has bit k for the k-th of the flags; part is null in the rows over all parts. Sets that no document of a part
    survives have no row. Documents are added up by part and flags before the CUBE, so that it expands a few rows for
    each part, however many documents there are.
    """
    flags = list(flags)
    patterns = failed.groupBy("part", *flags).agg(*[total.alias(name) for name, total in counts.items()])
    cubed = patterns.cube(*flags, "part").agg(F.grouping("part").alias("_all"), *[F.grouping(f).alias(f"_{f}") for f in flags], *[F.sum(c).alias(c) for c in counts])
    passed, mask = F.lit(True), F.lit(0)
    for k, f in enumerate(flags):
        passed = passed & ((F.col(f"_{f}") == 1) | ~F.col(f))
        mask = mask + F.when(F.col(f"_{f}") == 0, 1 << k).otherwise(0)
    return cubed.where(passed).select(F.when(F.col("_all") == 0, F.col("part")).alias("part"), mask.alias("mask"), *counts)


def _steps(spark: SparkSession, flags: str) -> DataFrame:
    """filter_order, step, and the masks before and after it: what the orders of the flags are, known beforehand."""
    rows = []
    for order in permutations(flags):
        before = 0
        for step, f in enumerate(order):
            after = before | 1 << flags.index(f)
            rows.append(("".join(order), step + 1, before, after))
            before = after
    return spark.createDataFrame(rows, "filter_order string, step int, before int, after int")


def interactions(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step, see failures().

    kept (after the step), removed (by it), redundant (failing its filter, removed before), unique_fails (failing its
    filter alone), good_lost and toxic_lost (removed by it, with quality = 1 or toxic = 1 in labels), shapley (what the
    step's filter removes, added up over all orders). All are long and count within the part; nothing lost is 0.

    A document is good or toxic if one row of its doc_id in labels says so; labels without a doc_id say nothing. Every
    value of the part has its rows; without documents there are none. What is joined after the CUBE has 32 rows a part.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    judged = failures(docs, part).join(known, "doc_id", "left")
    counts = {"n": F.count("*"), "good": F.count_if(F.coalesce("_good", F.lit(False))), "toxic": F.count_if(F.coalesce("_toxic", F.lit(False)))}
    found = written(survivors(judged, counts).where("part is not null"), "survivors")

    # every part has a row of the empty set; sets that nothing survives count 0
    masks = spark.range(1 << len(FILTERS)).select(F.col("id").cast("int").alias("mask"))
    sets = found.where("mask = 0").select("part").join(F.broadcast(masks)).join(found, ["part", "mask"], "left").fillna(0, list(counts))
    side = lambda name: sets.select("part", F.col("mask").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in counts])
    steps = _steps(spark, FILTERS)
    pairs = steps.groupBy("before", "after").agg(F.count("*").alias("times"))  # 80 pairs of sets, one filter apart
    lost = side("before").join(F.broadcast(pairs), "before").join(side("after"), ["part", "after"])
    lost = lost.withColumns({"filter": F.col("after") - F.col("before"), **{f"lost_{c}": F.col(f"before_{c}") - F.col(f"after_{c}") for c in counts}})
    every = (1 << len(FILTERS)) - 1
    own = Window.partitionBy("part", "filter")
    lost = lost.withColumns({
        "fails": F.max(F.when(F.col("before") == 0, F.col("lost_n"))).over(own),
        "unique_fails": F.max(F.when(F.col("after") == every, F.col("lost_n"))).over(own),
        "shapley": F.sum(F.col("lost_n") * F.col("times")).over(own),
    })
    return lost.join(F.broadcast(steps), ["before", "after"]).select(  # 600 rows
        "part", "filter_order", "step", F.col("after_n").alias("kept"), F.col("lost_n").alias("removed"), (F.col("fails") - F.col("lost_n")).alias("redundant"),
        "unique_fails", F.col("lost_good").alias("good_lost"), F.col("lost_toxic").alias("toxic_lost"), "shapley",
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
f AS (SELECT doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t),
             regexp_matches(t, '[#$%&*|]'), doc_id > first] AS fails FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM x a, x b, x c, x d, x e
      WHERE list_unique([a.k, b.k, c.k, d.k, e.k]) = 5),
h AS (SELECT g.*, ks, list_position(list_transform(ks, lambda k: fails[k]), true) AS hit, CAST(len(list_filter(fails, lambda b: b)) AS INTEGER) AS n_fails FROM g, o),
s AS (SELECT part, ks, step, ks[step] AS k, coalesce(sum(n) FILTER (hit IS NULL OR hit > step OR hit = 0), 0) AS kept, coalesce(sum(n) FILTER (hit = step), 0) AS removed,
             coalesce(sum(n) FILTER (hit < step AND hit > 0 AND fails[ks[step]]), 0) AS redundant, coalesce(sum(n) FILTER (n_fails = 1 AND fails[ks[step]]), 0) AS unique_fails,
             coalesce(sum(good) FILTER (hit = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit = step), 0) AS toxic_lost
      FROM h, (SELECT unnest(range(1, 6)) AS step) GROUP BY part, ks, step)
SELECT part, array_to_string(list_transform(ks, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM s
"""
