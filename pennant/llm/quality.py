"""Host-level quality rules, in DataFrame functions only.

Every document is measured and tested against a few rules. A host's failures are counted, its rates are shrunk towards
a beta prior fitted to all hosts, and hosts whose shrunk rate is too high get a verdict that is joined back: there, a
document that breaks a rule goes. A document that breaks none stays wherever it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pennant.llm.common import small, written

#: [^\x20\x09-\x0D]+ with every blank named, which the matcher then finds in one table.
WORD = r"[^ \t\n\x0B\f\r]+"
SYMBOL = r"[#*$%&|<>]"
#: Deviations by which a host's shrunk rate must lie above the mean of the prior to fail a rule.
APART = 2.0


def measure(docs: DataFrame, extra: list[str]) -> DataFrame:
    """doc_id, the `extra` columns, and n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (all long).

    A word window counts as found twice if two windows of the text have equal 64-bit hashes. Arrays stay inside their
    row, so nothing is shuffled; only texts with a repeated window are sorted.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select(
        "doc_id", *extra,
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", "")).cast("long").alias("word_chars"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("_lines"),
    )
    size = F.size("_words")
    word = lambda k: F.get("_words", k)
    hashes = F.transform(F.sequence(F.lit(0), size - 3), lambda k: F.xxhash64(word(k), word(k + 1), word(k + 2)))
    windows = read.select(
        "doc_id", *extra, "n_symbols", "word_chars",
        size.cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(size >= 3, hashes).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    sorted_windows = F.sort_array(F.transform("_windows", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    in_order = windows.withColumn("_sorted", F.when(twice, sorted_windows)).drop("_windows")
    like = lambda x, k: F.coalesce(F.get("_sorted", k)["h"] == x["h"], F.lit(False))
    again = F.filter("_sorted", lambda x, k: like(x, k - 1) | like(x, k + 1))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["k"], x["k"] + 1, x["k"] + 2))))
    return in_order.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_sorted").isNotNull(), F.size(covered)), F.lit(0)).cast("long")).drop("_sorted")


def _rules() -> dict[str, Column]:
    """The rules that count for hosts, on whole numbers so that every engine agrees."""
    return {
        "symbols": 100 * F.col("n_symbols") > 10 * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "repeats": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
    }


def _shrunk(hosts: DataFrame, counts: list[str]) -> DataFrame:
    """_host, n and, for each column of counts, rate_ (shrunk), mean_ (the prior's) and spread_ (the deviation of rate_).

    The prior: with the mean rate m and the variance v of the rates between hosts (by documents, less what chance
    explains), beta(m k, (1 - m) k) with k = m (1 - m) / v - 1, held to 1 .. 10000.
    """
    mean = hosts.agg(F.sum("n").alias("all_n"), F.count("*").alias("n_hosts"), *[(F.sum(f) / F.sum("n")).alias(f"m_{f}") for f in counts])
    m = {f: F.col(f"m_{f}") for f in counts}
    apart = [(F.sum(F.col("n") * F.pow(F.col(f) / F.col("n") - m[f], 2)) / F.first("all_n")).alias(f"v_{f}") for f in counts]
    spread = hosts.crossJoin(F.broadcast(mean)).groupBy("all_n", "n_hosts", *m.values()).agg(*apart)

    def strength(f: str) -> Column:
        chance = m[f] * (1 - m[f]) * F.col("n_hosts") / F.col("all_n")
        between = F.greatest(F.col(f"v_{f}") - chance, F.lit(1e-12))
        return F.least(F.greatest(m[f] * (1 - m[f]) / between - 1, F.lit(1.0)), F.lit(1e4))

    prior = spread.select(*m.values(), *[strength(f).alias(f"k_{f}") for f in counts])  # one row
    k = {f: F.col(f"k_{f}") for f in counts}
    rate = {f: (F.col(f) + m[f] * k[f]) / (F.col("n") + k[f]) for f in counts}
    return hosts.crossJoin(F.broadcast(prior)).select(
        "_host",
        *[rate[f].alias(f"rate_{f}") for f in counts],
        *[m[f].alias(f"mean_{f}") for f in counts],
        *[F.sqrt(rate[f] * (1 - rate[f]) / (F.col("n") + k[f] + 1)).alias(f"spread_{f}") for f in counts],
    )


def host_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """Judge docs (doc_id, text, host column) by their own failures and their hosts' shrunk failure rates.

    Returns the host column, doc_id, text_hash (64 bits, to tell rows with one doc_id apart), the counts of measure(), base_failed (fewer than 50 words, or over half of them in
    repeated three-word windows), broken (a rule of the hosts' is broken), host_rate (the shrunk rate of the host's
    documents with base_failed or broken), host_failed, failed_rules (the host's, sorted) and kept. A prior is fitted for
    each rule, see _shrunk(), and a host fails a rule if its shrunk rate lies more than APART of its deviations above the
    prior's mean. kept is false if base_failed, or if the document breaks a rule that its host fails.

    Null texts have no words and fail; null hosts form one host, apart from that named ''; repeated rows are judged each;
    an empty table gives no rows; a text of any length is measured within its row; other columns are ignored.
    """
    named = F.when(F.col(host).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(host).cast("string")))
    measured = measure(docs.select("doc_id", "text", named.alias("_host"), F.col(host).alias("_named"), F.xxhash64("text").alias("text_hash")), ["_host", "_named", "text_hash"])
    rules = _rules()
    broken = F.lit(False)
    for rule in rules.values():
        broken = broken | rule
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = written(measured.withColumn("base_failed", base).withColumn("broken", broken), "measured")
    counts = [F.count_if(rule).alias(name) for name, rule in rules.items()]
    hosts = judged.groupBy("_host").agg(F.count("*").alias("n"), F.count_if(F.col("base_failed") | F.col("broken")).alias("f"), *counts)
    rates = _shrunk(written(hosts, "hosts"), ["f", *rules])
    fails = {name: F.col(f"rate_{name}") - APART * F.col(f"spread_{name}") > F.col(f"mean_{name}") for name in rules}
    verdicts = rates.select("_host", F.col("rate_f").alias("host_rate"), *[failed.alias(f"_fails_{name}") for name, failed in fails.items()])
    back = judged.join(small(verdicts), "_host", "left")
    gone = F.lit(False)
    for name, rule in rules.items():
        gone = gone | rule & F.col(f"_fails_{name}")
    failed = F.filter(F.array(*[F.when(F.col(f"_fails_{name}"), name) for name in sorted(rules)]), lambda x: x.isNotNull())
    return back.select(
        F.col("_named").alias(host), "doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words",
        "base_failed", "broken", "host_rate", (F.size(failed) > 0).alias("host_failed"), failed.alias("failed_rules"), (~F.col("base_failed") & ~gone).alias("kept"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
windows AS (SELECT doc_id, k, ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] AS win
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS k FROM w)),
twice AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             [100 * n_symbols > 10 * word_chars, 100 * n_dup_lines > 30 * n_lines, 100 * n_repeat_words > 20 * n_words,
              word_chars < 2 * n_words OR word_chars > 20 * n_words] AS rules FROM m),
e AS (SELECT host, unnest([1, 2, 3, 4]) AS rule, unnest(rules) AS broken FROM j),
h AS (SELECT host, rule, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (broken) AS DOUBLE) AS f FROM e GROUP BY host, rule),
p AS (SELECT rule, sum(n) AS all_n, sum(f) / sum(n) AS m, count(*) AS n_hosts FROM h GROUP BY rule),
v AS (SELECT rule, any_value(m) AS m, greatest(sum(n * (f / n - m) ** 2) / any_value(all_n) - any_value(m * (1 - m) * n_hosts / all_n), 1e-12) AS v FROM h JOIN p USING (rule) GROUP BY rule),
k AS (SELECT rule, m, least(greatest(m * (1 - m) / v - 1, 1.0), 1e4) AS k FROM v),
r AS (SELECT host, rule, m, n + k AS nk, (f + m * k) / (n + k) AS rate FROM h JOIN k USING (rule)),
b AS (SELECT host, list(rate - @APART@ * sqrt(rate * (1 - rate) / (nk + 1)) > m ORDER BY rule) AS fails FROM r GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (rules[1] AND fails[1] OR rules[2] AND fails[2] OR rules[3] AND fails[3] OR rules[4] AND fails[4]) AS kept
FROM j JOIN b ON b.host = j.host
""".replace("@APART@", str(APART))
