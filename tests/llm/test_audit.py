"""The filters' interactions against plain counting, every order one by one, and on odd inputs."""

import itertools
import random
import re

import duckdb
import pytest

from pennant.llm import audit

DOCS = "doc_id long, text string, source string, A string, part string, mask int, n int"
LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", 1, 2) for i, t, s in rows], DOCS)


def plain(rows, labels):
    """Every order applied to the documents one step after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    judged = []
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        judged.append((s or "", i, fails))
    out, removed_by = {}, {}
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [j for j in left if j[2][f]]
                redundant = sum(j[2][f] for j in own) - len(gone)
                unique = sum(j[2][f] and sum(j[2].values()) == 1 for j in own)
                left = [j for j in left if not j[2][f]]
                out[part, "".join(order), step] = [len(left), len(gone), redundant, unique, sum(j[1] in good for j in gone), sum(j[1] in toxic for j in gone)]
                removed_by[part, f] = removed_by.get((part, f), 0) + len(gone)
    return sorted((*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def texts(n, seed):
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        words = [rng.choice(["aa", "Bb", "cc", "DD", "e"]) + str(rng.randrange(rng.choice([3, 900]))) for _ in range(rng.choice([0, 1, 199, 200, 300]))]
        made.append(rng.choice([" ", "\t", "\n\x0b"]).join(words) + rng.choice(["", "", " | &", "  "]))
    return made


@pytest.fixture(scope="module")
def given():
    rng = random.Random(4)
    made = texts(60, 3)
    rows = [(i, rng.choice(made), rng.choice(["s", "t", "", None, "u|é"])) for i in range(150)]
    rows += [(None, made[0], "s"), (None, made[0], None), (7, rows[7][1], "s"), (900, None, "t"), (901, "", "only"), (902, None, "only"), (903, " ".join(f"w{k % 9000}" for k in range(30_000)), "t")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160, 2)] + [(4, 1, 1), (None, 1, 1)]
    return rows, labels


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select(COLUMNS).collect())


def test_every_order_step_by_step(spark, given):
    rows, labels = given
    assert rows_of(audit.interactions(docs_of(spark, rows), spark.createDataFrame(labels, LABELS))) == plain(rows, labels)


def test_a_text_of_many_rows(spark, given, monkeypatch):
    rows, labels = given
    monkeypatch.setattr(audit, "HOT", 3)
    assert rows_of(audit.interactions(docs_of(spark, rows), spark.createDataFrame(labels, LABELS))) == plain(rows, labels)


def test_sql_agrees(spark, given, tmp_path):
    rows, labels = given
    rows = [r for r in rows if r[0] is not None]
    docs_of(spark, rows).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "l"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    db.sql(f"CREATE VIEW labels AS SELECT * FROM '{tmp_path}/l/*.parquet'")
    assert sorted(db.sql(f"SELECT {', '.join(COLUMNS)} FROM ({audit.ORACLE})").fetchall()) == plain(rows, labels)


def test_totals_over_all_parts_come_from_the_same_cube(spark, given):
    from pyspark.sql import functions as F

    rows, _ = given
    found = audit.survivors(audit.failures(docs_of(spark, rows)), {"n": F.count("*")}).collect()
    whole = {r.mask: r.n for r in found if r.part is None}
    assert whole[0] == len(rows)
    for mask, n in whole.items():
        assert n == sum(r.n for r in found if r.mask == mask and r.part is not None)


def test_no_documents_and_no_labels(spark, given):
    empty = spark.createDataFrame([], LABELS)
    assert audit.interactions(docs_of(spark, []), empty).count() == 0
    rows = given[0][:20]
    assert rows_of(audit.interactions(docs_of(spark, rows), empty)) == plain(rows, [])
