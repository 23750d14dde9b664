"""Personal data against a plain version, checksums, words nearby, odd and long inputs."""

import hashlib
import random
import re
import time

import duckdb
import pytest

from pennant.llm import pii

DOCS = "doc_id long, text string, found string, spans string, order long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS)


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    found = []
    for k, kind in enumerate(pii.BASE):
        for m in re.finditer(pii.PLAIN[kind], text, re.ASCII):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 10 <= len(d) <= 15}[kind]()
            if ok:
                found.append((m.start(), k, m.end(), kind))
    return sorted(found)


def iban(country, body):
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(number) % 97:02d}{body}"


def spans(spark, *texts):
    rows = pii.digest(pii.find(docs_of(spark, list(enumerate(texts))))).orderBy("doc_id").collect()
    return [r.spans for r in rows]


def test_base_spans_are_those_of_the_plain_version(spark):
    rng = random.Random(5)
    bits = ["a.b@c.de", "x@y", "_d@e.f-g.h", "@", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.01.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "+1 (212) 555-0100",
            "+44 20 7946 0958", "+1", "++12 ", "1 2-3", " ", "\n", "é", "𝄞", ".", "-", "(", "12345678901234567890", "word", "%", "٣"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    for i, row in enumerate(pii.digest(pii.find(docs_of(spark, list(enumerate(texts))))).orderBy("doc_id").collect()):
        want = plain(texts[i])
        assert row.base_sha256 == hashlib.sha256(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in want).encode()).hexdigest(), (texts[i], want, row.spans)
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(s[1] == k for s in want) for k in range(4))


def test_account_numbers_need_their_checksum_and_length(spark):
    good = iban("DE", "370400440532013000")
    bad = good[:-1] + str((int(good[-1]) + 1) % 10)
    spaced = " ".join(good[k : k + 4] for k in range(0, len(good), 4))
    got = spans(spark, good, bad, f"pay {spaced} AND GO", f"x{good}", f"{good}9", iban("GB", "WEST12345698765432"), iban("NO", "86011117947"))
    assert got == [f"iban:0:{len(good)}", "", f"iban:4:{4 + len(spaced)}", "", "", "iban:0:22", "iban:0:15"]


def test_words_nearby_decide_over_weak_spans(spark):
    nir = next(n for n in ("2550814168025", "2550814168031", "2550814168047") if not luhn(f"{n}{97 - int(n) % 97:02d}") and not luhn(f"{n}{98 - int(n) % 97:02d}"))
    key = f"{97 - int(nir) % 97:02d}"
    got = spans(
        spark, "ssn 123-45-6789", "code 123-45-6789", "ssn 666-45-6789", "serial version ssn 123-45-6789", "Tel. (212) 555-0100", "part (212) 555-0100", "call +1 (212) 555-0100",
        f"numéro de sécurité sociale {nir}{key}", f"numéro de sécurité sociale {nir}{int(key) + 1:02d}", f"{nir}{key}", "the ssn stands far away" + " and so on" * 9 + " 123-45-6789",
    )
    assert got == ["ssn:4:15", "", "", "", "local_phone:5:19", "", "phone:5:22", "nir:27:42", "", "", ""]


def test_scores(spark):
    found = pii.find(docs_of(spark, [(1, "visa 4111111111111111"), (2, "4111111111111111"), (3, "order 4111111111111111")])).collect()
    assert sorted((r.doc_id, r.found[0].score) for r in found) == [(1, 1.0), (2, 0.7), (3, 0.4)]


def test_long_texts_in_proportion(spark):
    unit = "mail a.b@c.de from 10.0.0.1 or +1 (212) 555-0100, "
    texts = [(1, unit * 20_000), (2, "a" * 1_000_000 + "@"), (3, "1" * 1_000_000), (4, "a@b" + ".c" * 200_000), (5, "1-" * 500_000), (6, "+1 " + "(" * 1_000_000), (7, "1." * 300_000)]
    start = time.perf_counter()
    rows = {r.doc_id: r for r in pii.digest(pii.find(docs_of(spark, texts))).collect()}
    assert time.perf_counter() - start < 60
    assert (rows[1].n_email, rows[1].n_ip, rows[1].n_phone) == (20_000, 20_000, 20_000)
    assert rows[1].base_sha256 == hashlib.sha256(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in plain(texts[0][1])).encode()).hexdigest()
    assert rows[4].spans == "email:0:400003" and rows[2].spans == rows[3].spans == ""


def test_odd_rows(spark):
    rows = docs_of(spark, [(None, None), (None, "a@b.c"), (1, ""), (2, None), (3, "a@b.c"), (3, "a@b.c")])
    got = sorted((str(r.doc_id), r.spans) for r in pii.digest(pii.find(rows)).collect())
    assert got == [("1", ""), ("2", ""), ("3", "email:0:5"), ("3", "email:0:5"), ("None", ""), ("None", "email:0:5")]
    assert pii.digest(pii.find(docs_of(spark, []))).count() == 0


def test_mask(spark):
    rows = docs_of(spark, [(1, "é write to a@b.c or 10.0.0.1."), (2, None), (3, "nothing"), (4, "1.2.3.4@x.de")])
    assert [r.text for r in pii.mask(rows).orderBy("doc_id").collect()] == ["é write to <email> or <ip>.", None, "nothing", "<email>"]


@pytest.mark.parametrize("words", ["bank", "ssn", ""])
def test_sql_agrees_on_planted_numbers(spark, words, tmp_path):
    rng = random.Random(len(words))
    rows = []
    for i in range(200):
        body = "".join(rng.choice("0123456789") for _ in range(18))
        number = iban("DE", body)
        parts = [rng.choice(["lorem", words, "version", "é𝄞"]), rng.choice([number, number[:-1] + "0", "123-45-6789", "(212) 555-0100", "2 55 08 14 168 025 38", "a@b.c", "4111 1111 1111 1111"]), "end"]
        rows.append((i, rng.choice([" ", "\n", ": "]).join(parts * rng.randrange(1, 4))))
    docs = docs_of(spark, rows)
    docs.write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    columns = "doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans"
    want = sorted(db.sql(f"SELECT {columns} FROM ({pii.oracle()})").fetchall())
    assert sorted(tuple(r) for r in pii.digest(pii.find(docs)).selectExpr(*columns.split(", ")).collect()) == want
