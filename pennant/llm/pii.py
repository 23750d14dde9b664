"""Personal data in texts, in DataFrame functions only.

A regular expression proposes the spans of each kind, checks confirm them (ranges, counts of digits, Luhn, mod-97), and
words nearby move their scores. Four base kinds stay whatever their score; the further kinds need a score of LEAST.
Everything happens in the arrays of a row, so nothing is shuffled and no document waits for another.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a passed checksum and a word of the kind nearby add to a kind's own score, and what an opposing word takes.
CHECKED, NEAR, OPPOSED = 0.4, 0.3, 0.3
#: The score that a span of a further kind needs.
LEAST = 0.6
#: Code points before and after a span that are searched for words; they end at the next span of the same kind.
BEFORE, AFTER = 48, 24
#: Spans whose places are added up at a time; more are added up block by block, so that time stays in proportion.
BLOCK = 64

# The lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29,
    "VG": 24, "XK": 20,
}
# Words near a span that speak for its kind, and words that speak against any number.
WORDS = {
    "email": ["e-mail", "email", "mail", "contact", "kontakt", "correo", "courriel"],
    "ip": ["ip", "address", "host", "server", "adresse"],
    "card": ["card", "credit", "visa", "mastercard", "amex", "karte", "carte", "tarjeta"],
    "phone": ["phone", "tel", "telephone", "call", "fax", "mobile", "telefon", "téléphone", "teléfono"],
    "iban": ["iban", "account", "bank", "konto", "compte", "cuenta"],
    "nir": ["nir", "insee", "sécurité sociale", "securite sociale", "numéro de sécu", "carte vitale"],
    "ssn": ["ssn", "social security", "social sec"],
    "local_phone": ["phone", "tel", "telephone", "call", "fax", "mobile", "telefon", "téléphone", "teléfono"],
}
AGAINST = ["version", "isbn", "issn", "order", "serial", "invoice", "sku", "build"]

# The patterns of the base kinds, and those of further kinds.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "nir": r"[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]) ?[0-9][0-9AB] ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local_phone": r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
}
BASE = ["email", "ip", "card", "phone"]


def _iban_pattern() -> str:
    by_length: dict[int, list[str]] = {}
    for country, length in sorted(IBAN_LENGTHS.items()):
        by_length.setdefault(length, []).append(country)
    return "(?:" + "|".join(f"(?:{'|'.join(names)})[0-9]{{2}}(?: ?[A-Z0-9]){{{length - 4}}}" for length, names in sorted(by_length.items())) + ")"


PLAIN["iban"] = _iban_pattern()
KINDS = [*BASE, "iban", "nir", "ssn", "local_phone"]

#: The patterns as the matcher runs them: the same matches, but a run of characters is entered at its start or where the
#: last match ended, and never given back, so that long runs take time in proportion and no stack.
QUICK = PLAIN | {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "iban": r"(?=[A-Z]{2}[0-9]{2})" + PLAIN["iban"],
}
#: A text without a match of this has no span of the kind; found in one look.
LOOK = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{2}",
    "nir": r"[12] ?[0-9]{2} ?[01][0-9] ?[0-9]", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "local_phone": r"[0-9]{3}[ .-][0-9]{4}",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
_IP = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
#: What must not stand right before or after a span of a further kind.
_EDGE = {"iban": (r"[A-Za-z0-9]\z", r"^[A-Za-z0-9]"), "nir": (r"[A-Za-z0-9]\z", r"^[A-Za-z0-9]"), "ssn": (r"[A-Za-z0-9.+-]\z|\+[0-9 ().-]*\z", r"^[A-Za-z0-9-]"), "local_phone": (r"[A-Za-z0-9.-]\z|\+[0-9 ().-]*\z", r"^[A-Za-z0-9-]")}
_SSN = r"^(?:000|666|9[0-9]{2})|-00-|-0000$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once; inside a lambda a column would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda total, x: total + x)


def _running(steps: Column) -> Column:
    """Running totals of an array of whole numbers."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: _total(F.slice(steps, b * BLOCK + 1, BLOCK)))
    heads = F.aggregate(blocks, F.array(F.lit(0)).cast("array<int>"), lambda got, x: F.array_append(got, F.element_at(got, -1) + x))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    return _let(heads, lambda h: F.transform(steps, lambda _, i: F.get(h, block(i)) + _total(F.slice(steps, block(i) * BLOCK + 1, i % BLOCK + 1))))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    """The remainder of an account number by 97, its first four characters last and letters as two digits."""
    bare = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4)))
    value = lambda c: F.ascii(c) - F.when(F.ascii(c) < 65, 48).otherwise(55)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda r, c: (r * F.when(F.ascii(c) < 65, 10).otherwise(100) + value(c)) % 97)


def _nir_key(match: Column) -> Column:
    """Whether the last two digits are what 97 lacks of the others; 2A and 2B stand for 19 and 18."""
    bare = F.replace(F.replace(F.replace(match, F.lit(" "), F.lit("")), F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
    return F.coalesce(97 - F.left(bare, F.lit(13)).try_cast("long") % 97 == F.right(bare, F.lit(2)).try_cast("long"), F.lit(False))


def _said(words: list[str]) -> str:
    return f"(?:^|[^a-z])(?:{'|'.join(words)})(?:[^a-z]|$)"


@dataclass(frozen=True)
class _Kind:
    """holds: what a match must be; checked: whether a checksum is passed, for kinds that have one; own: the kind's score."""

    holds: Callable[[Column], Column]
    own: float
    checked: Callable[[Column], Column] | None = None


def _sized(least: int, most: int) -> Callable[[Column], Column]:
    return lambda m: F.length(_digits(m)).between(least, most)


_RULES = {
    "email": _Kind(lambda m: F.lit(True), 0.7),
    "ip": _Kind(lambda m: m.rlike(_IP), 0.6),
    "card": _Kind(lambda m: _sized(14, 19)(m) & F.call_function("luhn_check", _digits(m)), 0.3, lambda m: F.lit(True)),
    "phone": _Kind(_sized(10, 15), 0.6),
    "iban": _Kind(lambda m: _mod97(m) == 1, 0.3, lambda m: F.lit(True)),
    "nir": _Kind(_nir_key, 0.1, lambda m: F.lit(True)),
    "ssn": _Kind(lambda m: ~m.rlike(_SSN), 0.4),
    "local_phone": _Kind(lambda m: F.lit(True), 0.4),
}


def _spans(text: Column, kind: str) -> Column:
    """The confirmed spans of one kind: an array of (start, order, end, kind, score) in code points."""
    rule, order = _RULES[kind], KINDS.index(kind)
    kept = [F.lit(order).alias("order"), F.lit(kind).alias("kind")]

    def judged(m: Column, end: Column, before: Column, after: Column) -> Column:
        near = F.concat(F.lower(F.right(before, F.lit(BEFORE))), F.lit(" \n "), F.lower(F.left(after, F.lit(AFTER))))
        holds = rule.holds(m)
        if kind in _EDGE:
            holds = holds & ~F.right(before, F.lit(BEFORE)).rlike(_EDGE[kind][0]) & ~F.left(after, F.lit(1)).rlike(_EDGE[kind][1])
        score = F.lit(rule.own) + (CHECKED if rule.checked else 0.0) + F.when(near.rlike(_said(WORDS[kind])), NEAR).otherwise(0.0) - F.when(near.rlike(_said(AGAINST)), OPPOSED).otherwise(0.0)
        score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)
        span = F.struct((end - F.length(m)).alias("start"), kept[0], end.alias("end"), kept[1], score.alias("score"))
        return F.when(holds, span)

    def placed(found: Column) -> Column:
        def cut(gaps: Column) -> Column:
            steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
            return _let(steps, lambda s: _let(_running(s), lambda ends: F.transform(found, lambda m, i: judged(m, F.get(ends, i), F.get(gaps, i), F.get(gaps, i + 1)))))

        return _let(F.split(text, QUICK[kind], -1), cut)

    kind_of = "array<struct<start:int,order:int,end:int,kind:string,score:double>>"
    spans = F.filter(_let(F.regexp_extract_all(text, F.lit(QUICK[kind]), F.lit(0)), placed), lambda s: s.isNotNull())
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= LEAST)
    return F.when(text.rlike(LOOK[kind]), spans.cast(kind_of)).otherwise(F.array().cast(kind_of))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """The personal data of docs (doc_id, text): doc_id and `found`, an array of (start, order, end, kind, score).

    start and end are code points, end exclusive; the array is sorted by start, then by the order of KINDS. Matches of a
    kind are leftmost and do not overlap each other; those that fail a check go and are not tried again. Spans of
    different kinds may overlap. score: the kind's own, plus CHECKED for a checksum, plus NEAR for a word of the kind
    nearby, less OPPOSED for a word that speaks against it, held to 0 .. 1.

    Null and empty texts have an empty array; null doc_ids stay null; repeated rows are read each; texts of any length
    are read whole, in time in proportion to their length; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    found = F.sort_array(F.concat(*[_spans(text, kind) for kind in KINDS]))
    return docs.select("doc_id", found.alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans) and spans (all of them) from find()."""
    base = F.filter("found", lambda s: s["order"] < len(BASE))
    count = lambda order: F.size(F.filter("found", lambda s: s["order"] == order)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """docs with every span of find() in its text replaced by <kind>; where spans overlap, the first one and its end count.

    Null texts stay null; texts without spans stay as they are.
    """
    text = F.coalesce("text", F.lit(""))
    found = F.sort_array(F.concat(*[_spans(text, kind) for kind in KINDS]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        parts = F.concat(state["parts"], F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.concat(F.lit("<"), s["kind"], F.lit(">"))))
        return F.when(s["start"] >= state["at"], F.struct(s["end"].alias("at"), parts.alias("parts"))).otherwise(state)

    done = F.aggregate(found, start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substr(text, s["at"] + 1)))
    return docs.withColumn("text", F.when(F.col("text").isNotNull(), done))


def _sql_kind(kind: str) -> str:
    """The confirmed spans of one kind in SQL: doc, start, stop, k."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({digits}), i, 1) AS INTEGER)
      ELSE CAST(substr(reverse({digits}), i, 1) AS INTEGER) * 2 - CASE WHEN CAST(substr(reverse({digits}), i, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
    bare = "replace(m, ' ', '')"
    number = f"replace(replace({bare}, '2A', '19'), '2B', '18')"
    turned = f"(substr({bare}, 5) || left({bare}, 4))"
    mod97 = f"list_reduce(list_prepend(0, list_transform(range(1, length({bare}) + 1), lambda i: ord(substr({turned}, i, 1)))), lambda r, c: (r * CASE WHEN c < 65 THEN 10 ELSE 100 END + c - CASE WHEN c < 65 THEN 48 ELSE 55 END) % 97)"
    holds = {
        "email": "true", "ip": f"regexp_matches(m, '{_IP}')", "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 10 AND 15",
        "iban": f"{mod97} = 1", "nir": f"coalesce(97 - TRY_CAST(left({number}, 13) AS BIGINT) % 97 = TRY_CAST(right({number}, 2) AS BIGINT), false)", "ssn": f"NOT regexp_matches(m, '{_SSN}')", "local_phone": "true",
    }[kind]
    if kind in _EDGE:
        holds += f" AND NOT regexp_matches(right(b, {BEFORE}), '{_EDGE[kind][0]}') AND NOT regexp_matches(left(a, 1), '{_EDGE[kind][1]}')"
    if kind not in BASE:
        near = f"(lower(right(b, {BEFORE})) || chr(32) || chr(10) || chr(32) || lower(left(a, {AFTER})))"
        score = f"{_RULES[kind].own + (CHECKED if _RULES[kind].checked else 0)}e0 + CASE WHEN regexp_matches({near}, '{_said(WORDS[kind])}') THEN {NEAR}e0 ELSE 0e0 END - CASE WHEN regexp_matches({near}, '{_said(AGAINST)}') THEN {OPPOSED}e0 ELSE 0e0 END"
        holds += f" AND round(greatest(0e0, least(1e0, {score})), 2) >= {LEAST}e0"
    return f"""SELECT doc_id, stop - length(m) AS start, stop, {KINDS.index(kind)} AS k, '{kind}' AS kind FROM (
  SELECT doc_id, ms[i] AS m, gs[i] AS b, gs[i + 1] AS a, list_sum(list_transform(ms[:i], lambda x: length(x))) + list_sum(list_transform(gs[:i], lambda x: length(x))) AS stop
  FROM (SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{PLAIN[kind]}') AS ms, regexp_split_to_array(t, '{PLAIN[kind]}') AS gs FROM d))) WHERE {holds}"""


def oracle() -> str:
    """The digest in SQL."""
    counts = ", ".join(f"CAST(count(*) FILTER (k = {k}) AS BIGINT) AS n_{kind}" for k, kind in enumerate(BASE))
    text = "kind || ':' || start || ':' || stop"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(_sql_kind(kind) for kind in KINDS)})
SELECT doc_id, {counts}, sha256(coalesce(string_agg({text}, ',' ORDER BY start, k) FILTER (k < {len(BASE)}), '')) AS base_sha256,
       coalesce(string_agg({text}, ',' ORDER BY start, k) FILTER (k IS NOT NULL), '') AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id"""
