"""License scans over a positional index of rare words, in DataFrame functions only.

A template is a paragraph of a public licence with its mandatory key phrases; a licence has several, so that a part of
it is found too. The corpus is asked once how many documents hold each word of the leading phrases. The words of a
leading phrase with the highest inverse document frequency are its postings. A file looks up its own licence words in
them, the rarest of each template that can be there, as the file has them all; places that agree in the relative
positions of the postings are starts, and what is left is verified word by word: the leading phrase, then the other key
phrases, each within SLACK words of where the template has it, as names and years shift what comes after them. Words of a
phrase that is there are all in the file, so none is lost, whatever the frequencies are.

A grant is a paragraph that does not name its licence, so no one phrase of it need stand. Its postings are those ANCHORS
of its words that stand once in it and have the highest inverse document frequency. Starts on which AGREE of a file's
words agree are taken; then all of the grant's short key phrases must stand within SLACK words of their places, and SHARE
percent of all its words. So a grant with a word changed, left out or put in is found. After one such change the anchors
agree on at most two starts, and AGREE or more on one of them if the grant has 2 * AGREE anchors or more.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

# Label, mandatory key phrases (the leading one first), and the paragraph, as the public licences have it.
TEMPLATES = [
    ("agpl", ["gnu affero general public license"], "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache-2.0", ["apache license version 2 0"], "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", ["apache license 2 0"], "Licensed under the Apache License 2.0"),
    ("apache-2.0", ["www apache org licenses license 2 0"], "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("artistic-2.0", ["artistic license 2 0"], "you can redistribute it and/or modify it under the terms of the Artistic License 2.0"),
    ("bsd", ["redistribution and use in source and binary forms"], "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", ["redistributions of source code must retain", "list of conditions and the following disclaimer"], "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", ["may be used to endorse or promote products", "without specific prior written permission"], "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsl-1.0", ["boost software license version 1 0"], "Distributed under the Boost Software License, Version 1.0."),
    ("cc-by-nc-4.0", ["cc by nc 4 0"], "licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", ["cc by sa 4 0"], "licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0", ["creative commons attribution sharealike 4 0"], "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-4.0", ["creative commons attribution 4 0"], "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", ["creative commons attribution noncommercial 4 0"], "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0-1.0", ["cc0 1 0 universal"], "released under CC0 1.0 Universal"),
    ("epl-2.0", ["eclipse public license", "2 0"], "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("gpl-2.0", ["gnu general public license version 2"], "licensed under the GNU General Public License, version 2"),
    ("gpl-2.0", ["gnu general public license", "free software foundation", "version 2"], "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", ["gnu general public license version 3"], "licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", ["gnu general public license", "free software foundation", "version 3"], "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", ["permission to use copy modify and or distribute this software for any purpose", "hereby granted"], "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", ["gnu lesser general public license"], "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", ["mit license"], "released under the MIT license"),
    ("mit", ["permission is hereby granted free of charge"], "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", ["the above copyright notice and this permission notice shall be included", "substantial portions of the software"], "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl-2.0", ["mozilla public license v 2 0"], "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("mpl-2.0", ["mozilla public license version 2 0"], "under the Mozilla Public License, version 2.0"),
    ("unlicense", ["free and unencumbered software"], "This is free and unencumbered software released into the public domain."),
    ("zlib", ["in no event will the authors be held liable", "arising from the use of this software"], "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", ["the origin of this software must not be misrepresented", "wrote the original software"], "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
]

# Label, mandatory key phrases, and the paragraph, of licences whose grants do not name them.
GRANTS = [
    ("bsd", ["redistribution and use", "binary forms", "conditions are met"], "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", ["redistributions of source code", "list of conditions"], "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", ["endorse or promote products", "written permission"], "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", ["permission to use", "this software for any purpose", "notice appear in all copies"], "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", ["permission is", "obtaining a copy of this software", "without restriction"], "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", ["permission notice", "substantial portions"], "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("zlib", ["in no event", "held liable", "use of this software"], "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", ["origin of this software", "original software"], "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
]

#: A grant's postings, those of them that agree on a start at least, and the percent of its words that stand near their places.
ANCHORS, AGREE, SHARE = 8, 3, 75
#: How many words the rest of a template may be shifted against its leading phrase.
SLACK = 12
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ with every separator named, which the matcher then finds in one table.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if chr(c) not in "0123456789abcdefghijklmnopqrstuvwxyz") + "]+"


def _rows(base, templates) -> list[tuple[str, list[str], list[tuple[list[str], int]], list[str], int, bool]]:
    """Label, leading phrase, the others with their distance from it, the paragraph's words, the place of the leading
    phrase there, and whether it is a base phrase."""
    made = []
    for label, keys, paragraph, is_base in [(label, [p], p, True) for label, p in base] + [(*t, False) for t in templates]:
        whole, keys = re.findall(WORD, paragraph.lower()), [k.split() for k in keys]
        places = [next(k for k in range(len(whole)) if whole[k : k + len(key)] == key) for key in keys]
        made.append((label, keys[0], [(key, at - places[0]) for key, at in zip(keys[1:], places[1:], strict=True)], whole, places[0], is_base))
    return made


def _granted(grants) -> list[tuple[str, list[tuple[list[str], int]], list[str]]]:
    """Label, key phrases with their places in the paragraph, and the paragraph's words."""
    made = []
    for label, keys, paragraph in grants:
        whole, keys = re.findall(WORD, paragraph.lower()), [k.split() for k in keys]
        made.append((label, [(key, next(k for k in range(len(whole)) if whole[k : k + len(key)] == key)) for key in keys], whole))
    return made


def _anchors(whole: list[str], frequency: dict[str, int]) -> list[tuple[int, str]]:
    """Place and word of a grant's postings; a word that no document holds could not be looked up by any."""
    once = [(frequency[w], w, k) for k, w in enumerate(whole) if whole.count(w) == 1 and frequency[w]]
    return [(k, w) for _, w, k in sorted(once)[:ANCHORS]]


def _words() -> Column:
    # lower() also maps letters beyond ASCII, always to letters that are words' parts too
    return F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))


def _is(at: Column, word: Column) -> Column:
    return F.coalesce((at >= 0) & (F.get("_words", at) == word), F.lit(False))


def _stands(phrase: Column, at: Column) -> Column:
    """Whether the file has the phrase at this place; single words are looked up, as a slice reads the whole file."""
    return ~F.exists(F.transform(phrase, lambda w, k: _is(at + k, w)), lambda same: ~same)


def _near(stands) -> Column:
    return F.exists(F.array(*map(F.lit, range(-SLACK, SLACK + 1))), stands)


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of the vocabulary stands; one row a word reaches the driver."""
    known = F.array(*map(F.lit, vocabulary))
    held = docs.select(F.explode(F.array_intersect(_words(), known)).alias("word"))
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


_text = lambda words: F.split(F.lit(" ".join(words)), " ")
_places = lambda pairs: F.array(*[F.struct(_text(key).alias("key"), F.lit(d).alias("d")) for key, d in pairs])
_SPANS = "array<struct<label:string,start:bigint,length:bigint,share:double,base:boolean>>"


def _index(rare: list[list[tuple[int, str]]]) -> tuple[list[str], Column]:
    """The words of the postings (place and word, for each phrase), and word -> array of (phrase, at)."""
    postings: dict[str, list[Column]] = {}
    for number, places in enumerate(rare):
        for at, word in places:
            postings.setdefault(word, []).append(F.struct(F.lit(number).alias("phrase"), F.lit(at).alias("at")))
    return list(postings), F.create_map(*[x for word, found in postings.items() for x in (F.lit(word), F.array(*found))])


def _near_share(whole: Column, first: Column) -> Column:
    return F.size(F.filter(whole, lambda w, k: _near(lambda e: _is(first + k + e, w)))) / F.size(whole)


def _grant_spans(found: DataFrame, rows, frequency: dict[str, int]) -> DataFrame:
    """found (_words, ...) with _granted, the spans of grants."""
    rare = [_anchors(whole, frequency) for *_, whole in rows]
    words, index = _index(rare)
    if not words:
        return found.withColumn("_granted", F.array().cast(_SPANS))
    of = lambda values, x: F.get(F.array(*values), x["phrase"])
    wanted = F.array(*[F.struct(F.lit(number).alias("phrase"), _text(w for _, w in places).alias("words")) for number, places in enumerate(rare)])
    enough = lambda x: F.size(F.array_intersect(x["words"], F.col("_known"))) >= AGREE
    found = found.withColumn("_known", F.array_intersect("_words", F.array(*map(F.lit, words))))
    found = found.withColumn("_possible", F.when(F.size("_known") >= AGREE, F.transform(F.filter(wanted, enough), lambda x: x["phrase"])))
    held = F.filter(F.transform("_words", lambda w, k: F.struct(w.alias("w"), k.alias("k"))), lambda x: x["w"].isin(words))
    look_up = lambda x: F.filter(index[x["w"]], lambda p: F.array_contains("_possible", p["phrase"]))
    starts = F.transform(held, lambda x: F.transform(look_up(x), lambda p: F.struct(p["phrase"].alias("phrase"), (x["k"] - p["at"]).alias("start"))))
    found = found.withColumn("_starts", F.sort_array(F.flatten(F.when(F.size("_possible") > 0, starts)))).drop("_known", "_possible")
    # an anchor proposes a start once, so agreement is a run of equal proposals
    same = lambda x, k: F.coalesce(F.get("_starts", k) == x, F.lit(False))
    agreed = F.filter("_starts", lambda x, k: ~same(x, k - 1) & same(x, k + AGREE - 1))
    missing = lambda x: F.exists(of([_places(keys) for _, keys, _ in rows], x), lambda o: ~_near(lambda e: _stands(o["key"], x["start"] + o["d"] + e)))
    kept = F.filter(agreed, lambda x: ~missing(x))
    spans = F.transform(
        kept,
        lambda x: F.struct(
            of([F.lit(label) for label, *_ in rows], x).alias("label"),
            F.greatest(x["start"], F.lit(0)).cast("long").alias("start"),
            of([F.lit(len(whole)) for *_, whole in rows], x).cast("long").alias("length"),
            _near_share(of([_text(whole) for *_, whole in rows], x), x["start"]).alias("share"),
            F.lit(False).alias("base"),
        ),
    )
    return found.withColumn("_granted", F.coalesce(F.filter(spans, lambda x: x["share"] >= SHARE / 100), F.array().cast(_SPANS))).drop("_starts")


def scan_licenses(docs: DataFrame, base=tuple(BASE), templates=tuple(TEMPLATES), grants=tuple(GRANTS), rarest: int = 3) -> DataFrame:
    """Find base phrases and licences in docs (doc_id, text).

    Returns doc_id, n_words, n_base (places of base phrases), first_word and last_word (smallest and largest start of
    one, words from 0, else null), base_labels and labels (distinct, sorted, comma-joined, else empty), spans (an array
    of label, start and length of the leading phrase, share and base, where share is the part of the template's words
    that stand within SLACK words of their places) and score (the largest share, else 0). A template is found where its
    leading phrase stands with all its other key phrases near. A grant's span is its whole paragraph, one for each start on
    which its words agree, from 0 if its head is cut off. Null texts have no words; repeated rows are scanned each;
    an empty table gives no rows; other columns are ignored. Texts may be of any length that a row can hold; work grows
    with their words. Every document is read within its row: nothing is shuffled but one count a word.
    """
    rows, granted = _rows(base, templates), _granted(grants)
    frequency = document_frequency(docs, sorted({w for _, key, *_ in rows for w in key} | {w for *_, whole in granted for w in whole}))
    rare = [sorted(enumerate(key), key=lambda x: (frequency[x[1]], x[1], x[0]))[:rarest] for _, key, *_ in rows]
    postings, index = _index(rare)
    of = lambda values, x: F.get(F.array(*values), x["phrase"])
    numbers = lambda values: [F.lit(v) for v in values]
    keys, wholes = [_text(key) for _, key, *_ in rows], [_text(whole) for _, _, _, whole, _, _ in rows]
    others = [_places(rest) if rest else F.array().cast("array<struct<key:array<string>,d:int>>") for _, _, rest, *_ in rows]

    # the file's own licence words, and the templates whose rarest words are all among them
    read = docs.select("doc_id", _words().alias("_words"))
    held = F.filter(F.transform("_words", lambda w, k: F.struct(w.alias("w"), k.alias("k"))), lambda x: x["w"].isin(postings))
    found = _grant_spans(read, granted, frequency)
    found = found.withColumn("_rare", F.when(F.arrays_overlap("_words", F.array(*map(F.lit, postings))), held))
    found = found.withColumn("_held", F.array_distinct(F.transform("_rare", lambda x: x["w"])))
    all_held = lambda words: F.size(F.array_except(words, F.col("_held"))) == 0
    needed = F.array(*[F.struct(F.lit(number).alias("phrase"), _text(sorted({w for _, w in places})).alias("words")) for number, places in enumerate(rare)])
    found = found.withColumn("_possible", F.when(F.size("_rare") > 0, F.transform(F.filter(needed, lambda x: all_held(x["words"])), lambda x: x["phrase"])))

    look_up = lambda x: F.filter(index[x["w"]], lambda p: F.array_contains("_possible", p["phrase"]))
    proposed = F.transform("_rare", lambda x: F.transform(look_up(x), lambda p: F.struct(p["phrase"].alias("phrase"), (x["k"] - p["at"]).alias("start"))))
    found = found.withColumn("_proposed", F.sort_array(F.flatten(F.when(F.size("_possible") > 0, proposed)))).drop("_rare", "_held", "_possible")
    same = lambda x, k: F.coalesce(F.get("_proposed", k) == x, F.lit(False))
    # a phrase's postings propose a start once each, so agreement is a run of equal proposals
    agreed = F.filter(
        "_proposed",
        lambda x, k: (x["start"] >= 0) & ~same(x, k - 1) & same(x, k + of(numbers(map(len, rare)), x) - 1),
    )
    led = F.filter(agreed, lambda x: _stands(of(keys, x), x["start"]))
    missing = lambda x: F.exists(of(others, x), lambda o: ~_near(lambda e: _stands(o["key"], x["start"] + o["d"] + e)))
    found = found.withColumn("_verified", F.filter(led, lambda x: ~missing(x))).drop("_proposed")

    share = lambda x: _near_share(of(wholes, x), x["start"] - of(numbers([at for *_, at, _ in rows]), x))
    is_base = lambda x: of(numbers([is_base for *_, is_base in rows]), x)
    spans = F.transform(
        "_verified",
        lambda x: F.struct(
            of(numbers([label for label, *_ in rows]), x).alias("label"),
            x["start"].cast("long").alias("start"),
            of(numbers([len(key) for _, key, *_ in rows]), x).cast("long").alias("length"),
            F.when(is_base(x), 1.0).otherwise(share(x)).alias("share"),
            is_base(x).alias("base"),
        ),
    )
    found = found.select("doc_id", F.size("_words").cast("long").alias("n_words"), F.concat(F.coalesce(spans, F.array().cast(_SPANS)), "_granted").alias("spans"))
    found = found.withColumn("_base", F.filter("spans", lambda x: x["base"]))
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")
    return found.select(
        "doc_id", "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda x: x["start"])).alias("last_word"),
        joined("_base").alias("base_labels"),
        joined("spans").alias("labels"),
        "spans",
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )


def oracle(base=tuple(BASE), templates=tuple(TEMPLATES), grants=tuple(GRANTS)) -> str:
    """DuckDB SQL with scan_licenses()' columns but spans: every phrase and every grant is looked for at every place."""
    words = lambda w: f"string_split('{' '.join(w)}', ' ')"
    rest = lambda others: f"CAST([{', '.join(f'{{phrase: {words(key)}, d: {d}}}' for key, d in others)}] AS STRUCT(phrase VARCHAR[], d INTEGER)[])"
    values = ",\n".join(f"('{label}', {words(key)}, {rest(others)}, {words(whole)}, {at}, {is_base})" for label, key, others, whole, at, is_base in _rows(base, templates))
    paragraphs = ",\n".join(f"({k}, '{label}', {rest(keys)}, {words(whole)})" for k, (label, keys, whole) in enumerate(_granted(grants)))
    return rf"""
WITH q(number, label, keys, whole) AS (VALUES {paragraphs}),
p(label, key, others, whole, lead, base) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM d),
led AS (SELECT w.doc_id, k, ws, p.* FROM w JOIN p ON w.word = key[1] JOIN d ON d.doc_id = w.doc_id WHERE ws[k : k + len(key) - 1] = key),
hit AS (SELECT * FROM led WHERE len(list_filter(others, lambda o: len(list_filter(range(-{SLACK}, {SLACK + 1}), lambda e:
          k + o.d + e >= 1 AND ws[k + o.d + e : k + o.d + e + len(o.phrase) - 1] = o.phrase)) = 0)) = 0),
f AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(ws)) AS word FROM d) GROUP BY word),
once AS (SELECT number, word, min(i) AS place FROM (SELECT number, unnest(whole) AS word, unnest(range(len(whole))) AS i FROM q) GROUP BY number, word HAVING count(*) = 1),
anchor AS (SELECT number, word, place FROM once JOIN f USING (word) QUALIFY row_number() OVER (PARTITION BY number ORDER BY df, word) <= {ANCHORS}),
agreed AS (SELECT w.doc_id, number, k - place AS k FROM w JOIN anchor USING (word) GROUP BY ALL HAVING count(*) >= {AGREE}),
granted AS (SELECT agreed.doc_id, label, len(list_filter(range(len(whole)), lambda i: k + i + {SLACK} >= 1
              AND list_contains(ws[greatest(k + i - {SLACK}, 1) : k + i + {SLACK}], whole[i + 1]))) / len(whole) AS share
            FROM agreed JOIN q USING (number) JOIN d ON d.doc_id = agreed.doc_id
            WHERE len(list_filter(keys, lambda o: len(list_filter(range(-{SLACK}, {SLACK + 1}), lambda e:
                    k + o.d + e >= 1 AND ws[k + o.d + e : k + o.d + e + len(o.phrase) - 1] = o.phrase)) = 0)) = 0),
s AS (SELECT doc_id, label, false AS base, NULL AS start, share FROM granted WHERE share >= {SHARE / 100}
      UNION ALL
      SELECT doc_id, label, base, k - 1 AS start,
             CASE WHEN base THEN 1e0 ELSE len(list_filter(range(1, len(whole) + 1), lambda i: k - lead + i - 1 + {SLACK} >= 1
               AND list_contains(ws[greatest(k - lead + i - 1 - {SLACK}, 1) : k - lead + i - 1 + {SLACK}], whole[i]))) / len(whole) END AS share FROM hit),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
             max(share) AS score FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0e0) AS score
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
