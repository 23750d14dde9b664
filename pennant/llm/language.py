"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies cover all labelled training documents, counted in Spark; the weights are fitted on a bounded sample
by follow-the-regularised-leader with elastic-net penalties, then a temperature is fitted on the part of the sample
that the weights have not seen. Prediction runs over whole texts in tasks that get the weights by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pennant.llm.common import id_in, id_out

#: n-grams of one to ORDERS characters fall into 2 ** BITS buckets.
ORDERS, BITS = 3, 15
_MIX = np.uint32(0x9E3779B1)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the n-grams of a text, lower-cased, with runs of ASCII non-letters as one blank."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = (chars > 127) | ((chars >= 97) & (chars <= 122))
    chars = np.where(letter, chars, np.uint32(32))
    kept = letter.copy()
    kept[:1] = True
    kept[1:] |= letter[:-1]
    chars = chars[kept]
    total = np.zeros(1 << BITS, np.int64)
    mixed = np.zeros(len(chars), np.uint32)
    for order in range(1, ORDERS + 1):
        if len(chars) < order:
            break
        mixed = (mixed[: len(chars) - order + 1] + chars[order - 1 :] + np.uint32(order)) * _MIX
        mixed = mixed ^ (mixed >> np.uint32(15))
        total += np.bincount(mixed & np.uint32((1 << BITS) - 1), minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at, total[at]


class Model:
    """Weights over buckets, classes in sorted order, inverse document frequencies and a temperature."""

    def __init__(self, classes: list[str], idf: np.ndarray, alpha=0.5, beta=1.0, l1=0.002, l2=0.002):
        self.classes, self.idf, self.temperature = classes, idf.astype(np.float32), 1.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.weights = np.zeros((len(idf), len(classes)), np.float32)

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def fit(self, samples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 3, seed: int = 7) -> None:
        """Follow-the-regularised-leader (proximal, per-coordinate rates) over (buckets, counts, class)."""
        z = np.zeros(self.weights.shape)
        n = np.zeros(self.weights.shape)
        vectors = [(at, self.vector(at, counts), label) for at, counts, label in samples]
        leader = lambda z, n: np.where(np.abs(z) <= self.l1, 0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in order.permutation(len(vectors)):
                at, x, label = vectors[k]
                w = leader(z[at], n[at])
                error = _softmax(x @ w)
                error[label] -= 1
                g = x[:, None] * error
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / self.alpha * w
                n[at] += g * g
        self.weights = leader(z, n).astype(np.float32)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(at, counts) @ self.weights[at]

    def calibrate(self, samples: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        """The temperature with the least log loss, by golden-section search over its logarithm."""
        if not samples:
            return
        logits = np.array([self.logits(at, counts) for at, counts, _ in samples])
        labels = np.array([label for *_, label in samples])

        def loss(log_t: float) -> float:
            scaled = logits / np.exp(log_t)
            top = scaled.max(1)
            return float(np.mean(top + np.log(np.exp(scaled - top[:, None]).sum(1)) - scaled[np.arange(len(labels)), labels]))

        lo, hi, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
        while hi - lo > 1e-3:
            a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
            lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
        self.temperature = float(np.exp((lo + hi) / 2))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(class, probability); `und` where there is no letter or nothing was learned."""
        if not text or not self.classes or not any(map(str.isalpha, text)):
            return "und", 0.0
        p = _softmax(self.logits(*ngram_counts(text)).astype(np.float64) / self.temperature)
        best = int(p.argmax())
        return self.classes[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def _document_frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for text in batch["text"]:
            total[ngram_counts(text)[0]] += 1
    at = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": at, "df": total[at]})


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = [ngram_counts(text) for text in batch["text"]]
        yield pd.DataFrame({
            "lang": batch["lang"], "unseen": batch["unseen"],
            "at": [at.astype("<u2").tobytes() for at, _ in made], "counts": [c.astype("<u4").tobytes() for _, c in made],
        })


def train(labelled: DataFrame, per_class: int = 500, unseen_share: float = 0.2) -> Model:
    """Fit a model on labelled (doc_id, text, lang), all without nulls.

    Document frequencies are over all rows. Weights and temperature come from about `per_class` documents of each
    class, chosen by a hash of doc_id: the only sample, and the only texts whose counts reach the driver.
    """
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a class
    n = sum(sizes.values())
    frequency = np.zeros(1 << BITS)
    for bucket, df in labelled.select("text").mapInPandas(_document_frequency, "bucket long, df long").groupBy("bucket").agg(F.sum("df")).collect():
        frequency[bucket] = df  # one row a bucket at most
    model = Model(sorted(sizes), np.log((1 + n) / (1 + frequency)) + 1)
    if not sizes:
        return model
    share = F.create_map(*[x for lang, size in sizes.items() for x in (F.lit(lang), F.lit(per_class / size))])
    draw = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(draw(1) < share[F.col("lang")]).select("lang", (draw(2) < unseen_share).alias("unseen"), "text")
    rows = sample.mapInPandas(_counted, "lang string, unseen boolean, at binary, counts binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["at"], r["counts"]))
    number = {lang: k for k, lang in enumerate(model.classes)}
    parsed = [(r["unseen"], np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<u4").astype(np.int64), number[r["lang"]]) for r in rows]
    model.fit([x[1:] for x in parsed if not x[0]] or [x[1:] for x in parsed])
    model.calibrate([x[1:] for x in parsed if x[0]])
    return model


def held_out(third: int = 1) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is `third`."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == third, F.lit(False))


def identify(docs: DataFrame, model: Model | None = None, per_class: int = 500) -> DataFrame:
    """Predict the language of docs (doc_id, text, lang) from their texts.

    Without a model, one is trained on the rows with non-null doc_id, text and lang that are not held_out(). Returns
    doc_id, text_hash (64 bits, to tell rows with one doc_id apart), held_out, lang_pred (a learned lang, or `und` with score 0 for texts that are null or have no letter, or if
    nothing was learned) and score, the calibrated probability; of equal probabilities the first lang in sorted order
    counts. Repeated rows are predicted each; an empty table gives no rows; a very long text takes about 30 times its
    characters in its task; other columns are ignored.
    """
    if model is None:
        known = F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()
        model = train(docs.where(known & ~held_out()).select("doc_id", "text", "lang"), per_class)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # 2 ** BITS weights a class

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learned = Model([], np.zeros(0))
        vars(learned).update(shared.value)
        for batch in batches:
            found = [learned.predict(text) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "held_out": batch["held_out"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    read = docs.select(id_in(), F.xxhash64("text").alias("text_hash"), held_out().alias("held_out"), "text")
    return read.mapInPandas(run, "doc_id long, text_hash long, held_out boolean, lang_pred string, score double").withColumn("doc_id", id_out())
