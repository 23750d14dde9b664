"""Near-duplicate documents by SuperMinHash: signatures, banding, exact verification, connected groups.

Documents with equal shingle sets are one class from the start, so copies cost one comparison with their class. Classes
that share a band of their signatures lie in one bucket. Each is first verified on full sets against the first of its
buckets, and the links found are closed. Only classes that are then still apart from the first of a bucket are held
against the bucket's other members: pair by pair in a small bucket, in blocks of bounded size in a large one. So nothing
is closed over that was not verified, and a large group costs a few comparisons a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pennant.llm.common import components, drop, id_in, id_out, small, written

#: BANDS bands of ROWS values: a pair of similarity 0.75 shares a band but for one case in 40,000.
BANDS, ROWS = 28, 4
#: Members of a bucket that are compared pair by pair at most, and at once in a larger one.
FEW, BLOCK = 32, 512
#: Rows of a few numbers (40 bytes at most) that are broadcast at most; more are shuffled.
NARROW_ROWS = 500_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values stirred so that equal ones stay equal and others look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles as sorted arrays of distinct 64-bit hashes."""

    def __init__(self, words: int = 5):
        self.words = words
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) <= size:
            step = np.full(2 * size + 1024, _BASE, np.uint64)
            back = np.full(len(step), pow(_BASE, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            self.powers, self.inverses = np.multiply.accumulate(step), np.multiply.accumulate(back)

    def hashes(self, text: str | None) -> np.ndarray:
        """The set of a text: lower-case ASCII, words between blanks; fewer words than a shingle has are one shingle."""
        raw = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.zeros(0, np.uint64)
        self._grow(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], out=sums[1:])
        words = mixed((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64) * _ODD)
        width = min(self.words, len(words))
        count = len(words) - width + 1
        joined = np.full(count, width, np.uint64)
        for k in range(width):
            joined = mixed(joined * _ODD + words[k : k + count])
        return np.unique(joined)


def signatures(sets: list[np.ndarray], slots: int, at_once: int = 100_000) -> np.ndarray:
    """SuperMinHash of each set: a row of `slots` values, equal in a share of places that estimates the similarity.

    Every element deals out a random permutation of the slots, one more of its ranks in each step; a slot keeps the
    least rank plus fraction. A set is done when no slot could still get a lower rank, which for large sets is soon.
    Slots keep minima, so large sets are taken `at_once` elements at a time.
    """
    result = np.full((len(sets), slots), np.inf)
    flat = result.ravel()
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    seeds = np.concatenate([*sets, np.zeros(0, np.uint64)])
    for first in range(0, len(seeds), at_once):
        owner, seed = owners[first : first + at_once], seeds[first : first + at_once]
        order = np.tile(np.arange(slots, dtype=np.uint8 if slots < 256 else np.uint16), (len(seed), 1))
        for step in range(slots):
            going = (result.max(1) > step)[owner]
            if not going.all():
                owner, seed, order = owner[going], seed[going], order[going]
            if not len(seed):
                break
            draw = mixed(seed + np.uint64((step + 1) * int(_ODD) % (1 << 64)))
            fraction = (draw >> np.uint64(32)).astype(np.float64) / 2.0**32
            other = step + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - step) >> np.uint64(32)).astype(np.int64)
            row = np.arange(len(seed))
            slot = order[row, other].astype(np.int64)
            order[row, other] = order[:, step]
            at = owner * slots + slot
            better = flat[at] > step
            np.minimum.at(flat, at[better], step + fraction[better])
    return result


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    values = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), values.shape[:2]).copy()
    for k in range(ROWS):
        keys = mixed(keys * _ODD + values[:, :, k])
    return keys.view(np.int64)


def _signed(chunk_shingles: int = 100_000):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            ids, texts = batch["doc_id"].to_numpy(), batch["text"].to_numpy()
            start, sets, held = 0, [], 0
            for k in range(len(ids)):
                sets.append(shingler.hashes(texts[k]))
                held += len(sets[-1])
                if held >= chunk_shingles or k == len(ids) - 1:
                    keys = band_keys(signatures(sets, BANDS * ROWS))
                    yield pd.DataFrame({
                        "doc_id": ids[start : k + 1], "h": batch["h"].to_numpy()[start : k + 1], "n_shingles": [len(s) for s in sets],
                        "f1": [int(mixed(s).sum(dtype=np.uint64).view(np.int64)) for s in sets],
                        "f2": [int(mixed(s ^ _ODD).sum(dtype=np.uint64).view(np.int64)) for s in sets],
                        "bands": list(keys),
                    })
                    start, sets, held = k + 1, [], 0

    return run


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingler = Shingler()
    for batch in batches:
        yield batch.drop(columns="text").assign(shingles=[shingler.hashes(text).view(np.int64) for text in batch["text"]])


def common_counts(left: list[np.ndarray], right: list[np.ndarray], chunk: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right sets."""
    sizes = [len(s) for s in left], [len(s) for s in right]
    values, place = np.unique(np.concatenate([*left, *right, np.zeros(0, np.uint64)]), return_inverse=True)
    split = sum(sizes[0])
    sides = [(np.repeat(np.arange(len(n)), n), part) for n, part in zip(sizes, (place[:split], place[split:]), strict=True)]
    both = np.bincount(sides[0][1], minlength=len(values)).astype(bool) & np.bincount(sides[1][1], minlength=len(values)).astype(bool)
    number = np.cumsum(both) - 1
    total = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2 ** 24
    kept = [(owner[both[part]], number[part[both[part]]]) for owner, part in sides]
    for first in range(0, int(both.sum()), chunk):
        tables = []
        for (owner, part), n in zip(kept, (len(left), len(right)), strict=True):
            here = (part >= first) & (part < first + chunk)
            table = np.zeros((n, chunk), np.float32)
            table[owner[here], part[here] - first] = 1
            tables.append(table)
        total += tables[0] @ tables[1].T
    return total.astype(np.int64)


def _similar(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    common = common_counts(left, right)
    union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None] - common
    return np.nonzero((100 * common >= percent * union) & (union > 0))


def _spanning(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Links from members to the least of their group, for links between the places a and b of ids (ascending)."""
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    linked = label != np.arange(len(ids))
    return pd.DataFrame({"a": ids[label[linked]], "b": ids[linked]})


def _compare(percent: int):
    """Links between the two sides of a block, members of a bucket and those of them that are still apart."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        sets = [x.view(np.uint64) for x in group["shingles"]]
        left, right = np.flatnonzero(group["apart"] == 0), np.flatnonzero(group["apart"] == 1)
        a, b = _similar([sets[k] for k in left], [sets[k] for k in right], percent)
        return _spanning(group["id"].to_numpy(), left[a], right[b])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of pairs whose full sets are similar enough."""
    pairs = written(pairs, "pairs")
    one = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")).join(small(pairs, NARROW_ROWS), "b")
    both = one.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    done = written(both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "links")
    drop(pairs)
    return done


def _apart(buckets: DataFrame, reached: DataFrame) -> DataFrame:
    """buckets (band, id, a, n) with each member's root and whether it is in another group than the first, as a table."""
    root = reached.select(F.col("id").alias("a"), F.col("component").alias("root_a"))
    rooted = buckets.join(reached, "id", "left").join(root, "a", "left")
    rooted = rooted.select("band", "id", "a", "n", F.coalesce("component", "id").alias("root"), F.coalesce("root_a", "a").alias("root_a"))
    return written(rooted.withColumn("apart", F.col("root") != F.col("root_a")), "rooted")


def _in_small(rooted: DataFrame) -> DataFrame:
    """(a, b) to compare in buckets of FEW members at most."""
    one = rooted.where(F.col("apart") & F.col("n").between(3, FEW)).select("band", "id", "root")
    all_ = rooted.where("a <> id").select("band", F.col("id").alias("other"), F.col("root").alias("root_o"))
    met = one.join(all_, "band").where("root <> root_o")
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _in_large(rooted: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links in larger buckets, by blocks of members and of those that are apart."""
    counts = rooted.where(F.col("n") > FEW).groupBy("band").agg(F.ceil(F.max("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if("apart") / BLOCK).cast("int").alias("others"))
    counts = written(counts.where("others > 0"), "counts")
    dealt = rooted.select("band", "id", "apart").join(small(counts), "band").join(sets, "id")
    place = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    members = dealt.select("band", place("blocks").alias("block"), every("others").alias("other"), F.lit(0).alias("apart"), "id", "shingles")
    others = dealt.where("apart").select("band", every("blocks").alias("block"), place("others").alias("other"), F.lit(1).alias("apart"), "id", "shingles")
    return members.unionByName(others).groupBy("band", "block", "other").applyInPandas(_compare(percent), "a long, b long")


def text_hash() -> Column:
    """Tells texts of rows with the same doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Groups of docs (doc_id, text) whose sets of five-word shingles have at least `percent` of their union in common.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept (doc_id = component_id).
    Links hold on full sets, none is below `percent`; one at 0.75 goes unseen with probability 2.4e-5, closer ones less.
    Null texts and texts without words have an empty set and link with nothing; rows are one node if their sets are
    equal, whatever their doc_id; a null doc_id stays null and comes before all others; an empty table gives no rows;
    a very long text takes about 40 times its bytes in its task; other columns are ignored.
    """
    out = _grouped(docs, percent)
    return out.select(id_out(), "n_shingles", id_out("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def first_rows(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id (see id_in()), h (the text_hash()) and kept of each row of docs, as in near_duplicates().

    kept holds for the rows of one (doc_id, h) in each group, the smallest, and for all with an empty set.
    """
    return _grouped(docs, percent).select("doc_id", "h", ((F.col("doc_id") == F.col("component_id")) & (F.col("h") == F.col("first_h"))).alias("kept"))


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, h and n_shingles of each row, and component_id and first_h, the smallest (doc_id, h) of its group."""
    read = docs.select(id_in(), "text", text_hash().alias("h"))
    signed = written(read.mapInPandas(_signed(), "doc_id long, h long, n_shingles long, f1 long, f2 long, bands array<long>"), "signatures")
    full = signed.where("n_shingles > 0")
    same_set = ["n_shingles", "f1", "f2"]
    # a class is named by its set, as several may share a doc_id
    classes = written(full.groupBy(same_set).agg(F.xxhash64(*same_set).alias("id"), F.min(F.struct("doc_id", "h")).alias("row"), F.first("bands").alias("bands")), "classes")

    # buckets, each with its first class
    placed = classes.select("id", F.explode("bands").alias("band"))
    first = placed.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    buckets = written(placed.join(first, "band"), "buckets")
    members = written(buckets.select("id").distinct().join(classes.select("id", "row.*"), "id"), "members")

    # their sets, from the whole texts again
    texts = read.join(small(members, NARROW_ROWS), ["doc_id", "h"]).select("id", "text")
    sets = written(texts.mapInPandas(_sets, "id long, shingles array<long>").dropDuplicates(["id"]), "sets")
    links = _verified(buckets.where("a <> id").select("a", F.col("id").alias("b")).distinct(), sets, percent)
    reached = components(links)
    rooted = _apart(buckets, reached)
    if not rooted.where("apart and n > 2").isEmpty():
        few = _verified(_in_small(rooted), sets, percent)
        links = written(links.unionByName(few).unionByName(_in_large(rooted, sets, percent)), "links")
        reached = components(links)
    drop(buckets, members, sets, rooted)
    known = classes.join(reached, "id", "left").select(*same_set, "row", F.coalesce("component", "id").alias("component"))
    firsts = known.groupBy("component").agg(F.min("row").alias("first"))
    named = known.drop("row").join(firsts, "component").select(*same_set, "first")
    return signed.join(named, same_set, "left").select("doc_id", "h", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"), F.coalesce("first.h", "h").alias("first_h"))
