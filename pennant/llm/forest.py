"""Embedding near-duplicates by a forest of random-projection trees with spill.

The upper splits of each tree are fitted on a bounded sample: a node is split along the random direction and threshold
that leave the fewest rows near the seam, and rows near it go to both sides. All rows are routed through them; leaves
that then still hold too many rows are split again in Spark, along random directions at the median of their own rows, so
that leaves have the same size whatever the number of rows. Rows that share a leaf and a label are compared in double
precision, and a pair that meets in several leaves is counted in the first one only. Leaves no direction can part, such
as a dense group, are compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pennant.llm.common import components, drop, small, written

#: Rows compared at once on each side of a block, and directions tried to split a leaf in Spark.
BLOCK, TRIES = 1024, 4


class Tree:
    """Splits as arrays; a negative child is a leaf, numbered from -1 down."""

    def __init__(self):
        self.planes: list[np.ndarray] = []
        self.thresholds: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0

    def grow(self, points: np.ndarray, leaf_rows: int, spill: float, random: np.random.Generator, tries: int = 12) -> int:
        """Add the node for these sample points; returns its number."""
        if len(points) > leaf_rows:
            planes = random.standard_normal((tries, points.shape[1]))
            planes /= np.linalg.norm(planes, axis=1, keepdims=True)
            at = np.sort(points @ planes.T, axis=0)
            best = (1.0, 0, 0.0)
            for quantile in np.linspace(0.3, 0.7, 9):
                threshold = at[int(quantile * (len(at) - 1))]
                near = (np.abs(at - threshold) < spill).mean(0)
                k = int(near.argmin())
                best = min(best, (float(near[k]), k, float(threshold[k])))
            if best[0] < 0.5:
                node = len(self.planes)
                self.planes.append(planes[best[1]])
                self.thresholds.append(best[2])
                self.children.append([0, 0])
                along = points @ planes[best[1]]
                self.children[node] = [
                    self.grow(points[along < best[2] + spill], leaf_rows, spill, random, tries),
                    self.grow(points[along > best[2] - spill], leaf_rows, spill, random, tries),
                ]
                return node
        self.leaves += 1
        return -self.leaves

    def route(self, points: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that each point falls into."""
        waiting = [(0 if self.planes else -1, np.arange(len(points)))]
        rows, leaves = [], []
        while waiting:
            node, inside = waiting.pop()
            if node < 0:
                rows.append(inside)
                leaves.append(np.full(len(inside), -node - 1))
            elif len(inside):
                along = points[inside] @ self.planes[node][: points.shape[1]]
                waiting.append((self.children[node][0], inside[along < self.thresholds[node] + spill]))
                waiting.append((self.children[node][1], inside[along > self.thresholds[node] - spill]))
        return np.concatenate(rows), np.concatenate(leaves)


def plant(sample: np.ndarray, share: float, trees: int, spill: float, leaf_rows: int, seed: int) -> list[Tree]:
    """Trees on unit vectors that are a `share` of all rows, for leaves of about `leaf_rows` rows of the whole.

    A leaf has eight rows of the sample at least, so more of the whole where the share is small.
    """
    made = []
    for number in range(trees):
        tree = Tree()
        tree.grow(sample, max(8, int(leaf_rows * share)), spill, np.random.default_rng([seed, number]))
        made.append(tree)
    return made


def _unit(vectors: list) -> np.ndarray:
    points = np.array([np.asarray(v, np.float64) for v in vectors])
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def _routed(forest: list[tuple], spill: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = []
        for state in forest:
            tree = Tree()
            tree.planes, tree.thresholds, tree.children, tree.leaves = state
            trees.append(tree)
        for batch in batches:
            for size, same in batch.groupby(batch["embedding"].map(len)):
                points = _unit(same["embedding"].tolist())
                dims = max([size, *(len(t.planes[0]) for t in trees if t.planes)])
                points = np.pad(points, ((0, 0), (0, dims - size)))[:, : max(1, *(len(t.planes[0]) if t.planes else 1 for t in trees))]
                parts = [tree.route(points, spill) for tree in trees]
                rows = np.concatenate([r for r, _ in parts])
                codes = np.concatenate([(number << 32) + leaf for number, (_, leaf) in enumerate(parts)])
                order = np.lexsort((codes, rows))
                rows, codes = rows[order], codes[order]
                ends = np.searchsorted(rows, np.arange(len(same) + 1))
                own = [codes[a:b].tolist() for a, b in zip(ends, ends[1:])]
                yield pd.DataFrame({"id": same["id"], "label": same["label"], "code": own})

    return run


def _compare(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        here, first, second = (int(group[c].iloc[0]) for c in ("code", "block", "other"))
        own = group["own"].to_numpy()
        left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
        ids, times = group["id"].to_numpy(), group["times"].to_numpy()
        counts, label = np.zeros(len(group), np.int64), np.arange(len(group))
        size = group["embedding"].map(len).to_numpy()
        codes = group["codes"].tolist()
        table = np.full((len(group), max(map(len, codes))), -1, np.int64)
        for k, c in enumerate(codes):
            table[k, : len(c)] = c
        pairs = []
        for dims in np.unique(size):
            l, r = left[size[left] == dims], right[size[right] == dims]
            if len(l) and len(r):
                a, b = np.nonzero(_unit(group["embedding"].iloc[l].tolist()) @ _unit(group["embedding"].iloc[r].tolist()).T >= threshold)
                a, b = l[a], r[b]
                pairs.append((a[a < b], b[a < b]) if first == second else (a, b))
        for a, b in pairs:
            for start in range(0, len(a), 100_000):
                p, q = a[start : start + 100_000], b[start : start + 100_000]
                shared = np.full(len(p), np.iinfo(np.int64).max)
                for k in range(table.shape[1]):
                    mine = table[p, k]
                    met = (table[q] == mine[:, None]).any(1) & (mine >= 0)
                    shared = np.where(met, np.minimum(shared, mine), shared)
                counted = shared == here
                np.add.at(counts, p[counted], times[q[counted]])
                np.add.at(counts, q[counted], times[p[counted]])
            while True:
                low = label.copy()
                np.minimum.at(low, a, label[b])
                np.minimum.at(low, b, label[a])
                low = low[low]
                if (low == label).all():
                    break
                label = low
        told = (counts > 0) | (label != np.arange(len(label)))
        return pd.DataFrame({"id": ids[told], "links": counts[told], "root": ids[label[told]]})

    return run


def _projected(seed: int, level: int):
    """Each row's places along its leaf's directions of this level."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (code, size), same in batch.groupby(["code", batch["embedding"].map(len)]):
                planes = np.random.default_rng([seed, level, int(code) & 0xFFFFFFFF, int(code) >> 32 & 0xFFFFFFFF]).standard_normal((TRIES, int(size)))
                planes /= np.linalg.norm(planes, axis=1, keepdims=True)
                yield same[["id", "label", "code"]].assign(along=list(_unit(same["embedding"].tolist()) @ planes.T))

    return run


def _split(placed: DataFrame, classes: DataFrame, leaf_rows: int, spill: float, seed: int) -> DataFrame:
    """placed (id, label, code), as a table, with leaves of more than leaf_rows rows split while a direction parts them."""
    schema, leaf, level = ", ".join(f"{c} {t}" for c, t in placed.dtypes), ["code", "label"], 0
    while True:
        crowds = written(placed.groupBy(*leaf).agg(F.count("*").alias("n")).where(F.col("n") > leaf_rows).select(*leaf), "crowds")
        inside = placed.join(small(crowds), leaf).join(classes.select("id", "embedding"), "id").select("id", "label", "code", "embedding")
        along = written(inside.mapInPandas(_projected(seed, level), f"{schema}, along array<double>"), "along")
        each = along.select(*leaf, F.posexplode("along").alias("j", "x"))
        medians = written(each.groupBy(*leaf, "j").agg(F.percentile_approx("x", 0.5, 1000).alias("t")), "medians")
        shares = each.join(small(medians), [*leaf, "j"]).groupBy(*leaf, "j", "t").agg(F.avg((F.abs(F.col("x") - F.col("t")) < spill).cast("double")).alias("near"))
        best = shares.groupBy(*leaf).agg(F.min_by(F.struct("j", "t", "near"), F.struct("near", "j")).alias("b")).select(*leaf, "b.*")
        cuts = written(best.where("near < 0.5").select(*leaf, "j", "t"), "cuts")
        if cuts.isEmpty():
            drop(crowds, along, medians, cuts)
            return placed
        x, t = F.get("along", F.col("j")), F.col("t")
        sides = F.array(F.when(x < t + spill, F.xxhash64("code", F.lit(0))), F.when(x > t - spill, F.xxhash64("code", F.lit(1))))
        moved = along.join(small(cuts), leaf).select("id", "label", F.explode(F.array_compact(sides)).alias("code"))
        new = written(placed.join(small(cuts.select(*leaf)), leaf, "left_anti").select("id", "label", "code").unionByName(moved), "placed")
        drop(crowds, along, medians, cuts, placed)
        placed, level = new, level + 1


def near_vectors(
    vectors: DataFrame, threshold: float = 0.98, trees: int = 10, leaf_rows: int = 512, sample_rows: int = 16_384, spread: float = 0.4, seed: int = 11
) -> DataFrame:
    """Groups of vectors (vec_id, embedding, label) whose cosine is at least `threshold` under the same label.

    Returns vec_id, n_links (rows linked directly), component_id (the smallest vec_id that links reach, its own
    included) and kept (vec_id = component_id). Vectors that are null, empty, zero or hold null or non-finite numbers,
    and those without a label, link with nothing; so do vectors of different lengths. Equal vectors under one label are
    compared once, and repeated rows count each; different vectors that share a vec_id, or have none, are told apart (by
    a 64-bit hash). A null vec_id stays null and is never the smallest, unless nothing it reaches has one, and then kept
    holds; an empty table gives no rows; other columns are ignored. A very long vector is one row of a block.

    The upper splits are fitted on about `sample_rows` distinct vectors (the only rows that reach the driver). Rows closer
    to a seam than `spread` times what a linked pair's distance measures along a random direction go to both sides. A pair
    is missed if every tree parts it, so recall falls with the splits that a row passes. If a split parts a pair at the
    threshold in 6 of 100 cases, as was found with six trees and twelve splits, ten trees keep 0.998 of such pairs at
    twelve splits and 0.96 at twenty-one, which a thousand million rows need; that is reckoned, see the tests for what is
    measured. More trees keep more. A wider seam does not pay: at 0.75, leaves of 16 rows took ten minutes and more.
    """
    sound = (
        F.col("label").isNotNull()
        & (F.size("embedding") > 0)
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", F.coalesce(sound, F.lit(False)).alias("sound"))
    rows = rows.withColumn("id", F.xxhash64("label", "embedding"))
    classes = rows.where("sound").groupBy("id").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("first"), F.count("*").alias("times"))
    classes = written(classes, "vectors")
    by_label = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first()
    n, most = by_label  # of one label
    drawn = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, sample_rows / max(n, 1)) * (1 << 30))
    sample = [r["embedding"] for r in classes.where(drawn).select("embedding").collect()] if n else []
    usual = max({len(v) for v in sample}, key=[len(v) for v in sample].count, default=1)
    points = _unit(sorted(v for v in sample if len(v) == usual)) if sample else np.zeros((0, 1))
    spill = spread * float(np.sqrt(max(0.0, 2 - 2 * threshold) / max(usual, 1)))
    forest = [(t.planes, t.thresholds, t.children, t.leaves) for t in plant(points, len(points) / max(n, 1), trees, spill, int(leaf_rows * n / most), seed)]
    label = vectors.schema["label"].dataType.simpleString()
    routed = classes.select("id", "label", "embedding").mapInPandas(_routed(forest, spill), f"id long, label {label}, code array<long>")
    placed = _split(written(routed.select("id", "label", F.explode("code").alias("code")), "placed"), classes, 2 * leaf_rows, spill, seed)

    crowds = placed.groupBy("code", "label").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    crowds = written(crowds.select("code", "label", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "crowds")
    dealt = placed.join(small(crowds), ["code", "label"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    own_codes = placed.groupBy("id").agg(F.sort_array(F.collect_list("code")).alias("codes"))  # as many as trees and seams give
    dealt = dealt.join(classes.select("id", "times", "embedding").join(own_codes, "id"), "id")
    dealt = dealt.withColumn("facing", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("code", "label", F.least("own", "facing").alias("block"), F.greatest("own", "facing").alias("other"), "own", "id", "times", "embedding", "codes")
    told = written(dealt.groupBy("code", "label", "block", "other").applyInPandas(_compare(threshold), "id long, links long, root long"), "found")
    drop(placed, crowds)
    reached = components(told.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")))
    named = classes.join(told.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(reached, "id", "left")
    named = named.select("id", "first", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = written(named.join(firsts, "component").select("id", "n_links", "component_id"), "named")
    drop(told)
    linked = rows.where("sound").join(named, "id").select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
