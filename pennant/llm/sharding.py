"""Sharding by histogram sort: find the key boundaries that split the bytes evenly, then exchange the rows once.

Rows are ordered by (hash of the text, doc_id, a hash of the row's place in the table of keys), so equal texts lie side
by side and mostly share a shard. Each round counts the exact bytes and rows below a bounded set of candidate boundaries
over all partitions; boundaries that miss their target get new candidates inside the interval that still holds them. A
text that a third of the rows share is split by doc_id like any other interval, and rows without a doc_id, or repeated
ones, by their places, so no task and no shard takes a hot key whole.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pennant.llm.common import written

#: Bytes that each row counts beside its text.
ROW_BYTES = 16
_SIGN = 1 << 63


def _packed(*parts: pd.Series) -> np.ndarray:
    """Keys of three signed 64-bit values as 24 bytes that sort alike, with a last byte that no array of bytes drops."""
    keys = np.ones((len(parts[0]), 25), np.uint8)
    for k, part in enumerate(parts):
        flipped = part.to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)
        keys[:, 8 * k : 8 * k + 8] = flipped.astype(">u8").view(np.uint8).reshape(-1, 8)
    return keys.view("S25").ravel()


def _boundaries(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(24, "big") + b"\x01" for k in keys], "S25")


def _histogram(keyed: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """(bytes, rows) with a key below each probe."""
    edges = _boundaries(probes)

    def count(batches):
        n_bytes, n_rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            place = np.searchsorted(edges, _packed(batch["h"], batch["d"], batch["r"]), side="right")
            n_bytes += np.bincount(place, batch["size"].to_numpy(), len(edges) + 1).astype(np.int64)
            n_rows += np.bincount(place, minlength=len(edges) + 1)
        at = np.flatnonzero(n_rows)
        yield pd.DataFrame({"place": at, "n_bytes": n_bytes[at], "n_rows": n_rows[at]})

    counted = keyed.select("h", "d", "r", "size").mapInPandas(count, "place long, n_bytes long, n_rows long")
    total = np.zeros((len(edges) + 1, 2), np.int64)
    for place, n_bytes, n_rows in counted.groupBy("place").agg(F.sum("n_bytes"), F.sum("n_rows")).collect():  # one row a probe
        total[place] = n_bytes, n_rows
    return [tuple(map(int, x)) for x in total.cumsum(0)[:-1]]


def splitters(keyed: DataFrame, parts: int, every: int, tolerance: float = 0.001, max_probes: int = 8192) -> tuple[list[int], list[int]]:
    """Keys that cut `keyed` (h long, d long, r long, size long) into `parts` parts of equal bytes, and the rows below each.

    A cut whose number is a multiple of `every` ends a shard: it may miss its target by `tolerance` of a shard. The
    others only balance the work of the exchange and may miss by a tenth of a part. A cut with at most one key left in
    its interval takes the nearer end. At most `max_probes` counts, or one for each cut
    still open if those are more, come back to the driver in a round.
    """
    first = keyed.agg(F.sum("size"), F.count("*"), F.min("d"), F.max("d")).first()
    total, rows = first[0] or 0, first[1]
    if not rows:
        return [], []
    low_d, span_d = first[2] + _SIGN, first[3] - first[2] + 1
    whole = span_d << 128

    def at(x: int) -> int:
        """The x-th of all possible keys."""
        pair, place = divmod(x, 1 << 64)
        return (((pair // span_d << 64) + low_d + pair % span_d) << 64) + place

    known: dict[int, tuple[int, int]] = {0: (0, 0), whole: (total, rows)}
    places = sorted(known)
    cuts: dict[int, int] = {}
    probes = [whole * k // max_probes for k in range(1, max_probes)]
    while len(cuts) < parts - 1:
        known.update(zip(probes, _histogram(keyed, [at(x) for x in probes]), strict=True))
        places = sorted(known)
        below = [known[x][0] for x in places]
        unsettled: set[tuple[int, int]] = set()
        for cut in range(1, parts):
            if cut in cuts:
                continue
            target = total * cut / parts
            k = max(1, bisect_left(below, target))
            lo, hi = places[k - 1], places[k]
            near = min((lo, hi), key=lambda x: abs(known[x][0] - target))
            allowed = tolerance * total * every / parts if cut % every == 0 else 0.1 * total / parts
            if abs(known[near][0] - target) <= allowed or known[hi][1] - known[lo][1] <= 1 or hi - lo <= 1:
                cuts[cut] = near
            else:
                unsettled.add((lo, hi))
        probes = sorted({lo + (hi - lo) * k // (each + 1) for lo, hi in unsettled for each in [max(1, max_probes // len(unsettled))] for k in range(1, each + 1)} - known.keys())
    cut_at = [cuts[c] for c in range(1, parts)]
    return [at(x) for x in cut_at], [known[x][1] for x in cut_at]


def shard_by_bytes(docs: DataFrame, shards: int = 40, rows_per_bin: int = 100_000) -> DataFrame:
    """Deal docs (doc_id, text) into shards 0 .. shards-1 of nearly equal bytes, in the order of (text hash, doc_id).

    Returns doc_id, size, text_crc32, shard and slot, the row's place in its shard, gapless from 0. A null text counts
    ROW_BYTES and checksum 0; a null doc_id sorts first; repeated rows, and rows without a doc_id, each get a slot of their
    own and are spread over shards like others; an empty table gives no rows; a text of any length is one row; other columns are ignored. Every shard is cut into bins of bounded rows, so that the exchange and the
    numbering work on even parts whatever the number of shards.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-_SIGN)).alias("d"),
        ),
        "shard-keys",
    )
    # a place that stays the same however the table is read
    keyed = keyed.withColumn("r", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    every = min(256, max(16, -(-keyed.count() // (shards * rows_per_bin))))
    cuts, rows_below = splitters(keyed, shards * every, every)
    edges = _boundaries(cuts)
    starts = np.array([0, *rows_below], np.int64)

    @F.pandas_udf("bin int, base long")
    def dealt(h: pd.Series, d: pd.Series, r: pd.Series) -> pd.DataFrame:
        part = np.searchsorted(edges, _packed(h, d, r), side="right")
        return pd.DataFrame({"bin": part.astype(np.int32), "base": starts[part] - starts[part // every * every]})

    in_bin = Window.partitionBy("bin").orderBy("h", "d", "r")
    return (
        keyed.withColumn("to", dealt("h", "d", "r"))
        .select("doc_id", "size", "text_crc32", "h", "d", "r", F.col("to.bin").alias("bin"), F.col("to.base").alias("base"))
        .select(
            "doc_id", "size", "text_crc32",
            (F.col("bin") / F.lit(every)).cast("int").alias("shard"),
            (F.col("base") + F.row_number().over(in_bin) - 1).alias("slot"),
        )
    )
