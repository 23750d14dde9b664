"""Bounded-space online packing of token sequences.

Each partition reads its documents once and keeps a fixed number of open windows. A document's whole windows are cut
off at once; what is left is placed best-fit, and when no open window has room the fullest one is emitted. Windows that
are still open when a partition ends are merged afterwards in rounds, many partitions' leftovers to a task, by the same
placing with whole windows as the items, so that no task ever takes more than a bounded number of windows.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pennant.llm.common import id_in, id_out, written

PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_bpe(vocabulary: str, ranks: str, pattern: str) -> Callable[[str], np.ndarray]:
    """An encoder for a byte-level BPE whose vocabulary file also exists as base64 tokens and ranks.

    The ids are those of the library that reads the vocabulary file, with its default settings. The one that reads ranks
    gives the same ids several times faster on texts that hold no added token's string and no long run of blanks (on
    which its pattern matcher gives up); the other texts go to the first.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={})
    sure = Tokenizer.from_file(vocabulary)
    added = [token.content for token in sure.get_added_tokens_decoder().values()]
    long_run = re.compile(r"\s{100000}")

    def encode(text: str) -> np.ndarray:
        if any(token in text for token in added) or len(text) >= 100_000 and long_run.search(text):
            ids = sure.encode(text, add_special_tokens=False).ids
        else:
            ids = fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4")

    return encode


#: A sequence id: the merging round above, then the partition, then a number within it.
_PARTITION_BITS, _NUMBER_BITS = 31, 27


def first_sequence(epoch: int, partition: int) -> int:
    """The first sequence id of a partition (below 2 ** 31, as Spark numbers them) in a merging round (below 32)."""
    return (epoch << _PARTITION_BITS | partition) << _NUMBER_BITS


class OpenWindows:
    """A bounded set of partly filled windows, by room left; place() is best-fit and may emit the fullest."""

    def __init__(self, capacity: int, most: int, first_id: int):
        self.capacity, self.most, self.next_id = capacity, most, first_id
        self.rooms: list[tuple[int, int]] = []  # (room, window), sorted

    def take(self) -> int:
        """The next window's id."""
        taken, self.next_id = self.next_id, self.next_id + 1
        if not self.next_id % (1 << _NUMBER_BITS):
            raise OverflowError("a partition fills 2 ** 27 windows, so its documents must be dealt over more partitions")
        return taken

    def place(self, length: int) -> tuple[int, int, int | None]:
        """(window, offset in it, window emitted to make room or None)."""
        emitted = None
        at = bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, window = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.most:
                emitted = self.rooms.pop(0)[1]
            room, window = self.capacity, self.take()
        insort(self.rooms, (room - length, window))
        return window, self.capacity - room, emitted


def _first_windows(encoder: Callable[[], Callable[[str], np.ndarray]], end_id: int | None, window: int, most: int, keep_ids: bool):
    """The task's function: pieces of its documents, with `open` for those in windows that are not full yet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        tail = np.array([] if end_id is None else [end_id], "<u4")
        windows = OpenWindows(window, most, first_sequence(0, TaskContext.get().partitionId()))
        still_open: dict[int, list[tuple]] = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_numpy(), batch["text"].to_numpy(), strict=True):
                ids = np.concatenate([encode(text), tail])
                n = len(ids)
                for start in range(0, n, window):
                    piece = ids[start : start + window].tobytes()
                    length = len(piece) // 4
                    kept = piece if keep_ids else None
                    if length == window:
                        rows.append((doc_id, start, length, kept, zlib.crc32(piece), n, windows.take(), 0, False))
                        continue
                    to, offset, emitted = windows.place(length)
                    still_open.setdefault(to, []).append((doc_id, start, length, kept, zlib.crc32(piece), n, to, offset, True))
                    if emitted is not None:
                        rows += [(*r[:-1], False) for r in still_open.pop(emitted)]
            yield pd.DataFrame(rows, columns=_COLUMNS)
        full = {w for room, w in windows.rooms if room == 0}
        yield pd.DataFrame([(*r[:-1], w not in full) for w, held in still_open.items() for r in held], columns=_COLUMNS)

    return run


_COLUMNS = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open"]


def _merged(window: int, most: int, last: bool, epoch: int):
    """One merging round over windows (sequence_id, used): where each goes, and whether that window stays open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([pd.DataFrame({"sequence_id": [], "used": []}, dtype="int64"), *batches])
        held = held.sort_values(["used", "sequence_id"], ascending=[False, True])
        windows = OpenWindows(window, len(held) + 1 if last else most, first_sequence(epoch, TaskContext.get().partitionId()))
        placed = [(w, *windows.place(int(used))[:2]) for w, used in zip(held["sequence_id"], held["used"], strict=True)]
        open_now = set() if last else {w for room, w in windows.rooms if room > 0}
        yield pd.DataFrame([(w, to, by, to in open_now) for w, to, by in placed], columns=["sequence_id", "to", "by", "open"])

    return run


def pack(
    docs: DataFrame,
    encoder: Callable[[], Callable[[str], np.ndarray]],
    end_id: int | None = 0,
    window: int = 1024,
    open_windows: int = 256,
    merge_windows: int = 4096,
    keep_ids: bool = True,
) -> DataFrame:
    """Pack the token ids of docs (doc_id, text) into sequences of at most `window` ids.

    encoder() is called once in each task and gives the function from a text to its ids; end_id follows each document
    (None: nothing does). Returns PIECES: a row for each run of ids that lies in one sequence, `start` ids after its
    document's first one and at `offset` in the sequence, with the ids as little-endian unsigned 32-bit integers
    (null unless keep_ids) and their CRC-32. Sequence ids are unique, not gapless. A null text counts as empty; an empty
    document without end_id has no piece; a null doc_id stays null; repeated rows are packed each; an empty table gives
    no rows; a very long text fills windows of its own, and its ids are in memory at once; other columns are ignored. At most `open_windows` windows are open in a task, and at most `merge_windows` of them meet in a merging
    task (the last round pads what is left).
    """
    read = docs.select(id_in(), F.coalesce("text", F.lit("")).alias("text"))
    pieces = written(read.mapInPandas(_first_windows(encoder, end_id, window, open_windows, keep_ids), f"{PIECES}, open boolean"), "pieces")
    left = written(pieces.where("open").groupBy("sequence_id").agg(F.sum("length").alias("used")), "windows")
    moves = pieces.where("open").select("sequence_id").distinct().select("sequence_id", F.col("sequence_id").alias("to"), F.lit(0).cast("long").alias("by"))
    epoch = 1
    n_left = left.count()
    while n_left:
        # as many tasks as keep each within its bound; one task is the last round
        tasks = -(-n_left // merge_windows)
        dealt = left.repartition(tasks, F.pmod(F.xxhash64("sequence_id"), F.lit(tasks))) if tasks > 1 else left.coalesce(1)
        step = written(dealt.mapInPandas(_merged(window, open_windows, tasks == 1, epoch), "sequence_id long, to long, by long, open boolean"), "moves")
        hop = step.select(F.col("sequence_id").alias("to"), F.col("to").alias("then"), F.col("by").alias("more"))
        moves = written(
            moves.join(hop, "to", "left").select("sequence_id", F.coalesce("then", "to").alias("to"), (F.col("by") + F.coalesce("more", F.lit(0))).alias("by")),
            "moves",
        )
        if tasks == 1:
            break
        used = left.join(step.where("open"), "sequence_id").groupBy(F.col("to").alias("sequence_id")).agg(F.sum("used").alias("used"))
        left = written(used, "windows")
        n_left, epoch = left.count(), epoch + 1
    moved = pieces.where("open").join(moves, "sequence_id").withColumn("offset", F.col("offset") + F.col("by")).withColumn("sequence_id", F.col("to"))
    names = [id_out(), *(c for c in pieces.columns if c not in ("doc_id", "open"))]
    return pieces.where("not open").select(names).unionByName(moved.select(names))
