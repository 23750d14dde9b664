"""SentencePiece encoding and decoding of merge-type (BPE) models with byte fallback, by backtracking.

A text is cut where no piece of the vocabulary can reach across. Each part is encoded left to right with the longest
piece that an Aho-Corasick scan finds at the place; a piece is taken only if merging its text with its neighbour's from
scratch gives just these two. Where no piece fits, the place is marked as failed in a bitfield and the last piece is
taken back and shortened. A sequence in which all neighbours are compatible is the merges' own result: the first merge
across a seam would also be the first one when only the two pieces beside that seam are merged.
"""

from __future__ import annotations

import re
import struct
import sys
from collections.abc import Callable, Iterator
from itertools import groupby
from types import ModuleType

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pennant.llm.common import id_in, id_out

_SPACE = "▁"
_NEVER = float("-inf")


class _Memo(dict):
    """A dict that computes what it lacks; it forgets everything when it holds more than `most` entries."""

    def __init__(self, compute: Callable, most: int):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self.compute(key)
        if len(key) <= 64:
            self[key] = value
        return value


class PieceModel:
    """A merge-type model: encode() gives ids as little-endian unsigned 32-bit integers, decode() the text of such ids."""

    def __init__(self, path: str, memo: int = 700_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if model.normalize("  ﬁ\t a ") != "▁▁▁ﬁ\t▁a▁":
            raise ValueError("only models that keep the text as it is, with a blank before it, are supported")
        size = model.get_piece_size()
        special = [i for i in range(size) if model.is_control(i) or model.is_unknown(i)]
        self.byte_id = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.byte_id) < 256:
            raise ValueError("the model has no byte fallback")
        self.ids = {model.id_to_piece(i): i for i in range(size) if i not in special and not model.is_byte(i) and not model.is_unused(i)}
        self.packed = {piece: struct.pack("<I", i) for piece, i in self.ids.items()}
        self.score = {piece: model.get_score(i) for piece, i in self.ids.items()}
        self.chars = {piece for piece in self.ids if len(piece) == 1}
        if any(p[k] != _SPACE and p[k + 1] == _SPACE for p in self.ids for k in range(len(p) - 1)):
            raise ValueError("a piece reaches across words")
        self.begin, self.end = struct.pack("<I", model.bos_id()), struct.pack("<I", model.eos_id())
        self.text_of = [b"" if i in special else model.id_to_piece(i).replace(_SPACE, " ").encode() for i in range(size)]
        for byte, i in self.byte_id.items():
            self.text_of[i] = bytes([byte])
        # a line end that no longer piece has parts words like a blank
        alone = "" if any("\n" in p for p in self.ids if len(p) > 1) else "\n"
        self.parts = re.compile(f"{_SPACE}*[^{_SPACE}{alone}]+|{_SPACE}+" + f"|{alone}" * bool(alone)).findall
        self.scan = ahocorasick.Automaton()
        for piece in self.ids.keys() - self.chars:
            self.scan.add_word(piece, len(piece))
        self.scan.make_automaton()
        self.fits = _Memo(lambda pair: self.merged("".join(pair)) == [p for p in pair if p], memo)
        self.encoded = _Memo(self._part, memo)

    def merged(self, text: str) -> list[str]:
        """The plain way, for texts of a piece or two: merge the best-scored neighbours, the leftmost first, to the end."""
        now, score = list(text), self.score.get
        scores = [score(a + b, _NEVER) for a, b in zip(now, now[1:])]
        while scores and (best := max(scores)) != _NEVER:
            k = scores.index(best)
            now[k : k + 2] = [now[k] + now[k + 1]]
            del scores[k]
            if k < len(scores):
                scores[k] = score(now[k] + now[k + 1], _NEVER)
            if k:
                scores[k - 1] = score(now[k - 1] + now[k], _NEVER)
        return now

    def _run(self, text: str) -> list[str]:
        """Pieces of a text of known characters, by backtracking."""
        size, fits = len(text), self.fits
        ends: dict[int, list[int]] = {}
        for last, length in self.scan.iter(text):
            if (start := last - length + 1) in ends:
                ends[start].append(last + 1)  # in order of length
            else:
                ends[start] = [last + 1]
        failed = bytearray(size // 8 + 1)
        taken: list[str] = []
        ranks: list[int] = []  # of the taken pieces, among those at their places; -1 is the single character
        before, place, here = "", 0, ends.get(0, ())
        rank = len(here) - 1
        while True:
            while rank >= -1:
                end = here[rank] if rank >= 0 else place + 1
                if not failed[end >> 3] >> (end & 7) & 1:
                    piece = text[place:end]
                    if fits[before, piece]:
                        break
                rank -= 1
            if rank >= -1:
                taken.append(piece)
                ranks.append(rank)
                if end == size:
                    return taken
                before, place, here = piece, end, ends.get(end, ())
                rank = len(here) - 1
            else:
                failed[place >> 3] |= 1 << (place & 7)
                place -= len(taken.pop())
                before, here, rank = taken[-1] if taken else "", ends.get(place, ()), ranks.pop() - 1

    def _part(self, text: str) -> bytes:
        if self.chars.issuperset(text):
            return b"".join(map(self.packed.__getitem__, self._run(text)))
        ids = []
        for known, run in groupby(text, self.chars.__contains__):
            part = "".join(run)
            ids.append(self._part(part) if known else b"".join([struct.pack("<I", self.byte_id[b]) for b in part.encode()]))
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        """Ids of the text between the begin and end ids."""
        whole = _SPACE + text.replace(" ", _SPACE) if text else ""
        return b"".join([self.begin, *map(self.encoded.__getitem__, self.parts(whole)), self.end])

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.text_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _model_of_worker(path: str) -> PieceModel:
    """The model, kept with what it has memorised while Spark reuses the worker for further tasks."""
    kept = sys.modules.setdefault("pennant_worker_models", ModuleType("pennant_worker_models")).__dict__
    if path not in kept:
        kept[path] = PieceModel(path)
    return kept[path]


def encode_pieces(docs: DataFrame, model: str, chunk_chars: int = 4_000_000) -> DataFrame:
    """Encode the texts of docs (doc_id, text) with the model file and decode the ids again.

    Returns doc_id, ids (binary: little-endian unsigned 32-bit integers, begin and end ids included) and decoded. A
    null or empty text has the begin and end ids only; a null doc_id stays null; repeated rows come out as often; an empty table gives no rows;
    other columns are ignored. A task holds a batch of texts and about `chunk_chars` characters' results at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = _model_of_worker(model)
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = pieces.encode(text)
                rows.append((doc_id, ids, pieces.decode(ids)))
                held += len(text)
                if held > chunk_chars:
                    yield pd.DataFrame(rows, columns=["doc_id", "ids", "decoded"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["doc_id", "ids", "decoded"])

    read = docs.select(id_in(), F.coalesce("text", F.lit("")).alias("text"))
    return read.mapInPandas(run, "doc_id long, ids binary, decoded string").withColumn("doc_id", id_out())
