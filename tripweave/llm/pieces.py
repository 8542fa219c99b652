"""SentencePiece encoding and decoding as the best path through a weighted finite-state transducer.

The model is compiled from its file into three parts that are composed with each input: the normaliser (a blank
before the text, blanks as U+2581), the pieces as arcs over spans of characters, and byte fallback for characters
without a piece. Weights are of the tropical semiring (add along a path, take the least of paths). A unigram model
weighs a piece by its negative score. A pair-merging (BPE) model has no additive scores: its transducer also
remembers the last piece, and an arc costs nothing if merging the two pieces' text gives just these two, and
infinitely much otherwise; one path of finite weight is left, which is what merging the whole text gives.
Texts are cut where no piece can reach across (before blank marks and, if the pieces allow it, between letters and
other characters), and each distinct part is composed once per task.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.llm.common import map_runs

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
KEPT_PARTS = 600_000  # parts, and pairs of pieces, whose answer a task remembers before it starts again
UNKNOWN_PENALTY = 10.0
# Fixed values of the model file format.
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6
UNIGRAM, BPE = 1, 2
# Cuts before blank marks; the second also between letters and other characters.
_AT_MARKS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_AT_LETTERS = re.compile(rf"{MARK}*(?:[^\W\d_²³¹]+|(?:[\d_²³¹]|[^\w{MARK}])+)|{MARK}+")
FALLBACK = -2  # the arc of a character without a piece


def _fields(data: bytes):
    """Field number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Answers(dict):
    """Asks ``find`` about a key that comes up for the first time, and remembers what it says."""

    def __init__(self, find: Callable) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, key):
        found = self[key] = self.find(key)
        return found


@dataclass
class Transducer:
    """Pieces, byte fallback and normaliser of one model file, compiled for composition."""

    data: bytes
    ids: dict[str, int] = field(default_factory=dict)
    scores: dict[int, float] = field(default_factory=dict)
    byte_ids: dict[int, int] = field(default_factory=dict)
    texts: list[bytes] = field(default_factory=list)
    unknown: int = 0
    kind: int = UNIGRAM
    prefix: bool = True

    def __post_init__(self) -> None:
        for number, value in _fields(self.data):
            if number == 1:
                piece = dict(_fields(value))
                self._add(piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("only identity normalisers that keep blanks are compiled")
                self.prefix = bool(rules.get(3, 1))
        if self.kind not in (UNIGRAM, BPE) or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces must be of a unigram or pair-merging model, with blank marks in front only")
        self.cut = _AT_LETTERS if all(len(_AT_LETTERS.findall(p)) == 1 for p in self.ids) else _AT_MARKS
        self.reach: dict[str, int] = {}  # the length of the longest piece that begins with these two characters
        for piece in self.ids:
            self.reach[piece[:2]] = max(len(piece), self.reach.get(piece[:2], 1))
        self.worst = min(self.scores.values()) - UNKNOWN_PENALTY
        self.pairs: dict[tuple[int, int], bool] = {}
        self.parts = Answers(lambda part: np.array(self.best_path(part), "<i4").tobytes())
        self.by_id = {i: p for p, i in self.ids.items()}

    def _add(self, piece: str, score: float, kind: int) -> None:
        at = len(self.texts)
        if kind in (NORMAL, USER_DEFINED, UNUSED):
            self.ids[piece], self.scores[at] = at, score
            self.texts.append(piece.replace(MARK, " ").encode())
        elif kind == BYTE:
            self.byte_ids[int(piece[3:5], 16)] = at
            self.texts.append(bytes([int(piece[3:5], 16)]))
        else:
            self.unknown = at if kind == UNKNOWN else self.unknown
            self.texts.append(" ⁇ ".encode() if kind == UNKNOWN else b"")

    def _merged(self, text: str) -> list[int]:
        """Pair merging of a short text by definition: always the best pair, the leftmost of equals."""
        symbols = list(text)
        while True:
            found = [(-self.scores[self.ids[a + b]], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.ids]
            if not found:
                return [self.ids.get(s, -1) for s in symbols]
            i = min(found)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    def joins(self, last: int, piece: int) -> bool:
        """Whether the arc of ``piece`` costs nothing in the state that remembers ``last`` (negative: no piece)."""
        if last < 0:
            last, before = -1, ""
        else:
            before = self.by_id[last]
        if (free := self.pairs.get((last, piece))) is None:
            if len(self.pairs) > KEPT_PARTS:
                self.pairs.clear()
            free = self.pairs[last, piece] = self._merged(before + self.by_id[piece]) == ([last, piece] if before else [piece])
        return free

    def _arcs(self, part: str, at: int) -> list[tuple[int, int]]:
        """Places reached from ``at`` and the piece read on the way, the shortest first."""
        get, most = self.ids.get, at + self.reach.get(part[at : at + 2], 1)
        arcs = [(end, piece) for end in range(at + 1, min(most, len(part)) + 1) if (piece := get(part[at:end])) is not None]
        return arcs if arcs and arcs[0][0] == at + 1 else [(at + 1, FALLBACK), *arcs]

    def _only_path(self, part: str) -> list[tuple[int, int]]:
        """The path of weight 0: depth first, long pieces first; a state without a way on is not entered again."""
        path: list[tuple[int, int]] = []
        left, ended = [self._arcs(part, 0)], set()
        while not path or path[-1][0] < len(part):
            while left[-1]:
                step = left[-1].pop()
                if step not in ended and (step[1] == FALLBACK or self.joins(path[-1][1] if path else -1, step[1])):
                    path.append(step)
                    left.append(self._arcs(part, step[0]) if step[0] < len(part) else [])
                    break
            else:
                left.pop()
                ended.add(path.pop())
        return path

    def _least_path(self, part: str) -> list[tuple[int, int]]:
        """The path of least weight where weights add up: one pass over the places from left to right."""
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)] + [(float("inf"), 0, 0)] * len(part)
        for at in range(len(part)):
            for end, piece in self._arcs(part, at):
                total = best[at][0] - (self.worst if piece == FALLBACK else self.scores[piece])
                if total < best[end][0]:
                    best[end] = (total, at, piece)
        path, at = [], len(part)
        while at:
            _, before, piece = best[at]
            path.append((at, piece))
            at = before
        return path[::-1]

    def best_path(self, part: str) -> list[int]:
        """Ids on the path of least weight through the composition of ``part`` with the model."""
        found: list[int] = []
        for end, piece in self._only_path(part) if self.kind == BPE else self._least_path(part):
            if piece != FALLBACK:
                found.append(piece)
            elif self.byte_ids:
                found += [self.byte_ids.get(b, self.unknown) for b in part[end - 1].encode()]
            else:
                found.append(self.unknown)
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        parts = self.cut.findall(MARK * self.prefix + text.replace(" ", MARK))
        if len(self.parts) > KEPT_PARTS:
            self.parts.clear()
        return b"".join(map(self.parts.__getitem__, parts))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        data = b"".join(map(self.texts.__getitem__, ids))
        return data[self.prefix and data[:1] == b" " :].decode("utf-8", "replace")



@lru_cache(maxsize=1)
def _on_worker(model: bytes) -> Transducer:
    """The compiled model, once per Python process."""
    return Transducer(model)


def encode_decode(documents: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """``documents`` with ``token_ids``, ``n_tokens`` and the text decoded from the ids, ``decoded``.

    Null texts have null ids and a null decoded text, empty ones no ids. Rows that repeat stay, other columns too (those
    named like a new one are replaced). Decoding gives the text back, but a blank mark (U+2581) in it becomes a blank.
    """
    spark = documents.sparkSession
    with open(model, "rb") as f:  # read by the driver and sent on: about half a megabyte
        sent = spark.sparkContext.broadcast(f.read())
    documents = documents.drop("token_ids", "n_tokens", "decoded")
    schema = T.StructType(list(documents.schema.fields)).add("token_ids", T.ArrayType(T.IntegerType())).add("n_tokens", T.LongType()).add("decoded", T.StringType())

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = _on_worker(sent.value)
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        coded = [machine.encode(t or "") for t in texts]
        ids = np.frombuffer(b"".join(coded), "<i4")
        counts = np.array([len(c) // 4 for c in coded], np.int64)
        nulls = pa.array([t is None for t in texts])
        ends = np.cumsum(counts)
        everything = ids.tolist()
        decoded = [None if t is None else machine.decode(everything[e - n : e]) for t, e, n in zip(texts, ends.tolist(), counts.tolist())]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids), mask=nulls)
        made = [lists, pa.array(counts, mask=np.asarray(nulls)), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "token_ids", "n_tokens", "decoded"])

    return map_runs(documents, text, schema, work)


def digest(encoded: DataFrame) -> DataFrame:
    """Rows for the query: the ids as they are, and whether decoding gave the text back."""
    return encoded.select("doc_id", "n_tokens", "token_ids", F.col("decoded").eqNullSafe(F.translate("text", MARK, " ")).alias("round_trip"), "decoded")
