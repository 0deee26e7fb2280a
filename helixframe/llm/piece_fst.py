"""SentencePiece encoding and decoding as weighted finite-state transducers.

Three machines are compiled from a model file and composed with each input: the normaliser (white space becomes the visible
mark, with the dummy prefix), the piece transducer (a trie whose paths spell pieces and emit their ids, and for a character
without a piece a path that emits its UTF-8 bytes), and for BPE models an acceptor of neighbours: piece v may follow u only
if the merges of the joined string end in u, v. A segmentation of which all neighbours are accepted is the one that the merges
produce, so the composition accepts just that one; for unigram models the acceptor takes everything and weights are
negative log probabilities. The ids are the shortest path in the tropical semiring (min, +), found left to right.

Inputs are cut where no piece can span, by classes of characters checked against all pieces, and ids of short units are
remembered, since words repeat. A piece weighs 1 in a BPE model. Merges serve to compile the acceptor, two pieces at a time; where
several have one and the same score (runs of the mark), tests hold the shortest path against the merges of the whole unit.

Defined results: null and empty texts have no ids; ids out of range decode to nothing, and null ids to an empty text; repeated rows
are coded each; very long texts are read whole, unit by unit; an empty table gives no rows; other columns are kept, but for one that has the name of the result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixframe.llm.tokens import blocks
from helixframe.storage import prepare

# Fixed values of the model format: types of pieces, types of models, the visible space.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if byte < 0x80:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = raw[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = raw[at : at + n], at + n
        yield key >> 3, value


class Model:
    """Pieces, their scores and types, and the normaliser's settings."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True, collapse: bool = False, escape: bool = True):
        self.pieces, self.kind = pieces, kind
        self.dummy_prefix, self.collapse, self.escape = dummy_prefix, collapse, escape

    @classmethod
    def load(cls, path: str) -> Model:
        pieces, trainer, normal = [], {}, {}
        with open(path, "rb") as f:
            raw = f.read()
        for number, value in _fields(raw):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0], own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if normal.get(2) or trainer.get(24) or any(t == USER_DEFINED for _, _, t in pieces):
            raise ValueError("models with a character map, white space as suffix, or user-defined pieces are not supported")
        return cls(pieces, trainer.get(3, UNIGRAM), bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(normal.get(5, 1)))


class _Units(dict):
    """Ids of units as bytes, found when first needed."""

    MAX, MAX_LENGTH = 600_000, 48

    def __init__(self, find):
        super().__init__()
        self._find = find

    def __missing__(self, unit: str) -> bytes:
        found = self._find(unit)
        if len(unit) <= self.MAX_LENGTH:
            if len(self) >= self.MAX:
                self.clear()
            self[unit] = found
        return found


class Transducer:
    MAX_PAIRS = 400_000

    def __init__(self, model: Model):
        self.model = model
        self.ids = {p: i for i, (p, _, t) in enumerate(model.pieces) if t == NORMAL}
        self.score = {p: model.pieces[i][1] for p, i in self.ids.items()}
        self.unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(model.pieces) if t == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.least = min(self.score.values(), default=0.0)
        self.trie: dict = {}
        for p in self.ids:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self._follows: dict[tuple[str, str], bool] = {}
        self._units = _Units(self.unit)
        self.cut = self._cutter()

    def _cutter(self) -> re.Pattern:
        """Units that no piece spans: a run of marks with the letters, the digit or the other characters behind it; else coarser ones."""
        numbers = "".join(c for c in map(chr, range(0x10000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
        for pattern in (rf"{SPACE}*(?:[^\W\d_{numbers}]+|\d|(?:(?!{SPACE})[\W_{numbers}])+)|{SPACE}+", rf"{SPACE}*[^{SPACE}]+|{SPACE}+"):
            if all(re.fullmatch(pattern, p, re.S) for p in self.ids):
                return re.compile(pattern, re.S)
        return re.compile(r".+", re.S)

    def normalise(self, text: str) -> str:
        m = self.model
        if m.collapse:
            text = re.sub(" +", " ", text.strip(" "))
        if m.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", SPACE) if m.escape else text

    def merged(self, text: str) -> list[str]:
        """Segmentation by the merges: again and again the neighbours whose joined piece scores best, leftmost first."""
        piece = list(text)
        after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(piece):
                joined = piece[i] + piece[after[i]]
                if (s := self.score.get(joined)) is not None:
                    heappush(heap, (-s, i, joined))

        for i in range(len(piece)):
            offer(i)
        while heap:
            _, i, joined = heappop(heap)
            j = after[i]
            if j >= len(piece) or not piece[i] or len(piece[i]) + len(piece[j]) != len(joined):
                continue  # one of them has been merged since
            piece[i], piece[j] = joined, ""
            after[i] = after[j]
            if after[i] < len(piece):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in piece if p]

    def follows(self, u: str, v: str) -> bool:
        """The acceptor of neighbours; of a first piece u is empty."""
        if self.model.kind != BPE:
            return True
        key = (u, v)
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) >= self.MAX_PAIRS:
                self._follows.clear()
            known = self._follows[key] = self.merged(u + v) == ([u, v] if u else [v])
        return known

    def shortest(self, unit: str) -> list[str]:
        """Pieces on the shortest path of the composition with the unit; a character without a piece stands for itself."""
        n, bpe = len(unit), self.model.kind == BPE
        cost: list[float | None] = [0.0] + [None] * n
        last = [""] * (n + 1)
        for i in range(n):
            if cost[i] is None:
                continue
            node, j, some = self.trie, i, False
            while j < n and (node := node.get(unit[j])) is not None:
                j += 1
                p = node.get("")
                if p is None:
                    continue
                some = some or j == i + 1
                step = cost[i] + (1.0 if bpe else -self.score[p])
                if (cost[j] is None or step < cost[j]) and self.follows(last[i], p):
                    cost[j], last[j] = step, p
            if not some:
                step = cost[i] + (1.0 if bpe else UNKNOWN_PENALTY - self.least)
                if cost[i + 1] is None or step < cost[i + 1]:
                    cost[i + 1], last[i + 1] = step, unit[i]
        out, j = [], n
        while j:
            out.append(last[j])
            j -= len(last[j])
        return out[::-1]

    def _emit(self, pieces: list[str]) -> bytes:
        out = []
        for p in pieces:
            known = self.ids.get(p)
            if known is not None:
                out.append(known)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return struct.pack(f"<{len(out)}I", *out)

    def unit(self, unit: str) -> bytes:
        return self._emit(self.shortest(unit))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        return b"".join(map(self._units.__getitem__, self.cut.findall(self.normalise(text)))) if text else b""

    def decode(self, ids: bytes | None) -> str:
        """The transducer read backwards: bytes gather to characters, marks become spaces, and the dummy prefix goes."""
        out, pending = [], bytearray()
        for i in np.frombuffer(ids or b"", "<u4").tolist():
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if i < len(self.model.pieces):
                p, _, kind = self.model.pieces[i]
                out.append(p.replace(SPACE, " ") if kind == NORMAL else " ⁇ " if kind == UNKNOWN else "")
        out.append(pending.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """One per worker process."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(Model.load(path))
    return _COMPILED[path]


def _mapped(df: DataFrame, source: str, name: str, kind: str, arrow: pa.DataType, path: str, method: str) -> DataFrame:
    prepare(df.sparkSession)

    def run(batches):
        change = getattr(compiled(path), method)
        for batch in batches:
            values = batch.column(source).to_pylist()
            for part in blocks(values):
                made = [change(v) for v in values[part]]
                rows = batch.slice(part.start, len(made))
                columns = {n: c for n, c in zip(rows.schema.names, rows.columns, strict=True) if n != name} | {name: pa.array(made, arrow)}
                yield pa.record_batch(list(columns.values()), names=list(columns))

    kept = [f"`{n}` {t}" for n, t in df.dtypes if n != name]
    return df.mapInArrow(run, ", ".join([*kept, f"`{name}` {kind}"]))


def encode(df: DataFrame, model: str, text: str = "text", name: str = "ids") -> DataFrame:
    """Adds the ids of the text as little-endian unsigned 32-bit bytes."""
    return _mapped(df, text, name, "binary", pa.binary(), model, "encode")


def decode(df: DataFrame, model: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the text of the ids."""
    return _mapped(df, ids, name, "string", pa.string(), model, "decode")
