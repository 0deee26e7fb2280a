"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Each task packs the examples of its own partition, so nothing is shuffled and a lost task is simply run
again. A pool of some hundred waiting pieces is held; a sequence takes, again and again, the piece with the
largest dot product between its demand and the room left, each dimension weighted by the pool's mean demand.
Where no piece fits, the best one is cut (if cutting is allowed) so that the sequence is filled.

Defined results: a null text is empty, so its example is the end id alone; a null id is carried; repeated rows
are packed each on its own; an empty table gives no rows; other columns are ignored. An example over a limit
is cut at it even where cutting is off, because no sequence could hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from helixframe.llm import tokens
from helixframe.storage import prepare

SCHEMA = "doc_id long, start long, length long, doc_tokens long, loss_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in (c.split()[0] for c in SCHEMA.split(", "))])


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


@dataclass
class Piece:
    """Tokens [start, start + length) of an example whose first `prompt` tokens bear no loss."""

    doc_id: int | None
    ids: bytes
    prompt: int
    start: int
    length: int

    def loss(self, length: int | None = None) -> int:
        end = self.start + (self.length if length is None else length)
        return max(0, end - max(self.start, self.prompt))

    def prefix(self, room: int, loss: int) -> int:
        """Tokens of the longest prefix within both."""
        return min(self.length, room, max(0, self.prompt - self.start) + loss)

    def cut(self, length: int) -> tuple[Piece, Piece]:
        rest = Piece(self.doc_id, self.ids, self.prompt, self.start + length, self.length - length)
        return Piece(self.doc_id, self.ids, self.prompt, self.start, length), rest


class VectorPacker:
    def __init__(self, limits: Limits, cut: bool = True, pool: int = 512):
        self.limits, self.cutting, self.size = limits, cut, pool
        self.pool: list[Piece] = []
        self.demand = np.zeros((pool, 3))

    def add(self, doc_id: int | None, ids: bytes, prompt: int = 0) -> Iterator[list[Piece]]:
        """Sequences that are full after the example has come."""
        lim, rest = self.limits, Piece(doc_id, ids, prompt, 0, len(ids) // 4)
        while rest.length >= lim.tokens or rest.loss() > lim.loss:
            head, rest = rest.cut(rest.prefix(lim.tokens, lim.loss))
            if head.length == lim.tokens:
                yield [head]
            else:
                yield from self._wait(head)
            if not rest.length:
                return
        if rest.length:
            yield from self._wait(rest)

    def finish(self) -> Iterator[list[Piece]]:
        while self.pool:
            full = self._fill()
            yield from self._binary(full) if self.cutting and not self.pool else [full]

    def _wait(self, piece: Piece) -> Iterator[list[Piece]]:
        self._set(len(self.pool), piece)
        self.pool.append(piece)
        if len(self.pool) == self.size:
            while len(self.pool) > self.size // 2:
                yield self._fill()

    def _set(self, i: int, piece: Piece) -> None:
        lim = self.limits
        self.demand[i] = piece.length / lim.tokens, 1 / lim.segments, piece.loss() / lim.loss

    def _take(self, i: int) -> Piece:
        piece, last = self.pool[i], self.pool.pop()
        if i < len(self.pool):
            self.pool[i] = last
            self.demand[i] = self.demand[len(self.pool)]
        return piece

    def _fill(self) -> list[Piece]:
        lim, out = self.limits, []
        weight = self.demand[: len(self.pool)].mean(axis=0)
        room, segments, loss = lim.tokens, lim.segments, lim.loss
        while self.pool and room and segments:
            d = self.demand[: len(self.pool)]
            score = d @ (weight * (room / lim.tokens, segments / lim.segments, loss / lim.loss))
            fits = (d[:, 0] <= (room + 0.5) / lim.tokens) & (d[:, 2] <= (loss + 0.5) / lim.loss)
            best = int(np.where(fits, score, -1.0).argmax())
            if fits[best]:
                piece = self._take(best)
            elif self.cutting and (n := self.pool[best := int(score.argmax())].prefix(room, loss)):
                piece, rest = self.pool[best].cut(n)
                self.pool[best] = rest
                self._set(best, rest)
            else:
                break
            out.append(piece)
            room, segments, loss = room - piece.length, segments - 1, loss - piece.loss()
        return out

    def _binary(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        """The last, partly filled sequence as sequences whose lengths are powers of two, which need no padding."""
        total = sum(p.length for p in pieces)
        todo = pieces[::-1]
        for bit in range(total.bit_length() - 1, -1, -1):
            room, out = total & (1 << bit), []
            while room:
                piece = todo.pop()
                if piece.length > room:
                    piece, rest = piece.cut(room)
                    todo.append(rest)
                out.append(piece)
                room -= piece.length
            if out:
                yield out


def _task(tokenizer: str, limits: Limits, end_id: int, cut: bool, with_prompt: bool):
    def run(batches):
        base, n = TaskContext.get().partitionId() << 33, 0
        packer = VectorPacker(limits, cut)
        rows: list[tuple] = []

        def keep(sequences):
            nonlocal n
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    ids = p.ids[4 * p.start : 4 * (p.start + p.length)]
                    rows.append((p.doc_id, p.start, p.length, len(p.ids) // 4, p.loss(), base + n, offset, ids))
                    offset += p.length
                n += 1

        def flush():
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
            rows.clear()
            return batch

        enc = tokens.encoder(tokenizer, tokens.SPACED)
        for part, ids in tokens.encoded(batches, tokenizer, tokens.SPACED, end_id):
            prompts = enc.encode(part.column("prompt").to_pylist()) if with_prompt else [b""] * len(ids)
            for doc_id, prompt, x in zip(part.column("doc_id").to_pylist(), prompts, ids, strict=True):
                keep(packer.add(doc_id, prompt + x, len(prompt) // 4))
            if len(rows) >= 1000:
                yield flush()
        keep(packer.finish())
        if rows:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 1, cut: bool = True, doc_id: str = "doc_id", text: str = "text", prompt: str | None = None) -> DataFrame:
    """Pieces of the examples with their places in packed sequences, and their ids (little-endian unsigned 32-bit).

    tokenizer: file of a byte-level tokenizer. prompt: a column of tokens that come first and bear no loss.
    """
    prepare(docs.sparkSession)
    cols = [docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")] + ([docs[prompt].alias("prompt")] if prompt else [])
    return docs.select(*cols).mapInArrow(_task(tokenizer, limits, end_id, cut, prompt is not None), SCHEMA)
