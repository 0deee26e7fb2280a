"""Whole-text tokenisation in Arrow batches with the tokenizers library.

A text of plain letters is cut into words by the tokenizer's own pattern; words repeat, so each worker keeps the
ids that the tokenizer's model gave for recent ones. Other texts are first cut into chunks where the pattern always cuts,
and chunks with other letters go through the whole tokenizer, which normalises them.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

#: Chunks of a byte-level tokenizer whose pattern joins one leading space to a word.
SPACED = r" ?\S+|\s+(?!\S)|\s+"
#: Chunks of a tokenizer that drops white space.
BARE = r"\S+"
#: White space to Python but not to the tokenizers' patterns: a text with one is encoded in one piece.
_ODD = "\x1c\x1d\x1e\x1f"


#: A character from U+0300 on. Below, letters have no combining marks and lower case is the same in every library.
_OTHER = re.compile("[^\x00-\u02ff]").search
# Fixed value: the words of the byte-level pre-tokeniser.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


def plain_pattern(pattern: str) -> str:
    """The pattern with \\p{L} and \\p{N} spelled out for the letters below U+0300, which the re module matches faster."""
    out, inside, at = [], False, 0
    named = {rf"\p{{{k}}}": re.escape("".join(chr(c) for c in range(0x300) if unicodedata.category(chr(c))[0] == k)) for k in "LN"}
    while at < len(pattern):
        part = pattern[at : at + 5]
        if part in named:
            out.append(named[part] if inside else f"[{named[part]}]")
            at += 5
            continue
        inside = pattern[at] == "[" or inside and pattern[at] != "]"
        out.append(pattern[at])
        at += 1
    return "".join(out)


class _WordIds(dict):
    """Ids of words as bytes, asked of the tokenizer's model when first needed."""

    MAX = 400_000
    MAX_KEY = 64

    def __init__(self, model):
        super().__init__()
        self._tokenize = model.tokenize
        self._letters = byte_letters()

    def __missing__(self, word: str) -> bytes:
        found = self._tokenize(word.encode().decode("latin-1").translate(self._letters))
        ids = b"".join([t.id.to_bytes(4, "little") for t in found])
        if len(word) <= self.MAX_KEY:
            if len(self) >= self.MAX:
                self.clear()
            self[word] = ids
        return ids


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, chunks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._chunks = re.compile(chunks).findall
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        added = [t["content"] for t in made.get("added_tokens") or []]
        #: Words of the vocabulary that the library finds in a text before it cuts it: such texts go through the whole library.
        self._added = re.compile("|".join(map(re.escape, added)), re.I).search if added else None
        self._lower = "Lowercase" in str(made["normalizer"])
        steps = (made["pre_tokenizer"] or {}).get("pretokenizers") or [made["pre_tokenizer"]]
        self._words = re.compile(plain_pattern(steps[0].get("pattern", {}).get("Regex", _BYTE_LEVEL))).findall
        self._ids = _WordIds(self._tokenizer.model)

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._ids.__getitem__, self._words(text.lower() if self._lower else text)))

    def _one(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(c in text for c in _ODD) or self._added and self._added(text):
            return self._whole(text)
        if text.isascii() or not _OTHER(text):
            return self._plain(text)
        return b"".join([self._whole(c) if _OTHER(c) else self._plain(c) for c in self._chunks(text)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self._one(t) for t in texts]


_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(path: str, chunks: str) -> ChunkEncoder:
    """One per worker process, so that tasks share what is remembered."""
    if (path, chunks) not in _ENCODERS:
        _ENCODERS[path, chunks] = ChunkEncoder(path, chunks)
    return _ENCODERS[path, chunks]


def blocks(values: list[str | None], rows: int = 256, chars: int = 2_000_000) -> Iterator[slice]:
    """Slices of bounded size, at least one value each."""
    start = size = 0
    for i, v in enumerate(values):
        if i > start and (i - start >= rows or size + len(v or "") > chars):
            yield slice(start, i)
            start, size = i, 0
        size += len(v or "")
    if start < len(values):
        yield slice(start, len(values))


def encoded(batches: Iterable, path: str, chunks: str, end_id: int, text: str = "text") -> Iterator[tuple]:
    """(rows of a batch as a slice of its Arrow table, ids of each with the end id as bytes)."""
    end = np.array([end_id], "<u4").tobytes()
    enc = encoder(path, chunks)
    for batch in batches:
        values = batch.column(text).to_pylist()
        for part in blocks(values):
            yield batch.slice(part.start, part.stop - part.start), [ids + end for ids in enc.encode(values[part])]
