"""Substring deduplication by sliding sentence spans.

A text is cut into sentences, and long ones into pieces, by winnowing: of each WINDOW neighbouring places between words the best is
cut, and ends of sentences always are. Best is a comma, semicolon or colon, then white space, then the rest; of equals the one after
the word of the smallest hash. So a piece has at most WINDOW words, and whether a place is cut depends on WINDOW - 1 places to each
side only: texts that share MIN_WORDS + 4 * WINDOW - 3 words share a span, wherever these stand. From every piece runs the
shortest span with at least `run` pieces and `min_words` words, and longer repeats are unions of such spans; shorter ones stay. The
words of a span, lower-cased and without what stands around them, are hashed to 96 bits. Spans meet by hash over the whole corpus; all
but the first of equal spans (by document id, then text hash, then place) are repeats, and pieces that a repeat covers are removed.

A task first compares its own spans: only the first of equal ones there goes on to the corpus-wide comparison, since the others are
repeats already. So a passage that a third of all documents hold sends a row a task and not a row a document to where it meets.

Defined results: null text stays null and an empty one empty, both without pieces; a null id counts as larger than any other; rows that
repeat id and text are one document and stay equal; spans may repeat within a document; what has too few pieces or words for a span
is never removed; very long texts are read whole, CHUNK characters at a time, and a place is cut where so many hold no end of a
sentence; an empty table gives no rows; columns beside the text are kept, but for ones named n_removed or removed, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.names import free, without
from helixframe.llm.rolling import BASES, mix, run_hashes
from helixframe.llm.tokens import blocks
from helixframe.storage import prepare

RUN, MIN_WORDS, WINDOW = 2, 20, 8
CHUNK = 500_000
#: Spans that a task compares among themselves at a time.
LOCAL = 300_000
# The marks that end sentences or parts of them, and opening ones, which belong to what follows.
ENDERS, WIDE_ENDERS, COMMAS, WIDE_COMMAS, OPENERS = ".!?…", "。！？｡", ",;:", "，、；：､", "「『（【《〈“‘([{¿¡"
#: Scripts without spaces (Thai to Khmer, kana, Han), of which each letter counts as a word.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]
_WORD, _LETTER, _SPACE, _LINE, _ENDER, _WIDE_ENDER, _COMMA, _WIDE_COMMA, _OPENER = (1 << i for i in range(9))
_AN_END = re.compile(rf"(?:\n|[{WIDE_ENDERS}]|[{ENDERS}](?:[^\w\s]|_)*\s)[\W_]*").search
_NEVER = (1 << 63) - 1


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, scrambled lower case) of each code point."""
    n = 0x110000
    kind = np.zeros(n, np.uint16)
    kind[np.fromiter((chr(i).isalnum() for i in range(n)), bool, n)] = _WORD
    for a, b in UNSPACED:
        own = kind[a : b + 1]
        own[own == _WORD] = _LETTER
    kind[np.fromiter((chr(i).isspace() for i in range(n)), bool, n)] = _SPACE
    kind[ord("\n")] = _SPACE | _LINE
    for marks, value in ((ENDERS, _ENDER), (WIDE_ENDERS, _WIDE_ENDER), (COMMAS, _COMMA), (WIDE_COMMAS, _WIDE_COMMA), (OPENERS, _OPENER)):
        kind[[ord(c) for c in marks]] = value
    lower = np.fromiter((ord(chr(i).lower()[0]) for i in range(n)), np.uint64, n)
    return kind, mix(lower + np.uint64(1))


def _cut_places(value: np.ndarray) -> np.ndarray:
    """Which places hold the least value of some WINDOW neighbouring ones; texts end with a 0, so that no window reaches over two."""
    n = len(value)
    if n < WINDOW:
        return value == 0
    least = np.lib.stride_tricks.sliding_window_view(value, WINDOW).min(axis=1) if WINDOW & (WINDOW - 1) else value
    step = 1
    while step < WINDOW and not WINDOW & (WINDOW - 1):
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    most = np.concatenate([np.zeros(WINDOW - 1, value.dtype), least, np.zeros(WINDOW - 1, value.dtype)])
    step = 1
    while step < WINDOW and not WINDOW & (WINDOW - 1):
        most = np.maximum(most[:-step], most[step:])
        step *= 2
    if WINDOW & (WINDOW - 1):
        most = np.lib.stride_tricks.sliding_window_view(most, WINDOW).max(axis=1)
    return (most == value) | (value == 0)


def _words(text: str, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first character, hash, value of the place behind, character to cut there) of each word; `last`: ends of the texts in it."""
    kinds, scrambled = _tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = kinds[codes]
    inside = kind & (_WORD | _LETTER) > 0
    bound = np.zeros(len(codes) + 1, bool)  # places between characters where no word goes on
    bound[last] = True
    before = np.concatenate([[0], kind[:-1]]).astype(np.uint16)
    starts = np.flatnonzero(inside & ((before & _WORD == 0) | (kind == _LETTER) | bound[:-1]))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none
    outside = np.flatnonzero(~inside)
    # The gap behind each word: characters that are in no word, up to the next word.
    g = np.searchsorted(outside, np.append(starts, len(codes)))
    first, stop = g[:-1], g[1:]
    ends = np.where(stop > first, outside[np.minimum(first, max(len(outside) - 1, 0))] if len(outside) else len(codes), np.append(starts[1:], len(codes)))
    some = np.flatnonzero(stop > first)
    has = np.zeros(len(starts), np.uint16)
    cut = np.append(starts[1:], len(codes))
    late = np.zeros(len(starts), bool)
    if len(some):
        own = outside[g[0] :]
        kind_of = kind[own]
        at = (first - g[0])[some]
        has[some] = np.bitwise_or.reduceat(kind_of, at)
        rank = np.where(kind_of & _LINE > 0, 3, np.where(kind_of & _SPACE > 0, 2, np.where(kind_of == _OPENER, 0, 1))).astype(np.int64)
        best = np.maximum.reduceat((rank << 48) | (own + 1), at)
        cut[some] = np.where(best >> 48 > 0, best & ((1 << 48) - 1), ends[some])
        space = np.maximum.reduceat(np.where(kind_of & _SPACE > 0, own, -1), at)
        ender = np.minimum.reduceat(np.where(kind_of == _ENDER, own, len(codes)), at)
        comma = np.minimum.reduceat(np.where(kind_of == _COMMA, own, len(codes)), at)
        late[some] = ender < space
        has[some] = np.where(comma < space, has[some], has[some] & ~np.uint16(_COMMA))
    word = run_hashes(scrambled[codes], starts, ends, BASES[0])
    value = word >> np.uint64(2) | np.uint64(1)
    comma = has & (_COMMA | _WIDE_COMMA) > 0
    value |= np.where(comma, 0, np.where(has & _SPACE > 0, 1, 2)).astype(np.uint64) << np.uint64(62)
    value[(has & (_LINE | _WIDE_ENDER) > 0) | late] = 0
    value[np.searchsorted(starts, last)[np.searchsorted(starts, last) > 0] - 1] = 0
    return starts, word, value, cut


def _chunks(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of about CHUNK characters that end behind an end of a sentence if there is one."""
    at = 0
    while len(text) - at > 2 * CHUNK:
        found = _AN_END(text, at + CHUNK, at + 2 * CHUNK)
        end = found.end() if found else at + 2 * CHUNK
        yield at, end
        at = end
    yield at, len(text)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_words() of the texts put together; long ones in chunks."""
    sizes = np.array([len(t) for t in texts])
    if sizes.sum() <= 2 * CHUNK:
        return _words("".join(texts), np.cumsum(sizes))
    parts, at = [], 0
    for t in texts:
        for a, b in _chunks(t):
            first, word, value, cut = _words(t[a:b], np.array([b - a]))
            parts.append((first + at + a, word, value, cut + at + a))
        at += len(t)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def spans(texts: list[str], run: int = RUN, min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """(hash, more bits of it, number of the text, first character, end) of the span from each piece that has one."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint32, np.int64, np.int64, np.int64))
    start, word, value, cut = _joined(texts)
    ends = np.cumsum(sizes)
    behind = np.flatnonzero(_cut_places(value))  # last words of pieces
    stop = behind + 1
    begin = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
    text = np.searchsorted(ends, start[begin], "right") if len(begin) else begin
    own_first = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
    own_last = np.concatenate([text[1:] != text[:-1], [True]]) if len(text) else own_first
    left = np.where(own_first, (ends - sizes)[text], np.concatenate([[0], cut[behind][:-1]]) if len(text) else 0)
    right = np.where(own_last, ends[text], cut[behind])
    number = np.arange(len(stop))
    to = np.maximum(np.searchsorted(stop, begin + min_words), number + run - 1)
    final = np.searchsorted(text, text, "right") - 1
    a = np.flatnonzero(to <= final)
    b = to[a]
    h1 = run_hashes(word, begin[a], stop[b], BASES[1])
    h2 = run_hashes(mix(word ^ np.uint64(BASES[0])), begin[a], stop[b], BASES[2]).astype(np.uint32)
    base = (ends - sizes)[text[a]]
    return h1, h2, text[a], left[a] - base, right[b] - base


def first_of_equals(h1: np.ndarray, h2: np.ndarray, *place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows without repeats of one place, whether an equal hash has a smaller place)."""
    order = np.argsort(h1, kind="stable")
    same = h1[order][1:] == h1[order][:-1]
    among = np.zeros(len(h1), bool)
    among[order[1:][same]] = among[order[:-1][same]] = True
    rows = np.flatnonzero(among)
    later, once = np.zeros(len(h1), bool), np.ones(len(h1), bool)
    if len(rows):
        own = rows[np.lexsort([p[rows] for p in place[::-1]] + [h2[rows], h1[rows]])]
        equal = (h1[own][1:] == h1[own][:-1]) & (h2[own][1:] == h2[own][:-1])
        twice = equal & np.logical_and.reduce([p[own][1:] == p[own][:-1] for p in place])
        new = np.concatenate([[True], ~equal])
        leader = own[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        later[own] = np.logical_or.reduce([p[own] != p[leader] for p in place])
        once[own[1:][twice]] = False
    keep = np.flatnonzero(once)
    return keep, later[keep]


def _spans(run: int, min_words: int):
    names = ["known", "h1", "h2", "doc", "row", "place"]

    def made(held):
        h1, h2, doc, row, place = (np.concatenate(c) for c in zip(*held, strict=True))
        keep, known = first_of_equals(h1, h2, doc, row, place)
        # Known repeats meet nothing: what stands for their hash deals them out evenly.
        dealt = mix((doc ^ row ^ place)[keep].view(np.uint64))
        k1, k2 = np.where(known, dealt, h1[keep]), np.where(known, 0, h2[keep]).astype(np.uint32)
        columns = [known, k1.view(np.int64), k2.view(np.int32), doc[keep], row[keep], place[keep]]
        for at in range(0, len(keep), 50_000):
            yield pa.record_batch([pa.array(c[at : at + 50_000]) for c in columns], names=names)

    def task(batches):
        held, n = [], 0
        for batch in batches:
            texts, doc, row = batch.column("text").to_pylist(), batch.column("doc").to_numpy(), batch.column("row").to_numpy()
            for part in blocks(texts, rows=1000, chars=CHUNK):
                h1, h2, text, a, b = spans(texts[part], run, min_words)
                held.append((h1, h2, doc[part][text], row[part][text], a << 32 | b))
                n += len(h1)
                if n >= LOCAL:
                    yield from made(held)
                    held, n = [], 0
        if n:
            yield from made(held)

    return task


def _rebuild(text: str, covered: str):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def task(batches):
        for batch in batches:
            values, places = batch.column(text).to_pylist(), batch.column(covered).to_pylist()
            for part in blocks(values):
                made = [(t, []) if not c else cut(t, c) for t, c in zip(values[part], places[part], strict=True)]
                rows = batch.slice(part.start, len(made)).drop_columns([covered])
                clean = pa.array([m[0] for m in made], pa.string())
                columns = [clean if name == text else column for name, column in zip(rows.schema.names, rows.columns, strict=True)]
                ranges = pa.array([[{"start": a, "end": b} for a, b in m[1]] for m in made], kind)
                yield pa.record_batch([*columns, pa.array([len(m[1]) for m in made], pa.int32()), ranges], names=[*rows.schema.names, "n_removed", "removed"])

    return task


def cut(text: str, places: list[int]) -> tuple[str, list[tuple[int, int]]]:
    """(text without the covered ranges, those ranges merged); a place is the first character << 32 | the end."""
    ranges: list[tuple[int, int]] = []
    for p in sorted(places):
        a, b = p >> 32, p & 0xFFFFFFFF
        if ranges and a <= ranges[-1][1]:
            ranges[-1] = ranges[-1][0], max(b, ranges[-1][1])
        else:
            ranges.append((a, b))
    at, kept = 0, []
    for a, b in ranges:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]]), ranges


def dedup(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with repeated pieces removed from the text, n_removed (ranges) and removed (these ranges of its characters before)."""
    prepare(docs.sparkSession)
    doc = F.coalesce(docs[doc_id].cast("long"), F.lit(_NEVER))
    row = F.xxhash64(docs[text])
    inputs = docs.filter(F.length(docs[text]) > 0).select(docs[text].alias("text"), doc.alias("doc"), row.alias("row"))
    found = inputs.mapInArrow(_spans(run, min_words), "known boolean, h1 long, h2 int, doc long, row long, place long")
    in_order = "rank() over (partition by known, h1, h2 order by doc, row, place) > 1"
    repeats = found.withColumn("later", F.expr(in_order)).filter("known or later")
    covered = repeats.groupBy("doc", "row").agg(F.collect_set("place").alias("covered"))
    rest = without(docs, "n_removed", "removed")
    d, r, c = free(docs, "doc", "row", "covered")
    keyed = rest.withColumns({d: F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_NEVER)), r: F.xxhash64(f"`{text}`")})
    joined = keyed.join(covered.toDF(d, r, c), [d, r], "left").select(*(F.col(f"`{x}`") for x in rest.columns), c)
    schema = ", ".join([*(f"`{x}` {t}" for x, t in rest.dtypes), "n_removed int, removed array<struct<start: int, end: int>>"])
    return joined.mapInArrow(_rebuild(text, c), schema)
