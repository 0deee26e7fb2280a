"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming distance, grouped by connection.

components() gives the groups of fingerprints alone. similar() finds all links of a Jaccard similarity of word shingles: links of
fingerprints are candidates, one a text and bucket and not all pairs of a group, and each is held against the exact similarity.
Texts that these links leave apart then meet by an equi-join of prefixes, which loses no pair, and are checked in the same way, or in
blocks where many meet.

Defined results: null text is empty, and empty texts are equal to each other; ids may repeat or be null (a null id
counts as larger than any other, and a group of null ids only has a null component_id); rows that repeat id and text
fall into one group, and drop_similar() keeps one of them, any if other columns differ; very long texts are read whole, CHUNK bytes at
a time; an empty table gives no rows; extra columns of any name are kept by drop_similar() and ignored by the others.
"""

from __future__ import annotations

from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm import hamming
from helixframe.llm.names import free
from helixframe.llm.rolling import BASES, mix, run_hashes
from helixframe.llm.tokens import blocks
from helixframe.operators.components import connected_components
from helixframe.storage import drop, prepare, stage

SEED = 42
#: Bytes whose words are hashed at a time.
CHUNK = 500_000
#: Candidates of one text that meet it in one task; of a text with more, several copies go out.
HUB = 256
#: Texts outside of the largest group at a shingle up to which they are paired; beyond, blocks of texts are compared in tasks: of so many
#: texts and shingles each on average, and so many columns of their incidence matrix at a time.
FEW, BLOCK, BLOCK_SHINGLES, COLUMNS = 256, 1500, 500_000, 2048
#: Shingles that prefixes of similar texts share at least, if their sets have so many, as a number and as a share of the set: a larger one
#: makes prefixes longer, and fewer unlike texts share so many. LOCAL: rows of prefixes that a task compares itself at a time.
SHARED, SHARE = 4, 0.04
#: Texts in which frequent shingles are counted, or one in EVERY if that is more; texts of those that hold a frequent one at least, and
#: frequent ones kept at most. Unlike texts meet at each shingle that is not known as frequent, so what is known has to grow with the table.
LOCAL = 500_000
SAMPLE, EVERY, FREQUENT, MOST = 10_000, 10, 3, 1_000_000
#: Bits of a text's parities, which rule out most unlike pairs before their texts are dealt; a power of two, and 64 at least.
PARITIES = 1024


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(own: list[bytes], n: int):
    """All runs of n words joined by spaces; of fewer words the whole sequence; of none, none."""
    if len(own) < n:
        return [b" ".join(own)] if own else []
    return own if n == 1 else map(b" ".join, zip(*(own[i:] for i in range(n))))


def hashes(features) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, features, repeat(SEED)), np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(n: int):
    def run(batches):
        for batch in batches:
            texts, rest = batch.column("text").to_pylist(), batch.drop_columns(["text"])
            for part in blocks(texts):
                own = [words(t) for t in texts[part]]
                found = [fingerprint(hashes(shingles(w, n))) for w in own]
                rows = rest.slice(part.start, len(found))
                yield pa.record_batch([*rows.columns, pa.array(np.array(found, np.uint64).view(np.int64))], names=[*rows.schema.names, "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of the text as a signed long."""
    prepare(docs.sparkSession)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _roots(fps: DataFrame, tau: int) -> DataFrame:
    """(fp, root) of the distinct fingerprints that have links."""
    found = connected_components(hamming.links(fps, tau), "a", "b")
    return found.select(F.col("node").alias("fp"), "root")


def components(docs: DataFrame, tau: int = 3, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links within tau bits lead to."""
    prints = stage(fingerprints(docs, shingle, doc_id=doc_id, text=text), "fingerprints")
    groups = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "groups")
    rooted = stage(groups.join(_roots(groups.select("fp"), tau), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = stage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_SCRAMBLED = mix(_LOWER + np.uint64(1))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word."""
    codes = np.frombuffer(raw, np.uint8)
    blank = np.concatenate([[True], _BLANK[codes], [True]])
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    return starts, run_hashes(_SCRAMBLED[codes], starts, ends, BASES[0])


def _hashed_long(raw: bytes) -> np.ndarray:
    """Hashes of the words of a long text, some CHUNK bytes at a time; a longer word has a hash of its own kind."""
    out, at = [], 0
    while at < len(raw):
        part = np.frombuffer(raw, np.uint8, min(CHUNK, len(raw) - at), at)
        end = at + len(part)
        if end < len(raw) and not _BLANK[raw[end]]:
            blanks = np.flatnonzero(_BLANK[part])
            if not len(blanks):
                while end < len(raw) and not _BLANK[raw[end]]:
                    end += 1
                out.append(np.array([xxhash.xxh64_intdigest(raw[at:end].lower(), SEED)], np.uint64))
                at = end
                continue
            end = at + int(blanks[-1]) + 1
        out.append(_hashed(raw[at:end])[1])
        at = end
    return np.concatenate([np.zeros(0, np.uint64), *out])


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, where each text's begin and the last end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if sum(map(len, raw)) + len(raw) > CHUNK:
        own = [_hashed_long(r) for r in raw]
        return np.concatenate([np.zeros(0, np.uint64), *own]), np.cumsum([0, *map(len, own)])
    starts, h = _hashed(b" ".join(raw))
    firsts = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return h, np.searchsorted(starts, firsts)


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values of each owner, sorted and once each; where each owner's begin and the last end)."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(n + 1))


def members(texts: list[str | None], shingle: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(the distinct shingles of each text as sorted hashes, 0 alone for a text without words; fingerprints of the texts' sets of words)."""
    h, ends = word_hashes(texts)
    n = len(texts)
    count = np.diff(ends)
    owner = np.repeat(np.arange(n), count)
    left = np.repeat(ends[1:], count) - np.arange(len(h))  # words from each one to the end of its text
    first = np.arange(len(h)) == ends[owner] if len(h) else np.zeros(0, bool)
    begin = np.flatnonzero((left >= shingle) | first)
    runs = run_hashes(h, begin, np.minimum(begin + shingle, ends[owner[begin] + 1]), BASES[1]) if len(h) else h
    values, at = _distinct(runs, owner[begin], n)
    none = np.zeros(1, np.uint64)
    sets = [values[a:b] if b > a else none for a, b in zip(at.tolist(), at[1:].tolist())]
    words_, at = _distinct(h, owner, n)
    return sets, np.array([fingerprint(words_[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())], np.uint64)


def least_shared(n: int, similarity: float) -> int:
    """Members that a set of n shares with any similar one at least."""
    return max(1, ceil(similarity * n - 1e-9))


def needed(n: int, similarity: float) -> int:
    """Members that the prefix of a set of n shares with any similar set's at least, if that one's does not ask for fewer."""
    return min(max(SHARED, ceil(SHARE * n)), least_shared(n, similarity))


def prefix(own: np.ndarray, frequent: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """(first members in the order infrequent before frequent, then by value; how many of them a similar set's prefix shares).

    With the same frequent (sorted) for all sets, two similar sets share the smaller of their numbers at least.
    """
    at = np.minimum(np.searchsorted(frequent, own), max(len(frequent) - 1, 0))
    common = frequent[at] == own if len(frequent) else np.zeros(len(own), bool)
    overlap = least_shared(len(own), similarity)
    need = needed(len(own), similarity)
    return np.concatenate([own[~common], own[common]])[: len(own) - overlap + need], need


def _members(shingle: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in blocks(texts, chars=CHUNK):
                found, counts = np.unique(np.concatenate(members(texts[part], shingle)[0]), return_counts=True)
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(counts)], names=["h", "n"])

    return run


def _frequent(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """Sorted hashes of the shingles that many of some texts hold; any choice gives the same links."""
    body = F.coalesce(docs[text], F.lit("")).alias("text")
    every = max(1, min(-(-docs.count() // SAMPLE), EVERY))
    some = docs.select(body).filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    counts = some.mapInArrow(_members(shingle), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    found = counts.orderBy(F.col("n").desc(), "h").limit(MOST).select("h").toPandas()
    return np.sort(found["h"].to_numpy(np.int64).view(np.uint64))


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """A row of longs a set: bit i is the parity of its members of kind i. Two sets differ in as many members as their rows in bits, at least."""
    kind = (np.concatenate(sets) >> np.uint64(65 - PARITIES.bit_length())).astype(np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(own) for own in sets])
    odd = np.bincount(owner * PARITIES + kind, minlength=len(sets) * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sets), PARITIES), axis=1, bitorder="little").view(np.int64)


def _alike(a: str, b: str, similarity: float):
    """Whether sets of size{a} and size{b} may be similar, by their parities in bits{a} and bits{b}: similar ones differ in few members."""
    differ = F.aggregate(F.zip_with(f"bits{a}", f"bits{b}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return differ <= (F.col(f"size{a}") + F.col(f"size{b}")) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _prints(shingle: int, similarity: float):
    """Adds to rows of texts their fingerprints, numbers of shingles, of those that prefixes of similar texts share, and parities."""

    def run(batches):
        for batch in batches:
            texts, rest = batch.column("text").to_pylist(), batch.drop_columns(["text"])
            for part in blocks(texts, rows=1000, chars=CHUNK):
                sets, fps = members(texts[part], shingle)
                rows = rest.slice(part.start, len(sets))
                needs = [needed(len(own), similarity) for own in sets]
                bits = parities(sets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bits.shape[1], pa.int32()), pa.array(bits.ravel()))
                columns = [pa.array(fps.view(np.int64)), pa.array([len(own) for own in sets], pa.int32()), pa.array(needs, pa.int32()), lists]
                yield pa.record_batch([*rows.columns, *columns], names=[*rows.schema.names, "fp", "size", "need", "bits"])

    return run


def meeting_rows(h: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, h, key) once each of all rows whose h has one key here, and of others all as known and one more, which goes on as not known."""
    order = np.lexsort((key, h))
    h, key = h[order], key[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])
    h, key = h[new], key[new]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    known = ~first
    known[:-1] |= ~first[1:]
    return np.concatenate([np.zeros(int(first.sum()), bool), np.ones(int(known.sum()), bool)]), np.concatenate([h[first], h[known]]), np.concatenate([key[first], key[known]])


def _prefixes(shingle: int, similarity: float, frequent: np.ndarray):
    def made(held):
        known, h, key = meeting_rows(*(np.concatenate(c) for c in zip(*held, strict=True)))
        for at in range(0, len(h), 50_000):
            yield pa.record_batch([pa.array(c[at : at + 50_000]) for c in (known, h.view(np.int64), key)], names=["known", "h", "key"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("key").to_numpy()
            for part in blocks(texts, rows=1000, chars=CHUNK):
                for own, key in zip(members(texts[part], shingle)[0], keys[part], strict=True):
                    first, _ = prefix(own, frequent, similarity)
                    held.append((first, np.full(len(first), key)))
                    n += len(first)
                if n >= LOCAL:
                    yield from made(held)
                    held, n = [], 0
        if n:
            yield from made(held)

    return run


def _text_edges(texts: DataFrame, tau: int) -> DataFrame:
    """(a, b): links of the fingerprints, each between one text of either, and of a fingerprint's first text with its others."""
    reps = stage(texts.groupBy("fp").agg(F.min("text_key").alias("rep"), F.count("*").alias("n")), "reps")
    found = hamming.links(reps.select("fp"), tau).distinct()
    x, y = (reps.select(F.col("fp").alias(f), F.col("rep").alias(r)) for f, r in (("a", "ra"), ("b", "rb")))
    between = found.join(x, "a").join(y, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    inside = texts.join(reps.filter("n > 1"), "fp").filter("text_key <> rep").select(F.col("rep").alias("a"), F.col("text_key").alias("b"))
    out = stage(between.union(inside), "edges")
    drop(reps)
    return out


def _meetings(prefixes: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame:
    """(h, key, size, need, root, own, hot): texts at the shingles of prefixes where groups of found (node, root) meet.

    own: in the largest group there. hot: more than FEW texts are outside of it. prefixes: (known, h, key); texts: (key, size, need).
    """
    same = Window.partitionBy("known", "dealt")
    dealt = prefixes.withColumn("dealt", F.when(F.col("known"), F.xxhash64("h", "key")).otherwise(F.col("h")))
    several = dealt.withColumns({"least": F.min("key").over(same), "most": F.max("key").over(same)}).filter("known or least < most")
    shared = stage(several.select("h", "key").distinct(), "shared")
    roots = found.select(F.xxhash64("node").alias("key"), F.xxhash64("root").alias("root"))
    own = stage(texts.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "own")
    rooted = stage(shared.join(own, "key"), "rooted")
    drop(shared, own)
    mixed = stage(rooted.groupBy("h").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("h"), "mixed")
    rows = stage(rooted.join(mixed, "h"), "rows")
    drop(rooted, mixed)
    sizes = rows.groupBy("h", "root").agg(F.count("*").alias("n")).groupBy("h").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("others"))
    main, sizes = F.col("root") == F.col("main"), stage(sizes, "sizes")
    out = stage(rows.join(sizes, "h").select("h", "key", "size", "need", "root", main.alias("own"), (F.col("others") > FEW).alias("hot")), "meetings")
    drop(rows, sizes)
    return out


def _pairs(meetings: DataFrame, similarity: float) -> DataFrame:
    """(a, b): keys of texts in different groups that may be similar and share no hot shingle of their prefixes, FEW a text and shingle at most."""
    x, y = (meetings.filter("not hot").select("h", *(F.col(c).alias(c + e) for c in ("key", "root", "size", "need", "own"))) for e in ("1", "2"))
    near = F.least("size1", "size2") >= F.greatest("size1", "size2") * similarity - 1e-6
    once = (F.col("root1") != F.col("root2")) & (F.col("own2") | (F.col("key1") < F.col("key2")))
    a, b = F.least("key1", "key2").alias("a"), F.greatest("key1", "key2").alias("b")
    pairs = x.filter("not own1").join(y, "h").filter(once & near).groupBy(a, b).agg(F.count("*").alias("n"), F.first(F.least("need1", "need2")).alias("need"))
    return pairs.filter("n >= need").select("a", "b")


def links_among(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect all sets that similar pairs connect; products of parts of the incidence matrix count what pairs share."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], float)
    owner = np.repeat(np.arange(n), sizes.astype(int))
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    several = np.bincount(column) > 1
    column, owner = (np.cumsum(several) - 1)[column][several[column]], owner[several[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((n, n), np.float32)
    for at in range(0, int(several.sum()), COLUMNS):
        i, j = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((n, COLUMNS), np.float32)
        part[owner[i:j], column[i:j] - at] = 1
        both += part @ part.T
    left, out = np.ones(n, bool), []
    for root in range(n):
        todo = [root] if left[root] else []
        left[root] = False
        while todo:
            x = todo.pop()
            shared = both[x].astype(float)
            found = np.flatnonzero((shared >= similarity * (sizes[x] + sizes - shared)) & left)
            left[found] = False
            todo.extend(found.tolist())
            out.extend((x, y) for y in found.tolist())
    return out


def _linked(shingle: int, similarity: float):
    def run(batches):
        last, keys, sets = None, [], []

        def close():
            found = links_among(sets, similarity) if len(sets) > 1 else []
            return [(keys[i], keys[j]) for i, j in found]

        for batch in batches:
            texts = batch.column("text").to_pylist()
            group = list(zip(*(batch.column(c).to_pylist() for c in ("h", "b1", "b2", "text_key")), strict=True))
            out = []
            for part in blocks(texts, rows=1000, chars=CHUNK):
                for (*g, key), own in zip(group[part], members(texts[part], shingle)[0], strict=True):
                    if g != last:
                        out += close()
                        last, keys, sets = g, [], []
                    keys.append(key)
                    sets.append(own)
            if out:
                yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["a", "b"])
        if out := close():
            yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def _hot_links(meetings: DataFrame, bodies: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links that connect similar texts which share a hot shingle. Texts of a shingle are dealt to blocks, and tasks take pairs of blocks."""
    hot = meetings.filter("hot")
    whole = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    blocks_ = stage(hot.groupBy("h").agg(whole.alias("k")), "blocks")
    own = F.pmod(F.xxhash64("key"), F.col("k")).cast("int")
    dealt = hot.select("h", "key").join(blocks_, "h").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.filter("k = 1 or own <> other").select("h", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "key")
    cols = ["h", "b1", "b2"]
    full = dealt.hint("merge").join(bodies.withColumn("key", F.xxhash64("text_key")), "key").select(*cols, "text_key", "text").repartition(*cols).sortWithinPartitions(*cols, "text_key")
    return stage(full.mapInArrow(_linked(shingle, similarity), "a string, b string"), "links")


def _check(shingle: int, similarity: float):
    def run(batches):
        last, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "text1", "text2"))
            for part in blocks(y, chars=CHUNK):
                out = []
                for i, other in zip(range(part.start, part.stop), members(y[part], shingle)[0]):
                    if a[i] != last:
                        last, own = a[i], members([x[i]], shingle)[0][0]
                    small, large = sorted((len(own), len(other)))
                    if small >= similarity * large:
                        both = small + large - len(np.unique(np.concatenate([own, other])))
                        if both >= similarity * (small + large - both):
                            out.append((a[i], b[i]))
                if out:
                    yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def _with_text(edges: DataFrame, bodies: DataFrame, end: str, name: str) -> DataFrame:
    """The edges with the text of one end; of a text with more than HUB edges, several copies go to as many groups of them."""
    other = "b" if end == "a" else "a"
    many = stage(edges.groupBy(end).count().filter(F.col("count") > HUB).select(end, F.ceil(F.col("count") / HUB).cast("int").alias("k")), "hubs")
    salted = edges.join(many, end, "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("k", F.lit(1))).cast("int")).drop("k")
    own = bodies.select(F.col("text_key").alias(end), F.col("text").alias(name)).join(many, end, "left")
    copies = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))).drop("k")
    return salted.join(copies, [end, "salt"]).drop("salt")


def _bodies(keys: DataFrame, texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(text_key, text) of the keys; rows: (text_key, first, text), texts: (text_key, first).

    Here and where documents are dropped, texts are merged with keys at every size, so that plans do not change as tables grow.
    """
    wanted = stage(texts.select("text_key", "first").join(keys, "text_key"), "wanted")
    out = stage(rows.join(wanted.hint("merge"), ["text_key", "first"]).dropDuplicates(["text_key"]).select("text_key", "text"), "bodies")
    drop(wanted)
    return out


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("text_key")).union(edges.select("b")).distinct()


def _verified(edges: DataFrame, bodies: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The edges (a, b) between text keys whose texts are similar; bodies: (text_key, text)."""
    both = _with_text(_with_text(edges, bodies, "b", "text2"), bodies, "a", "text1")
    return stage(both.sortWithinPartitions("a").select("a", "b", "text1", "text2").mapInArrow(_check(shingle, similarity), "a string, b string"), "links")


def similar(docs: DataFrame, tau: int = 8, shingle: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, component_id, kept_key): groups of documents of that Jaccard similarity or more, one row an id and text.

    The first candidates have fingerprints of their sets of words within tau bits: single words keep near copies closer than
    shingles do, and the exact check rules out what only shares its words. Texts of different groups that share enough of
    their prefixes are then checked one by one, so tau bears on speed alone. The document to keep has component_id and kept_key.
    """
    prepare(docs.sparkSession)
    never = F.lit((1 << 63) - 1)
    body = F.coalesce(docs[text], F.lit(""))
    read = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.md5(body).alias("text_key"), body.alias("text"))
    prints = stage(read.mapInArrow(_prints(shingle, similarity), "doc_id long, text_key string, fp long, size int, need int, bits array<long>"), "fingerprints")
    texts = stage(prints.groupBy("text_key", "fp", "size", "need", "bits").agg(F.min(F.coalesce("doc_id", never)).alias("first")), "texts")
    rows = read.select(F.coalesce("doc_id", never).alias("first"), "text", "text_key")
    edges = _text_edges(texts, tau)
    bodies = _bodies(_ends(edges), texts, rows)
    checked = _verified(edges, bodies, shingle, similarity)
    drop(edges, bodies)
    prefixes = read.select(F.xxhash64("text_key").alias("key"), "text").mapInArrow(_prefixes(shingle, similarity, _frequent(docs, text, shingle)), "known boolean, h long, key long")
    meetings = _meetings(prefixes, texts.select(F.xxhash64("text_key").alias("key"), "size", "need"), connected_components(checked, "a", "b"))
    named = texts.select("text_key", F.xxhash64("text_key").alias("key"))
    found = stage(_pairs(meetings, similarity), "pairs")
    x, y = (texts.select(F.xxhash64("text_key").alias(k), *(F.col(c).alias(c + k) for c in ("text_key", "size", "bits"))) for k in "ab")
    alike = found.join(x, "a").join(y, "b").filter(_alike("a", "b", similarity))
    pairs = stage(alike.select(F.col("text_keya").alias("a"), F.col("text_keyb").alias("b")), "pairs")
    drop(found)
    at_hot = meetings.filter("hot").select("key").distinct().join(named, "key").select("text_key")
    bodies = _bodies(_ends(pairs).union(at_hot).distinct(), texts, rows)
    links = _verified(pairs, bodies, shingle, similarity).union(_hot_links(meetings, bodies, shingle, similarity))
    drop(meetings, pairs, bodies)
    found = connected_components(checked.union(links), "a", "b")
    rooted = stage(texts.join(found, texts["text_key"] == found["node"], "left").select("text_key", "first", F.coalesce("root", "text_key").alias("root")), "rooted")
    least = stage(rooted.groupBy("root").agg(F.min(F.struct("first", "text_key")).alias("least")), "least")
    labels = rooted.join(least, "root").select("text_key", F.col("least.first").alias("component_id"), F.col("least.text_key").alias("kept_key"))
    out = prints.select("doc_id", "text_key").distinct().join(labels, "text_key")
    return out.select("doc_id", "text_key", F.nullif("component_id", never).alias("component_id"), "kept_key")


def drop_similar(docs: DataFrame, tau: int = 8, shingle: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with one document of each group: the smallest id, then the smallest text hash; repeated rows once."""
    found = similar(docs, tau, shingle, similarity, doc_id, text)
    never = F.lit((1 << 63) - 1)
    i, k = free(docs, "id", "key")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.withColumns({i: F.coalesce(F.col(f"`{doc_id}`").cast("long"), never), k: F.md5(body)})
    key = [F.coalesce("doc_id", never).alias(i), F.col("text_key").alias(k)]
    gone = stage(found.filter("not (doc_id <=> component_id and text_key = kept_key)").select(*key), "gone")
    several = stage(rows.groupBy(i, k).count().filter("count > 1").select(i, k), "several")  # few, as a rule: only these rows are dealt out by key
    kept = rows.join(gone.hint("merge"), [i, k], "left_anti")
    if several.isEmpty():
        return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
    once = kept.join(several, [i, k], "left_anti").union(kept.join(several, [i, k], "left_semi").dropDuplicates([i, k]))
    return once.select(*(F.col(f"`{c}`") for c in docs.columns))
