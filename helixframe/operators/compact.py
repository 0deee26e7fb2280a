"""Unambiguous paths cut where their vertices change bucket, counted and joined bucket by bucket.

A vertex belongs to the bucket of its least m-mer, in an order that is the same on both strands, so neighbours mostly share one.
Reads are cut into the runs of their vertices in a bucket, with the edge on each side, and dealt by bucket as numbers of 32 bases:
one shuffle of a few bytes a run. A task then has every occurrence of every edge of its vertices; it counts them, types the vertices
and joins the paths inside it. What is left between buckets are links between such pieces, about an eighth of the vertices.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators.components import connected_components
from helixframe.storage import prepare

#: Bases whose runs are cut at once, windows that are counted at once, and bases a bucket is meant to get.
CUT, COUNT, BUCKET = 4_000_000, 4_000_000, 8_000_000
MOST_BUCKETS = 4096

RECORDS = "bucket int, codes binary, sizes binary"
PIECES = (
    "v long, h boolean, ev long, eh boolean, n long, seq string, least long, freq long, "
    "nv long, nh boolean, ncnt long, nslot int, bv long, bh boolean, bcnt long, bslot int, is_piece boolean"
)
_NO = np.uint64(0)
_LUT = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _LUT[ord(_c)] = _LUT[ord(_c.lower())] = _i
_LETTERS = np.frombuffer(b"ACGT", np.uint8)
_PLACE = np.array([0, 3, 2, 1])  # of A, C, G and T in "ATGC"


def fits(k: int) -> bool:
    """An edge must fit 32 bases, and no vertex may be its own reverse complement."""
    return k % 2 == 1 and 3 <= k <= 31


def revcomp(x: np.ndarray, n: int) -> np.ndarray:
    """Of numbers of n bases, two bits each."""
    x = ~x
    for s, m in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = ((x >> np.uint64(s)) & np.uint64(m)) | ((x & np.uint64(m)) << np.uint64(s))
    return x.byteswap() >> np.uint64(64 - 2 * n)


def _m(k: int) -> int:
    return min(8, k // 2)


@lru_cache
def _order(m: int) -> np.ndarray:
    """The rank of each m-mer, the same as its reverse complement's."""
    codes = np.arange(4**m, dtype=np.uint64)
    return np.random.default_rng(0).permutation(4**m).astype(np.uint16)[np.minimum(codes, revcomp(codes, m))]


def _least(ranks: np.ndarray, w: int) -> np.ndarray:
    """The least of each w in a row."""
    size, now = 1, ranks
    while size < w:
        step = min(size, w - size)
        now = np.minimum(now[: len(now) - step], now[step:])
        size += step
    return now


def buckets_of(v: np.ndarray, k: int, buckets: int) -> np.ndarray:
    m, order = _m(k), _order(_m(k))
    least = np.full(len(v), 65535, np.uint16)
    for j in range(k - m + 1):
        least = np.minimum(least, order[(v >> np.uint64(2 * j)) & np.uint64(4**m - 1)])
    return least % buckets


def cut(letters: np.ndarray, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, code, windows) of the runs in letters, where anything but bases separates reads: k + windows bases from the highest bits."""
    m, w = _m(k), 32 - k
    c = _LUT[letters]
    n = len(c) - k + 1  # places of vertices
    if n < 2:
        return np.empty(0, np.uint16), np.empty(0, np.uint64), np.empty(0, np.uint8)
    bad = np.zeros(len(c) + 1, np.int32)
    np.cumsum(c > 3, out=bad[1:])
    ok = bad[k:] == bad[:n]
    code = np.concatenate([c & 3, np.zeros(40, np.uint8)]).astype(np.uint16)  # beyond the end, for the last records
    size = 1
    parts = code
    while size < m:
        step = min(size, m - size)
        parts = (parts[: len(parts) - step] << np.uint16(2 * step)) | (parts[step:] & np.uint16(4**step - 1))
        size += step
    of = (_least(_order(m)[parts[: len(c) - m + 1]], k - m + 1) % buckets).astype(np.uint16)
    change = of[1:] != of[:-1]
    starts = np.flatnonzero(ok & np.concatenate([[True], change | ~ok[:-1]]))
    ends = np.flatnonzero(ok & np.concatenate([change | ~ok[1:], [True]]))
    first = starts - ((starts > 0) & ok[starts - 1])
    last = ends - 1 + ((ends < n - 1) & ok[np.minimum(ends + 1, n - 1)])
    windows, of = last - first + 1, of[starts]
    pieces = -(-windows // w)
    which = np.repeat(np.arange(len(starts)), pieces)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    place = first[which] + nth * w
    sizes = np.minimum(windows[which] - nth * w, w)
    out, got = np.zeros(len(place), np.uint64), 0
    while got < 32:
        step = min(m, 32 - got)
        out = (out << np.uint64(2 * step)) | (parts[place + got].astype(np.uint64) >> np.uint64(2 * (m - step)))
        got += step
    unused = (32 - k - sizes).astype(np.uint64) * np.uint64(2)
    return of[which], (out >> unused) << unused, sizes.astype(np.uint8)


def _blobs(of: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(of, kind="stable")
    of = of[order]
    at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
    offsets = np.append(at, len(of)).astype(np.int32)
    binary = lambda x, width: pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets * np.int32(width)), pa.py_buffer(np.ascontiguousarray(x[order]))])
    return pa.record_batch([pa.array(of[at].astype(np.int32)), binary(codes, 8), binary(sizes, 1)], names=["bucket", "codes", "sizes"])


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Rows of about CUT letters; a text may be longer."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False) + 1)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CUT, "right")))
        yield texts.slice(at, to - at)
        at = to


def records(reads: DataFrame, k: int, buckets: int, seq: str) -> DataFrame:
    """RECORDS: the runs of all reads, those of a bucket together a chunk."""

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for part in _slices(pa.concat_arrays(held)):
                joined = pc.binary_join_element_wise(part, pa.scalar("", part.type), pa.scalar("\n", part.type))
                yield _blobs(*cut(np.frombuffer(b"".join(joined.cast(pa.large_binary()).to_pylist()), np.uint8), k, buckets))

        for batch in batches:
            held.append(pc.fill_null(batch.column(0).cast(pa.large_string()), ""))
            size += held[-1].nbytes
            if size >= CUT:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    prepare(reads.sparkSession)
    return reads.select(seq).mapInArrow(cut_all, RECORDS)


def windows_of(codes: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """The canonical windows of k + 1 bases in records."""
    sizes = sizes.astype(np.int64)
    nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x = (np.repeat(codes, sizes) >> ((31 - k - nth).astype(np.uint64) * np.uint64(2))) & np.uint64((1 << 2 * (k + 1)) - 1)
    return np.minimum(x, revcomp(x, k + 1))


def _count(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x.sort()
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return x[at], np.diff(np.append(at, len(x)))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    x, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(x, kind="stable")
    x, n = x[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return x[at], np.add.reduceat(n, at) if len(at) else n


class _Counter:
    """Counts of windows; what is held is bounded by distinct windows, not by their occurrences."""

    def __init__(self, k: int):
        self.k, self.codes, self.sizes, self.held, self.parts, self.base = k, [], [], 0, [(np.empty(0, np.uint64), np.empty(0, np.int64))], 0

    def add(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        self.codes.append(codes)
        self.sizes.append(sizes)
        self.held += int(sizes.sum(dtype=np.int64))
        if self.held >= COUNT:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.parts.append(_count(windows_of(np.concatenate(self.codes), np.concatenate(self.sizes), self.k)))
            self.codes, self.sizes, self.held = [], [], 0
        if sum(len(x) for x, _ in self.parts[1:]) > max(COUNT, len(self.parts[0][0])):
            self.parts = [_merge(self.parts)]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self.flush()
        return _merge(self.parts)


def _jumped(succ: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, steps to it, whether there is none) of each node; succ: -1 at an end."""
    end, dist = np.where(succ >= 0, succ, np.arange(len(succ))), (succ >= 0).astype(np.int64)
    for _ in range(len(succ).bit_length()):
        further = end[end]
        if (further == end).all():
            break
        dist += dist[end]
        end = further
    return end, dist, succ[end] >= 0


def pieces_of(e: np.ndarray, cnt: np.ndarray, k: int, bucket: int, buckets: int) -> pa.RecordBatch:
    """PIECES of a bucket from its counted edges. A piece comes once, as it is read from one end; a row that is none is an edge of an ambiguous vertex."""
    u = np.uint64
    left, right = e >> u(2), e & u((1 << 2 * k) - 1)
    l_rc, r_rc = revcomp(left, k), revcomp(right, k)
    lh, rh, lv, rv = l_rc <= left, r_rc <= right, np.minimum(left, l_rc), np.minimum(right, r_rc)
    side = 16 * lh + 8 * rh
    slots = np.concatenate([side + 4 + _PLACE[(e & u(3)).astype(np.int64)], side + _PLACE[(e >> u(2 * k)).astype(np.int64)]]).astype(np.int32)
    own = np.concatenate([buckets_of(lv, k, buckets) == bucket, buckets_of(rv, k, buckets) == bucket])
    pick = lambda a, b: np.concatenate([a, b])[own]
    src, src_h, dst, dst_h, cnt, slots = pick(lv, rv), pick(lh, ~rh), pick(rv, lv), pick(rh, ~lh), pick(cnt, cnt), slots[own]
    vertices, at = np.unique(src, return_inverse=True)
    node = 2 * at + src_h
    degree = np.bincount(node, minlength=2 * len(vertices))
    d_l, d_h = degree[0::2], degree[1::2]
    ambiguous = ~((d_l + d_h == 1) | ((d_l == 1) & (d_h == 1)))
    edge = np.full(2 * len(vertices), -1)
    edge[node] = np.arange(len(node))
    edge[np.repeat(ambiguous, 2)] = -1  # what is left has one edge on a side at most
    place = np.minimum(np.searchsorted(vertices, dst), max(0, len(vertices) - 1))
    inside = (vertices[place] == dst) & ~ambiguous[place] if len(vertices) else np.empty(0, bool)
    succ = np.where((edge >= 0) & inside[edge], (2 * place + dst_h)[edge], -1) if len(node) else edge
    end, dist, circular = _jumped(succ)
    if circular.any():  # cut at the smallest vertex on both strands; the cut stays as a link, so the whole circle is seen again later
        seen = np.zeros(len(succ), bool)
        for x in np.flatnonzero(circular[0::2]) * 2:
            if not seen[x]:  # the first seen is the smallest
                y, before = x, -1
                while not seen[y]:
                    seen[y] = seen[y ^ 1] = True
                    before, y = y, succ[y]
                succ[before] = succ[x ^ 1] = -1
        end, dist, _ = _jumped(succ)
    nodes = np.flatnonzero(np.repeat(~ambiguous, 2))
    heads = nodes[succ[nodes ^ 1] < 0]
    heads = heads[heads < (end[heads] ^ 1)]
    tails, n = end[heads], dist[heads] + 1
    offset = np.cumsum(n) - n
    path = np.full(len(succ), -1)
    path[tails] = np.arange(len(heads))
    kept = nodes[path[end[nodes]] >= 0]
    of = path[end[kept]]
    members = np.empty(len(kept), np.int64)
    members[offset[of] + n[of] - 1 - dist[kept]] = kept
    shown = lambda x: np.where(x & 1 == 1, revcomp(vertices[x >> 1], k), vertices[x >> 1])
    begin = offset + (k - 1) * np.arange(len(heads))
    letters = np.empty(len(kept) + (k - 1) * len(heads), np.uint8)
    start = shown(heads)
    for j in range(k - 1):
        letters[begin + j] = _LETTERS[((start >> u(2 * (k - 1 - j))) & u(3)).astype(np.int64)]
    rows = np.repeat(np.arange(len(heads)), n)
    letters[np.arange(len(kept)) + (k - 1) * (rows + 1)] = _LETTERS[(shown(members) & u(3)).astype(np.int64)]
    seq = pa.Array.from_buffers(pa.string(), len(heads), [None, pa.py_buffer(np.append(begin, len(letters)).astype(np.int32)), pa.py_buffer(letters)])
    most = np.iinfo(np.int64).max
    inner = np.where(succ[members] >= 0, cnt[edge[members]], most) if len(node) else members
    over = lambda x: np.minimum.reduceat(x, offset) if len(heads) else x[:0]
    freq = over(inner)

    def link(x: np.ndarray) -> list[pa.Array]:
        j, none = edge[x], edge[x] < 0
        return [pa.array(c[j] if len(node) else c[:0], kind, mask=none) for c, kind in ((dst.astype(np.int64), pa.int64()), (dst_h, pa.bool_()), (cnt, pa.int64()), (slots, pa.int32()))]

    long = lambda x: pa.array(x.astype(np.int64))
    columns = [long(vertices[heads >> 1]), pa.array(heads & 1 == 1), long(vertices[tails >> 1]), pa.array(tails & 1 == 1), long(n), seq, long(over(vertices[members >> 1])), pa.array(freq, pa.int64(), mask=freq == most), *link(tails), *link(heads ^ 1), pa.array(np.ones(len(heads), bool))]
    names = [c.split()[0] for c in PIECES.split(", ")]
    found = pa.record_batch(columns, names=names)
    own = ambiguous[at]
    rest = {"v": long(src[own]), "h": pa.array(src_h[own]), "nv": long(dst[own]), "nh": pa.array(dst_h[own]), "ncnt": long(cnt[own]), "nslot": pa.array(slots[own]), "is_piece": pa.array(np.zeros(own.sum(), bool))}
    edges = pa.record_batch([rest[c] if c in rest else pa.nulls(int(own.sum()), found.schema.field(c).type) for c in names], names=names)
    return pa.Table.from_batches([found, edges]).combine_chunks()


def bucket_count(bases: int) -> int:
    return int(min(MOST_BUCKETS, max(4, bases // BUCKET)))


def pieces(reads: DataFrame, k: int, freq_t: int = 1, wrap256: bool = False, seq: str = "seq", bases: int | None = None) -> DataFrame:
    """PIECES of the graph of count_kplus(); bases: about how many the reads have, which are counted if it is not given."""
    if bases is None:
        bases = reads.agg(F.sum(F.length(seq))).first()[0] or 0
    buckets = bucket_count(bases)

    def join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, bucket = _Counter(k), None
        for batch in batches:
            for b, codes, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                assert bucket in (None, b), "a task gets one bucket"
                bucket = b
                found.add(np.frombuffer(codes, np.uint64), np.frombuffer(sizes, np.uint8))
        if bucket is None:
            return
        e, cnt = found.result()
        if wrap256:
            cnt = cnt % 256
        loops = (e == _NO) | (e == np.uint64(0x5555555555555555 & ((1 << 2 * (k + 1)) - 1)))
        keep = ~loops & (cnt >= freq_t)
        yield from pieces_of(e[keep], cnt[keep], k, bucket, buckets).to_batches(max_chunksize=50_000)

    return records(reads, k, buckets, seq).repartitionById(buckets, "bucket").mapInArrow(join_all, PIECES)


def _ambiguous(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter("not is_piece").select(F.col("v").alias(name)).distinct()


def bare_edges(rows: DataFrame, k: int) -> DataFrame:
    """(src, src_h, dst, dst_h, cnt, slot): the edges with an ambiguous vertex at both ends."""
    both = rows.filter("not is_piece").join(_ambiguous(rows, "nv"), "nv", "left_semi")
    return both.select(S.unpack("v", k).alias("src"), F.col("h").alias("src_h"), S.unpack("nv", k).alias("dst"), F.col("nh").alias("dst_h"), F.col("ncnt").alias("cnt"), F.col("nslot").alias("slot"))


def nodes(rows: DataFrame) -> DataFrame:
    """(v, h, nv, nh, w, lv, lh, least): each piece on both strands, by its first and last vertex, and the first of the next piece, if any."""
    there = F.struct("v", "h", "nv", "nh", F.col("n").alias("w"), F.col("ev").alias("lv"), F.col("eh").alias("lh"), "least")
    back = F.struct(F.col("ev").alias("v"), (~F.col("eh")).alias("h"), F.col("bv").alias("nv"), F.col("bh").alias("nh"), F.col("n").alias("w"), F.col("v").alias("lv"), (~F.col("h")).alias("lh"), "least")
    both = rows.filter("is_piece").select(F.inline(F.array(there, back)))
    marked = both.join(_ambiguous(rows, "nv").withColumn("out", F.lit(True)), "nv", "left")
    inner = lambda c: F.when(F.col("out").isNull(), F.col(c)).alias(c)
    return marked.select("v", "h", inner("nv"), inner("nh"), "w", "lv", "lh", "least")


def placed(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """(group_id, rnk, n, seq, first, last, in_nb, in_h, in_cnt, out_nb, out_h, out_cnt, freq): pieces of open paths in the strand of their path.

    ends: of nodes(), the last vertex of the path and the steps to it. As in paths.ranked() a path is read from the smaller of its
    ends, and a path of one vertex so that it is left by its last slot. freq holds the link to the next piece too.
    """
    ahead = ends.select("v", "h", F.col("ev").alias("last_v"), F.col("dist").alias("ahead"))
    behind = ends.select(F.col("v").alias("ev"), (~F.col("h")).alias("eh"), F.col("ev").alias("first_v"), F.col("dist").alias("behind"))
    own = rows.filter("is_piece").join(ahead, ["v", "h"]).join(behind, ["ev", "eh"])
    slots = F.struct(F.coalesce("nslot", F.lit(-1)), "h"), F.struct(F.coalesce("bslot", F.lit(-1)), ~F.col("h"))
    single = F.when(F.coalesce("nslot", "bslot").isNull(), ~F.col("h")).otherwise(slots[0] > slots[1])
    own = own.withColumn("fwd", F.when(F.col("first_v") == F.col("last_v"), single).otherwise(F.col("first_v") < F.col("last_v")))
    way = lambda a, b: F.when(F.col("fwd"), a).otherwise(b)
    more = F.col("n") - 1
    read = own.select(
        F.least("first_v", "last_v").alias("group_id"), (way(F.col("behind"), F.col("ahead")) - more).alias("rnk"), "n", way(F.col("seq"), S.revcomp("seq")).alias("seq"),
        (way(F.col("ahead"), F.col("behind")) == more).alias("last"), "freq",
        way(F.col("bv"), F.col("nv")).alias("in_nb"), (~way(F.col("bh"), F.col("nh"))).alias("in_h"), way(F.col("bcnt"), F.col("ncnt")).alias("in_cnt"),
        way(F.col("nv"), F.col("bv")).alias("out_nb"), way(F.col("nh"), F.col("bh")).alias("out_h"), way(F.col("ncnt"), F.col("bcnt")).alias("out_cnt"),
    )
    first, last = F.col("rnk") == 0, F.col("last")
    at = {c: F.when(first if c.startswith("in") else last, F.col(c)) for c in ("in_nb", "in_h", "in_cnt", "out_nb", "out_h", "out_cnt")}
    return read.withColumns(at | {"freq": F.least("freq", F.when(~last, F.col("out_cnt"))), "first": first})


def contigs(pieces_: DataFrame, k: int) -> DataFrame:
    """The contigs of placed(), as contigs.merge() gives them. A contig's pieces come together in one row, which is the result itself."""
    in_order = F.sort_array(F.collect_list(F.struct("rnk", F.when(F.col("first"), F.col("seq")).otherwise(F.substr("seq", F.lit(k))).alias("seq"))))
    ends = [F.max(c).alias(c) for c in ("in_nb", "in_h", "in_cnt", "out_nb", "out_h", "out_cnt")]
    made = pieces_.groupBy("group_id").agg(*ends, F.min("freq").alias("freq"), F.array_join(F.transform(in_order, lambda x: x["seq"]), "").alias("seq"))
    return made.select(S.unpack("group_id", k).alias("contig_id"), S.unpack("in_nb", k).alias("in_nb"), "in_h", "in_cnt", S.unpack("out_nb", k).alias("out_nb"), "out_h", "out_cnt", "freq", F.length("seq").alias("length"), "seq")


def _members(rows: DataFrame, k: int, *kept: str) -> DataFrame:
    """(v, h, i, ...): the vertices of pieces (n, seq), i from 0."""
    each = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    read = each.withColumn("x", F.substr("seq", (F.col("i") + 1).cast("int"), F.lit(k))).withColumn("v", S.canonical("x"))
    return read.select("v", (F.col("v") != F.col("x")).alias("h"), "i", *kept)


def ranks(pieces_: DataFrame, k: int) -> DataFrame:
    """The vertices of placed() as paths.list_rank() gives them."""
    rows = _members(pieces_.withColumn("group_id", S.unpack("group_id", k)), k, "group_id", "rnk", "n", "last")
    return rows.select("v", "h", "group_id", (F.col("rnk") + F.col("i")).alias("rnk"), (F.col("last") & (F.col("i") == F.col("n") - 1)).alias("last"), F.lit(False).alias("is_cycle"))


def vertices(rows: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """(v): the vertices of the pieces that begin at heads (v, h)."""
    return _members(rows.filter("is_piece").join(heads, ["v", "h"], "left_semi"), k).select("v")


def components(rows: DataFrame, nodes_: DataFrame, k: int) -> DataFrame:
    """(v, group_id) as paths.path_components() gives them: stars over pieces, each named by its smallest vertex."""
    a = nodes_.filter("nv is not null").select("nv", "nh", F.col("least").alias("a"))
    b = nodes_.select(F.col("v").alias("nv"), F.col("h").alias("nh"), F.col("least").alias("b"))
    found = connected_components(a.join(b, ["nv", "nh"]), "a", "b").withColumnRenamed("node", "least")
    rooted = rows.filter("is_piece").select("least", "n", "seq").join(found, "least", "left")
    return _members(rooted.withColumn("group_id", S.unpack(F.coalesce("root", "least"), k)), k, "group_id").select("v", "group_id")
