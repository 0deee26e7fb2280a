"""All links of 64-bit fingerprints within a Hamming distance, by the general pigeonhole principle.

Bits are grouped into partitions, correlated ones together, and partition i gets a threshold T_i so that the
thresholds sum to tau - m + 1: then fingerprints within tau agree within T_i in some partition. T_i may be -1 (the partition
is left out), 0 (equal bits meet), 1 (fingerprints with an even number of ones among the bits also go to the keys one flipped bit
away: of two that differ in one bit, one has an even number) or 2 (all go there, so any two within two bits meet). Number of partitions and thresholds come from dynamic programming on the work they cost,
rows written plus pairs compared; pairs are estimated from a bounded sample of fingerprints. The estimates set
only the cost: every plan finds every link.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.storage import prepare, stage

SAMPLE = 1500
#: Microseconds for a row dealt to a bucket, and for a pair compared.
ROW_COST, PAIR_COST = 2.0, 0.002
#: Fingerprints of a bucket that one task compares; a larger bucket is split into blocks, and tasks take pairs of blocks.
BLOCK = 50_000


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def groups_of_bits(sample: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """m groups of nearly equal size; each grows from a free bit by the bits most correlated with it."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0)) + 1e-9
    corr = np.abs((bits.T @ bits) / norm[:, None] / norm)
    free, out = list(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        own = [free.pop(0)]
        while len(own) < size:
            best = max(free, key=lambda b: corr[b, own].sum())
            free.remove(best)
            own.append(best)
        out.append(tuple(sorted(own)))
    return out


def shares(sample: np.ndarray, bits: tuple[int, ...]) -> list[float]:
    """Estimated shares of pairs that differ in 0, 1 and 2 of the bits: counted in the sample, or for rare ones from each bit's own rate."""
    mask = np.uint64(sum(1 << b for b in bits))
    own = sample & mask
    pairs = len(own) * (len(own) - 1) / 2
    seen = np.zeros(3)
    for i in range(len(own) - 1):
        d = np.bitwise_count(own[i + 1 :] ^ own[i])
        seen += [(d == k).sum() for k in range(3)]
    model = np.array([1.0, 0.0, 0.0])
    for b in bits:
        q = float(((sample >> np.uint64(b)) & np.uint64(1)).mean())
        p = min(max(2 * q * (1 - q), 1e-6), 1.0)
        model = model * (1 - p) + np.array([0, *model[:2]]) * p
    return [s / pairs if s >= 10 else max(float(m), s / max(pairs, 1)) for s, m in zip(seen, model, strict=True)]


def plan(sample: np.ndarray, n: int, tau: int) -> list[Part]:
    """The cheapest partitions and thresholds for n fingerprints."""
    best: tuple[float, list[Part]] = (np.inf, [])
    for m in range(1, min(tau + 1, 12) + 1):
        need = tau - m + 1
        table: dict[int, tuple[float, list[Part]]] = {0: (0.0, [])}  # by the sum of thresholds
        for bits in groups_of_bits(sample, m):
            p0, p1, p2 = shares(sample, bits)
            pairs, w = n * n / 2 * PAIR_COST, len(bits)
            costs = {-1: 0.0, 0: n * ROW_COST + pairs * p0, 1: n * (w / 2 + 1) * ROW_COST + pairs * ((w / 2 + 1) * p0 + p1 + p2), 2: n * (w + 1) * ROW_COST + pairs * ((w + 1) * p0 + 2 * p1 + 2 * p2)}
            new: dict[int, tuple[float, list[Part]]] = {}
            for total, (cost, parts) in table.items():
                for t, c in costs.items():
                    if cost + c < new.get(total + t, (np.inf,))[0]:
                        new[total + t] = cost + c, [*parts, Part(bits, t)]
            table = new
        for total, (cost, parts) in table.items():
            if total >= need and cost < best[0]:
                best = cost, [p for p in parts if p.threshold >= 0]
    if not best[1]:  # tau so large that no plan has the thresholds: everything meets
        return [Part((), 0)]
    return best[1]


def stars(values: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """(value, other value) within tau that connect each component of the values; each is compared only with ones not yet reached."""
    left, out = np.unique(values), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            own = todo.pop()
            near = np.bitwise_count(left ^ own) <= tau
            if near.any():
                found = left[near]
                todo.extend(found)
                out.extend((int(own), int(x)) for x in found)
                left = left[~near]
    return out


def _compare(tau: int):
    def run(batches):
        held: list[np.ndarray] = []  # of the bucket that may go on in the next batch
        last = None

        def close(out):
            if sum(map(len, held)) > 1:
                out.extend(stars(np.concatenate(held), tau))
            held.clear()

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "key", "b1", "b2")])
            fps = batch.column("fp").to_numpy().view(np.uint64)
            if not len(fps):
                continue
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(fps)]
            out: list[tuple[int, int]] = []
            for a, b in zip(cuts, cuts[1:]):
                if (key := tuple(keys[:, a])) != last:
                    close(out)
                    last = key
                held.append(fps[a:b])
            if out:
                yield _edges(out)
        out = []
        close(out)
        if out:
            yield _edges(out)

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.uint64).view(np.int64)
    return pa.record_batch([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])


def in_blocks(rows: DataFrame, keys: list[str], item, limit: int) -> DataFrame:
    """Adds b1, b2: rows of a group of over `limit` are copied to all pairs of blocks that hold their own block."""
    counted = rows.groupBy(*keys).count().filter(F.col("count") > limit)
    large = stage(counted.withColumn("k", F.ceil(F.col("count") / limit).cast("int")).drop("count"), "large")
    k = F.coalesce("k", F.lit(1))
    own = F.pmod(F.xxhash64(item), k).cast("int")
    dealt = rows.join(large, keys, "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
    return dealt.withColumns({"b1": F.least("own", "other"), "b2": F.greatest("own", "other")}).drop("k", "own", "other")


def links(fps: DataFrame, tau: int) -> DataFrame:
    """(a, b) that connect all of the distinct long values `fp` within tau bits: in each bucket, a tree for each component.

    Every pair within tau is connected by links of its bucket; pairs are not all emitted.
    """
    prepare(fps.sparkSession)
    n = fps.count()
    sample = np.array([r.fp for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    if n < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    keys = []
    for i, part in enumerate(plan(sample, n, tau)):
        own = F.col("fp").bitwiseAND(F.lit(signed(part.mask)))
        here = [F.struct(F.lit(i).alias("part"), x.alias("key")) for x in (own, *(own.bitwiseXOR(F.lit(signed(1 << b))) for b in part.bits))]
        every, first = F.array(*here), F.array(here[0])
        keys.append(first if part.threshold == 0 else every if part.threshold == 2 else F.when(F.bit_count(own) % 2 == 0, every).otherwise(first))
    dealt = fps.select("fp", F.explode(F.concat(*keys)).alias("k")).select("fp", "k.part", "k.key")
    cols = ["part", "key", "b1", "b2"]
    rows = in_blocks(dealt, ["part", "key"], "fp", BLOCK).select(*cols, "fp")
    return rows.repartition(*cols).sortWithinPartitions(*cols).mapInArrow(_compare(tau), "a long, b long")
