"""Nearest neighbours by inner product with vantage-point trees, one a shard.

Inner products become distances: a vector x of a shard gets one more component, sqrt(M^2 - |x|^2) with the shard's largest
norm M, a query gets 0 there; then nearer means a larger inner product, and the triangle inequality holds. Each tree is
built once from the distinct vectors of its shard and kept as bytes in a table; blocks of queries then meet every shard.
A branch is left out if the query's distance to it, times `relax`, exceeds the distance of the k-th found so far: relax 1 is exact,
more prunes more. What is found is scored again in correctly rounded double precision.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part; vectors of other
lengths never meet; rows with the query's own id are not candidates for it; of repeated rows each id is found once; equal scores
go to the smaller id, a null id takes no part; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.storage import prepare, stage

#: Rows of a shard and queries of a block, on average.
SHARD_ROWS, BLOCK_ROWS, LEAF = 8192, 4096, 64
#: Distinct vectors kept beyond k, against rounding before scores are computed again; where scores tie beyond them, all of a shard are scored.
SLACK = 6


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x, dim) of the rows that take part; x has doubles."""
    x = vectors[embedding].cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), x.alias("x")).filter("vec_id is not null and x is not null")
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("x", lambda v: v != 0)).withColumn("dim", F.size("x"))


class Tree:
    """Nodes are (vantage point, radius, inner child, outer child) or leaves (first, last) of the vectors in tree order."""

    def __init__(self, vectors: np.ndarray, extra: np.ndarray, order: np.ndarray, nodes: np.ndarray, radii: np.ndarray, top: float):
        self.vectors, self.extra, self.order, self.nodes, self.radii, self.top = vectors, extra, order, nodes, radii, top

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 7) -> Tree:
        norms = np.einsum("ij,ij->i", vectors, vectors)
        top = float(norms.max())
        extra = np.sqrt(np.maximum(top - norms, 0))
        rng = np.random.default_rng(seed)
        order, nodes, radii = np.arange(len(vectors)), [], []

        def grow(a: int, b: int) -> int:
            at = len(nodes)
            nodes.append((a, b, -1, -1))
            radii.append(0.0)
            if b - a <= LEAF:
                return at
            own = order[a:b]
            p = own[rng.integers(b - a)]
            d = np.sqrt(np.maximum(norms[own] + extra[own] ** 2 + top - 2 * (vectors[own] @ vectors[p] + extra[own] * extra[p]), 0))
            radius = float(np.median(d))
            inside = d <= radius
            if inside.all():
                return at
            order[a:b] = np.concatenate([own[inside], own[~inside]])
            middle = a + int(inside.sum())
            radii[at] = radius
            nodes[at] = p, -1, grow(a, middle), grow(middle, b)
            return at

        grow(0, len(vectors))
        return cls(vectors, extra, order, np.array(nodes, np.int64), np.array(radii), top)

    def search(self, queries: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(places of the k best vectors or -1, their inner products, vectors compared) for each query."""
        n, squares = len(queries), np.einsum("ij,ij->i", queries, queries)
        best, place = np.full((n, k), -np.inf), np.full((n, k), -1)
        bound = np.full(n, np.inf)  # distance of the k-th found
        blur = 1e-7 * np.sqrt(self.top + squares)  # more than rounding can do to distances
        leaves = {int(a): self.vectors[self.order[a:b]] for a, b, left, _ in self.nodes if left < 0}
        seen = 0

        def visit(at: int, who: np.ndarray) -> None:
            nonlocal seen
            a, b, inner, outer = self.nodes[at]
            if inner < 0:
                scores = queries[who] @ leaves[int(a)].T
                seen += scores.size
                better = scores.max(axis=1) > best[who, -1]
                who, scores = who[better], scores[better]
                if len(who):
                    all_scores = np.hstack([best[who], scores])
                    all_places = np.hstack([place[who], np.broadcast_to(self.order[a:b], scores.shape)])
                    pick = np.argpartition(-all_scores, k - 1, axis=1)[:, :k]
                    part = np.take_along_axis(all_scores, pick, 1)
                    sort = np.argsort(-part, axis=1, kind="stable")
                    best[who] = np.take_along_axis(part, sort, 1)
                    place[who] = np.take_along_axis(np.take_along_axis(all_places, pick, 1), sort, 1)
                    bound[who] = np.sqrt(np.maximum(self.top + squares[who] - 2 * best[who, -1], 0))
                return
            d = np.sqrt(np.maximum(self.top + squares[who] - 2 * (queries[who] @ self.vectors[a]), 0))
            gap = d - self.radii[at]
            near = gap <= 0
            for first, second, side in ((inner, outer, near), (outer, inner, ~near)):
                if side.any():
                    visit(int(first), who[side])
                    far = np.abs(gap[side]) * relax <= bound[who[side]] + blur[who[side]]
                    if far.any():
                        visit(int(second), who[side][far])

        if n:
            visit(0, np.arange(n))
        return place, best, seen


def _dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def index(rows: DataFrame, k: int, shards: int) -> DataFrame:
    """(dim, shard, tree): a tree over the distinct vectors of each shard, with the k + 1 smallest ids of each."""
    prepare(rows.sparkSession)

    def build(key, pdf):
        x = np.stack(pdf["x"].to_list()).astype(float) + 0.0  # -0.0 becomes 0.0
        ids = pdf["vec_id"].to_numpy()
        unique, group = np.unique(x, axis=0, return_inverse=True)
        by = np.lexsort((ids, group.ravel()))
        lists = [np.unique(own)[: k + 1] for own in np.split(ids[by], np.cumsum(np.bincount(group.ravel()))[:-1])]
        tree = Tree.build(unique)
        raw = _dump(vectors=unique, extra=tree.extra, order=tree.order, nodes=tree.nodes, radii=tree.radii, top=np.array(tree.top), ids=np.concatenate(lists), ends=np.cumsum([len(i) for i in lists]))
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [raw]})

    shard = F.pmod(F.xxhash64("vec_id", "x"), F.lit(shards)).cast("int")
    return rows.withColumn("shard", shard).groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary")


def _answers(raw: bytes, ids: np.ndarray, x: np.ndarray, k: int, relax: float) -> Iterator[tuple[int, int, int, float]]:
    z = np.load(io.BytesIO(raw))
    tree = Tree(z["vectors"], z["extra"], z["order"], z["nodes"], z["radii"], float(z["top"]))
    ends, all_ids = z["ends"], z["ids"]
    keep = min(k + SLACK, len(tree.vectors))
    places, best, _ = tree.search(x, keep, relax)
    blur = 1e-12 * np.sqrt(tree.top * np.einsum("ij,ij->i", x, x))
    # A query's own vector may be among the first k + 1. If the last one kept is as good as these, others left out may be too.
    tied = (best[:, -1] >= best[:, min(k, keep - 1)] - blur) & (keep < len(tree.vectors))
    for number, (own, q, found) in enumerate(zip(ids.tolist(), x, places, strict=True)):
        if tied[number]:
            found = np.flatnonzero(tree.vectors @ q >= best[number, min(k, keep - 1)] - blur[number])
        found = found[found >= 0]
        exact = [math.fsum(p) for p in (tree.vectors[found] * q).tolist()]
        rows = [(-s, i) for s, f in zip(exact, found, strict=True) for i in all_ids[ends[f - 1] if f else 0 : ends[f]].tolist() if i != own]
        for s, i in sorted(rows)[:k]:
            yield number, own, i, -s


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, relax: float = 1.0, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of vectors for each of queries, both from usable()."""
    prepare(vectors.sparkSession)
    n, n_queries = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // block_rows))
    trees = stage(index(vectors, k, shards), "trees").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    block = F.pmod(F.xxhash64("x", "vec_id"), F.lit(blocks)).cast("int")
    asked = queries.distinct().withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("query_key", F.xxhash64("x"))

    def probe(_, trees, asked):
        rows = []
        if len(trees) and len(asked):
            x = np.stack(asked["x"].to_list()).astype(float)
            keys = asked["query_key"].tolist()
            rows = [(keys[number], own, i, s) for number, own, i, s in _answers(trees["tree"].iloc[0], asked["vec_id"].to_numpy(), x, k, relax)]
        return pd.DataFrame(rows, columns=["query_key", "query_id", "vec_id", "score"])

    cols = ["dim", "shard", "block"]
    found = trees.groupBy(*cols).cogroup(asked.groupBy(*cols)).applyInPandas(probe, "query_key long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    once = found.dropDuplicates(["query_id", "query_key", "vec_id", "score"])
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
