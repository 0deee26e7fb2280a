import random

import numpy as np

from helixframe.operators import compact
from helixframe.plans.assembly import Assembly
from helixframe.sources.config import Parameters


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def random_reads(seed):
    """Reads of a line with a repeat and of a circle, on both strands, some wrong, some with letters that are no bases."""
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choices("ACGT", k=n))
    again = some(30)
    line, ring = some(150) + again + some(120) + again + some(150), some(90)
    texts = [line[i : i + 40] for i in range(0, len(line) - 39, 3)] + [(ring * 2)[i : i + 40] for i in range(0, 90, 5)]
    for i in range(0, len(texts), 6):
        at = rng.randrange(40)
        texts[i] = texts[i][:at] + rng.choice("ACGTNacgtR") + texts[i][at + 1 :]
    return [rc(t) if set(t) <= set("ACGT") and rng.random() < 0.5 else t for t in texts] + ["", None, "ACG", "A" * 40]


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_pieces_give_what_single_vertices_give(spark, monkeypatch):
    """F2 to F9: the tables that the queries build on are the same from pieces of buckets as vertex by vertex."""
    monkeypatch.setattr(compact, "bucket_count", lambda bases: 5)
    k = 9
    reads = spark.createDataFrame([(r,) for r in random_reads(k)], "seq string")
    p = Parameters(k_mer_t=k, freq_t=1, bubble_t=1, tip_t=3, output_contig_t=20)
    by_buckets, plain = Assembly(reads, p), Assembly(reads, p)
    plain.by_buckets = False
    assert by_buckets.by_buckets
    assert rows(by_buckets.ranks) == rows(plain.ranks)
    assert rows(by_buckets.contigs) == rows(plain.contigs)
    assert rows(by_buckets.components) == rows(plain.components)
    assert rows(by_buckets.ambiguous.select("src", "src_h", "dst", "dst_h", "cnt", "slot")) == rows(plain.ambiguous.select("src", "src_h", "dst", "dst_h", "cnt", "slot"))


def test_circle_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(compact, "bucket_count", lambda bases: 5)
    ring = "".join(random.Random(2).choices("ACGT", k=30))
    reads = spark.createDataFrame([((ring * 2)[i : i + 20],) for i in range(30)], "seq string").coalesce(1)
    a = Assembly(reads, Parameters(k_mer_t=9))
    found = a.ranks.collect()
    assert len(found) == 30 and all(r.is_cycle for r in found)
    assert {r.group_id for r in found} == {min(r.v for r in found)} and sorted(r.rnk for r in found) == list(range(30))


def test_fewer_nodes_are_ranked(spark, monkeypatch):
    """F2 to F9: the rounds of ranking go over pieces, not over all vertices."""
    monkeypatch.setattr(compact, "bucket_count", lambda bases: 4)
    rng = random.Random(0)
    line = "".join(rng.choices("ACGT", k=3000))
    a = Assembly(spark.createDataFrame([(line[i : i + 70],) for i in range(0, 2931, 10)], "seq string"), Parameters(k_mer_t=21))
    assert a.ranks.count() == 2980
    assert a.piece_nodes.count() < 2 * 2980 / 4


def test_numbers_are_reverse_complemented():
    texts = ["".join(random.Random(i).choices("ACGT", k=13)) for i in range(50)]
    number = lambda t: int("".join(str("ACGT".index(c)) for c in t), 4)
    assert compact.revcomp(np.array([number(t) for t in texts], np.uint64), 13).tolist() == [number(rc(t)) for t in texts]
