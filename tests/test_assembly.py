import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.plans.assembly import Assembly
from helixframe.sources.config import Parameters

SAMPLE = "AATGCG ATGCCGTA CCTGCCGTA CGTAGCAATCA CGTACAATC GTACAA".split()


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def assembly(spark, reads, **p):
    return Assembly(spark.createDataFrame([(r,) for r in reads], "seq string"), Parameters(**p))


@pytest.fixture(scope="module")
def sample(spark):
    return assembly(spark, SAMPLE)


def test_sample_counts(sample):
    got = {r.kp1: r.cnt for r in sample.kplus.collect()}
    twice = "CGGCA ACGGC CCGTA CAATC GTACA TACAA".split()
    once = "AATGC ATGCG ATGCC CCTGC CTGCC CGTAG GCTAC TAGCA AGCAA ATTGC AATCA CGTAC ACAAT".split()
    assert got == dict.fromkeys(twice, 2) | dict.fromkeys(once, 1)


def test_sample_vertices(sample):
    by = {t: {r.v for r in sample.vertices.filter(f"vtype = {t}").collect()} for t in (1, 2, 3)}
    assert by[1] == set("AATG CGCA CAGG ATCA".split()) and by[3] == set("ATGC GGCA CGTA ATTG".split()) and len(by[2]) == 11


def test_sample_contigs(sample):
    got = sorted((r.contig_id, r.in_nb, r.in_h, r.in_cnt, r.out_nb, r.out_h, r.out_cnt, r.freq, r.seq) for r in sample.contigs.collect())
    want = [
        ("AATG", None, None, None, "ATGC", False, 1, None, "AATG"),
        ("CGCA", None, None, None, "ATGC", True, 1, None, "CGCA"),
        ("ACGG", "CGTA", True, 2, "GGCA", False, 2, 2, "ACGGC"),
        ("CAGG", None, None, None, "GGCA", True, 1, 1, "CCTGC"),
        ("CTAC", "CGTA", False, 1, "ATTG", True, 1, 1, "GTAGCAA"),
        ("ACAA", "ATTG", False, 1, "CGTA", True, 1, 2, "TTGTAC"),
        ("AATC", "ATTG", True, 2, None, None, None, 1, "AATCA"),
    ]
    assert got == sorted(want)


def test_sample_simplified(sample):
    assert {r.contig_id for r in sample.filtered.collect()} == set("AATG CGCA ACGG CAGG ACAA AATC".split())
    edges = {(r.src, r.contig_id or r.dst) for r in sample.graph.collect()}
    assert edges == {("ATGC", "GGCA"), ("GGCA", "ATGC"), ("GGCA", "ACGG"), ("GGCA", "CAGG"), ("CGTA", "ACGG"), ("CGTA", "ACAA"), ("ATTG", "ACAA"), ("ATTG", "AATC")}
    assert {(r.v, r.vtype, r.status) for r in sample.pruned[1].collect()} == {("GGCA", 2, "normal"), ("CGTA", 2, "normal"), ("ATTG", 2, "normal")}
    assert {(r.v, r.group_id) for r in sample.groups.collect()} == {(v, "ATTG") for v in ("GGCA", "CGTA", "ATTG")}
    assert [r.seq for r in sample.sequences.collect()] in (["TGATTGTACGGCAGG"], [rc("TGATTGTACGGCAGG")])


def strandless(rows):
    return sorted(min(r.seq, rc(r.seq)) for r in rows)


def test_strand_and_order_of_reads_do_not_matter(spark, sample):
    rng = random.Random(1)
    reads = [rc(r) if rng.random() < 0.5 else r for r in SAMPLE]
    rng.shuffle(reads)
    assert strandless(assembly(spark, reads).sequences.collect()) == strandless(sample.sequences.collect())


def test_kept_tables_go_on(spark, sample, tmp_path):
    sample.write(str(tmp_path))
    again = Assembly(spark.createDataFrame([], "seq string"), sample.p).load(str(tmp_path))
    assert strandless(again.sequences.collect()) == strandless(sample.sequences.collect())


def test_split_short_and_homopolymer_reads(spark):
    a = assembly(spark, ["ACGTTNNACG", "AAAAAAAA", "", None, "acgtt", "ACXGTTA"])
    assert {(r.kp1, r.cnt) for r in a.kplus.collect()} == {("AACGT", 2)}


def test_linear_reads_give_one_contig_and_no_output(spark):
    rng = random.Random(7)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    reads = [genome[i : i + 40] for i in range(0, 261, 7)] + [genome[-40:]]
    a = assembly(spark, reads, k_mer_t=15)
    assert strandless(a.contigs.collect()) == [min(genome, rc(genome))]
    assert a.sequences.count() == 0
    isolated = Assembly(a.reads, a.p, emit_isolated=True)
    assert strandless(isolated.sequences.collect()) == [min(genome, rc(genome))]


def test_circle_is_cut_at_its_smallest_vertex(spark):
    rng = random.Random(11)
    genome = "".join(rng.choice("ACGT") for _ in range(200))
    reads = [(genome * 2)[i : i + 50] for i in range(0, 200, 5)]
    a = assembly(spark, reads, k_mer_t=15)
    (c,) = a.contigs.collect()
    assert c.in_nb is None and c.out_nb is None and c.length == 200 + 14
    kmers = [min(x, rc(x)) for x in ((genome * 2)[i : i + 15] for i in range(200))]
    assert c.contig_id == min(kmers) and min(c.seq[:15], rc(c.seq[:15])) == min(kmers)
    assert c.seq in genome * 3 or rc(c.seq) in genome * 3


def test_palindromic_edges_are_ambiguous(spark):
    a = assembly(spark, ["TTACGCGTCC"], k_mer_t=5)
    assert {r.v for r in a.vertices.filter("vtype = 3").collect()} >= {"ACGCG"}


def test_wrap256(spark):
    reads = spark.createDataFrame([("ACGTT",)] * 256, "seq string")
    assert Assembly(reads, wrap256=True).kplus.count() == 0 and Assembly(reads).kplus.first().cnt == 256


def model(reads, k, bubble_t, tip_t, min_len, freq_t=1):
    """The whole assembly by plain loops on dictionaries, up to the sequences of groups and contigs."""
    counts = {}
    for r in reads:
        for i in range(len(r) - k):
            s = min(r[i : i + k + 1], rc(r[i : i + k + 1]))
            if len(set(s)) > 1:
                counts[s] = counts.get(s, 0) + 1
    counts = {s: n for s, n in counts.items() if n >= freq_t}

    def node(x):
        y = rc(x)
        return (y, True) if y <= x else (x, False)

    out = {}
    for s, n in counts.items():
        (a, p), (b, q) = node(s[:k]), node(s[1:])
        out.setdefault((a, p), []).append(((b, q), n))
        out.setdefault((b, not q), []).append(((a, not p), n))
    names = {v for v, _ in out}
    deg = {v: (len(out.get((v, False), [])), len(out.get((v, True), []))) for v in names}
    kind = {v: 1 if sum(d) == 1 else 2 if d == (1, 1) else 3 for v, d in deg.items()}
    return counts, out, kind


def contigs_by_walking(k, out, kind):
    text = lambda v, h: rc(v) if h else v
    found, seen = set(), set()
    for v in kind:
        if kind[v] == 3:
            continue
        for h in (False, True):
            nxt = lambda o: next((d for d, _ in out.get(o, [])), None)
            before = nxt((v, not h))
            if before is not None and kind[before[0]] != 3:
                continue
            o, seq = (v, h), text(v, h)
            seen.add(v)
            while (n := nxt(o)) is not None and kind[n[0]] != 3:
                o = n
                seen.add(o[0])
                seq += text(*o)[-1]
            found.add(min(seq, rc(seq)))
    return found, seen


@pytest.mark.parametrize(("k", "seed"), [(5, 1), (7, 2), (8, 3), (11, 4)])
def test_contigs_against_walking(spark, k, seed):
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    reads = []
    for _ in range(120):
        i = rng.randrange(370)
        r = list(genome[i : i + 30])
        if rng.random() < 0.3:
            r[rng.randrange(30)] = rng.choice("ACGT")
        reads.append("".join(r) if rng.random() < 0.5 else rc("".join(r)))
    a = assembly(spark, reads, k_mer_t=k, tip_t=5, bubble_t=2)
    counts, out, kind = model(reads, k, 1, 1, 10)
    assert {r.kp1: r.cnt for r in a.kplus.collect()} == counts
    assert {r.v: r.vtype for r in a.vertices.collect()} == kind
    want, seen = contigs_by_walking(k, out, kind)
    circles = {v for v in kind if kind[v] != 3} - seen
    got = a.contigs.filter(~F.col("contig_id").isin(list(circles))) if circles else a.contigs
    assert set(strandless(got.collect())) == want
    ranked = {r.v: r.group_id for r in a.ranks.collect()}
    parts = {r.v: r.group_id for r in a.components.collect()}
    assert set(ranked) == set(parts) == {v for v in kind if kind[v] != 3}
    pairs = {(ranked[v], parts[v]) for v in ranked}
    assert len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})
    sequences = [r.seq for r in a.sequences.collect()]
    edges = set(counts)
    for s in sequences:
        assert all(min(s[i : i + k + 1], rc(s[i : i + k + 1])) in edges for i in range(len(s) - k))


def test_column_functions(spark):
    df = spark.createDataFrame([("ACGTN", "GATTACA")], "n string, s string")
    r = df.select(S.revcomp("s").alias("rc"), S.unpack(S.pack("s"), 7).alias("same"), S.edit_distance("s", F.lit("GACTATA")).alias("d"), S.edit_distance("s", F.lit("GACTATA"), 1).alias("far"), S.windows("s", 8).alias("none"), S.fragments("n").alias("parts"), S.is_homopolymer(F.lit("CCCC")).alias("homo")).first()
    assert tuple(r) == ("TGTAATC", "GATTACA", 2, -1, [], ["ACGT", ""], True)
