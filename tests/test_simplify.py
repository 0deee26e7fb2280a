"""The contig graph, tips, groups and merging against plain loops over dictionaries."""

import random
from collections import defaultdict

import pytest

from helixframe.operators import dbg, simplify
from tests.test_assembly import assembly, rc, strandless


def walk_tips(rows, most):
    """rows: oriented edges (src, src_h, dst, dst_h, contig_id, length); the rules of tip removal vertex by vertex."""
    rows = set(rows)
    status = dict.fromkeys({r[0] for r in rows}, "normal")

    def kinds():
        d = defaultdict(lambda: [0, 0])
        for r in rows:
            d[r[0]][r[1]] += 1
        return {v: 1 if sum(d[v]) == 1 else 2 if d[v] == [1, 1] else 3 for v in status if status[v] != "deleted"}

    kind = kinds()
    while any(status[v] == "normal" and k == 1 for v, k in kind.items()):
        out = defaultdict(list)
        for r in rows:
            out[r[0], r[1]].append(r)
        verdict = {}
        for v, k in kind.items():
            if k != 1 or status[v] != "normal":
                continue
            h = bool(out[v, True])
            path, cost, at = [v], 1, (v, h)
            while True:
                (r,) = out[at]
                cost += r[5]
                if r[2] is None:
                    found = "deleted" if cost <= most else "finished"
                    break
                cost += 1
                w = r[2]
                if status[w] != "normal":
                    found = status[w]
                    break
                if kind[w] != 2:
                    found = "deleted" if cost <= most else "finished"
                    break
                path.append(w)
                at = (w, r[3])
            verdict.update(dict.fromkeys(path, found))
        status.update(verdict)
        gone = {v for v, s in status.items() if s == "deleted"}
        rows = {r for r in rows if r[0] not in gone and r[2] not in gone}
        new = kinds()
        kind = {v: new[v] if status[v] == "normal" else kind[v] for v in new}
    return rows, kind, status


def stitched(rows, kind, seqs, k, min_len):
    """Sequences of the groups without circles, and of unused contigs at ambiguous vertices."""
    out = {}
    for r in rows:
        if kind[r[0]] != 3:
            out[r[0], r[1]] = r
    text = lambda v, h: rc(v) if h else v
    piece = lambda r, back=False: rc(seqs[r[4]]) if r[5 + 1] != back else seqs[r[4]]
    found, used, seen = set(), set(), set()
    for v in (v for v in kind if kind[v] != 3):
        for h in (False, True):
            into = out.get((v, not h))
            if into and into[2] and kind[into[2]] != 3:
                continue
            parts, at = [], (v, h)
            if into and into[4]:
                parts.append(piece(into, True))
                used.add(into[4])
            while True:
                seen.add(at[0])
                parts.append(text(*at))
                r = out.get(at)
                if r and r[4]:
                    parts.append(piece(r))
                    used.add(r[4])
                if not r or not r[2] or kind[r[2]] == 3:
                    break
                at = (r[2], r[3])
            s = parts[0] + "".join(p[k - 1 :] for p in parts[1:])
            found.add(min(s, rc(s)))
    circles = {v for v in kind if kind[v] != 3} - seen
    rest = {r[4] for r in rows if r[4] and kind[r[0]] == 3} - used
    both = list(found) + [min(seqs[c], rc(seqs[c])) for c in rest]
    return sorted(s for s in both if len(s) > min_len), circles


@pytest.mark.parametrize(("k", "seed", "tip"), [(5, 1, 6), (7, 2, 10), (9, 5, 12), (6, 9, 5)])
def test_simplification_against_loops(spark, k, seed, tip):
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(350))
    reads = []
    for _ in range(90):
        i = rng.randrange(320)
        r = list(genome[i : i + 30])
        if rng.random() < 0.4:
            r[rng.randrange(30)] = rng.choice("ACGT")
        reads.append("".join(r) if rng.random() < 0.5 else rc("".join(r)))
    a = assembly(spark, reads, k_mer_t=k, tip_t=tip, bubble_t=1, output_contig_t=k + 2)
    seqs = {r.contig_id: r.seq for r in a.filtered.collect()}
    raw = a.graph.collect()
    rows = [(r.src, r.src_h, r.dst, r.dst_h, r.contig_id, r.length, r.rev) for r in raw]
    want_rows, kind, status = walk_tips(rows, k - 1 + tip)
    graph, states = a.pruned
    assert {(r.v, r.vtype, r.status) for r in states.collect()} == {(v, kind[v], status[v]) for v in kind}
    assert {(r.src, r.src_h, r.dst, r.dst_h, r.contig_id, r.length, r.rev) for r in graph.collect()} == want_rows
    want, circles = stitched(want_rows, kind, seqs, k, k + 2)
    got = a.sequences.collect()
    groups = {r.v: r.group_id for r in a.groups.collect()}
    assert set(groups) == {v for v in kind if kind[v] != 3}
    names = {groups[v] for v in circles}
    assert sorted(set(strandless(r for r in got if not (r.kind == "group" and r.id in names)))) == sorted(set(want))
    parts = {r.v: r.group_id for r in simplify.group_components(graph, states).collect()}
    pairs = {(groups[v], parts[v]) for v in groups}
    assert set(parts) == set(groups) and len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


def test_bubbles_in_order(spark):
    from helixframe.operators import contigs

    schema = "contig_id string, in_nb string, out_nb string, freq long, length int, seq string"
    rows = [
        ("A", "X", "Y", 2, 6, "ACGTAC"),
        ("B", "X", "Y", 2, 6, "ACGTAA"),  # equal to A in freq: A, the earlier, goes
        ("C", "Y", "X", 1, 6, rc("ACGTTA")),  # on the other strand, near B: C goes
        ("D", "X", "Y", None, 6, "TTTTTT"),
        ("E", "X", "Z", 1, 6, "ACGTAC"),
        ("F", None, "Y", 1, 6, "ACGTAC"),
    ]
    df = spark.createDataFrame(rows, schema)
    assert {r.contig_id for r in contigs.bubble_filter(df, 1).collect()} == {"B", "D", "E", "F"}
    assert contigs.bubble_filter(df, 1, long=5).count() == 6


def test_empty_reads(spark):
    a = assembly(spark, ["AC", "NNN"], k_mer_t=5)
    assert a.kplus.count() == a.contigs.count() == a.sequences.count() == 0
    assert a.vertices.columns == ["v", "d_l", "d_h", "vtype"] and dbg.bitmaps(a.edges).count() == 0
