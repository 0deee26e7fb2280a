import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import hamming, langid, queries, simhash
from helixframe.operators.components import connected_components


def groups_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(300)] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(300)] + [(7, 7), (1, 0), (1, 0)]
    got = connected_components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long"), "a", "b").collect()
    want = groups_of(pairs, {x for p in pairs for x in p if p[0] != p[1]})
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("tau", [0, 1, 3, 5, 8])
def test_links_connect_all_pairs_within_tau(spark, tau):
    rng = random.Random(tau)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(6):
            for b in rng.sample(range(64), rng.randrange(tau + 3)):
                v ^= 1 << b
            values.add(v)
    fps = [hamming.signed(v) for v in sorted(values)]
    got = hamming.links(spark.createDataFrame([(v,) for v in fps], "fp long"), tau).collect()
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= tau]
    assert groups_of([(r.a, r.b) for r in got], fps) == groups_of(pairs, fps)


def test_large_buckets_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(hamming, "BLOCK", 7)
    test_links_connect_all_pairs_within_tau(spark, 3)


def test_plans_reach_the_sum_of_thresholds():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**64, 300, np.uint64)
    for n in (10, 10**5, 10**7, 10**9):
        for tau in (1, 3, 6, 8):
            parts = hamming.plan(sample, n, tau)
            bits = [b for p in parts for b in p.bits]
            assert len(bits) == len(set(bits))
            assert any(sum(p.threshold for p in parts) - (m - len(parts)) >= tau - m + 1 for m in range(len(parts), 13))


@settings(max_examples=50, deadline=None)
@given(st.text(st.sampled_from("aB \t\n\x0b\x1fé"), max_size=30))
def test_fingerprint_by_definition(text):
    own = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", own)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(simhash.hashes(simhash.shingles(simhash.words(text), 3))) == want


def test_op6_against_all_pairs(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = {r.doc_id: simhash.fingerprint(simhash.hashes(simhash.shingles(simhash.words(r.text), 3))) for r in rows}
    ids = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = {i: (f"{prints[i]:016x}", root) for i, root in groups_of(pairs, ids).items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, sf).collect()} == want


def test_op6_odd_rows(spark):
    long = "word " * 50_000
    rows = [(5, None, "x"), (3, "", "y"), (None, "a b c d", "z"), (9, "A  b\tc d", None), (9, "A  b\tc d", None), (1, long, ""), (2, long + "end", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.components(df).collect())
    assert got == [(-1, 9), (1, 1), (2, 1), (3, 3), (5, 3), (9, 9), (9, 9)]
    assert simhash.components(df.limit(0)).count() == 0


def jaccard(a, b):
    a, b = (set(simhash.shingles(simhash.words(x), 5)) or {b""} for x in (a, b))
    return len(a & b) / len(a | b)


def test_drop_similar_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(rows)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if jaccard(rows[a], rows[b]) >= 0.8]
    assert {r.doc_id for r in simhash.drop_similar(docs).collect()} == set(groups_of(pairs, ids).values())


def test_similar_on_ten_thousand_documents(spark):
    """All links over all distinct texts, by plain sets and an index of all shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)
    sets = {i: set(simhash.shingles(simhash.words(t), 5)) or {b""} for t, i in first.items()}
    held = defaultdict(list)
    for i, own in sets.items():
        for x in sorted(own, key=hash)[: len(own) // 5 + 1]:  # similar sets share one of these
            held[x].append(i)
    near = {(a, b) for own in held.values() for a in own for b in own if a < b and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b]))}
    pairs = [(a, b) for a, b in near if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert pairs
    roots = groups_of(pairs, list(sets))
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    assert got == {r.doc_id: roots[first[r.text]] for r in rows}


@pytest.mark.parametrize("frequent, few, block", [(3, 8, 256), (10**9, 8, 256), (10**9, 0, 3), (10**9, 10**9, 256)])
def test_drop_similar_loses_no_link_of_any_edit(spark, monkeypatch, frequent, few, block):
    for name, value in (("FREQUENT", frequent), ("FEW", few), ("BLOCK", block), ("COLUMNS", 50)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(11)
    line = " ".join(f"common{i}" for i in range(30))
    rows = []
    for i in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 4, 6, 9, 24, 60, 200, 700]))]
        n = len(base)
        tail = [f"x{rng.randrange(10**6)}" for _ in range(max(1, int(n * rng.uniform(0.1, 0.24))))]
        changed = [w if rng.random() > 0.02 else "other" for w in base]
        for own in (base, base + tail, tail + base, base[: n - int(n * rng.uniform(0.1, 0.19))], changed):
            rows.append((len(rows), " ".join(own) + (f" {line}" if i % 3 == 0 else "")))
    texts = dict(rows)
    pairs = [(a, b) for a in texts for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    want = groups_of(pairs, list(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {i: simhash.fingerprint(simhash.hashes(set(simhash.words(t)))) for i, t in rows}
    assert any((prints[a] ^ prints[b]).bit_count() > 8 for a, b in pairs)
    assert {r.doc_id: r.component_id for r in simhash.similar(df).collect()} == want


def test_prefixes_of_similar_sets_share_enough():
    rng = random.Random(6)
    for _ in range(300):
        base = rng.sample(range(1, 10**6), rng.randrange(1, 60))
        a, b = (np.unique(np.array(rng.sample(base, max(1, len(base) - rng.randrange(4))), np.uint64)) for _ in range(2))
        both = len(np.intersect1d(a, b))
        if both >= 0.8 * (len(a) + len(b) - both):
            (x, m), (y, n) = (simhash.prefix(s, np.sort(np.array(base[::3], np.uint64)), 0.8) for s in (a, b))
            assert len(np.intersect1d(x, y)) >= min(m, n)


def test_drop_similar_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HUB", 3)
    base = [f"w{i}" for i in range(200)]
    near = [(100 + i, " ".join([*base[:i], "other", *base[i + 1 :]]), "s", "k") for i in range(0, 200, 10)]
    odd = [(None, "alone here", "s", "k"), (4, None, "s", "k"), (5, "", "s", "k"), (6, "same id", "a", "k"), (6, "same id", "b", "k"), (6, "not the same", "c", "k"), (50, " ".join(base), None, "k")]
    rows = simhash.drop_similar(spark.createDataFrame(near + odd, "doc_id long, text string, root string, __KEY string"))
    assert rows.columns == ["doc_id", "text", "root", "__KEY"] and {r["__KEY"] for r in rows.collect()} == {"k"}
    assert sorted((r.doc_id or -1, r.text) for r in rows.collect()) == [(-1, "alone here"), (4, None), (6, "not the same"), (6, "same id"), (50, " ".join(base))]


def test_links_among_against_all_pairs():
    rng = random.Random(5)
    for _ in range(30):
        sets = []
        for _ in range(12):
            base = rng.sample(range(1000), 30)
            sets += [np.unique(np.array(rng.sample(base, 30 - rng.randrange(5)) + rng.sample(range(2000), rng.randrange(4)), np.uint64)) for _ in range(4)]
        want = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        assert groups_of(simhash.links_among(sets, 0.8), range(len(sets))) == groups_of(want, range(len(sets)))


def test_a_large_group_of_unlike_near_copies_is_not_paired(spark):
    """Texts that share most shingles but are below the similarity, and some above: rows stay linear, links are all found."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(x if j not in (a, b) else f"y{i}z{j}" for j, x in enumerate(base)) for i, (a, b) in enumerate((rng.randrange(40), rng.randrange(40)) for _ in range(600))]
    rows = list(enumerate(texts))
    sets = {i: set(simhash.shingles(simhash.words(t), 5)) for i, t in rows}
    pairs = [(a, b) for a in sets for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == groups_of(pairs, list(sets))


def test_members_by_loops(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 60)
    rng = random.Random(5)
    texts = [None, "", " \t", "a", "A b", "x" * 200, *("".join(rng.choice(["Word ", "é", "b\x0b", "c\u00a0d ", "  "]) for _ in range(rng.randrange(120))) for _ in range(40))]
    seen = {}
    for t in texts:
        (own,), (fp,) = simhash.members([t], 3)
        want = set(simhash.shingles(simhash.words(t), 3)) or {b""}
        assert len(own) == len(want) and (np.diff(own.astype(object)) > 0).all()
        seen.setdefault(frozenset(want), own.tolist())
        assert seen[frozenset(want)] == own.tolist() and (fp != 0 or not simhash.words(t))
    monkeypatch.setattr(simhash, "CHUNK", 10**6)
    sets, _ = simhash.members([t for t in texts if len(t or "") < 60], 3)
    assert [s.tolist() for s in sets] == [simhash.members([t], 3)[0][0].tolist() for t in texts if len(t or "") < 60]
    all_ = {frozenset(k): set(v) for k, v in seen.items()}
    for a, x in all_.items():
        for b, y in all_.items():
            assert len(a & b) == len(x & y)


def test_langid_held_out_accuracy(spark, sf):
    rows = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.op5_langid(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows)
    right = total = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.held_out and r.lang_pred != "und":
            total += 1
            right += r.lang_pred == rows[r.doc_id].lang
    assert total > 200 and right > 0.97 * total


def test_langid_scores_against_plain_loops(monkeypatch):
    monkeypatch.setattr(langid, "WINDOW", 7)
    rng = np.random.default_rng(0)
    model = langid.Model(["x", "y"], np.log([0.3, 0.7]), np.hstack([rng.normal(size=(2, langid.BUCKETS)), np.zeros((2, 1))]))

    def bucket(gram):
        h = 0
        for k, c in enumerate(gram):
            h = (((h ^ ord(c)) * int(langid._MIX[k % 3])) + k + 1) % 2**32
        return (h ^ h >> 15) * int(langid._MIX[1]) % 2**32 >> 16

    texts = ["Ab", "", None, "123 !", "Länger als ein Fenster, 漢字 too", "é", "²½ Ⅷ ①", "abcdef", "abcdefg", "abcde", "abcd", "x" * 33]
    names, best = langid.score(model, texts)
    for t, n, s in zip(texts, names, best, strict=True):
        if not t or not any(c.isalpha() for c in t):
            assert (n, s) == ("und", 0.0)
            continue
        p = f" {t.lower()} "
        logits = model.log_prior + sum(model.log_prob[:, bucket(p[i : i + k])] for k in langid.ORDERS for i in range(len(p) - k + 1))
        assert n == model.languages[int(logits.argmax())]
        assert s == pytest.approx(1 / np.exp(logits - logits.max()).sum())


def test_langid_windows_are_bounded():
    seen = [grams.shape[1] for grams, _, _ in langid.windows(["ab " * 3_000_000])]
    assert len(seen) > 2 and max(seen) <= 5 * langid.WINDOW


def test_langid_counts_by_loops(spark):
    rows = [(1, "the cat sat", "en"), (2, "le chat", "fr"), (3, "the the", "en"), (4, None, "en"), (5, "x", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), smoothing=0.5)

    def bucket(gram):
        h = 0
        for k, c in enumerate(gram):
            h = (((h ^ ord(c)) * int(langid._MIX[k % 3])) + k + 1) % 2**32
        return (h ^ h >> 15) * int(langid._MIX[1]) % 2**32 >> 16

    counts = np.full((2, langid.BUCKETS), 0.5)
    for _, text, lang in rows[:3]:
        p = f" {text} "
        for k in langid.ORDERS:
            for i in range(len(p) - k + 1):
                counts[["en", "fr"].index(lang), bucket(p[i : i + k])] += 1
    assert model.languages == ["en", "fr"] and np.allclose(model.log_prior, np.log([2 / 3, 1 / 3]))
    assert np.allclose(model.log_prob[:, :-1], np.log(counts / counts.sum(axis=1, keepdims=True))) and (model.log_prob[:, -1] == 0).all()


def test_langid_refuses_what_are_no_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        langid.fit(spark.createDataFrame([(i, "text", f"l{i}") for i in range(3)], "doc_id long, text string, lang string"))


def test_langid_odd_tables(spark):
    schema = "doc_id long, text string, lang string, Score string, lang_pred string"
    empty = langid.fit(spark.createDataFrame([], schema))
    df = spark.createDataFrame([(None, None, None, "a", "b"), (1, "", "en", "a", "b"), (1, "hello", None, "a", "b")], schema)
    assert [(r.lang_pred, r.score) for r in langid.predict(df, empty).collect()] == [("und", 0.0)] * 3
    model = langid.fit(spark.createDataFrame([(1, "the cat", "en", "", ""), (2, "le chat", "fr", "", ""), (None, "le chien", "fr", "", "")], schema))
    out = langid.predict(df, model)
    assert sorted(r.lang_pred for r in out.collect()) == ["en", "und", "und"] or sorted(r.lang_pred for r in out.collect()) == ["fr", "und", "und"]
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    counts = defaultdict(int)
    for r in langid.predict(df.limit(0), model).collect():
        counts[r.lang_pred] += 1
    assert not counts


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for n in (1, 40, 500, 3000)]
    sets += [np.unique(np.concatenate([s[: len(s) - len(s) // 10], rng.integers(0, 1 << 64, len(s) // 10, np.uint64)])) for s in sets] + [np.zeros(1, np.uint64)]
    rows = simhash.parities(sets)
    assert rows.shape == (len(sets), simhash.PARITIES // 64)
    for a, x in zip(rows, sets):
        for b, y in zip(rows, sets):
            assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= len(np.setxor1d(x, y))


def test_unlike_pairs_go_before_their_texts_are_read(spark, monkeypatch):
    """Texts that share enough shingles of their prefixes, but are not similar: none of their pairs may reach the check of texts."""
    rng, seen, real = random.Random(4), [], simhash._verified
    same = " ".join(rng.choices("abcdefghij", k=40))
    rows = [(i, same + " " + " ".join(f"w{i}x{j}" for j in range(60))) for i in range(40)]
    monkeypatch.setattr(simhash, "_verified", lambda edges, *rest: seen.append(edges.count()) or real(edges, *rest))
    found = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.component_id for r in found}) == 40 and seen[-1] == 0


def test_frequent_shingles_are_counted_in_a_share_of_the_table(spark, monkeypatch):
    """What 30 of 600 texts share is known as frequent, though a sample of SAMPLE texts would not show it."""
    monkeypatch.setattr(simhash, "SAMPLE", 10)
    rows = [(f"one two three four p{i % 20}" + f" u{i} v{i} w{i} x{i} y{i}",) for i in range(600)]
    got = simhash._frequent(spark.createDataFrame(rows, "text string"), "text", 5)
    shared = {int(simhash.members([f"one two three four p{j}"], 5)[0][0][0]) for j in range(20)}
    assert len(shared & set(got.tolist())) >= 8
