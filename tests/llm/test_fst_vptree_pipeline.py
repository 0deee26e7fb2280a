import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from helixframe.llm import piece_fst, queries, simhash, vptree

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aabcdethinoe   ▁\n\t.12²é漢字ﬁ-_(\x00🙂ßΣ"), max_size=40) | st.text(max_size=20))
def test_ids_and_text_equal_the_library(text):
    fst = piece_fst.compiled(PATH)
    ids = fst.encode(text)
    want = LIBRARY.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert fst.decode(ids) == LIBRARY.decode(want)


def test_unigram_shortest_path_by_enumeration():
    rng = random.Random(8)
    pieces = [("<unk>", 0.0, piece_fst.UNKNOWN)] + [(p, -rng.uniform(1, 5), piece_fst.NORMAL) for p in ["▁", "a", "b", "ab", "ba", "▁a", "aba", "bb", "abb"]]
    fst = piece_fst.Transducer(piece_fst.Model(pieces, piece_fst.UNIGRAM))
    cost = {p: -s for p, s, t in pieces if t == piece_fst.NORMAL}
    for _ in range(200):
        s = "▁" + "".join(rng.choice("ab") for _ in range(rng.randrange(9)))
        paths = []
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(s)]
            parts = [s[a:b] for a, b in itertools.pairwise(at)]
            if all(p in cost for p in parts):
                paths.append(sum(cost[p] for p in parts))
        assert sum(cost[p] for p in fst.shortest(s)) == pytest.approx(min(paths))


def test_shortest_path_equals_merges_without_units():
    fst = piece_fst.compiled(PATH)
    rng = random.Random(9)
    for _ in range(300):
        s = "▁" + "▁".join("".join(rng.choice("etaonirsh.") for _ in range(rng.randrange(1, 12))) for _ in range(3))
        assert fst.shortest(s) == fst.merged(s)
    for _ in range(5000):  # merges of runs of marks have equal scores
        s = "".join(rng.choice(["▁", "▁" * rng.randrange(1, 40), "the", "in", "a", "s"]) for _ in range(rng.randrange(1, 9)))
        assert fst.shortest(s) == fst.merged(s)


def merges_by_hand(text, score):
    out = list(text)
    while True:
        best = max(((score[a + b], -i) for i, (a, b) in enumerate(itertools.pairwise(out)) if a + b in score), default=None)
        if best is None:
            return out
        out[-best[1] : 2 - best[1]] = [out[-best[1]] + out[1 - best[1]]]


def test_merges_against_loops_and_long_runs_of_marks():
    fst = piece_fst.compiled(PATH)
    rng = random.Random(3)
    for n in (1, 5, 30, 90):
        for _ in range(40):
            s = "".join(rng.choice(["▁", "▁▁", "th", "e", "in", "a"]) for _ in range(n))
            assert fst.merged(s) == merges_by_hand(s, fst.score)
    for text in (" " * 5000 + "a", "a" + " " * 777 + "the end", " " * 20_000):
        assert np.frombuffer(fst.encode(text), "<u4").tolist() == LIBRARY.encode(text)


def test_op9(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9_piece_fst(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        want = np.array(LIBRARY.encode(rows[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_crc32) == (len(want) // 4, zlib.crc32(want)) and r.same


def test_fst_odd_rows(spark):
    long = "word  and more words " * 20_000
    df = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, long, None), (2, long, None)], "doc_id long, text string, ids string")
    got = piece_fst.decode(piece_fst.encode(df, PATH), PATH).collect()
    assert sorted(r.decoded for r in got) == ["", "", long, long]
    assert piece_fst.encode(df.limit(0), PATH).count() == 0


def nearest(rows, queries_, k):
    ok = [(i, np.array(x, float)) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    out = {}
    for q, y in ok:
        if q in queries_:
            scored = sorted({(-math.fsum(y * x), i) for i, x in ok if i != q and len(x) == len(y)})[:k]
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return out


def grouped(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return dict(out)


def test_exact_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(700)]
    rows += [(700 + i, rows[5][1]) for i in range(60)] + [(760, None), (761, []), (762, [0.0] * 8), (763, [float("nan")] * 8), (764, [1.0, None] * 4), (765, [float("inf")] * 8), (None, rows[3][1])]
    rows += [(770, [1.0, 2.0]), (771, [2.0, 1.0]), (6, rows[6][1])]
    df = spark.createDataFrame([(i, x, "c") for i, x in rows], "vec_id long, embedding array<float>, score string")
    asked = {5, 6, 100, 705, 759, 770, 762}
    v = vptree.usable(df)
    got = vptree.search(v, v.filter(v.vec_id.isin(list(asked))), k=20, relax=1.0, shard_rows=150, block_rows=3)
    assert grouped(got.collect()) == nearest(rows, asked, 20)
    assert vptree.search(v.limit(0), v.limit(0)).count() == 0


def test_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(500, 2)))]
    rows += [(1000 + i, [2.0, 0.0, float(i)]) for i in range(4)] + [(2000, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = vptree.usable(df)
    for shard_rows in (100, 5000):
        got = vptree.search(v, v.filter("vec_id = 2000"), k=20, shard_rows=shard_rows)
        assert grouped(got.collect()) == nearest(rows, {2000}, 20)
        assert sorted(r.vec_id for r in got.collect()) == [*range(16), 1000, 1001, 1002, 1003]


def test_pruning_leaves_out_branches():
    rng = np.random.default_rng(5)
    x = np.concatenate([c + 0.01 * rng.normal(size=(400, 3)) for c in 5 * rng.normal(size=(12, 3))])
    tree = vptree.Tree.build(x)
    places, _, seen = tree.search(x[:200], 5, 1.0)
    truth = np.argsort(-(x[:200] @ x.T), axis=1)[:, :5]
    assert (np.sort(places, 1) == np.sort(truth, 1)).all() and seen < 0.6 * 200 * len(x)


def test_op10_is_exact_in_few_intrinsic_dimensions():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(8192, 6)) @ np.linalg.qr(rng.normal(size=(64, 6)))[0].T
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    places, _, _ = vptree.Tree.build(x).search(x[:100], 26, queries.RELAX)
    assert (np.sort(places, 1) == np.sort(np.argsort(-(x[:100] @ x.T), axis=1)[:, :26], 1)).all()


def test_op10_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = nearest(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    got = grouped(queries.op10_vptree(spark, sf).collect())
    assert set(got) == set(want)
    hits = sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    truth = {(q, i): s for q, found in nearest(rows, set(want), 10**6).items() for _, i, s in found}
    assert all(truth[q, i] == s for q, found in got.items() for _, i, s in found)


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    first = corpus_pipeline.language_id(spark, docs, sf)
    assert first.columns == columns and dict(first.dtypes) == dict(docs.dtypes)
    kept = {r.doc_id: r for r in first.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {i for i, t in texts.items() if t and any(c.isalpha() for c in t)} == set(kept)
    second = corpus_pipeline.near_duplicates(spark, first, sf)
    assert second.columns == columns and dict(second.dtypes) == dict(docs.dtypes)
    ids = sorted(r.doc_id for r in second.collect())
    sets = {i: set(simhash.shingles(simhash.words(texts[i]), 5)) for i in ids}
    assert not [(a, b) for a, b in itertools.combinations(ids, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    third = corpus_pipeline.repeated_substrings(spark, second, sf)
    assert third.columns == columns and dict(third.dtypes) == dict(docs.dtypes)
    assert all(r.n_chars == len(r.text) for r in third.collect())
    last = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == {r.doc_id for r in third.collect()}


def test_pipeline_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, __key string"
    rows = [(1, None, None, None, None, "", ""), (None, "Hello there my friend.", "en", "s", 3, "", ""), (2, "12 34", "en", "s", 5, "", ""), (3, "Bonjour mon ami.", "fr", "s", 5, "", ""), (3, "Bonjour mon ami.", "fr", "s", 5, "", "")]
    for name, df in (("odd", spark.createDataFrame(rows, schema)), ("empty", spark.createDataFrame([], schema))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in got} == ({None, 3} if name == "odd" else set())
