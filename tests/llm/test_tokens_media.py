import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixframe.llm import matroska, packing, queries, token_orc, tokens

GPT, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = "doc_id long, text string, source string, ids string, start string"
CASES = [
    (1, None, None, None, None),
    (None, "no id  at\nall \n\n x", "a", "b", "c"),
    (2, "", "a", "b", "c"),
    (3, "tie", "a", "b", "c"),
    (3, "tie", "a", "b", "c"),
    (4, "  lead\x1ctrail \t\n é <|endoftext|> it's " + "long word " * 9000, "a", "b", "c"),
    (5, "x" * 5000, "a", "b", "c"),
    *((100 + i, "w" * (i % 7) + " a b" * (i % 50), "s", "", "") for i in range(300)),
]


def whole(path, texts):
    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "é ", "<|", "漢", "\n", "b "]), max_size=12).map("".join) | st.text(st.sampled_from("ab 'sS1.\n\t\x1c\x85  é́ΣσİK漢"), max_size=40))
def test_chunks_give_the_ids_of_whole_texts(text):
    for path, chunks in ((GPT, tokens.SPACED), (WORD, tokens.BARE)):
        got = np.frombuffer(tokens.encoder(path, chunks).encode([text])[0], "<u4").tolist()
        assert got == whole(path, [text])[0]


def check_packed(rows, expected, limits):
    """rows: pieces; expected: doc_id -> multiset of id lists."""
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
        assert r.length > 0 and len(r.ids) == 4 * r.length
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(p.loss_tokens for p in pieces) <= limits.loss
    assert set(docs) == set(expected)
    for doc_id, lists in expected.items():
        want = sorted(x for ids in lists for x in enumerate(ids))
        got = sorted((p.start + i, x) for p in docs[doc_id] for i, x in enumerate(np.frombuffer(bytes(p.ids), "<u4").tolist()))
        assert got == want
    return [sum(p.length for p in s) for s in sequences.values()]


def by_id(ids, path, texts, end):
    out = defaultdict(list)
    for i, x in zip(ids, whole(path, texts), strict=True):
        out[i].append([*x, end])
    return out


def test_pack_odd_rows(spark):
    df = spark.createDataFrame(CASES, ODD).repartition(2, "doc_id")
    want = by_id([c[0] for c in CASES], GPT, [c[1] for c in CASES], 1)
    sizes = check_packed(packing.pack(df, GPT).collect(), want, packing.Limits())
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes)


def test_pack_instruction_limits_without_cuts(spark):
    rows = [(i, "question " * (i % 40), "answer word " * (i % 90)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, ask string, text string").coalesce(1)
    limits = packing.Limits(tokens=512, segments=6, loss=300)
    got = packing.pack(df, GPT, limits, prompt="ask", cut=False).collect()
    want = defaultdict(list)
    for (i, _, _), a, b in zip(rows, whole(GPT, [r[1] for r in rows]), whole(GPT, [r[2] for r in rows]), strict=True):
        want[i].append([*a, *b, 1])
    check_packed(got, want, limits)
    assert all(r.length == r.doc_tokens for r in got)


def test_pack_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    got = {(r.doc_id, r.start): r for r in queries.op1_packing(spark, sf).collect()}
    pieces = packing.pack(docs, GPT).collect()
    sizes = check_packed(pieces, by_id([r.doc_id for r in rows], GPT, [r.text for r in rows], 1), packing.Limits())
    assert sum(2048 - n for n in sizes if n & (n - 1)) < 0.01 * sum(sizes)
    assert {k: (r.length, r.ids_crc32, r.sequence_id, r.offset) for k, r in got.items()} == {(p.doc_id, p.start): (p.length, zlib.crc32(bytes(p.ids)), p.sequence_id, p.offset) for p in pieces}


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], ODD), GPT).count() == 0


def orc_expected(ids, texts):
    start, out = 0, []
    for i, x in sorted(zip(ids, whole(WORD, texts), strict=True), key=lambda p: (p[0] is not None, p[0] or 0)):
        x = [*x, 2]
        out.append((i, start, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))))
        start += len(x)
    return out


def test_orc_round_trip(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = orc_expected([r.doc_id for r in rows], [r.text for r in rows])
    assert sorted(map(tuple, queries.op7_token_orc(spark, sf).collect())) == want


def test_orc_odd_rows_and_pruning(spark, tmp_path):
    path = str(tmp_path / "t")
    token_orc.write(spark.createDataFrame(CASES, ODD), path, WORD)
    got = sorted(map(tuple, token_orc.digest(token_orc.read(spark, path)).collect()), key=lambda r: r[1])
    assert got == orc_expected([c[0] for c in CASES], [c[1] for c in CASES])
    found = token_orc.lookup(spark, path, [3, 101])
    assert sorted(r.doc_id for r in found.collect()) == [3, 3, 101]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    empty = str(tmp_path / "e")
    token_orc.write(spark.createDataFrame([], ODD), empty, WORD)
    assert token_orc.read(spark, empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 900))
def test_mux_round_trip(raw, times):
    payload = raw * times
    data = matroska.mux(payload)
    found = matroska.parse(data)
    assert found.error is None and matroska.payload_of(data, found) == payload
    assert len(found.cues) == len(found.clusters) == -(-len(payload) // 65536)
    assert [p[1] for p in found.packets] == [i * 128_000_000 for i in range(len(found.packets))]


def test_lacing_groups_and_unknown_sizes():
    e, m = matroska.element, matroska
    xiph = b"\x81\x00\x05" + bytes([m.XIPH << 1, 2]) + b"\xff\x01" + b"\x02" + b"a" * 256 + b"bb" + b"ccc"
    ebml = b"\x81\xff\xff" + bytes([m.EBML_LACING << 1, 2]) + m.write_size(300) + ((0x4000 | (8191 - 100))).to_bytes(2) + b"d" * 300 + b"e" * 200 + b"f"
    group = e(m.BLOCK_GROUP, e(m.BLOCK, b"\x82\x00\x07\x00zz") + e(m.REFERENCE_BLOCK, b"\x01"))
    body = e(m.TIMESTAMP, b"\x64") + e(0xEC, b"void") + e(m.SIMPLE_BLOCK, xiph) + e(m.SIMPLE_BLOCK, ebml) + group
    cluster = m.CLUSTER.to_bytes(4) + b"\x01" + b"\xff" * 7 + body
    data = e(m.EBML, e(m.DOC_TYPE, b"webm")) + m.SEGMENT.to_bytes(4) + b"\xff" + cluster + cluster
    found = m.parse(data)
    assert found.error is None and found.doc_type == "webm" and len(found.clusters) == 2
    assert [data[p[2] : p[2] + p[3]] for p in found.packets] == [b"a" * 256, b"bb", b"ccc", b"d" * 300, b"e" * 200, b"f", b"zz"] * 2
    assert [p[1] // 10**6 for p in found.packets[:7]] == [105] * 3 + [99] * 3 + [107]
    assert [p[4] for p in found.packets[:7]] == [False] * 6 + [False] and found.packets[6][0] == 2


def test_delays_scales_and_encodings_of_tracks():
    e, m = matroska.element, matroska
    plain = m.uint(m.TRACK_NUMBER, 1) + m.uint(m.CODEC_DELAY, 6_500_000)
    scaled = m.uint(m.TRACK_NUMBER, 2) + e(m.TRACK_TIMESTAMP_SCALE, b"\x3f\x00\x00\x00")
    cluster = e(m.CLUSTER, m.uint(m.TIMESTAMP, 100) + e(m.SIMPLE_BLOCK, b"\x81\x00\x14\x00a") + e(m.SIMPLE_BLOCK, b"\x82\x00\x14\x00b"))

    def file(*tracks):
        return e(m.EBML, b"") + e(m.SEGMENT, e(m.TRACKS, b"".join(e(m.TRACK_ENTRY, t) for t in tracks)) + cluster)

    found = m.parse(file(plain, scaled))
    assert found.error is None and [p[1] for p in found.packets] == [113_500_000, 110_000_000]
    found = m.parse(file(plain + e(m.CONTENT_ENCODINGS, e(0x6240, b"")), scaled))
    assert "encodings" in found.error and len(found.packets) == 2


@pytest.mark.parametrize("cut", [0, 3, 30, 100, 300])
def test_damaged_files_give_an_error(cut):
    data = matroska.mux(bytes(range(256)) * 8)
    found = matroska.parse(data[:cut] if cut else b"\x00not media")
    assert found.error


def test_op8(spark, sf):
    import hashlib

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op8_matroska(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        p = matroska.padded(rows[r.doc_id])
        m = matroska.mux(p)
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-64:]) and r.payload_bytes == len(p)
        assert r.media_bytes == len(m) and r.media_sha256 == hashlib.sha256(m).hexdigest()


def test_media_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "z" * 200_000, None)], "doc_id long, text string, payload_note string")
    got = sorted(matroska.read_back(matroska.store(df)).collect(), key=lambda r: len(r.payload))
    assert [len(r.payload) for r in got] == [64, 64, 64, 200_000] and all(r.error is None for r in got)
    table = matroska.packets(matroska.store(df).filter("doc_id is null"), "doc_id")
    assert table.agg(F.sum("size")).first()[0] == 200_000 and table.filter("cued").count() == table.count() == 196
    assert matroska.packets(spark.createDataFrame([(1, None)], "k long, media binary"), "k").count() == 0
    assert matroska.store(df.limit(0)).count() == 0


def test_media_columns_take_the_place_of_others(spark):
    df = spark.createDataFrame([(1, "some text", "x", "y", "z")], "doc_id long, text string, Media string, error string, Feature string")
    (row,) = matroska.read_back(matroska.store(df)).collect()
    assert bytes(row.payload) == matroska.padded("some text") and row.error is None and set(row.asDict()) == {"doc_id", "media", "payload", "feature", "error"}
