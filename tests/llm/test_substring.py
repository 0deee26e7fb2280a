import math
import random
from collections import defaultdict

import numpy as np
import pytest

from helixframe.llm import queries, substring

M = 1 << 64


def scrambled(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % M
    x = (x ^ x >> 27) * 0x94D049BB133111EB % M
    return x ^ x >> 31


def word_value(word):
    total = sum(scrambled(ord(c.lower()[0]) + 1) * pow(0x9E3779B97F4A7C15, i, M) for i, c in enumerate(word)) % M
    return scrambled(total ^ len(word) * 0x94D049BB133111EB % M) >> 2 | 1


def unspaced(c):
    return any(a <= ord(c) <= b for a, b in substring.UNSPACED)


def pieces_by_hand(text):
    """(start, end, words) of each piece, by loops over characters and windows."""
    words, at = [], 0
    while at < len(text):
        if not text[at].isalnum():
            at += 1
            continue
        end = at + 1
        while not unspaced(text[at]) and end < len(text) and text[end].isalnum() and not unspaced(text[end]):
            end += 1
        words.append((at, end))
        at = end
    if not words:
        return []
    values, cuts = [], []
    for n, (_, end) in enumerate(words):
        stop = words[n + 1][0] if n + 1 < len(words) else len(text)
        gap = text[end:stop]
        spaces = [i for i, c in enumerate(gap) if c.isspace()]

        def before_space(marks):
            return any(c in marks and spaces and i < spaces[-1] for i, c in enumerate(gap))

        if n + 1 == len(words) or "\n" in gap or any(c in substring.WIDE_ENDERS for c in gap) or before_space(substring.ENDERS):
            values.append((0, 0))
        elif any(c in substring.WIDE_COMMAS for c in gap) or before_space(substring.COMMAS):
            values.append((1, word_value(text[slice(*words[n])])))
        else:
            values.append((2 if spaces else 3, word_value(text[slice(*words[n])])))
        if "\n" in gap:
            cut = gap.rindex("\n") + 1
        elif spaces:
            cut = spaces[-1] + 1
        else:
            cut = max((i + 1 for i, c in enumerate(gap) if c not in substring.OPENERS), default=0)
        cuts.append(end + cut)
    size = substring.WINDOW
    chosen = {i for i, v in enumerate(values) if v == (0, 0)}
    for a in range(len(values) - size + 1):
        least = min(values[a : a + size])
        chosen |= {i for i in range(a, a + size) if values[i] == least}
    out, start, first = [], 0, 0
    for i in sorted(chosen):
        end = cuts[i] if i + 1 < len(words) else len(text)
        out.append((start, end, [text[a:b].lower() for a, b in words[first : i + 1]]))
        start, first = end, i + 1
    return out


def spans_by_hand(text):
    own = pieces_by_hand(text)
    for a in range(len(own)):
        for b in range(a + substring.RUN, len(own) + 1):
            words = [w for p in own[a:b] for w in p[2]]
            if len(words) >= substring.MIN_WORDS:
                yield tuple(words), own[a][0], own[b - 1][1]
                break


def dedup_by_hand(rows):
    """rows: (doc_id, text hash, text); all by plain loops."""
    where = defaultdict(list)
    for k, (i, h, text) in enumerate(rows):
        for words, a, b in spans_by_hand(text or ""):
            where[words].append(((math.inf if i is None else i, h, a), k, b))
    gone = defaultdict(set)
    for found in where.values():
        original = min(found)[0]
        for place, k, b in found:
            if place != original:
                gone[k].update(range(place[2], b))
    return ["".join(c for at, c in enumerate(r[2]) if at not in gone[k]) if gone[k] else r[2] for k, r in enumerate(rows)]


def test_spans_of_blocks_equal_those_by_hand():
    rng = random.Random(4)
    parts = ["word ", "other", ". ", "!", "\n", ", ", "é ", "end.\n", "*** ", "  ", "Ab", "c d ", "漢字", "。", "「", "，", "ß_", " (so ", '." ', "٣ ", "Ⅷ", " "]
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(160))) for _ in range(rng.randrange(1, 6))]
        h1, h2, text, a, b = substring.spans(texts)
        want = [(n, x, y, words) for n, t in enumerate(texts) for words, x, y in spans_by_hand(t)]
        assert list(zip(text.tolist(), a.tolist(), b.tolist())) == [w[:3] for w in want]
        by = defaultdict(set)
        for h, w in zip(zip(h1.tolist(), h2.tolist()), want, strict=True):
            by[w[3]].add(h)
        assert all(len(x) == 1 for x in by.values()) and len(set.union(*by.values(), set())) == len(by)


def test_long_texts_are_read_in_chunks(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["word ", "other ", "some. ", "ab\n ", "x, ", "「y", "。"]) for _ in range(700)) for _ in range(3)]
    want = [c.tolist() for c in substring.spans(texts)]
    monkeypatch.setattr(substring, "CHUNK", 100)
    assert [c.tolist() for c in substring.spans(texts)] == want
    assert len(substring.spans(["x" * 150])[0]) == 0


def test_op3_against_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "xxhash64(text) h").collect()
    got = {r.doc_id: r for r in queries.op3_substring(spark, sf).collect()}
    want = dedup_by_hand([(r.doc_id, r.h, r.text) for r in docs])
    assert {r.doc_id: w for r, w in zip(docs, want, strict=True)} == {i: r.text for i, r in got.items()}
    texts = {r.doc_id: r.text for r in docs}
    for i, r in got.items():
        gone = sum(x.end - x.start for x in r.removed)
        assert len(r.text) + gone == len(texts[i]) and (gone > 0) == (r.n_removed > 0)


PASSAGE = " ".join(f"Word{i} of the passage stands here now and then it goes on{'.' if i % 3 else ','}" for i in range(8))


@pytest.mark.parametrize("local", [1, 10**6])
def test_planted_passages_go_and_the_rest_stays(spark, monkeypatch, local):
    monkeypatch.setattr(substring, "LOCAL", local)
    clean = [f"This is the own text number {i} with words w{i}a w{i}b w{i}c." for i in range(6)]
    rows = [(i, f"{c} {c.upper()[:20]} and so on {PASSAGE} W{i}x stands behind. {c}", "s", i) for i, c in enumerate(clean)]
    out = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string, N_removed string, __doc long"))
    assert out.columns == ["doc_id", "text", "__doc", "n_removed", "removed"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert [r["__doc"] for r in sorted(out.collect())] == list(range(6))
    assert got[0] == rows[0][1]
    for i in range(1, 6):
        assert "Word2 of the passage" not in got[i] and got[i].startswith(clean[i]) and got[i].endswith(f"W{i}x stands behind. {clean[i]}")


@pytest.mark.parametrize("ends", ["", ".", ".,;", ".,"])
def test_shared_runs_of_fifty_words_share_a_span(ends):
    rng = random.Random(9)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) + (rng.choice(ends) if ends and rng.random() < 0.1 else "") for _ in range(n))

    assert substring.MIN_WORDS + 4 * substring.WINDOW - 3 <= 50
    for n in [50, 51, 60, 80] * 100:
        passage = prose(n)
        h1, h2, text, _, _ = substring.spans([f"{prose(rng.randrange(40))} {passage} {prose(rng.randrange(40))}" for _ in range(2)])
        a, b = (set(zip(h1[text == i].tolist(), h2[text == i].tolist())) for i in range(2))
        assert a & b


def test_scripts_without_spaces(spark):
    han = "今天天气很好，我们一起去公园散步。路上遇见了许多老朋友！"
    passage = han + "昨日は雨が降ったので、家で本を読みました。「明日は晴れるでしょう。」と母が言いました。"
    rows = [(i, f"{o * 5}。{passage}{o}終") for i, o in enumerate("甲乙丙")]
    got = {r.doc_id: r.text for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    assert all("公园" not in got[i] and "雨" not in got[i] and got[i].startswith(rows[i][1][:5]) and got[i].endswith("終") for i in (1, 2))


def test_odd_rows(spark):
    long = "Some sentence with enough words to make a span of its own here. " * 3000
    rows = [(None, PASSAGE), (3, None), (4, ""), (5, PASSAGE), (5, PASSAGE), (6, long), (7, "x" * 50_000), (8, "... --"), *[(9, PASSAGE)] * 50]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.dedup(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[None].text == "" and by[3].text is None and by[4].text == "" and by[7].text == "x" * 50_000 and by[8].text == "... --"
    assert [r.text for r in got if r.doc_id == 5] == [PASSAGE] * 2 and len(by[6].text) < 400 and {r.text for r in got if r.doc_id == 9} == {""}
    assert substring.dedup(df.limit(0)).count() == 0


def test_first_of_equals_by_loops():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(0, 60))
        h1, h2, a, b = (rng.integers(0, 4, n) for _ in range(4))
        rows = list(zip(h1.tolist(), h2.tolist(), a.tolist(), b.tolist()))
        keep, later = substring.first_of_equals(h1.astype(np.uint64), h2.astype(np.uint64), a, b)
        got = sorted((rows[i], bool(x)) for i, x in zip(keep.tolist(), later.tolist()))
        assert got == sorted((r, any(o[:2] == r[:2] and o < r for o in rows)) for r in set(rows))
