"""Language identification: multinomial naive Bayes over hashed character n-grams.

fit() counts n-grams of a bounded, documented sample of labelled rows on the executors and makes a matrix of log
probabilities (buckets x languages); predict() broadcasts it and scores batches in numpy: n-gram numbers of all
texts of a block index the matrix, and sums over each text's segment give its scores. The matrix has
BUCKETS x languages doubles whatever the corpus' size, and more than MOST_LANGUAGES labels are an error.

Defined results: a text that is null or without a letter is `und` with score 0, as is every text if no row was
labelled; a letter is a character that Unicode calls one, so numbers of any kind are none; equal scores go to the alphabetically first
language; very long texts are scored whole, some windows at a time; repeated rows are scored each; columns of the input are kept, but
for ones named lang_pred or score in any case of letters, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.names import without
from helixframe.llm.tokens import blocks
from helixframe.storage import prepare

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
WINDOW = 500_000
#: Labelled rows that fit() takes at most, in expectation: those of the smallest id hashes.
TRAIN_ROWS = 40_000
#: Languages that a model may have: the matrix takes half a megabyte for each.
MOST_LANGUAGES = 200
_WORD_CHARACTER = re.compile(r"[^\W\d_]").finditer
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # languages x (BUCKETS + 1); the last column is 0, for places without an n-gram


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in _WORD_CHARACTER(text or ""))


def windows(texts: list[str], chars: int = 4 * WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket of each n-gram by order and place, first place of each window, text of each window), of about so many characters at a time."""
    parts: list[str] = []
    owner: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(-1, len(t) + 1, WINDOW):  # a space stands before and behind
            own = f"{' ' if at < 0 else ''}{t[max(at, 0) : at + WINDOW + max(ORDERS) - 1].lower()}"
            parts.append(f"{own} " if at + WINDOW + max(ORDERS) - 1 > len(t) else own)
            owner.append(i)
            size += len(parts[-1])
            if size >= chars:
                yield _grams(parts, owner)
                parts, owner, size = [], [], 0
    if parts:
        yield _grams(parts, owner)


def _grams(parts: list[str], owner: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    # Places of a window's own n-grams; the overlap with the next window counts there.
    own = np.minimum(sizes, WINDOW)
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    left = np.repeat(ends, sizes) - np.arange(len(codes))  # characters from here to the window's end
    mine = np.arange(len(codes)) - np.repeat(ends - sizes, sizes) < np.repeat(own, sizes)
    out = np.full((len(ORDERS), len(codes)), BUCKETS, np.int64)
    h = np.zeros(len(codes), np.uint32)
    for k in range(max(ORDERS)):
        n = len(codes) - k
        if n <= 0:
            break
        h[:n] = (h[:n] ^ codes[k:]) * _MIX[k % 3] + np.uint32(k + 1)
        if k + 1 in ORDERS:
            mixed = h ^ (h >> np.uint32(15))
            mixed = (mixed * _MIX[1]) >> np.uint32(16)
            out[ORDERS.index(k + 1)] = np.where((left > k) & mine, mixed, BUCKETS)
    return out, ends - sizes, np.array(owner)


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for part in blocks(texts):
            by: dict[str, list[str]] = {}
            for lang, text in zip(langs[part], texts[part], strict=True):
                by.setdefault(lang, []).append(text)
            for lang, own in by.items():
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS + 1, np.int64)
                for grams, _, _ in windows(own):
                    counts[lang] += np.bincount(grams.ravel(), minlength=BUCKETS + 1)
    for lang, c in counts.items():
        some = np.flatnonzero(c[:BUCKETS])
        yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(c[some])], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, smoothing: float = 0.1, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from text and label of at most about `rows` labelled rows."""
    prepare(docs.sparkSession)
    labelled = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), docs[lang].alias("lang")).filter("lang is not null and text is not null")
    n = labelled.select("doc_id").count()
    share = min(1.0, rows / max(1, n))
    # By id and text, as ids may be null or repeat; rows that repeat both are taken or left together.
    kept = labelled.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else labelled
    own = {r["lang"]: r["count"] for r in kept.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(own) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels: the column does not seem to hold languages")
    languages = sorted(own)
    counted = kept.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long")
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x BUCKETS rows at most
    matrix = np.zeros((len(languages), BUCKETS + 1))
    if languages:
        matrix[[languages.index(x) for x in sums["lang"]], sums["bucket"].to_numpy()] = sums["n"]
    matrix[:, :BUCKETS] += smoothing
    matrix = np.log(matrix[:, :BUCKETS] / matrix[:, :BUCKETS].sum(axis=1, keepdims=True)) if languages else matrix[:, :BUCKETS]
    total = sum(own.values())
    prior = np.array([math.log(own[x] / total) for x in languages])
    return Model(languages, prior, np.hstack([matrix, np.zeros((len(languages), 1))]))


def score(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and posterior probability of each text."""
    names, best = ["und"] * len(texts), [0.0] * len(texts)
    some = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
    if some:
        logits = np.tile(model.log_prior[:, None], len(some))
        for grams, starts, owner in windows([texts[i] for i in some]):
            for k, row in enumerate(model.log_prob):
                sums = sum(np.add.reduceat(row[g], starts) for g in grams)
                logits[k] += np.bincount(owner, sums, len(some))
        top = logits.argmax(axis=0)
        share = 1 / np.exp(logits - logits.max(axis=0)).sum(axis=0)
        for i, t, s in zip(some, top.tolist(), share.tolist(), strict=True):
            names[i], best[i] = model.languages[t], s
    return names, best


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with lang_pred and score."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = without(docs, "lang_pred", "score")

    def run(batches):
        for batch in batches:
            values = batch.column(text).to_pylist()
            for part in blocks(values):
                names, best = score(shared.value, values[part])
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.record_batch([*rows.columns, pa.array(names, pa.string()), pa.array(best, pa.float64())], names=[*rows.schema.names, "lang_pred", "score"])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes), "lang_pred string", "score double"])
    return kept.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1
