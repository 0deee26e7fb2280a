"""Token ids in ORC: run-length encoded integers, row indexes, and Bloom filters on document ids.

Documents are dealt by ranges of doc_id and sorted, so file number and place in the file give the global order
and each stripe covers a narrow id range. Each row keeps the number of ids before it in its file; a reader adds
the totals of the earlier files, so stripes can be read in parallel and in any order.

Defined results: null text is empty and leaves the end id alone; null ids come first; rows with equal ids are
ordered by text hash, then text; repeated rows are kept; an empty table gives a file set without rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import tokens
from helixframe.storage import prepare

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
#: Files whose totals (one number a file, from the column n_tokens alone) are broadcast; beyond, they are joined.
MAX_BROADCAST = 100_000
OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "10000", "orc.stripe.size": str(16 << 20), "orc.compress": "ZSTD"}


def _encode(tokenizer: str, end_id: int):
    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for rows, ids in tokens.encoded(batches, tokenizer, tokens.BARE, end_id):
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.record_batch([rows.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(before + ends[:-1]), pa.array(sizes), lists], schema=_ARROW)
            before += int(ends[-1])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts, append end_id to each, and write ORC files in ascending doc_id order."""
    prepare(docs.sparkSession)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    dealt = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    dealt.mapInArrow(_encode(tokenizer, end_id), SCHEMA).write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files with `start`, the number of ids of all documents before."""
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens")).orderBy("part").collect()
    sums = accumulate((n for _, n in totals), initial=0)
    firsts = spark.createDataFrame([(part, first) for (part, _), first in zip(totals, sums)], "part int, first long")
    firsts = F.broadcast(firsts) if len(totals) <= MAX_BROADCAST else firsts
    return rows.join(firsts, "part").select("doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The stored rows of a few documents: stripe statistics and Bloom filters rule out the other stripes."""
    return spark.read.schema(SCHEMA).orc(path).filter(F.col("doc_id").isin(doc_ids))


def _crc(batches):
    for batch in batches:
        lists = batch.column("ids")
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(flat, "<i4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit integers, of rows from read()."""
    prepare(rows.sparkSession)
    return rows.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
