"""Counting canonical (k+1)-mers, the edges of the de Bruijn graph.

Work is done once a read where it can be: splitting at letters that are no bases, and the reverse complement, from which the
other strand of each window is cut. What remains a window is two substrings and a comparison in generated code, on bytes: cutting
letters walks through a string from its start, and cutting bytes copies them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequence as S


def split_reads(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """(seq): the parts of each read between Ns, in upper case."""
    return reads.select(F.explode(S.fragments(F.upper(seq))).alias("seq"))


def _places(reads: DataFrame, k: int, seq: str, kind: str = "string") -> DataFrame:
    """(seq, rc, n, i): each start of a window in the parts of a read that have only bases; so no window has other letters."""
    parts = reads.select(F.explode(F.split(F.upper(seq), "[^ACGT]")).alias("seq")).filter(F.length("seq") > k)
    both = parts.select(F.col("seq").cast(kind).alias("seq"), S.revcomp("seq").cast(kind).alias("rc"), F.length("seq").alias("n"))
    return both.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n") - k)))


def kplus_windows(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(s): every window of k + 1 bases."""
    return _places(reads, k, seq).select(F.substr("seq", "i", F.lit(k + 1)).alias("s"))


def _canonical_bytes(reads: DataFrame, k: int, seq: str) -> DataFrame:
    """(kp1): canonical windows as bytes, which sort as their letters, without homopolymers; the canonical ones are those of A and C."""
    bytes_ = _places(reads, k, seq, "binary")
    other = F.substr("rc", F.col("n") - F.col("i") - F.lit(k - 1), F.lit(k + 1))
    own = bytes_.select(F.least(F.substr("seq", "i", F.lit(k + 1)), other).alias("kp1"))
    return own.filter(~F.col("kp1").isin(b"A" * (k + 1), b"C" * (k + 1)))


def canonical_kplus(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kp1): canonical windows without homopolymers, which would be loops."""
    return _canonical_bytes(reads, k, seq).select(F.col("kp1").cast("string").alias("kp1"))


def count_kplus(reads: DataFrame, k: int, freq_t: int = 1, wrap256: bool = False, seq: str = "seq") -> DataFrame:
    """(kp1, cnt) with cnt at least freq_t. wrap256 keeps counts modulo 256 before that filter."""
    counted = _canonical_bytes(reads, k, seq).groupBy("kp1").agg(F.count("*").alias("cnt")).withColumn("kp1", F.col("kp1").cast("string"))
    if wrap256:
        counted = counted.withColumn("cnt", F.col("cnt") % 256)
    return counted.filter(F.col("cnt") >= freq_t)
