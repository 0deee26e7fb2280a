"""FASTQ and plain-text ingestion, and FASTA output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.operators.sort import with_position
from helixframe.storage import stage

#: Blocks of files whose line offsets are broadcast; beyond, they are joined.
MAX_BROADCAST = 100_000

def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, read_id, seq): the second line of each record of four; names and qualities are dropped.

    Files are split as Spark splits them. A first pass counts the lines of each block of a file; the lines of the blocks
    before, plus a line's place in its block, number it, so no file is read by one task alone.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value").withColumn("__n", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("__n").alias("__first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = stage(blocks.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift")), "blocks")
    if starts.count() <= MAX_BROADCAST:
        starts = F.broadcast(starts)
    line = F.col("__n") + F.col("__shift")
    numbered = lines.join(starts, ["file", "block"]).withColumn("line", line)
    return numbered.filter("line % 4 = 1").select("file", F.expr("line div 4").alias("read_id"), F.regexp_replace("value", "\r$", "").alias("seq"))


def put_fastq(spark: SparkSession, source: str, target: str) -> None:
    """Write one read a line, the reads of each split in their order and without a shuffle; fails if the target exists."""
    read_fastq(spark, source).sortWithinPartitions("file", "read_id").select("seq").write.mode("errorifexists").text(target)


def put(spark: SparkSession, source: str, target: str, force: bool = False, lines_a_file: int | None = None) -> None:
    """Copy the lines of a file, or of all files of a folder; an existing target is an error unless forced."""
    writer = spark.read.text(source, lineSep="\n").write.mode("overwrite" if force else "errorifexists")
    (writer.option("maxRecordsPerFile", lines_a_file) if lines_a_file else writer).text(target)


def read_reads(spark: SparkSession, *paths: str) -> DataFrame:
    """(seq) of one or several folders with a read a line."""
    return spark.read.text(list(paths), lineSep="\n").withColumnRenamed("value", "seq")


def assignment(df: DataFrame) -> DataFrame:
    """(partition, rows): how the rows are dealt out."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("rows"))


def fasta(assembly: DataFrame) -> DataFrame:
    """One value a sequence: the header and the letters on two lines."""
    return assembly.select(F.concat_ws("\n", F.concat(F.lit(">"), "name"), "seq").alias("value"))


def named(assembly: DataFrame) -> DataFrame:
    """Adds names contig-<number>, numbered from 1 in order of the sequence, so the same sequences get the same names anywhere."""
    placed = with_position(assembly, "seq", name="__n")
    return placed.withColumn("name", F.concat(F.lit("contig-"), F.col("__n") + 1)).drop("__n")


def write_fasta(assembly: DataFrame, path: str) -> None:
    fasta(assembly).write.mode("overwrite").text(path)
