"""python -m helixframe: load reads, or assemble them as a configuration says."""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.sql import SparkSession

from helixframe.plans.assembly import Assembly
from helixframe.sources import config, fastq


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="helixframe", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    put = commands.add_parser("put", help="copy the lines of a file or folder")
    put_reads = commands.add_parser("put-fastq", help="write the reads of FASTQ files, one a line")
    for p in (put, put_reads):
        p.add_argument("source")
        p.add_argument("target")
    put.add_argument("--force", action="store_true", help="replace the target")
    put.add_argument("--lines", type=int, help="lines of a file at most")
    run = commands.add_parser("assemble", help="assemble the reads of a configuration and keep each table that it gives a path for")
    run.add_argument("configuration")
    run.add_argument("--section", help="its section, if it has several")
    run.add_argument("--emit-isolated", action="store_true", help="write contigs without neighbours too")
    return parser.parse_args(argv)


def assemble(spark: SparkSession, text: str, section: str | None = None, emit_isolated: bool = False) -> Assembly:
    """Run a configuration: reads from its input folder, tables and FASTA to the paths it has."""
    section = section or config.only_section(text)
    paths = config.load_paths(text, section)
    missing = {"HDFS_INPUT_PATH", "HDFS_OUTPUT_PATH"} - set(paths)
    if missing:
        raise ValueError(f"the configuration lacks {sorted(missing)}")
    made = Assembly(fastq.read_reads(spark, paths["HDFS_INPUT_PATH"]), config.Parameters.load(text, section), emit_isolated=emit_isolated)
    made.write_each(paths)
    return made


def main(argv: list[str] | None = None) -> None:
    args = _arguments(argv)
    logging.basicConfig(format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("helixframe").setLevel(logging.INFO)
    spark = SparkSession.builder.appName("helixframe").getOrCreate()
    if args.command == "put":
        fastq.put(spark, args.source, args.target, args.force, args.lines)
    elif args.command == "put-fastq":
        fastq.put_fastq(spark, args.source, args.target)
    else:
        assemble(spark, Path(args.configuration).read_text(), args.section, args.emit_isolated)


if __name__ == "__main__":
    main()
