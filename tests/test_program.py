"""The command line, what loops leave in the shared folder, and varints."""

import os

import pytest
from pyspark.sql import functions as F

from helixframe import __main__ as program
from helixframe.functions import sequence as S
from helixframe.operators import paths, pregel
from helixframe.sources import config
from helixframe.storage import shared_dir


def _tables(spark):
    root = shared_dir(spark).removeprefix("file://") + "/helixframe"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_assemble_from_a_configuration(spark, tmp_path):
    letters = "ACGTTGCATGACCTGATTGCACGGATACCATTGCAGT"
    (tmp_path / "r.fastq").write_text("".join(f"@{i}\n{letters[i:i + 12]}\n+\n{'2' * 12}\n" for i in range(len(letters) - 11)))
    program.main(["put-fastq", str(tmp_path / "r.fastq"), str(tmp_path / "in")])
    program.main(["put", str(tmp_path / "in"), str(tmp_path / "copy"), "--lines", "5"])
    text = "[Any]\nK_MER_T = 5 // letters\noutput_contig_t = 0\n" + "".join(f"{k} = {tmp_path}/{'in' if names == ('reads',) else k}\n" for k, names in config.PATHS.items())
    (tmp_path / "a.ini").write_text(text)
    program.main(["assemble", str(tmp_path / "a.ini"), "--emit-isolated"])
    out = tmp_path / "HDFS_OUTPUT_PATH"
    lines = [x for f in sorted(out.glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[0] == ">contig-1" and len(lines) % 2 == 0
    for key, names in config.PATHS.items():
        if names not in (("reads",), ("sequences",)):
            for name in names:
                assert spark.read.parquet(f"{tmp_path}/{key}/{name}").columns
    assert spark.read.parquet(f"{tmp_path}/DeBruijn_PATH/kplus").count() > 20
    with pytest.raises(ValueError, match="lacks"):
        program.assemble(spark, "[a]\nk_mer_t = 5\n")
    with pytest.raises(ValueError, match="sections"):
        program.assemble(spark, "[a]\nx = 5\n[b]\nx = 5\n")


def test_jump_leaves_its_results_only(spark):
    before = _tables(spark)
    n = 100
    nodes = spark.range(n).select(F.col("id").alias("v"), F.lit(False).alias("h"), F.when(F.col("id") < n - 1, F.col("id") + 1).alias("nv"), F.lit(False).alias("nh"), F.lit(2).alias("w"))
    circle = spark.range(1000, 1004).select(F.col("id").alias("v"), F.lit(False).alias("h"), F.when(F.col("id") < 1003, F.col("id") + 1).otherwise(1000).alias("nv"), F.lit(False).alias("nh"), F.lit(2).alias("w"))
    ends, circular = paths.jump(nodes.union(circle))
    assert {(r.v, r.ev, r.dist) for r in ends.collect()} == {(i, n - 1, 2 * (n - 1 - i)) for i in range(n)}
    assert sorted(r.v for r in circular.collect()) == [1000, 1001, 1002, 1003]
    assert len(_tables(spark) - before) == 2


def test_supersteps_leave_one_table(spark):
    before = _tables(spark)
    start = spark.range(6).select("id", F.col("id").alias("label"))

    def compute(df, step, _):
        if step == 1:
            return df
        return df.withColumns({"label": F.least("label", "m"), "active": F.coalesce(F.col("m") < F.col("label"), F.lit(False))})

    def send(df, step):
        return df.filter("active and id < 5").select((F.col("id") + 1).alias("dst"), F.col("label").alias("m"))

    out = pregel.run(start, compute, send, {"m": F.min("m")}, phases=2)
    assert {(r.id, r.label) for r in out.collect()} == {(i, 0) for i in range(6)}
    assert len(_tables(spark) - before) == 1


def test_varints(spark):
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 2**32 - 1]
    df = spark.createDataFrame([(numbers,), ([],), (None,)], "n array<long>").select("n", S.varints("n").alias("b"))
    rows = df.select("n", "b", S.from_varints("b").alias("back")).collect()
    assert [r.back for r in rows] == [numbers, [], None]
    assert bytes(rows[0].b)[:6] == bytes([0x80, 0x81, 0xFF, 0x00, 0x81, 0x2C])
