import inspect
import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import pregel, sort
from helixframe.sources import config, fastq

INI = """; comment
[Some_Section]
K_MER_T = 0x15 // letters after a number are ignored
freq_t = 02   ; ends here
bubble_t=3
TIP_T : 4
path = "/a ; b" # kept in quotes
output_contig_t = 10
"""


def test_ini():
    values = config.read_ini(INI)
    assert values["some_section:path"] == "/a ; b" and values["some_section:freq_t"] == "02"
    assert config.Parameters.load(INI, "SOME_section") == config.Parameters(21, 2, 3, 4, 10)
    assert config.Parameters.load("", "x") == config.Parameters(4, 1, 1, 1, 10)
    assert config.read_ini(config.write_ini(values)) | {"some_section:path": ""} == values | {"some_section:path": ""}
    assert [config.parse_int(x) for x in ("12//", "-3", "0x1F", "017", "x")] == [12, -3, 31, 15, 0]
    with pytest.raises(ValueError, match="line end"):
        config.read_ini("[a]\nb=1")


def test_fastq_and_text(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n in range(3):
        (source / f"{n}.fastq").write_text("".join(f"@r{n}{i}\nACGT{'ACGT'[i] * n}\r\n+\n2222\n" for i in range(4)))
    got = fastq.read_fastq(spark, str(source))
    assert sorted(r.seq for r in got.collect()) == sorted(f"ACGT{'ACGT'[i] * n}" for n in range(3) for i in range(4))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "37")
    try:
        assert fastq.read_fastq(spark, str(source)).rdd.getNumPartitions() > 0
        split = {(r.file[-7:], r.read_id): r.seq for r in fastq.read_fastq(spark, str(source)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert split == {(f"{n}.fastq", i): f"ACGT{'ACGT'[i] * n}" for n in range(3) for i in range(4)}
    out = str(tmp_path / "reads")
    fastq.put_fastq(spark, str(source), out)
    assert fastq.read_reads(spark, out).count() == 12
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        fastq.put_fastq(spark, str(source), out)
    copy = str(tmp_path / "copy")
    fastq.put(spark, out, copy, lines_a_file=2)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        fastq.put(spark, out, copy)
    fastq.put(spark, out, copy, force=True)
    assert fastq.read_reads(spark, out, copy).count() == 24
    assert fastq.assignment(fastq.read_reads(spark, out)).agg(F.sum("rows")).first()[0] == 12


def test_fasta(spark, tmp_path):
    df = spark.createDataFrame([("ACGT",), ("TTTT",), ("GGG",)], "seq string")
    path = str(tmp_path / "out")
    fastq.write_fasta(fastq.named(df), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert len(lines) == 6 and sorted(x for x in lines if x[0] != ">") == ["ACGT", "GGG", "TTTT"]
    names = [x for x in lines if x[0] == ">"]
    assert len(set(names)) == 3 and all(x.startswith(">contig-") for x in names)


def test_sort_with_position(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), rng.random()) for _ in range(500)]
    got = sort.with_position(spark.createDataFrame(rows, "a int, b double").repartition(7), "a", "b", partitions=5).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.pos)] == sorted(rows)
    assert sorted(r.pos for r in got) == list(range(500))
    assert sort.with_position(spark.createDataFrame([], "a int"), "a").count() == 0


def test_pregel_shortest_paths_with_aggregator_and_stop(spark):
    edges = [(i, i + 1) for i in range(12)] + [(0, 6), (3, 99)]
    e = spark.createDataFrame(edges, "src long, to long")
    v = spark.createDataFrame([(i, 0 if i == 0 else None) for i in range(13)], "id long, dist int")

    def compute(df, step, found):
        if step == 1:
            return df.withColumn("active", F.lit(False))
        better = F.col("dist").isNull() | (F.col("m") < F.col("dist"))
        return df.withColumns({"dist": F.least("dist", "m"), "active": F.lit(False), "id": F.when(better, F.col("id")).otherwise(F.col("id"))})

    def send(df, step):
        return df.filter(f"dist = {step - 1}").join(e, df["id"] == e["src"]).select(F.col("to").alias("dst"), (F.col("dist") + 1).alias("m"))

    got = {r.id: r.dist for r in pregel.run(v, compute, send, {"m": F.min("m")}).collect()}
    assert got == {i: min(i, 1 + i - 6 if i >= 6 else i) for i in range(13)}
    seen = []

    def stop(step, found):
        seen.append((step, found["n"]))
        return step == 3

    partial = pregel.run(v, compute, send, {"m": F.min("m")}, {"n": F.count("*")}, stop)
    assert [s for s, _ in seen] == [1, 2, 3] and seen[0][1] == 13 and partial.filter("dist is not null").count() == 5


def test_pregel_runs_until_quiet_or_fails(spark):
    assert inspect.signature(pregel.run).parameters["max_supersteps"].default is None
    v = spark.createDataFrame([(1,)], "id int")
    compute = lambda df, step, found: df.withColumn("active", F.lit(step < 3))
    send = lambda df, step: df.select(F.col("id").alias("dst"), F.lit(1).alias("m")).limit(0)
    assert pregel.run(v, compute, send, {"m": F.min("m")}, max_supersteps=3).count() == 1
    with pytest.raises(RuntimeError, match="after 2 supersteps"):
        pregel.run(v, compute, send, {"m": F.min("m")}, max_supersteps=2)


def test_pregel_phases_and_plain_messages(spark):
    v = spark.createDataFrame([(1, 0), (2, 0)], "id long, n int")

    def compute(df, step, found):
        got = F.size("messages") if "messages" in df.columns else F.lit(0)
        return df.withColumns({"n": F.col("n") + got, "active": F.lit(False)})

    def send(df, step):
        to = F.explode(F.array(F.lit(1), F.lit(2), F.lit(77)).cast("array<long>"))
        return df.select(to.alias("dst"), F.col("id").alias("sender")) if step == 1 else df.select(F.col("id").alias("dst"), F.col("id").alias("sender")).limit(0)

    report = []
    assert {r.id: r.n for r in pregel.run(v, compute, send, phases=3, report=report).collect()} == {1: 6, 2: 6}
    assert sum(n for *_, n in report) == 3 * 6 and {(p, s) for p, s, *_ in report} == {(1, 1), (2, 1), (3, 1)}
    assert {r.id: r.n for r in pregel.run(v, compute, send, phases=lambda number, state: number == 1).collect()} == {1: 2, 2: 2}
