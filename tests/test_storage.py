import time

from pyspark.sql import functions as F

from helixframe.storage import drop, stage


def test_staged_tables_leave_no_shuffle_files(spark):
    def files():
        return len(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().toList().mkString("\n").split("shuffle_")) - 1

    was, before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled"), files()
    made = [stage(spark.range(5000).repartition(7).groupBy((F.col("id") % 100).alias("g")).count(), "counts") for _ in range(3)]
    for _ in range(50):  # files go in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert [m.count() for m in made] == [100] * 3
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == was
    drop(*made)
