"""Intermediate tables and what their writing leaves on disk."""

import time

from pyspark.sql import functions as F

from gaugewell.sources.shared import materialise

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for i in range(blocks.size()) if (name := blocks.apply(i).name()).startswith("shuffle_")}


def test_shuffle_files_go_with_the_write(spark):
    before, setting = shuffle_files(spark), spark.conf.get(_CLEANUP)
    rows = spark.range(20_000).withColumn("k", F.col("id") % 100)
    sums = rows.repartition("k").groupBy("k").agg(F.sum("id").alias("s"))
    kept = materialise(rows.join(sums.hint("merge"), "k"), "test")
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(_CLEANUP) == setting
    # what was written, and the plan it came from, can still be read
    assert kept.count() == 20_000 and sums.count() == 100 and rows.join(sums, "k").count() == 20_000
