"""What written steps leave behind."""

import os
import time

from pyspark.sql import functions as F

from kinprofile.llm import common


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in folders for _, _, files in os.walk(d.getAbsolutePath()) for f in files if f.startswith("shuffle_")}


def test_a_written_step_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    grouped = spark.range(1000).groupBy((F.col("id") % 7).alias("g")).count()
    out = common.Steps(spark).write(grouped.join(spark.range(7).repartition(3).withColumnRenamed("id", "g"), "g"), "step")
    assert sorted(r["count"] for r in out.collect()) == [142] + [143] * 6
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(common.SHUFFLE_CLEANUP, None) is None
    assert grouped.count() == 7  # a plan whose files went is computed anew
