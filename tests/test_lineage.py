import glob
import os

from pyspark.sql import functions as F

from siftwork.plans import lineage


def shuffle_files(spark):
    jvm = spark.sparkContext._jvm
    dirs = [str(d) for d in jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return {f for d in dirs for f in glob.glob(os.path.join(d, "*", "shuffle_*"))}


def test_a_cut_leaves_no_shuffle_files_and_the_setting_as_it_was(spark):
    counted = lambda: spark.range(10_000).repartition(7).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    before = shuffle_files(spark)
    table = lineage.cut(counted(), "test")
    assert shuffle_files(spark) <= before
    assert spark.conf.get(lineage.CLEANUP) == "false"
    assert table.count() == 100 and table.agg(F.sum("n")).first()[0] == 10_000
    lineage.drop(table)
