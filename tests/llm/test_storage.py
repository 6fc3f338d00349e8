import time

import pytest
from pyspark.sql import functions as F

from pagewright.llm import storage


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f for f in files if "/shuffle_" in f}


@pytest.mark.parametrize("write", [lambda df: storage.written(df, "counts")])
def test_shuffle_files_go_with_the_write(spark, write):
    before = shuffle_files(spark)
    counts = spark.range(20000).repartition(3, "id").groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    found = write(counts)
    until = time.time() + 5
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left
    assert {(r.k, r.n) for r in found.collect()} == {(k, 200) for k in range(100)}
