"""Tables written once in the shared folder, where several later steps read them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession, name: str) -> str:
    """The URI of a folder of its own in the shared folder."""
    setting = "spark.checkpoint.dir"
    root = spark.conf.get(setting, None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"{setting} has to name a folder that all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set(setting, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame) -> DataFrame:
    """df written once in the shared folder and read again, where several later steps read it. Its shuffle files go as soon as it is written."""
    spark, path = df.sparkSession, folder(df.sparkSession, "structure")
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.kept_at = path
    return table


def let_go(*tables: DataFrame) -> None:
    """Deletes tables that ``kept`` gave, when no step reads them any more; others are left alone."""
    for table in tables:
        if path := getattr(table, "kept_at", None):
            context = table.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
