"""A folder of notes as a stream: those marked for study, each version once (declared by the reference, not built there)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming (path, content) of whole text files as they come."""
    return spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def parsed(notes: DataFrame) -> DataFrame:
    """Adds front_matter, body and digest."""
    matter = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?"
    return notes.withColumns({"front_matter": F.regexp_extract("content", matter, 1), "body": F.regexp_replace("content", matter, ""), "digest": F.sha2("content", 256)})


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the whole text files that there are now, for ``changes.Changes.apply`` with ``complete``."""
    return spark.read.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def marked(notes: DataFrame, tag: str = "study") -> DataFrame:
    """Notes that bear the tag."""
    return notes.filter(F.col("content").rlike(rf"(?m)(^|\s)#{tag}\b"))


def to_study(notes: DataFrame, tag: str = "study") -> DataFrame:
    """Streaming: versions of notes that bear the tag, each once; state grows with the versions seen. ``changes`` keeps the last version alone."""
    return marked(notes, tag).dropDuplicates(["path", "digest"])
