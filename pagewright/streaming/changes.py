"""Diff-only processing: of the notes that come, those that differ from what was last seen of them go on, deletions too.

What was last seen is a table of digests in versions: ``<root>/delta=<v>`` has the (path, digest, deleted) that version v changed, ``<root>/base=<v>`` all that stood after version v.
A version counts once it is whole (Spark's _SUCCESS). Changes of version v are worked out from the versions before v alone and
replace what an earlier try of v left, so a version that is done again gives the same changes, and a note that goes back to an earlier text is a change again.
``compact`` puts versions together, so that the table grows with the notes and not with their history.

As a stream: ``Changes.sink(...)`` for ``foreachBatch``, whose batch ids are the versions.

Defined results: of several rows of a path in one version the last by ``order`` counts, of equals the one of largest digest; a null content is a deletion; a deletion of what is not there is none; rows
without a path are passed over; an empty version is a version; with ``complete`` rows are all notes that there are, and paths that are missing are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

STATE = "path string, digest string, version long, deleted boolean"


class Changes:
    """The digest table under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, kind: str = "delta") -> list[int]:
        """Whole versions of a kind, ascending."""
        path, files = self._files()
        if not files.exists(path(self.root)):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path(self.root))]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}=") and files.exists(path(f"{self.root}/{n}/_SUCCESS")))

    def _read(self, kind: str, versions: list[int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(*(f"{self.root}/{kind}={v}" for v in versions))

    def before(self, version: int) -> DataFrame:
        """(path, digest, version, deleted) as it stood before a version: the last of each path, from the last base and the deltas since."""
        bases = [v for v in self.versions("base") if v < version]
        since = bases[-1] if bases else -1
        rows = self._read("base", bases[-1:]).unionByName(self._read("delta", [v for v in self.versions() if since < v < version]))
        last = rows.groupBy("path").agg(F.max_by(F.struct("digest", "version", "deleted"), "version").alias("last"))
        return last.select("path", "last.*")

    def apply(self, notes: DataFrame, version: int, order: str | None = None, complete: bool = False) -> DataFrame:
        """notes (path, content, ...) that changed since the versions before ``version``, with digest, change (insert, update, delete) and version; the version is written.

        Rows of deletions have nulls in the other columns of notes.
        """
        bases = self.versions("base")
        if bases and version <= bases[-1]:
            raise ValueError(f"version {version} is in base {bases[-1]} already")
        digested = notes.filter("path is not null").withColumn("_digest", F.sha2("content", 256))
        ranked = F.struct(*([F.col(order)] if order else []), "_digest")
        latest = digested.groupBy("path").agg(F.max_by("_digest", ranked).alias("digest"))  # contents are not shuffled for this
        seen = self.before(version).filter("not deleted").select(F.col("path").alias("_path"), F.col("digest").alias("_before"))
        both = latest.join(seen, F.col("path") == F.col("_path"), "full" if complete else "left")
        change = F.when(F.col("digest").isNull(), F.when(F.col("_before").isNotNull(), "delete")).when(F.col("_before").isNull(), "insert").when(F.col("_before") != F.col("digest"), "update")
        changed = both.select(F.coalesce("path", "_path").alias("path"), "digest", F.lit(version).cast("long").alias("version"), change.alias("change")).filter("change is not null")
        changed.withColumn("deleted", F.col("change") == "delete").write.mode("overwrite").parquet(f"{self.root}/delta={version}")

        delta = self.changed(version)
        here = delta.filter("not deleted").select(F.col("path").alias("_path"), F.col("digest").alias("_changed"))
        met = digested.join(here, (F.col("path") == F.col("_path")) & (F.col("_digest") == F.col("_changed")), "left_semi")
        others = [c for c in notes.columns if c not in ("path", "digest", "change", "version")]
        contents = met.groupBy("path").agg(F.max_by(F.struct(*others), ranked).alias("_note"))
        return delta.join(contents, "path", "left").select("path", *(F.col(f"_note.{c}").alias(c) for c in others), "digest", "change", "version")

    def changed(self, version: int) -> DataFrame:
        """(path, digest, version, deleted, change) that a version changed."""
        return self.spark.read.schema(f"{STATE}, change string").parquet(f"{self.root}/delta={version}")

    def sink(self, process: Callable[[DataFrame, int], None], order: str | None = None, complete: bool = False) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: ``process`` gets the changes and the batch id, again with the same rows if a batch is done again."""

        def batch(notes: DataFrame, version: int) -> None:
            process(self.apply(notes, version, order, complete), version)

        return batch

    def compact(self, version: int) -> None:
        """Puts all up to a version in its base, without what is deleted, and drops what the base stands for. That version and those before it can't be done again after that."""
        path, files = self._files()
        self.before(version + 1).filter("not deleted").write.mode("overwrite").parquet(f"{self.root}/base={version}")
        for kind, last in (("delta", version), ("base", version - 1)):
            for v in self.versions(kind):
                if v <= last:
                    files.delete(path(f"{self.root}/{kind}={v}"), True)
