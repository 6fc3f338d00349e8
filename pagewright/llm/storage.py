"""Shared folders: where tasks put files that other executors and the driver read."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from urllib.parse import unquote, urlparse

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and one machine runs all (as in tests), one of our own."""
    if _scratch:
        return _scratch[-1][0]
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{SETTING} has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set(SETTING, root)
    return root.rstrip("/")


_scratch: list[tuple[str, list[Broadcast]]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written and values broadcast meanwhile are deleted at the end. Gives a function that writes a table for longer."""
    outer = shared_root(spark)
    folder, broadcasts = f"{outer}/scratch-{uuid.uuid4().hex[:12]}", []
    _scratch.append((folder, broadcasts))
    try:
        yield lambda df, name: written(df, name, outer)
    finally:
        _scratch.pop()
        for value in broadcasts:
            value.destroy()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast(spark: SparkSession, value) -> Broadcast:
    shared = spark.sparkContext.broadcast(value)
    if _scratch:
        _scratch[-1][1].append(shared)
    return shared


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of a folder of its own under the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def new_file_folder(spark: SparkSession, name: str) -> str:
    """A folder that exists, for files that tasks put; readable while it has none."""
    folder = new_folder(spark, name)
    put(folder, "_started", 0, b"")
    return folder


def written(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder (or under root) and read again: cuts lineage, survives lost executors.

    Its shuffle files go as soon as it is written; else they stay until the driver happens to collect its garbage, and add up over the steps.
    """
    spark = df.sparkSession
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}" if root else new_folder(spark, name)
    with setting(spark, SHUFFLES_GO, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """A session setting that holds for what is written meanwhile."""
    before = spark.conf.get(name)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def put(folder: str, name: str, attempt: int, data) -> None:
    """Puts a file in place whole: under a temporary name of this attempt first, then renamed.

    data: bytes or a list of bytes. Attempts of one task write the same bytes, so whichever is last may win.
    """
    pieces = data if isinstance(data, list) else [data]
    temporary = f"_{name}.{attempt}.tmp"
    if (path := _local(folder)) is not None:
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{temporary}", "wb") as out:
            out.writelines(pieces)
            out.flush()
            os.fsync(out.fileno())
        os.replace(f"{path}/{temporary}", f"{path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{temporary}") as out:
        for piece in pieces:
            out.write(piece)
    with suppress(FileNotFoundError):
        store.delete_file(f"{path}/{name}")
    store.move(f"{path}/{temporary}", f"{path}/{name}")
