"""Files in and out: Markdown texts, Markdown and chunk files, names of outputs."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F



def stem(path: Column) -> Column:
    """The file name of a path without its last extension; escapes of URIs are undone."""
    name = F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(name, r"(?s)(.)\.[^.]*\z", "$1")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, chapter_name, markdown) of UTF-8 files; chapter_name is the file's stem, doc_id a hash of its path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markdown"))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", stem(F.col("path")).alias("chapter_name"), "markdown")


def timestamp(now: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if now is None else now, "yyyyMMdd_HHmmss")


def output_path(source: str, output: str | None = None, now: datetime | None = None) -> str:
    """The given output, or <folder>/out/<stem with underscores for white space>__extracted__<time>.md; its folder is made."""
    if not output:
        path = Path(source)
        name = "_".join(path.stem.split()) if path.stem.strip() == path.stem else "_".join(["", *path.stem.split()])
        output = str(path.parent / "out" / f"{name}__extracted__{(now or datetime.now()):%Y%m%d_%H%M%S}.md")
    Path(output).parent.mkdir(parents=True, exist_ok=True)
    return output


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines, a file a partition."""
    chunks.write.mode("overwrite").json(path)


def export_chunks(chunks: DataFrame, path: str) -> int:
    """One JSON array for one document's chunks, streamed row by row; gives their number."""
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for n, row in enumerate(chunks.orderBy("doc_id", "chunk_index").toLocalIterator(), 1):
            fields = {k: v for k, v in row.asDict(True).items() if k != "doc_id"}
            out.write(",\n" * (n > 1) + ("\n" if n == 1 else "") + "\n".join("  " + x for x in json.dumps(fields, indent=2, ensure_ascii=False).split("\n")))
        out.write("\n]" if n else "]")
    return n


def write_markdown(documents: DataFrame, path: str) -> None:
    """A folder of text files partitioned by document."""
    documents.select("doc_id", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def count_chars(documents: DataFrame, text: str = "markdown") -> DataFrame:
    return documents.select("doc_id", F.length(text).cast("long").alias("n_chars"))
