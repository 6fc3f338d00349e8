"""PDF files as spans and table boxes, where a PDF library is installed; the rest of the package needs only the spans.

``read_pages`` is a Python data source that cuts a file into ranges of pages by its size, so that a book of thousands of pages is many tasks and no row holds its bytes. How
many pages there are is found out by the tasks: range r of n has the pages from pages * r // n on. Files on a local path are opened there, others are read whole by each of their tasks.
``parse`` is the same for contents that are in a column already.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

BYTES_PER_TASK = 8 << 20  # of a file


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


BOX = ArrayType(DoubleType())
SPAN = _struct(text=StringType(), font=StringType(), size=DoubleType(), flags=IntegerType(), bbox=BOX)
PAGE = _struct(page=IntegerType(), page_height=DoubleType(), blocks=ArrayType(_struct(lines=ArrayType(_struct(spans=ArrayType(SPAN))))), boxes=ArrayType(BOX))
PAGES = StructType([StructField("doc_id", LongType()), *PAGE.fields])
OF_PATH = StructType([StructField("path", StringType()), *PAGE.fields])


def library():
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDF files needs PyMuPDF on the executors") from e
    return fitz


def page_row(number: int, page) -> dict:
    """PAGE of a page: its text blocks, and the boxes of its tables; tables that cannot be found are none."""
    blocks = [{"lines": [{"spans": [{k: list(s[k]) if k == "bbox" else s[k] for k in ("text", "font", "size", "flags", "bbox")} for s in line["spans"]]} for line in b["lines"]]} for b in page.get_text("dict")["blocks"] if "lines" in b]
    try:
        boxes = [list(map(float, table.bbox)) for table in page.find_tables().tables]
    except Exception:  # any failure means no tables
        boxes = []
    return {"page": number, "page_height": float(page.rect.height), "blocks": blocks, "boxes": boxes}


def parse(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """PAGES of PDF contents (doc_id, content); a document is closed whatever happens."""
    fitz = library()
    for batch in files:
        for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
            with fitz.open(stream=content, filetype="pdf") as doc:
                for number, page in enumerate(doc):
                    yield pd.DataFrame([{"doc_id": doc_id} | page_row(number, page)])


@dataclass
class PageRange(InputPartition):
    """Range ``at`` of ``of`` of a file's pages."""

    path: str
    at: int
    of: int


def _store(uri: str):
    """(file system, path) of a path or URI."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else uri
    return fs.FileSystem.from_uri(uri)


class PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.per_task = options["path"], int(options.get("bytespertask", BYTES_PER_TASK))

    def partitions(self) -> list[PageRange]:
        from pyarrow import fs

        store, path = _store(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.path.lower().endswith(".pdf")]
        prefix = "file:" if isinstance(store, fs.LocalFileSystem) else self.path[: self.path.index(path.split("/")[0])]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            ranges = max(1, -(-f.size // self.per_task))
            out += [PageRange(prefix + f.path, r, ranges) for r in range(ranges)]
        return out

    def read(self, part: PageRange) -> Iterator[pa.RecordBatch]:
        fitz, schema = library(), to_arrow_schema(OF_PATH)
        if part.path.startswith("file:"):
            opened = fitz.open(part.path.removeprefix("file:"))
        else:
            store, path = _store(part.path)
            with store.open_input_stream(path) as content:
                opened = fitz.open(stream=io.BytesIO(content.read()).getvalue(), filetype="pdf")
        with opened as doc:
            for number in range(len(doc) * part.at // part.of, len(doc) * (part.at + 1) // part.of):
                yield pa.RecordBatch.from_pylist([{"path": part.path} | page_row(number, doc[number])], schema)


class PdfPages(DataSource):
    """Format ``pdf_pages``: OF_PATH of the file at a path, or of all ``.pdf`` files under it; option bytesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> StructType:
        return OF_PATH

    def reader(self, schema: StructType) -> PdfReader:
        return PdfReader({k.lower(): v for k, v in self.options.items()})


def read_pages(spark: SparkSession, path: str, bytes_per_task: int = BYTES_PER_TASK) -> DataFrame:
    """PAGES of the PDF file at path, or of those under it; doc_id is a hash of the file's path."""
    spark.dataSource.register(PdfPages)
    pages = spark.read.format("pdf_pages").option("bytesPerTask", bytes_per_task).load(path)
    return pages.select(F.xxhash64("path").alias("doc_id"), *PAGE.names)


def table_boxes(pages: DataFrame) -> DataFrame:
    """(doc_id, page, x0, y0, x1, y1)."""
    box = pages.select("doc_id", "page", F.explode("boxes").alias("box"))
    return box.select("doc_id", "page", *(F.col("box")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))
