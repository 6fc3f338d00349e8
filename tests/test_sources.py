import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagewright.plans import structure
from pagewright.operators import layout, markdown
from pagewright.sources import files, pdf
from pagewright.streaming import notes


def test_markdown_files_to_chunk_files(spark, tmp_path):
    (tmp_path / "My book+1.md").write_text("# Á\n" + "wörd " * 60, encoding="utf-8")
    read = files.read_markdown(spark, str(tmp_path))
    row = read.first()
    assert row.chapter_name == "My book+1" and row.markdown.startswith("# Á")
    found = structure.to_chunks(markdown.to_lines(read))
    assert files.export_chunks(found, str(tmp_path / "out.json")) == 1
    text = (tmp_path / "out.json").read_text(encoding="utf-8")
    assert json.loads(text)[0]["section_name"] == "Á" and "wörd" in text
    files.write_chunks(found, str(tmp_path / "chunks"))
    assert spark.read.json(str(tmp_path / "chunks")).count() == 1
    assert files.export_chunks(found.limit(0), str(tmp_path / "none.json")) == 0 and json.loads((tmp_path / "none.json").read_text()) == []
    files.write_markdown(read, str(tmp_path / "texts"))
    assert spark.read.text(str(tmp_path / "texts")).count() == 2
    assert files.count_chars(read).first().n_chars == len(row.markdown)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_markdown(spark, str(tmp_path / "missing"))


def test_output_path(tmp_path):
    now = datetime(2024, 1, 2, 3, 4, 5)
    assert files.output_path(str(tmp_path / "a  b.pdf"), None, now) == str(tmp_path / "out/a_b__extracted__20240102_030405.md") and (tmp_path / "out").is_dir()
    assert files.output_path("x.pdf", str(tmp_path / "deep/er.md")) == str(tmp_path / "deep/er.md") and (tmp_path / "deep").is_dir()


def test_pdf_needs_its_library(spark):
    boxes = spark.createDataFrame([(1, 0, [[1.0, 2.0, 3.0, 4.0]])], "doc_id long, page int, boxes array<array<double>>")
    assert tuple(pdf.table_boxes(boxes).first()) == (1, 0, 1.0, 2.0, 3.0, 4.0)
    try:
        import fitz  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            next(pdf.parse(iter([])))


class Pdf:
    """A stand-in for an open PDF file: two pages, with an image block, blank spans, and a table on the second that cannot be found."""

    closed = 0

    def __init__(self, stream, filetype):
        assert filetype == "pdf"
        if stream == b"broken":
            raise ValueError("no PDF")
        self.stream = stream

    def __enter__(self):
        return self

    def __exit__(self, *error):
        Pdf.closed += 1

    def __iter__(self):
        return iter([Page(self.stream, False), Page(self.stream, True)])


class Page:
    rect = type("Rect", (), {"height": 800})

    def __init__(self, stream, broken):
        self.broken, self.stream = broken, stream

    def get_text(self, kind):
        assert kind == "dict"
        if self.stream == b"unreadable":
            raise OSError("damaged")
        span = lambda text, y, size=10.0, flags=0, x=72.0: {"text": text, "font": "Times", "size": size, "flags": flags, "bbox": (x, y, x + 50.0, y + size), "color": 0}
        return {"blocks": [{"image": b""}, {"lines": [{"spans": [span("Big Title", 50.0, 18.0, 16)]}]}, {"lines": [{"spans": [span(" ", 90.0), span("some text", 100.0), span("goes on.", 100.0, x=150.0)]}, {"spans": [span("in the table", 205.0)]}]}]}

    def find_tables(self):
        if self.broken:
            raise RuntimeError("none")
        return type("Tables", (), {"tables": [type("Table", (), {"bbox": (0, 200, 500, 230)})]})


def test_pdf_pages_with_a_stand_in_library(spark, monkeypatch):
    import sys
    import types

    import pandas as pd

    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(open=Pdf))
    files_ = pd.DataFrame({"doc_id": [1, 2], "content": [b"a", b"b"]})
    pages = pd.concat(pdf.parse(iter([files_])))
    assert pages[["doc_id", "page", "page_height"]].values.tolist() == [[1, 0, 800.0], [1, 1, 800.0], [2, 0, 800.0], [2, 1, 800.0]] and Pdf.closed == 2
    assert pages.boxes.tolist() == [[[0.0, 200.0, 500.0, 230.0]], [], [[0.0, 200.0, 500.0, 230.0]], []]
    for content, error in ((b"unreadable", OSError), (b"broken", ValueError)):
        with pytest.raises(error):
            list(pdf.parse(iter([pd.DataFrame({"doc_id": [3], "content": [content]})])))
    assert Pdf.closed == 3
    table = spark.createDataFrame(pages.to_dict("records"), pdf.PAGES)
    spans = layout.flatten_blocks(table)
    assert [(r.seq, r.text, r.font_size, r.x0) for r in spans.filter("doc_id = 1 and page = 0").orderBy("seq").collect()] == [(0, "Big Title", 18.0, 72.0), (1, "some text", 10.0, 72.0), (2, "goes on.", 10.0, 150.0), (3, "in the table", 10.0, 72.0)]
    text = {r.doc_id: r.markdown for r in structure.to_markdown(spans, pdf.table_boxes(table)).collect()}
    assert text[1] == text[2] == "# Big Title\n\nsome text goes on.\n\n# Big Title\n\nsome text goes on.\n\nin the table"  # in its box on the first page alone


STAND_IN = '''
"""A stand-in for the PDF library: a file is JSON, a list of pages [height, title, body, box or null]; blanks pad it to a size."""
import json


class Page:
    def __init__(self, height, title, body, box):
        self.rect, self.title, self.body, self.box = type("Rect", (), {"height": height}), title, body, box

    def get_text(self, kind):
        span = lambda text, y, size, flags=0: {"text": text, "font": "Times", "size": size, "flags": flags, "bbox": (72.0, y, 200.0, y + size), "color": 0}
        lines = [{"spans": [span(self.title, 50.0, 18.0, 16)]}] if self.title else []
        return {"blocks": [{"image": b""}, {"lines": lines}, {"lines": [{"spans": [span(x, 100.0 + 40 * i, 10.0)]} for i, x in enumerate(self.body)]}]}

    def find_tables(self):
        if self.box is None:
            raise RuntimeError("none")
        return type("Tables", (), {"tables": [type("Table", (), {"bbox": self.box})]})


class Document:
    def __init__(self, data):
        self.pages = [Page(*p) for p in json.loads(data)]

    def __enter__(self):
        return self

    def __exit__(self, *error):
        pass

    def __len__(self):
        return len(self.pages)

    def __getitem__(self, i):
        return self.pages[i]


def open(path=None, stream=None, filetype=None):
    if stream is None:
        with __builtins__["open"](path, "rb") as f:
            stream = f.read()
    return Document(stream)
'''


@pytest.fixture
def pdf_library(spark, tmp_path):
    """The stand-in where Python workers import it from."""
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib/fitz.py").write_text(STAND_IN)
    environment, before = spark.sparkContext.environment, os.environ["PYTHONPATH"]
    kept = environment.get("PYTHONPATH")
    environment["PYTHONPATH"] = os.environ["PYTHONPATH"] = f"{tmp_path / 'lib'}{os.pathsep}{before}"
    yield
    os.environ["PYTHONPATH"] = before
    if kept is None:
        environment.pop("PYTHONPATH")
    else:
        environment["PYTHONPATH"] = kept


def book(pages, size=0):
    return json.dumps(pages).ljust(size)


def test_page_ranges_give_the_whole_file(spark, tmp_path, pdf_library):
    pages = [[800 + i, f"Title {i}" if i % 5 == 0 else "", [f"line {i}.", "in the table", ""], [0, 130, 500, 160] if i % 2 else None] for i in range(23)]
    folder = tmp_path / "books"
    (folder / "more").mkdir(parents=True)
    (folder / "A long book.pdf").write_text(book(pages, 10_000))
    (folder / "more/short.PDF").write_text(book(pages[:1]))
    (folder / "more/empty.pdf").write_text("[]")
    (folder / "notes.txt").write_text("no PDF")
    whole = pdf.read_pages(spark, str(folder))
    cut = pdf.read_pages(spark, str(folder), bytes_per_task=1000)
    assert cut.rdd.getNumPartitions() == 10 + 1 + 1 and whole.rdd.getNumPartitions() == 3
    rows = lambda df: sorted(repr(r) for r in df.collect())
    assert rows(cut) == rows(whole) and whole.count() == 24
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(str(folder)).select(F.xxhash64("path").alias("doc_id"), "content")
    assert rows(contents.mapInPandas(pdf.parse, pdf.PAGES)) == rows(whole)
    one = pdf.read_pages(spark, str(folder / "A long book.pdf"), bytes_per_task=10)  # more ranges than pages
    assert [r.page for r in one.select("page").orderBy("page").collect()] == list(range(23))
    assert pdf.table_boxes(one).count() == 11
    with pytest.raises(Exception, match="FileNotFoundError"):
        pdf.read_pages(spark, str(tmp_path / "missing.pdf")).count()


def test_extract_command(spark, tmp_path, pdf_library):
    """A PDF file to a Markdown file by the command line."""
    from pagewright import cli

    pages = [[800, "Big Title", ["Some text that ends-", "goes away"], [0, 130, 500, 160]], [800, "", ["here on the next page."], None]]
    (tmp_path / "My book.pdf").write_text(book(pages))
    logs = tmp_path / "logs"
    assert cli.main(["extract", str(tmp_path / "My book.pdf"), "--output", str(tmp_path / "deep/out.md"), "--log-dir", str(logs)]) == 0
    assert (tmp_path / "deep/out.md").read_text() == "# Big Title\n\nSome text that endshere on the next page."
    assert "written to" in (logs / "processing/extract.log").read_text() and (logs / "errors/extract.log").read_text() == ""
    assert cli.main(["extract", str(tmp_path / "My book.pdf"), "--log-dir", str(logs)]) == 0
    made = list((tmp_path / "out").glob("My_book__extracted__*.md"))
    assert len(made) == 1 and made[0].read_text().startswith("# Big Title")
    assert cli.main(["extract", str(tmp_path / "none.pdf"), "--log-dir", str(logs)]) == 1
    assert "failed" in (logs / "errors/extract.log").read_text()


def test_note_stream(spark, tmp_path):
    folder = tmp_path / "vault"
    folder.mkdir()
    (folder / "a.md").write_text("---\ntags: [x]\n---\nBody #study")
    (folder / "b.md").write_text("no tag, #studying")
    stream = notes.to_study(notes.parsed(notes.watch(spark, str(folder))))
    query = stream.writeStream.format("memory").queryName("studied").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    row = spark.table("studied").first()
    assert spark.table("studied").count() == 1 and row.front_matter == "tags: [x]" and row.body == "Body #study"


def test_timestamp(spark):
    assert spark.range(1).select(files.timestamp(F.lit("2024-01-02 03:04:05").cast("timestamp"))).first()[0] == "20240102_030405"


def test_command_line(spark, tmp_path):
    from pagewright import cli

    (tmp_path / "ch1.md").write_text("# A\n" + "word " * 300)
    logs = str(tmp_path / "logs" / "run.log")
    assert cli.main(["chunk", str(tmp_path / "ch1.md"), "--book-title", "B", "--log-file", logs]) == 0
    made = json.loads((tmp_path / "ch1.json").read_text())
    assert [c["chunk_index"] for c in made] == [0, 1] and made[0]["chapter_name"] == "ch1" and made[0]["book_title"] == "B" and list(made[0]) == ["chunk_index", "content", "book_title", "chapter_name", "section_name", "metadata"]
    assert cli.main(["chunk", str(tmp_path / "none.md"), "--log-file", logs]) == 1
    assert cli.main(["chunk", str(tmp_path / "ch1.md"), "--overlap", "2000", "--log-file", logs]) == 1
    assert "failed" in (tmp_path / "logs" / "run.log").read_text()
