"""Command line: ``extract`` a PDF to Markdown, ``chunk`` Markdown to JSON. Exit code 1 on failure; logs go to the console and to files."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession

from .operators import chunk as chunk_ops, layout, markdown
from .plans import structure
from .sources import files, pdf

log = logging.getLogger("pagewright")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pagewright")
    commands = top.add_subparsers(dest="command", required=True)
    extract = commands.add_parser("extract", help="a PDF file to Markdown")
    extract.add_argument("pdf_path")
    extract.add_argument("--output", "-o")
    extract.add_argument("--log-dir", default="logs")
    chunk = commands.add_parser("chunk", help="a Markdown file to a JSON array of chunks")
    chunk.add_argument("input", type=Path)
    chunk.add_argument("--book-title")
    for name, default in (("--chunk-size", 1000), ("--overlap", 150), ("--min-size", 100)):
        chunk.add_argument(name, type=int, default=default)
    chunk.add_argument("--output", "-o", type=Path)
    chunk.add_argument("--log-file", default="ingestion.log")
    return top


def set_up_logs(*targets: tuple[Path, int]) -> None:
    """Console from INFO on, and each file from its level on."""
    log.setLevel(logging.DEBUG)
    log.handlers.clear()
    console = logging.StreamHandler(sys.stdout)
    console.setLevel(logging.INFO)
    handlers = [console]
    for path, level in targets:
        path.parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(path, encoding="utf-8"))
        handlers[-1].setLevel(level)
    for handler in handlers:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)


def only_text(df: DataFrame) -> str:
    """The Markdown of a table of one document."""
    row = df.select("markdown").first()
    return row["markdown"] if row else ""


def extract(spark: SparkSession, args: argparse.Namespace) -> None:
    pages = structure.kept(pdf.read_pages(spark, args.pdf_path))  # files are parsed once, for spans and for boxes
    text = only_text(structure.to_markdown(layout.flatten_blocks(pages), pdf.table_boxes(pages)))
    log.info("%d characters", len(text))
    target = files.output_path(args.pdf_path, args.output)
    Path(target).write_text(text, encoding="utf-8")
    log.info("written to %s", target)


def chunk(spark: SparkSession, args: argparse.Namespace) -> None:
    if not args.input.is_file():
        raise FileNotFoundError(args.input)
    read = files.read_markdown(spark, str(args.input))
    options = chunk_ops.ChunkOptions(args.chunk_size, args.overlap, args.min_size)
    counts = Observation()
    found = structure.kept(structure.to_chunks(markdown.to_lines(read), options, book_title=args.book_title, chapter_name=args.input.stem, observation=counts))
    target = args.output or args.input.with_suffix(".json")
    log.info("%d sections, %d characters in chunks", counts.get["sections"], counts.get["characters"])
    if counts.get["thin_chunks"]:
        log.warning("%d chunks of fewer than %d characters dropped, %d characters in all", counts.get["thin_chunks"], args.min_size, counts.get["thin_characters"])
    log.info("%d chunks written to %s", files.export_chunks(found, str(target)), target)


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    if args.command == "extract":
        set_up_logs((Path(args.log_dir) / "processing" / "extract.log", logging.DEBUG), (Path(args.log_dir) / "errors" / "extract.log", logging.ERROR))
    else:
        set_up_logs((Path(args.log_file), logging.DEBUG))
    try:
        {"extract": extract, "chunk": chunk}[args.command](SparkSession.builder.getOrCreate(), args)
    except Exception as e:
        log.error("%s failed: %s", args.command, e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
