"""The chains of operators: spans to Markdown, Markdown to chunks.

A step's table goes when the next one is kept, and a step shuffles its rows once, so that disk holds two tables and one shuffle at most. The tables that a result is
read from stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as t
from ..operators import chunk, clean, headers, layout, markdown, merge
from ..operators.store import folder, kept, let_go  # noqa: F401


def to_paragraphs(spans: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paragraphs in reading order, baseline font sizes)."""
    inside = kept(layout.outside_tables(layout.with_font_flags(spans), tables))
    baselines = kept(headers.baseline_sizes(inside))
    of_document = inside.repartition("doc_id")  # as all steps to paragraphs need them
    paragraphs = kept(layout.paragraphs(layout.paragraph_numbers(layout.reading_order(of_document))))
    let_go(inside)
    return paragraphs, baselines


def to_joined(spans: DataFrame, tables: DataFrame, compat: bool = True) -> tuple[DataFrame, DataFrame]:
    """(paragraphs without running headers and captions, joined over pages; baseline font sizes)."""
    paragraphs, baselines = to_paragraphs(spans, tables)
    known = kept(headers.known_headers(headers.with_levels(paragraphs, baselines)))
    cleaned = kept(clean.drop_captions(clean.drop_running_headers(paragraphs, known, compat), compat))
    let_go(paragraphs, known)
    joined = kept(merge.join_pages(cleaned))
    let_go(cleaned)
    return joined, baselines


def levelled(joined: DataFrame, baselines: DataFrame) -> DataFrame:
    return headers.with_levels(joined.filter(t.strip(layout.paragraph_text(joined["spans"])) != ""), baselines)


def to_levelled(spans: DataFrame, tables: DataFrame, compat: bool = True) -> DataFrame:
    """Paragraphs without running headers and captions, joined over pages, with header levels; empty ones are left out. compat: see ``operators.clean``."""
    return levelled(*to_joined(spans, tables, compat))


def to_emitted(spans: DataFrame, tables: DataFrame) -> DataFrame:
    """What ``to_lines`` reads of the levelled paragraphs, kept: spans of code, text of all else."""
    joined, baselines = to_joined(spans, tables)
    mono = F.col("is_mono")
    found = kept(levelled(joined, baselines).select("doc_id", "page_no", "para_no", "is_mono", "level", F.when(mono, F.col("spans")).alias("spans"), F.when(~mono, F.col("text")).alias("text")))
    let_go(joined, baselines)
    return found


def to_lines(levelled: DataFrame) -> DataFrame:
    """Clean Markdown lines (doc_id, line_no, line)."""
    return cleaned_lines(kept(markdown.to_lines(markdown.emit(levelled))))


def cleaned_lines(lines: DataFrame) -> DataFrame:
    """Markdown lines after the passes over them; a kept table of lines goes."""
    repeated = kept(markdown.drop_repeated_headers(lines))
    let_go(lines)
    return markdown.drop_numbered(markdown.drop_page_number(repeated))


def to_markdown(spans: DataFrame, tables: DataFrame, compat: bool = True) -> DataFrame:
    """(doc_id, markdown)."""
    joined, baselines = to_joined(spans, tables, compat)
    lines = kept(markdown.to_lines(markdown.emit(levelled(joined, baselines))))
    let_go(joined, baselines)
    return markdown.to_text(cleaned_lines(lines))


def to_chunks(lines: DataFrame, options: chunk.ChunkOptions = chunk.ChunkOptions(), **names) -> DataFrame:
    return chunk.chunks(chunk.sections(lines), options, **names)
