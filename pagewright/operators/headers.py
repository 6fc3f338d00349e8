"""Baseline font size and header levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as t
from .layout import GAP_FACTOR, paragraph_text

NO_SIZE = 12.0
MAX_WORDS = 15
#: Beginnings of a text that is no header: fixed values.
NOT_HEADERS = ("table", "figure", "image", "chart", "graph", "input", "output", "context", "token", "description")


def baseline_sizes(spans: DataFrame) -> DataFrame:
    """(doc_id, baseline): the most frequent font size, to halves (half to even); of equally frequent ones the first met."""
    sized = spans.withColumn("half", F.when(F.col("font_size") > 0, F.bround(F.col("font_size") * 2) / 2))
    counts = sized.groupBy("doc_id", "half").agg(F.count("*").alias("n"), F.min(F.struct("page", "seq")).alias("first"))
    rank = F.when(F.col("half").isNotNull(), F.struct("n", -F.col("first.page"), -F.col("first.seq")))
    return counts.groupBy("doc_id").agg(F.coalesce(F.max_by("half", rank), F.lit(NO_SIZE)).alias("baseline"))


def with_levels(paragraphs: DataFrame, baselines: DataFrame) -> DataFrame:
    """Adds text, is_mono and level (0: no header) to paragraphs (doc_id, page_no, para_no, spans), each seen after the one before it."""
    order = W.partitionBy("doc_id").orderBy("page_no", "para_no")
    spans, first = F.col("spans"), F.col("spans")[0]
    before = F.lag(F.element_at("spans", -1)).over(order)
    df = paragraphs.withColumns({"_before": before, "text": t.strip(paragraph_text(spans)), "is_mono": F.exists(spans, lambda s: s["is_mono"])}).join(baselines, "doc_id", "left")
    spaced = F.coalesce(first["y0"] - F.col("_before.y0") > GAP_FACTOR * (first["font_size"] + F.col("_before.font_size")) / 2, F.lit(False))
    base = F.coalesce("baseline", F.lit(NO_SIZE))
    ratio = F.when(base > 0, F.array_max(spans["font_size"]) / base).otherwise(1.0)
    bold = F.exists(spans, lambda s: s["is_bold"])
    n_bold = F.size(F.filter(spans, lambda s: s["is_bold"]))
    df = df.withColumns({"_ratio": ratio, "_bold": bold, "_spaced": spaced, "_mixed": (n_bold >= 2) & (n_bold < F.size(spans))})
    return df.withColumn("level", header_level(F.col("text"), F.col("_ratio"), F.col("_bold"), F.col("_mixed"), F.col("_before").isNotNull(), F.col("_spaced"))).drop("_before", "_ratio", "_bold", "_spaced", "_mixed", "baseline")


def header_level(text: Column, ratio: Column, bold: Column, mixed: Column, has_before: Column, spaced: Column) -> Column:
    """The level from 1 to 3, or 0. mixed: some bold spans, two at least, and some that are not."""
    words = F.size(F.filter(F.split(text, f"{t.SPACE}+"), lambda w: w != ""))
    excluded = (text == "") | F.lower(text).rlike(rf"\A(?:{'|'.join(NOT_HEADERS)})") | text.rlike("[()]") | mixed | (words > MAX_WORDS)
    demoted = has_before & ~spaced & (ratio < 1.3) & ~(bold & (ratio >= 1.2))
    by_size = F.when((ratio >= 1.5) | (bold & (ratio >= 1.3)), 1).when((ratio >= 1.3) | (bold & (ratio >= 1.15)), 2).when((ratio >= 1.15) | bold, 3).otherwise(0)
    return F.when((by_size == 0) | demoted | excluded, 0).otherwise(by_size)  # patterns last: most texts are no headers by size


def known_headers(levelled: DataFrame) -> DataFrame:
    """(doc_id, header): distinct normalized titles of the header paragraphs that are not code."""
    return levelled.filter("level > 0 and not is_mono").select("doc_id", t.normalize(F.col("text")).alias("header")).filter("header <> ''").distinct()
