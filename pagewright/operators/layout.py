"""Spans to reading order and paragraphs.

Spans: doc_id, page, seq, text, font, font_size, x0, y0, x1, y1, page_height, flags; seq is the order of extraction on a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as t

LINE_TOLERANCE = 3.0
GAP_FACTOR = 1.5
READING = ("line_no", "x0", "y0", "seq")
FIELDS = ("text", "font_size", "y0", "is_bold", "is_mono")


def flatten_blocks(pages: DataFrame) -> DataFrame:
    """Spans of pages (doc_id, page, page_height, blocks nested as block > lines > spans); images and blank spans fall away."""
    lines = pages.select("doc_id", "page", "page_height", F.posexplode("blocks").alias("b", "block")).select("doc_id", "page", "page_height", "b", F.posexplode("block.lines").alias("l", "line"))
    spans = lines.select("doc_id", "page", "page_height", "b", "l", F.posexplode("line.spans").alias("s", "span")).withColumn("text", t.strip(F.col("span.text"))).filter("text <> ''")
    order = W.partitionBy("doc_id", "page").orderBy("b", "l", "s")
    box = [F.col("span.bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return spans.select("doc_id", "page", (F.row_number().over(order) - 1).alias("seq"), "text", F.coalesce("span.font", F.lit("")).alias("font"), F.coalesce("span.size", F.lit(0.0)).alias("font_size"), *box, "page_height", F.coalesce("span.flags", F.lit(0)).alias("flags"))


def with_font_flags(spans: DataFrame) -> DataFrame:
    """Adds is_bold (flag 16 or the font's name) and is_mono (the font's name)."""
    font = F.lower(F.coalesce("font", F.lit("")))
    bold = (F.coalesce("flags", F.lit(0)).bitwiseAND(16) != 0) | F.contains(font, F.lit("bold"))
    return spans.withColumns({"is_bold": bold, "is_mono": font.rlike(t.MONO_FONT)})


def outside_tables(spans: DataFrame, tables: DataFrame) -> DataFrame:
    """Spans whose centre lies in no table box (doc_id, page, x0, y0, x1, y1) of their page."""
    s, b = spans.alias("s"), tables.alias("b")
    inside = ((F.col("s.x0") + F.col("s.x1")) / 2).between(F.col("b.x0"), F.col("b.x1")) & ((F.col("s.y0") + F.col("s.y1")) / 2).between(F.col("b.y0"), F.col("b.y1"))
    return s.join(b, (F.col("s.doc_id") == F.col("b.doc_id")) & (F.col("s.page") == F.col("b.page")) & inside, "left_anti")


def reading_order(spans: DataFrame) -> DataFrame:
    """Adds line_no: going down the page, a span joins the line whose first span is at most LINE_TOLERANCE higher."""
    others = [c for c in spans.columns if c not in ("doc_id", "page", "y0", "seq")]
    pages = spans.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("y0", "seq", *others))).alias("spans"))
    begin = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("line"), F.array().cast("array<int>").alias("lines"))

    def step(acc: Column, s: Column) -> Column:
        same = F.coalesce(F.abs(s["y0"] - acc["anchor"]) <= LINE_TOLERANCE, F.lit(False))
        line = F.when(same, acc["line"]).otherwise(acc["line"] + 1)
        return F.struct(F.when(same, acc["anchor"]).otherwise(s["y0"]).alias("anchor"), line.alias("line"), F.concat(acc["lines"], F.array(line)).alias("lines"))

    lines = F.aggregate("spans", begin, step, lambda acc: acc["lines"])
    return pages.select("doc_id", "page", "spans", lines.alias("lines")).select("doc_id", "page", F.inline(F.arrays_zip("spans", "lines"))).select("doc_id", "page", "spans.*", F.col("lines").alias("line_no")).select(*spans.columns, "line_no")


def paragraph_numbers(ordered: DataFrame) -> DataFrame:
    """Adds para_no: a paragraph ends where the step down is over GAP_FACTOR times the mean font size."""
    order = W.partitionBy("doc_id", "page").orderBy(*READING)
    gap = F.col("y0") - F.lag("y0").over(order)
    far = gap > GAP_FACTOR * (F.col("font_size") + F.lag("font_size").over(order)) / 2
    marked = ordered.withColumn("_break", F.coalesce(far, F.lit(False)).cast("int"))
    return marked.withColumn("para_no", F.sum("_break").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_break")


def paragraphs(numbered: DataFrame) -> DataFrame:
    """(doc_id, page_no, para_no, spans): spans in reading order; pages with paragraphs are numbered without gaps."""
    spans = numbered.groupBy("doc_id", "page", "para_no").agg(F.sort_array(F.collect_list(F.struct(*READING, *(c for c in FIELDS if c not in READING)))).alias("spans"))
    fields = ", ".join(f"'{c}', s.{c}" for c in FIELDS)
    spans = spans.withColumn("spans", F.expr(f"transform(spans, s -> named_struct({fields}))"))
    page_no = F.dense_rank().over(W.partitionBy("doc_id").orderBy("page")) - 1
    return spans.select("doc_id", page_no.alias("page_no"), "para_no", "spans")


def paragraph_text(spans: Column) -> Column:
    return F.array_join(spans["text"], " ")
