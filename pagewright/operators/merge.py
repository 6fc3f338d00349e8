"""Paragraphs that go on over a page break."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as t
from .layout import FIELDS, paragraph_text


def page_joins(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, page_no, joins) of each page that has paragraphs: whether its last goes on in the first of the next page.

    A paragraph that ends with a hyphen or without an end of sentence goes on. One that has just been joined is done, so in a run of
    pages with one open paragraph each every second page joins.
    """
    text = paragraph_text(F.col("spans"))
    open_ = t.ends_with_hyphen(text) | ~t.ends_sentence(text)
    pages = paragraphs.select("doc_id", "page_no", "para_no", open_.alias("open")).groupBy("doc_id", "page_no").agg(F.count("*").alias("n"), F.max_by("open", "para_no").alias("open"))
    order = W.partitionBy("doc_id").orderBy("page_no")
    pages = pages.withColumn("able", F.col("open") & F.coalesce(F.lead("page_no").over(order) == F.col("page_no") + 1, F.lit(False)))
    chained = F.col("able") & (F.col("n") == 1) & F.coalesce(F.lag("able").over(order), F.lit(False))
    pages = pages.withColumn("island", F.sum(F.when(chained, 0).otherwise(1)).over(order))
    place = F.row_number().over(W.partitionBy("doc_id", "island").orderBy("page_no"))
    return pages.select("doc_id", "page_no", (F.col("able") & (place % 2 == 1)).alias("joins"))


def join_pages(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with those that go on joined; a hyphen at the break goes, and the two spans around it become one."""
    after = page_joins(paragraphs).filter("joins").select("doc_id", (F.col("page_no") + 1).alias("page_no"), F.lit(True).alias("_joined"))
    in_page, in_doc = W.partitionBy("doc_id", "page_no").orderBy("para_no"), W.partitionBy("doc_id").orderBy("page_no", "para_no")
    # marks go in before the first paragraph of their page, so that paragraphs are shuffled once, by document
    both = paragraphs.unionByName(after, allowMissingColumns=True).repartition("doc_id")
    df = both.withColumn("_goes_back", F.coalesce(F.lag("_joined").over(in_page), F.lit(False))).filter("_joined is null")
    df = df.withColumn("_next", F.when(F.lead("_goes_back").over(in_doc), F.lead("spans").over(in_doc)))
    last, first = F.element_at("spans", -1), F.col("_next")[0]
    text = t.replaced(last["text"], rf"{t.SPACE}*-{t.SPACE}*\z")
    fused = F.struct(F.concat(text, t.replaced(first["text"], rf"\A{t.SPACE}+")).alias("text"), *(last[c].alias(c) for c in FIELDS if c != "text"))
    hyphened = F.concat(F.slice("spans", F.lit(1), F.size("spans") - 1), F.array(fused), F.slice("_next", F.lit(2), F.size("_next")))
    spans = F.when(F.col("_next").isNull(), F.col("spans")).when(t.ends_with_hyphen(last["text"]), hyphened).otherwise(F.concat("spans", "_next"))
    return df.withColumn("spans", spans).filter("not _goes_back").select(*paragraphs.columns)
