"""Table captions, and running headers and footers of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as t
from .layout import FIELDS, paragraph_text

KEY = 8  # characters of a title that it is met by


def with_first_text(spans: Column, text: Column, compat: bool = True) -> Column:
    """spans with the text of the first replaced; the others keep theirs, so that their text is there twice, or go if not ``compat``."""
    rest = [F.col("spans")[0][c].alias(c) for c in FIELDS if c != "text"]
    first = F.array(F.struct(text.alias("text"), *rest))
    return F.concat(first, F.slice(spans, F.lit(2), F.size(spans))) if compat else first


def drop_captions(paragraphs: DataFrame, compat: bool = True) -> DataFrame:
    """Paragraphs without a leading ``Table N``; those that are nothing else go. What is left is put into the first span (``compat``: see with_first_text)."""
    text = paragraph_text(F.col("spans"))
    left = paragraphs.withColumns({"_text": text, "_left": t.strip_caption(text)})
    spans = F.when(F.col("_left") == F.col("_text"), F.col("spans")).otherwise(with_first_text(F.col("spans"), F.col("_left"), compat))
    return left.filter("not (_left = '' and _text <> '')").withColumn("spans", spans).drop("_text", "_left")


def cut_header(text: Column, header: Column, compat: bool = True) -> Column:
    """The text after ``number | header``, or '' where it is a running header whole, or null where it is none. If not ``compat`` no word is cut in two."""
    pattern = t.header_pattern(header) if compat else F.concat(t.header_pattern(header), F.lit(f"(?!{t.WORD})"))
    leading = F.concat(F.lit(rf"(?iu)\A({t.SPACE}*\p{{Nd}}{{1,4}}{t.SPACE}*\|{t.SPACE}*(?:\p{{Nd}}+{t.SPACE}*)?{t.EDGE_MARKS}*"), pattern, F.lit(rf"{t.EDGE_MARKS}*)"))
    trailing = F.concat(F.lit(r"(?iu)\A"), pattern, F.lit(rf"{t.EDGE_MARKS}*{t.SPACE}*\|{t.SPACE}*\p{{Nd}}{{1,4}}{t.SPACE}*\z"))
    met = F.call_function("regexp_extract", text, leading, F.lit(1))
    rest = t.replaced(t.strip(F.substring(text, F.length(met) + 1, F.length(text))), rf"\A{t.EDGE_MARKS}+")
    return F.when((met != "") & F.startswith(t.normalize(t.strip_digits(met)), header), rest).when(F.regexp_like(text, trailing), "")


def footer_title(text: Column) -> Column:
    """The normalized title of ``number | title`` or ``title | number``; null if it is neither."""
    left, right = t.strip(t.before_pipe(text)), t.strip(t.after_pipe(text))
    number = r"\A\p{Nd}{1,4}\z"
    title = F.when(left.rlike(number), right).when(right.rlike(number), left)
    return t.normalize(t.strip_digits(title))


def squeezed(text: Column) -> Column:
    """The word characters of a text, with case folded as patterns fold it."""
    return t.replaced(F.lower(F.upper(text)), t.NOT_WORD)


def header_cuts(asked: DataFrame, headers: DataFrame, compat: bool = True) -> DataFrame:
    """(doc_id, page_no, para_no, cut, footer) of paragraphs (doc_id, page_no, para_no, text) that a title of theirs (doc_id, header) cuts; the first by length, then by name.

    A title that cuts a paragraph has, squeezed, the characters that follow the page number there, or all that precede it; so titles are met by a join on their first
    KEY characters, or on all, and only those that meet are tried as patterns. footer: whether the paragraph is a page number and a title, no more.
    """
    known = headers.withColumnRenamed("doc_id", "_doc").withColumn("_key", squeezed(F.col("header")))
    text = F.col("text")
    number = rf"\A{t.SPACE}*\p{{Nd}}{{1,4}}{t.SPACE}*\|"
    after = F.when(text.rlike(number), t.replaced(squeezed(t.replaced(text, number)), r"\A\p{Nd}+"))
    trailing = rf"\|{t.SPACE}*\p{{Nd}}{{1,4}}{t.SPACE}*\z"
    before = F.when(text.rlike(trailing), squeezed(t.replaced(text, trailing)))
    starts = F.transform(F.sequence(F.lit(1), F.least(F.lit(KEY), F.greatest(F.length(after), F.lit(1)))), lambda n: F.substring(after, F.lit(1), n))
    here = asked.withColumn("_whole", before).withColumn("_start", F.explode(F.concat(F.coalesce(starts, F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))))
    of_doc = F.col("doc_id") == F.col("_doc")
    led = here.filter("_start <> ''").join(known, of_doc & (F.col("_start") == F.substring("_key", 1, KEY)))
    ended = here.filter("_start is null and _whole is not null").join(known, of_doc & (F.col("_whole") == F.col("_key")))
    tried = led.unionByName(ended).withColumn("cut", cut_header(text, F.col("header"), compat)).filter("cut is not null")
    cuts = tried.groupBy("doc_id", "page_no", "para_no").agg(F.min_by(F.struct("cut", "text"), F.struct(-F.length("header"), "header")).alias("_first")).select("doc_id", "page_no", "para_no", "_first.*")
    footers = cuts.withColumn("_title", footer_title(text)).join(known, of_doc & (F.col("_title") == F.col("header")), "left")
    return footers.select("doc_id", "page_no", "para_no", "cut", F.col("header").isNotNull().alias("footer"))


def drop_running_headers(paragraphs: DataFrame, headers: DataFrame, compat: bool = True) -> DataFrame:
    """Paragraphs without running headers of their document's known titles (doc_id, header), each there once.

    compat: two quirks stay; a cut paragraph keeps the text of its other spans beside what is left, and a title is cut out of a longer word.

    Titles are tried longest first, then by name. The first paragraph of a page that follows an open sentence is kept unless it is nothing
    but a footer; whether a sentence is open there depends on the page before in the same way, so each page is worked out
    for both cases and the cases are folded along the document.
    """
    text = F.col("_text")
    shielded = F.coalesce(F.regexp_extract(text, "([A-Za-z])", 1).rlike("[a-z]"), F.lit(False))
    with_text = lambda df: df.withColumn("_text", paragraph_text(F.col("spans")))
    asked = with_text(paragraphs).filter(F.contains(text, F.lit("|")) & ~shielded).select("doc_id", "page_no", "para_no", text.alias("text"))
    of_page = header_cuts(asked, headers, compat).groupBy("doc_id", "page_no").agg(F.map_from_entries(F.collect_list(F.struct("para_no", F.struct("cut", "footer")))).alias("_cuts"))
    there = paragraphs.filter("doc_id is not null and page_no is not null")  # as the last join asks; said here, both that read it share its shuffle
    pages_of = with_text(there.repartition("doc_id", "page_no"))
    df = pages_of.join(of_page, ["doc_id", "page_no"], "left").withColumn("_found", F.try_element_at("_cuts", F.col("para_no"))).drop("_cuts")
    first = F.row_number().over(_page().orderBy("para_no")) == 1
    df = df.withColumn("_cut", F.col("_found.cut")).withColumn("_waits", first & F.coalesce(~F.col("_found.footer"), F.lit(False)))
    cut_spans = F.when(F.col("_cut").isNull(), F.col("spans")).otherwise(with_first_text(F.col("spans"), F.col("_cut"), compat))
    df = df.withColumn("_cut_spans", cut_spans)
    opened = lambda x: t.ends_with_hyphen(x) | ~t.ends_sentence(x)
    after_cut = F.when(F.coalesce(F.col("_cut") != "", F.lit(True)), opened(paragraph_text(F.col("_cut_spans"))))
    df = df.withColumns({"_closed": after_cut, "_open": F.when(F.col("_waits"), opened(text)).otherwise(after_cut)})
    last = lambda c: F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("para_no"))), F.lit(False))
    pages = df.groupBy("doc_id", "page_no").agg(last("_closed").alias("closed"), last("_open").alias("open"))
    steps = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "closed", "open"))).alias("pages"))
    begin = F.struct(F.lit(False).alias("now"), F.array().cast("array<struct<page_no:int,follows:boolean>>").alias("seen"))

    def step(acc: Column, p: Column) -> Column:
        seen = F.concat(acc["seen"], F.array(F.struct(p["page_no"].alias("page_no"), acc["now"].alias("follows"))))
        return F.struct(F.when(acc["now"], p["open"]).otherwise(p["closed"]).alias("now"), seen.alias("seen"))

    follows = steps.select("doc_id", F.inline(F.aggregate("pages", begin, step, lambda acc: acc["seen"])))
    df = df.join(follows, ["doc_id", "page_no"])
    keeps = F.col("follows") & F.col("_waits")
    kept = df.filter(keeps | F.coalesce(F.col("_cut") != "", F.lit(True)))
    return kept.withColumn("spans", F.when(keeps, F.col("spans")).otherwise(F.col("_cut_spans"))).select(*paragraphs.columns)


def _page():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id", "page_no")
