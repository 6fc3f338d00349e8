"""Markdown from paragraphs, and the passes over its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as t
from .layout import paragraph_text
from .store import kept

FENCE = "```"


def emit(levelled: DataFrame) -> DataFrame:
    """(doc_id, markdown) from paragraphs with text, is_mono and level. Code paragraphs in a row share a fence, with an empty part before it."""
    order = W.partitionBy("doc_id").orderBy("page_no", "para_no")
    df = levelled.withColumn("_new", F.coalesce(~(F.col("is_mono") & F.lag("is_mono").over(order)), F.lit(True)).cast("int"))
    df = df.withColumn("_part", F.sum("_new").over(order))
    line = F.when(F.col("is_mono"), paragraph_text(F.col("spans"))).when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    parts = df.select("doc_id", "_part", "page_no", "para_no", "is_mono", line.alias("line")).groupBy("doc_id", "_part", "is_mono").agg(F.sort_array(F.collect_list(F.struct("page_no", "para_no", "line"))).alias("lines"))
    joined = F.array_join("lines.line", "\n")
    code = F.concat(F.when(F.col("_part") > 1, "\n\n").otherwise(""), F.lit(f"{FENCE}\n"), joined, F.lit(f"\n{FENCE}"))
    parts = parts.select("doc_id", "_part", F.when(F.col("is_mono"), code).otherwise(joined).alias("part"))
    return parts.groupBy("doc_id").agg(F.array_join(F.expr("transform(sort_array(collect_list(struct(_part, part))), p -> p.part)"), "\n\n").alias("markdown"))


def to_lines(documents: DataFrame, text: str = "markdown") -> DataFrame:
    """(doc_id, line_no, line)."""
    return documents.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def to_text(lines: DataFrame, name: str = "markdown") -> DataFrame:
    return lines.groupBy("doc_id").agg(F.array_join(F.expr("transform(sort_array(collect_list(struct(line_no, line))), l -> l.line)"), "\n").alias(name))


def is_fence(line: Column) -> Column:
    return F.startswith(t.strip(line), F.lit(FENCE))


def with_fences(lines: DataFrame) -> DataFrame:
    """Adds is_fence and in_code: a line between an opening fence and the next."""
    before = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    marked = lines.withColumn("is_fence", is_fence(F.col("line")))
    count = F.coalesce(F.sum(F.col("is_fence").cast("int")).over(before), F.lit(0))
    return marked.withColumn("in_code", ~F.col("is_fence") & (count % 2 == 1))


FEW = 1000  # titles of a document that are looked through one by one for each asked line


def drop_repeated_headers(lines: DataFrame, few: int = FEW) -> DataFrame:
    """Lines without running headers around a pipe that repeat a Markdown header above them.

    Titles of documents with more than ``few`` are found by their parts of ten characters (seen_by_parts), so that the work follows the matches; the rows are the same either way.
    """
    line = F.col("line")
    marked = lines.select("doc_id", "line_no", "line", t.is_header_line(line).alias("_header")).filter(F.col("_header") | is_fence(line) | t.is_pipe_candidate(line))  # other lines are not shuffled
    df = with_fences(marked).filter(~F.col("is_fence") & ~F.col("in_code"))
    title = t.normalize(t.strip(t.replaced(F.col("line"), r"\A#+")))
    sides = (t.normalize(t.strip_digits(t.before_pipe(F.col("line")))), t.normalize(t.strip(t.after_pipe(F.col("line")))))
    texts = F.when(F.col("_header"), F.array(title)).otherwise(F.array(*sides))
    df = kept(df.select("doc_id", "line_no", "_header", F.when(~F.col("_header"), F.col("line")).alias("line"), texts.alias("texts")))  # headers and asked lines, read four times

    titles = df.filter("_header").select("doc_id", "line_no", F.col("texts")[0].alias("title")).filter("title <> ''").groupBy("doc_id", "title").agg(F.min("line_no").alias("since"))
    titles = titles.withColumn("_n", F.count("*").over(W.partitionBy("doc_id")))
    asked = df.filter(~F.col("_header")).select("doc_id", "line_no", "line", "texts")

    listed = titles.filter(F.col("_n") <= few).groupBy("doc_id").agg(F.collect_list(F.struct("since", "title")).alias("_seen"))
    short = asked.join(listed, "doc_id").withColumn("_above", F.expr("transform(filter(_seen, s -> s.since < line_no), s -> s.title)"))
    short = short.select("doc_id", "line_no", "line", *(t.matches_seen(F.col("texts")[i], F.col("_above")).alias(c) for i, c in enumerate(("_left", "_right")))).filter("_left or _right")
    many = titles.filter(F.col("_n") > few).select("doc_id", "title", "since")
    long = asked.join(many.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "line_no", "line", F.posexplode("texts").alias("side", "text"))
    met = seen_by_parts(long, many).groupBy("doc_id", "line_no").agg(F.max(F.col("side") == 0).alias("_left"), F.max(F.col("side") == 1).alias("_right"), F.first("line").alias("line"))

    found = short.unionByName(met).select("doc_id", "line_no", without_header(F.col("line"), F.col("_left"), F.col("_right")).alias("_rest")).filter("_rest is not null")
    changed = lines.select("doc_id", "line_no", "line").join(found, ["doc_id", "line_no"], "left").filter("_rest is null or _rest <> ''")
    return changed.select("doc_id", "line_no", F.coalesce("_rest", "line").alias("line"))


def seen_by_parts(sides: DataFrame, titles: DataFrame) -> DataFrame:
    """Rows of sides (doc_id, line_no, side, text, ...) for which ``matches_seen`` holds with a title (doc_id, title, since) from above, one for each such title.

    Of two texts of which one holds the other, the longer holds the first ten characters of the shorter: so one join on those of titles, and one on those of lines. Texts of
    less than ten characters match whole.
    """
    parts = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 9, F.lit(1))), lambda i: F.substring(c, i, F.lit(10))))
    keys = ["doc_id", "line_no", "side"]
    texts, first = sides.filter("text <> ''"), lambda c: F.substring(c, 1, 10)
    met = lambda line_part, title_part: texts.select(*keys, line_part(F.col("text")).alias("_part")).join(titles.select("doc_id", "since", title_part(F.col("title")).alias("_part")), ["doc_id", "_part"]).filter("since < line_no").select(*keys, "since")
    pairs = met(lambda c: F.explode(parts(c)), first).unionByName(met(first, lambda c: F.explode(parts(c)))).distinct()  # numbers alone: texts come after
    long = F.least(F.length("text"), F.length("title")) >= 10
    alike = (F.col("title") == F.col("text")) | (long & (F.contains("text", F.col("title")) | F.contains("title", F.col("text"))))
    return pairs.join(texts, keys).join(titles, ["doc_id", "since"]).filter(alike).drop("since", "title")


def without_header(line: Column, left_seen: Column, right_seen: Column) -> Column:
    """What is left of a line without a seen title and the page number at its pipe; null if there is no such title. The flags say on which side of the pipe one is."""
    left, right = t.before_pipe(line), t.strip(t.after_pipe(line))
    body = t.replaced(t.replaced(right, rf"\A{t.SPACE}*\p{{Nd}}+{t.SPACE}*"), rf"\A{t.EDGE_MARKS}+")
    rest = t.replaced(t.strip(t.strip_header_prefix(right, t.normalize(right))), rf"\A{t.EDGE_MARKS}+")
    number_first = left.rlike(rf"\A{t.SPACE}*\p{{Nd}}+{t.SPACE}*\z")
    return F.when(left_seen, body).when(number_first & right_seen, rest)


def drop_page_number(lines: DataFrame) -> DataFrame:
    """Lines where the first page number at the start of a paragraph, once a document, is taken off."""
    df = with_fences(lines)
    bare = t.strip(F.col("line"))
    order = W.partitionBy("doc_id", "in_code").orderBy("line_no")
    starts = F.coalesce(F.lag(bare == "").over(order), F.lit(True))
    number = F.regexp_extract("line", rf"\A{t.SPACE}*([0-9]{{1,3}}|\p{{Nd}}{{1,3}}){t.SPACE}+[A-Za-z]", 1)
    fits = ~F.col("is_fence") & ~F.col("in_code") & ~t.is_header_line(F.col("line")) & starts & number.rlike(r"\p{Nd}") & ~number.rlike(r"\A0+\z")
    df = df.withColumn("_fits", fits)
    first = F.min(F.when(F.col("_fits"), F.col("line_no"))).over(W.partitionBy("doc_id"))
    indent = F.regexp_extract("line", rf"\A({t.SPACE}*)", 1)
    rest = t.replaced(F.col("line"), rf"\A{t.SPACE}*\p{{Nd}}{{1,3}}{t.SPACE}+")
    return df.withColumn("_first", first).select("doc_id", "line_no", F.when(F.col("line_no") == F.col("_first"), F.concat(indent, rest)).otherwise(F.col("line")).alias("line"))


def drop_numbered(lines: DataFrame) -> DataFrame:
    """Lines outside code, headers aside, that do not begin with a number of one or two digits and a letter."""
    df = with_fences(lines)
    numbered = F.col("line").rlike(rf"\A{t.SPACE}*\p{{Nd}}{{1,2}}{t.SPACE}+[A-Za-z]")
    return df.filter(F.col("is_fence") | F.col("in_code") | t.is_header_line(F.col("line")) | ~numbered).select("doc_id", "line_no", "line")
