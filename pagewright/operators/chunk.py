"""Markdown lines to header sections, and sections to numbered chunks."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from ..functions import text as t

SEPARATORS = ("\n\n", "\n", " ", "")
UNPRINTABLE = r"[^\p{L}\p{M}\p{N}\p{P}\p{S} ]"
COUNTERS = ("sections", "chunks", "thin_chunks", "characters", "thin_characters")
CODE = re.compile(r"```[\s\S]*?```")


@dataclass(frozen=True)
class ChunkOptions:
    """Sizes in characters."""

    size: int = 1000
    overlap: int = 150
    least: int = 100

    def __post_init__(self):
        if self.overlap > self.size:
            raise ValueError(f"overlap {self.overlap} is larger than the chunk size {self.size}")


def _code_states(lines: DataFrame) -> DataFrame:
    """Adds in_code: whether a fence of either kind is open after the line. Only fence lines are folded."""
    three = F.startswith("line", F.lit("```"))
    single = F.length("line") - F.length(F.replace("line", F.lit("```"), F.lit(""))) == 3
    kind = F.when(three & single, 1).when(three, 3).when(F.startswith("line", F.lit("~~~")), 2)  # 3 closes a fence but opens none
    fences = lines.select("doc_id", "line_no", kind.alias("kind")).filter("kind is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "kind"))).alias("fences"))
    begin = F.struct(F.lit(0).alias("open"), F.array().cast("array<struct<line_no:bigint,open:int>>").alias("seen"))

    def step(acc: Column, x: Column) -> Column:
        closes = (acc["open"] == x["kind"]) | ((acc["open"] == 1) & (x["kind"] == 3))
        now = F.when(acc["open"] == 0, F.when(x["kind"] == 3, 0).otherwise(x["kind"])).when(closes, 0).otherwise(acc["open"])
        return F.struct(now.alias("open"), F.concat(acc["seen"], F.array(F.struct(x["line_no"].alias("line_no"), now.alias("open")))).alias("seen"))

    states = fences.select("doc_id", F.inline(F.aggregate("fences", begin, step, lambda acc: acc["seen"])))
    # states go in before their lines, so that the lines are shuffled once, by document, as the windows that follow need them
    both = lines.withColumn("_line", F.lit(1)).unionByName(states.withColumn("_line", F.lit(0)), allowMissingColumns=True)
    so_far = W.partitionBy("doc_id").orderBy("line_no", "_line")
    both = both.withColumn("in_code", F.coalesce(F.last("open", ignorenulls=True).over(so_far), F.lit(0)) > 0)
    return both.filter("_line = 1").drop("open", "_line")


def sections(lines: DataFrame) -> DataFrame:
    """(doc_id, section_no, content, headers) of lines (doc_id, line_no, line): text between headers of three levels, with the headers open there."""
    clean = lines.select("doc_id", "line_no", t.strip(F.col("line")).alias("line")).withColumn("line", t.replaced(F.col("line"), UNPRINTABLE))
    df = _code_states(clean)
    level = F.when(F.col("in_code"), 0)
    for n in (3, 2, 1):
        level = level.when((F.col("line") == "#" * n) | F.startswith("line", F.lit("#" * n + " ")), n)
    df = df.withColumn("level", level.otherwise(0))
    so_far = W.partitionBy("doc_id").orderBy("line_no")
    at = {n: F.max(F.when(F.col("level") == n, F.col("line_no"))).over(so_far) for n in (1, 2, 3)}
    title = {n: F.last(F.when(F.col("level") == n, t.strip(F.substring("line", n + 1, 1 << 30))), ignorenulls=True).over(so_far) for n in (1, 2, 3)}
    df = df.withColumns({f"_at{n}": at[n] for n in at} | {f"_title{n}": title[n] for n in title})
    above = F.lit(-1).cast("long")
    for n in (1, 2, 3):
        df = df.withColumn(f"h{n}", F.when(F.col(f"_at{n}") > above, F.col(f"_title{n}")))
        above = F.greatest(above, F.coalesce(f"_at{n}", F.lit(-1).cast("long")))
    cuts = (F.col("level") > 0) | ((F.col("line") == "") & ~F.col("in_code"))
    df = df.withColumn("_piece", F.sum(cuts.cast("int")).over(so_far)).filter(~cuts)
    same = lambda *names: F.expr(" and ".join(f"{c} <=> lag({c}) over (partition by doc_id order by line_no)" for c in names))
    df = df.withColumn("_new", (~same("h1", "h2", "h3") | F.lag("line_no").over(so_far).isNull()).cast("int"))
    df = df.withColumn("_sep", F.when(F.col("_new") == 1, "").when(F.col("_piece") == F.lag("_piece").over(so_far), "\n").otherwise("  \n"))
    df = df.withColumn("section_no", F.sum("_new").over(so_far) - 1)
    found = df.groupBy("doc_id", "section_no", "h1", "h2", "h3").agg(F.array_join(F.expr("transform(sort_array(collect_list(struct(line_no, _sep || line as text))), l -> l.text)"), "").alias("content"))
    headers = F.map_filter(F.create_map(*(x for n in (1, 2, 3) for x in (F.lit(f"Header {n}"), F.col(f"h{n}")))), lambda _, v: v.isNotNull())
    return found.select("doc_id", F.col("section_no").cast("int").alias("section_no"), "content", headers.alias("headers"))


def code_blocks(content: Column) -> Column:
    """The fenced blocks of a text, in order."""
    return F.regexp_extract_all(content, F.lit(r"```[\s\S]*?```"), 0)


def merged(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Pieces put together to at most size characters, each window starting with up to overlap characters of the one before."""
    out, window, total = [], [], 0
    for piece in pieces:
        if window and total + len(piece) > size:
            out.append("".join(window).strip())
            while total > overlap or (total + len(piece) > size and total > 0):
                total -= len(window.pop(0))
        window.append(piece)
        total += len(piece)
    return [x for x in [*out, "".join(window).strip()] if x]


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """A text cut at the first separator it holds; pieces that are still too long are cut at the next ones."""
    at = next(i for i, s in enumerate(separators) if s in text)
    separator, rest = separators[at], separators[at + 1 :]
    pieces = list(text)
    if separator:  # a piece begins with its separator
        first, *others = text.split(separator)
        pieces = [first, *(separator + x for x in others)]
    out, short = [], []
    for piece in filter(None, pieces):
        if len(piece) < size:
            short.append(piece)
            continue
        out += merged(short, size, overlap)
        short = []
        out += split_text(piece, size, overlap, rest) if rest else [piece]
    return out + merged(short, size, overlap)


def split_section(content: str, options: ChunkOptions) -> list[str]:
    """Chunks of a section; code blocks stand in them whole. Placeholders are put back in ascending order, by plain replacement."""
    blocks = CODE.findall(content)
    numbers = iter(range(len(blocks)))
    chunks = split_text(CODE.sub(lambda _: f"CODE_BLOCK_PLACEHOLDER_{next(numbers)}", content), options.size, options.overlap) if content else []
    for i, block in enumerate(blocks):
        chunks = [c.replace(f"CODE_BLOCK_PLACEHOLDER_{i}", block) for c in chunks]
    return chunks


def chunks(found: DataFrame, options: ChunkOptions = ChunkOptions(), book_title: str | None = None, chapter_name: Column | str | None = None, observation: Observation | None = None) -> DataFrame:
    """(doc_id, chunk_index, content, book_title, chapter_name, section_name, metadata) of sections; thin chunks go before they are numbered.

    observation: gets COUNTERS with the first action on the result, from the same pass: sections that gave chunks, chunks kept and dropped as thin, and characters of both.
    """

    @F.pandas_udf("array<string>")
    def split(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: split_section(c or "", options))

    chapter = chapter_name if isinstance(chapter_name, Column) else F.lit(chapter_name).cast("string")
    named = F.create_map(F.lit("book_title"), F.lit(book_title).cast("string"), F.lit("chapter_name"), chapter)
    metadata = F.map_concat("headers", F.map_filter(named, lambda _, v: F.coalesce(v != "", F.lit(False))))
    df = found.select("doc_id", "section_no", "headers", metadata.alias("metadata"), F.posexplode(split("content")).alias("piece", "content"))
    df = df.withColumn("content", t.strip(F.col("content")))
    thin = F.length("content") < options.least
    if observation is not None:
        chars = lambda which: F.coalesce(F.sum(F.when(which, F.length("content"))), F.lit(0)).cast("long")
        counts = (F.count_if(F.col("piece") == 0), F.count_if(~thin), F.count_if(thin), chars(~thin), chars(thin))
        df = df.observe(observation, *(c.alias(n) for c, n in zip(counts, COUNTERS, strict=True)))
    df = df.filter(~thin)
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("section_no", "piece")) - 1
    name = lambda key: F.coalesce(F.try_element_at("metadata", F.lit(key)), F.lit(""))
    section = F.coalesce(*(F.try_element_at("headers", F.lit(f"Header {n}")) for n in (1, 2, 3)), F.lit(""))
    return df.select("doc_id", index.cast("int").alias("chunk_index"), "content", name("book_title").alias("book_title"), name("chapter_name").alias("chapter_name"), section.alias("section_name"), "metadata")
