"""The registry of queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as t
from ..operators import chunk, clean, headers, layout, markdown, merge, notes, reviews, vectors
from ..streaming import changes
from . import fixtures, structure
from .oracles import ORACLES


def _paragraphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return structure.to_paragraphs(fixtures.spans(spark, sf_dir), fixtures.tables(spark, sf_dir))


def _on_lines(name: str, column):
    return lambda spark, sf_dir: fixtures.lines(spark, sf_dir).select("doc_id", "line_no", column().alias(name))


def _on_spans(**columns):
    return lambda spark, sf_dir: fixtures.spans(spark, sf_dir).select("doc_id", "page", "seq", *(f().alias(n) for n, f in columns.items()))


def _with_text(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "page_no", "para_no", layout.paragraph_text(F.col("spans")).alias("text"))


def font_flags(spark, sf_dir):
    return layout.with_font_flags(fixtures.spans(spark, sf_dir)).select("doc_id", "page", "seq", "is_bold", "is_mono")


def flatten_blocks(spark, sf_dir):
    """The spans nested into blocks of lines, with an image and blank spans among them, and flattened again."""
    field = lambda *names: F.struct(F.col("text"), F.col("font"), F.col("font_size").alias("size"), F.col("flags"), F.array(*names).alias("bbox"))
    spans = fixtures.spans(spark, sf_dir).select("doc_id", "page", "page_height", "seq", F.floor(F.col("seq") / 3).alias("line"), F.floor(F.col("seq") / 12).alias("block"), field("x0", "y0", "x1", "y1").alias("span"))
    gathered = lambda df, of, key: df.agg(F.sort_array(F.collect_list(F.struct(key, of))).alias("x")).withColumn(of, F.col(f"x.{of}")).drop("x")
    lines = gathered(spans.groupBy("doc_id", "page", "page_height", "block", "line"), "span", "seq")
    blank = F.expr("struct('  ' as text, 'Times' as font, cast(9 as double) as size, 0 as flags, array(0d, 0d, 9d, 9d) as bbox)")
    lines = lines.withColumn("line_", F.struct(F.concat("span", F.array(blank)).alias("spans")))
    blocks = gathered(lines.groupBy("doc_id", "page", "page_height", "block"), "line_", "line").withColumn("block_", F.struct(F.col("line_").alias("lines")))
    pages = gathered(blocks.groupBy("doc_id", "page", "page_height"), "block_", "block")
    image = F.expr("transform(slice(block_, 1, 1), b -> named_struct('lines', cast(null as array<struct<spans:array<struct<text:string,font:string,size:double,flags:int,bbox:array<double>>>>>)))")
    flat = layout.flatten_blocks(pages.select("doc_id", "page", "page_height", F.concat(image, "block_").alias("blocks")))
    return flat.select("doc_id", "page", "text", "font", "font_size", "x0", "y0", "x1", "y1", "flags")


def table_antijoin(spark, sf_dir):
    return layout.outside_tables(fixtures.spans(spark, sf_dir), fixtures.tables(spark, sf_dir)).select("doc_id", "page", "seq", "text")


def _inside(spark, sf_dir):
    return layout.outside_tables(layout.with_font_flags(fixtures.spans(spark, sf_dir)), fixtures.tables(spark, sf_dir))


def baseline_font(spark, sf_dir):
    return headers.baseline_sizes(_inside(spark, sf_dir))


def reading_order(spark, sf_dir):
    return layout.reading_order(_inside(spark, sf_dir)).select("doc_id", "page", "seq", "line_no")


def paragraphs(spark, sf_dir):
    found, _ = _paragraphs(spark, sf_dir)
    return found.select("doc_id", "page_no", "para_no", layout.paragraph_text(F.col("spans")).alias("text"), F.size("spans").cast("long").alias("n_spans"))


def classify_headers(spark, sf_dir):
    return headers.with_levels(*_paragraphs(spark, sf_dir)).select("doc_id", "page_no", "para_no", "text", "is_mono", "level")


def known_headers(spark, sf_dir):
    return headers.known_headers(headers.with_levels(*_paragraphs(spark, sf_dir)))


def drop_captions(spark, sf_dir):
    return _with_text(clean.drop_captions(_paragraphs(spark, sf_dir)[0]))


def running_headers(spark, sf_dir):
    found, baselines = _paragraphs(spark, sf_dir)
    return _with_text(clean.drop_running_headers(found, structure.kept(headers.known_headers(headers.with_levels(found, baselines)))))


def page_merge(spark, sf_dir):
    return merge.page_joins(_paragraphs(spark, sf_dir)[0])


def join_pages(spark, sf_dir):
    return _with_text(merge.join_pages(_paragraphs(spark, sf_dir)[0]))


def emit_markdown(spark, sf_dir):
    levelled = headers.with_levels(*_paragraphs(spark, sf_dir))
    return markdown.emit(levelled.filter("text <> ''"))


def full_markdown(spark, sf_dir):
    return structure.to_markdown(fixtures.spans(spark, sf_dir), fixtures.tables(spark, sf_dir))


def document_summary(spark, sf_dir):
    """(doc_id, n_headers, n_paragraphs, n_chars, markdown_sha) of the whole chain."""
    levelled = structure.to_emitted(fixtures.spans(spark, sf_dir), fixtures.tables(spark, sf_dir))
    counts = structure.kept(levelled.groupBy("doc_id").agg(F.count_if(F.col("level") > 0).alias("n_headers"), F.count("*").alias("n_paragraphs")))
    lines = structure.kept(markdown.to_lines(markdown.emit(levelled)))
    structure.let_go(levelled)
    texts = markdown.to_text(structure.cleaned_lines(lines))
    return counts.join(texts, "doc_id").select("doc_id", "n_headers", "n_paragraphs", F.length("markdown").cast("long").alias("n_chars"), F.sha2("markdown", 256).alias("markdown_sha"))


def pipe_lines(spark, sf_dir):
    return markdown.drop_repeated_headers(fixtures.lines(spark, sf_dir))


def page_number_prefix(spark, sf_dir):
    return markdown.drop_page_number(fixtures.lines(spark, sf_dir))


def numbered_drop(spark, sf_dir):
    return markdown.drop_numbered(fixtures.lines(spark, sf_dir))


def md_sections(spark, sf_dir):
    found = chunk.sections(fixtures.lines(spark, sf_dir))
    return found.select("doc_id", "section_no", *(F.try_element_at("headers", F.lit(f"Header {n}")).alias(f"h{n}") for n in (1, 2, 3)), "content")


def section_names(spark, sf_dir):
    """Sections as chunks: thin ones dropped, the rest numbered and named by their outermost header."""
    found = md_sections(spark, sf_dir).withColumn("n_chars", F.length(t.strip(F.col("content"))).cast("long")).filter("n_chars >= 100")
    index = (F.row_number().over(W.partitionBy("doc_id").orderBy("section_no")) - 1).cast("int")
    return found.select("doc_id", index.alias("chunk_index"), F.coalesce("h1", "h2", "h3", F.lit("")).alias("section_name"), "n_chars")


def code_blocks(spark, sf_dir):
    texts = markdown.to_text(fixtures.lines(spark, sf_dir), "text")
    return texts.select("doc_id", F.posexplode(chunk.code_blocks(F.col("text"))).alias("block_no", "block")).withColumn("block_no", F.col("block_no").cast("long"))


def chunks(spark, sf_dir):
    return structure.to_chunks(fixtures.lines(spark, sf_dir)).withColumn("metadata", F.to_json("metadata"))


def chunks_titled(spark, sf_dir):
    """Smaller chunks that carry a book title and, but for each twelfth document, a chapter."""
    part = F.col("doc_id") % 12
    chapter = F.when(part == 0, "").otherwise(F.concat(F.lit("Chapter "), part.cast("string")))
    found = structure.to_chunks(fixtures.lines(spark, sf_dir), chunk.ChunkOptions(600, 80, 40), book_title="Collected notes", chapter_name=chapter)
    return found.withColumn("metadata", F.to_json("metadata"))


def chunk_stats(spark, sf_dir):
    size = F.length("content")
    return chunks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(size).alias("n_chars"), F.max(size).alias("longest"), F.min(size).alias("shortest"))


def char_count(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.length("text").cast("long").alias("n_chars"))


def note_json(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chunk_ = F.struct(F.col("source").alias("path"), F.col("text").alias("content"))
    return notes.note_json(docs.select(F.col("doc_id").alias("note_id"), F.col("source").alias("title"), F.array("lang").alias("tags"), F.array(chunk_).alias("chunks")))


PROMPT = "Cards for this note:\n{parsed_json}\nAnswer with JSON."


def render_prompt(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chunk_ = F.struct(F.col("source").alias("path"), F.col("text").alias("content"))
    return notes.render_prompt(docs.select(F.col("doc_id").alias("note_id"), F.col("source").alias("title"), F.array("lang").alias("tags"), F.array(chunk_).alias("chunks")), PROMPT)


def parse_cards(spark, sf_dir):
    """The turns of each conversation as the cards of one reply, parsed."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    card = F.struct(F.concat_ws("::", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.lit("qa").alias("type"), F.col("text").alias("front"), F.col("role").alias("back"), F.array("role").alias("tags"))
    cards = talks.select(F.col("conv_id").alias("note_id"), "turn", card.alias("card")).groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct("turn", "card"))).alias("cards"))
    replies = cards.select("note_id", F.to_json(F.struct(F.col("cards.card").alias("cards"))).alias("json"))
    return notes.parse_cards(replies).select("note_id", "card_no", "id", "type", "front", "back", "source_path", F.col("tags")[0].alias("tag"))


def _cards(spark, sf_dir):
    """(cards, notes): turns of conversations taken as cards of a note."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    index = (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).cast("int")
    mark = F.when(F.col("turn") % 5 == 4, ":").otherwise("::")
    kind = F.when(F.col("role") == "user", "qa").when(F.col("role") == "assistant", "cloze").otherwise(F.col("role"))
    cards = talks.select(
        F.col("conv_id").alias("note_id"), index.alias("card_no"), F.concat(F.col("conv_id").cast("string"), mark, F.col("turn").cast("string")).alias("id"), kind.alias("type"), F.col("text").alias("front"),
        F.concat(F.lit("turn-"), (F.col("turn") % 3).cast("string")).alias("source_path"), F.when(F.col("turn") % 2 == 0, F.array(F.lit("chat"))).otherwise(F.array(F.lit("other"))).alias("tags"),
    )
    known = talks.select(F.col("conv_id").alias("note_id")).distinct().withColumns({"chunks": F.array(*(F.struct(F.lit(f"turn-{i}").alias("path"), F.lit("").alias("content")) for i in (0, 1))), "tags": F.array(F.lit("chat"))})
    return cards, known


def card_validate(spark, sf_dir):
    """Turns of conversations taken as cards of a note."""
    return notes.check_cards(*_cards(spark, sf_dir)).select("note_id", "card_no", "id_ok", "unique", "type_ok", "cloze_ok", "path_ok", "tags_ok", "first_of_kind")


def _resolved(spark, sf_dir):
    """The same cards, their fronts cut to a word and a deletion put into every second cloze, resolved."""
    cards, known = _cards(spark, sf_dir)
    word = F.split("front", " ")[0]
    front = F.when((F.col("type") == "cloze") & (F.col("card_no") % 4 == 1), F.concat(F.lit("{{c1::"), word, F.lit("}}"))).otherwise(word)
    tags = F.concat("tags", F.array(F.concat_ws("_", F.lit("Of"), "type"), F.concat(F.lit("Turn "), (F.col("card_no") % 3).cast("string"))))
    return notes.resolve_cards(cards.withColumns({"front": front, "back": F.col("front"), "tags": tags}), known)


def card_accepted(spark, sf_dir):
    found = _resolved(spark, sf_dir).filter("accepted")
    return found.select("note_id", F.col("index").cast("long").alias("index"), "id", "type", "front", "back", "source_path", F.array_join("tags", ",").alias("tags"))


def card_rejected(spark, sf_dir):
    found = _resolved(spark, sf_dir).filter("not accepted")
    return found.select("note_id", F.col("card_no").cast("long").alias("card_no"), "id", F.array_join("reasons", ",").alias("reasons"))


def related_exact(spark, sf_dir):
    """The ten nearest of all vectors for each whose id is divisible by 50."""
    return vectors.neighbors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def related_indexed(spark, sf_dir):
    """The same through an inverted-file index over all vectors."""
    return vectors.related(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def card_schedule(spark, sf_dir):
    """Events taken as reviews of cards (a user's kind of event), in tens of their value as quality."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("quality", F.floor(F.col("value") / 10).cast("int"))
    return reviews.schedule(events, ["user_id", "event_type"], "ts", "quality").withColumn("due", F.col("due").cast("string"))


def note_changes(spark, sf_dir):
    """Documents as notes in two versions: those of several lines, then a listing of those under 2,000 characters, every second with a line more."""
    notes_ = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "n_chars")
    table = changes.Changes(spark, structure.folder(spark, "digests"))
    table.apply(notes_.filter(F.contains("content", F.lit("\n"))), 0)
    edited = F.when(F.col("n_chars") % 2 == 0, F.concat("content", F.lit("\nreviewed"))).otherwise(F.col("content"))
    found = table.apply(notes_.filter("length(content) < 2000").withColumn("content", edited), 1, complete=True)
    return found.select(F.col("path").cast("long").alias("doc_id"), "change", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("n_chars"), "digest")


def queries():
    """Query functions by name."""
    on_spans = {
        "document_summary": document_summary,
        "sentence_end": _on_spans(hyphen=lambda: t.ends_with_hyphen(F.col("text")), sentence=lambda: t.ends_sentence(F.col("text"))),
        "table_caption": _on_spans(stripped=lambda: t.strip_caption(F.col("text"))),
        "markdown": emit_markdown,
        "full_markdown": full_markdown,
        **{f.__name__: f for f in (font_flags, flatten_blocks, table_antijoin, baseline_font, reading_order, paragraphs, classify_headers, known_headers, drop_captions, running_headers, page_merge, join_pages)},
    }
    return {
        **on_spans,
        "spans_fixture": fixtures.spans,
        "md_fixture": fixtures.lines,
        "normalize_text": _on_lines("normalized", lambda: t.normalize(F.col("line"))),
        "strip_digits_seps": _on_lines("stripped", lambda: t.strip_digits(F.col("line"))),
        "pipe_candidate": _on_lines("candidate", lambda: t.is_pipe_candidate(F.col("line"))),
        **{f.__name__: f for f in (pipe_lines, page_number_prefix, numbered_drop, md_sections, section_names, code_blocks, chunks, chunks_titled, chunk_stats, char_count, note_json, render_prompt, parse_cards, card_validate, related_exact, related_indexed, card_schedule, note_changes, card_accepted, card_rejected)},
    }


def oracle_sql():
    """DuckDB SQL by query name."""
    return dict(ORACLES)
