"""Note JSON for a prompt, and checks of the cards that come back (contracts that the reference states in prompts only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

CARDS = "struct<cards:array<struct<id:string,type:string,front:string,back:string,source_path:string,tags:array<string>>>>"


def note_json(notes: DataFrame) -> DataFrame:
    """(note_id, json) of notes (note_id, title, tags array, chunks array of struct(path, content))."""
    note = F.struct(F.col("note_id").cast("string").alias("note_id"), "title", F.struct("tags").alias("frontmatter"), "chunks")
    return notes.select("note_id", F.to_json(note).alias("json"))


def render_prompt(notes: DataFrame, template: str, slot: str = "{parsed_json}") -> DataFrame:
    """(note_id, prompt): the template with the note's JSON, escaped as a JSON string, in its slot. Null fields are left out of the JSON."""
    quoted = F.to_json(F.struct(F.col("json").alias("s")))
    inner = F.expr("substring(q, 7, length(q) - 8)")
    return note_json(notes).withColumn("q", quoted).select("note_id", F.replace(F.lit(template), F.lit(slot), inner).alias("prompt"))


def parse_cards(replies: DataFrame) -> DataFrame:
    """(note_id, card_no, id, type, front, back, source_path, tags) of replies (note_id, json). A null reply, one that is no such JSON or has no cards gives no rows; fields that lack are null."""
    return replies.select("note_id", F.from_json("json", CARDS).alias("r")).select("note_id", F.posexplode("r.cards").alias("card_no", "card")).select("note_id", "card_no", "card.*")


def check_cards(cards: DataFrame, notes: DataFrame) -> DataFrame:
    """Adds a boolean for each rule: id_ok, unique, type_ok, cloze_ok, path_ok, tags_ok, first_of_kind."""
    known = notes.select("note_id", F.transform("chunks", lambda c: c["path"]).alias("_paths"), F.coalesce("tags", F.array().cast("array<string>")).alias("_tags"))
    same_id, same_front = W.partitionBy("note_id", "id"), W.partitionBy("note_id", F.lower(F.trim("front"))).orderBy("card_no")
    df = cards.join(known, "note_id", "left")
    return df.select(
        *cards.columns,
        F.coalesce(F.startswith("id", F.concat(F.col("note_id").cast("string"), F.lit("::"))), F.lit(False)).alias("id_ok"),
        (F.count("*").over(same_id) == 1).alias("unique"),
        F.coalesce(F.col("type").isin("qa", "cloze"), F.lit(False)).alias("type_ok"),
        F.coalesce((F.col("type") != "cloze") | F.contains("front", F.lit("{{c1::")), F.lit(False)).alias("cloze_ok"),
        F.coalesce(F.array_contains("_paths", F.col("source_path")), F.lit(False)).alias("path_ok"),
        (F.size(F.array_except("_tags", F.coalesce("tags", F.array().cast("array<string>")))) == 0).alias("tags_ok"),
        (F.row_number().over(same_front) == 1).alias("first_of_kind"),
    )


def resolve_cards(cards: DataFrame, notes: DataFrame) -> DataFrame:
    """Cards (note_id, card_no, type, front, back, source_path, tags, ...) as accepted or rejected: adds accepted, reasons and index; tags and id are made anew for accepted ones.

    Reasons: note (there is none), front or back (null or blank), type, cloze (no deletion in its front), source_path (of no chunk of the note), duplicate (a card before it in the note has the same
    front, but for case and outer blanks, and was not rejected for another reason). An accepted card has the tags of its note, then its own and its duplicates' in their order, in kebab-case, each once; its id is
    ``note_id::index``, index counting the note's accepted cards from 0. Rejected cards keep their id and tags, and have no index. card_no is expected to be unique in a note.
    """
    no_tags, key = F.array().cast("array<string>"), F.lower(F.trim("front"))
    known = notes.select("note_id", F.transform("chunks", lambda c: c["path"]).alias("_paths"), F.coalesce("tags", no_tags).alias("_tags"))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    kind = F.col("type")
    reasons = F.array_compact(F.array(
        F.when(F.col("_tags").isNull(), "note"), F.when(blank("front"), "front"), F.when(blank("back"), "back"), F.when(~F.coalesce(kind.isin("qa", "cloze"), F.lit(False)), "type"),
        F.when((kind == "cloze") & ~F.coalesce(F.contains("front", F.lit("{{c1::")), F.lit(False)), "cloze"), F.when(F.col("_tags").isNotNull() & ~F.coalesce(F.array_contains("_paths", F.col("source_path")), F.lit(False)), "source_path"),
    ))
    judged = cards.join(known, "note_id", "left").withColumns({"reasons": reasons, "_key": key}).drop("_paths")
    good = judged.filter(F.size("reasons") == 0)
    firsts = good.groupBy("note_id", "_key").agg(F.min("card_no").alias("_first"))
    kebab = F.regexp_replace(F.lower(F.trim("_tag")), r"[\s_]+", "-")
    tags = good.select("note_id", "_key", "card_no", F.posexplode("tags").alias("_at", "_tag")).withColumn("_tag", kebab).filter("_tag <> ''")
    tags = tags.groupBy("note_id", "_key", "_tag").agg(F.min(F.struct("card_no", "_at")).alias("_met"))  # each tag once before they are put together
    tags = tags.groupBy("note_id", "_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("_met", "_tag"))), lambda x: x["_tag"]).alias("_own"))
    df = judged.join(firsts.join(tags, ["note_id", "_key"], "left"), ["note_id", "_key"], "left")
    sound = F.size("reasons") == 0
    df = df.withColumn("accepted", sound & (F.col("card_no") == F.col("_first")))
    index = F.when(F.col("accepted"), F.row_number().over(W.partitionBy("note_id", "accepted").orderBy("card_no")) - 1)
    df = df.withColumn("index", index).withColumn("reasons", F.when(sound & ~F.col("accepted"), F.array(F.lit("duplicate"))).otherwise(F.col("reasons")))
    union = F.array_distinct(F.concat("_tags", F.coalesce("_own", no_tags)))
    made = {"tags": F.when(F.col("accepted"), union).otherwise(F.col("tags")), "id": F.when(F.col("accepted"), F.concat_ws("::", F.col("note_id").cast("string"), F.col("index").cast("string"))).otherwise(F.col("id"))}
    return df.withColumns(made).select(*cards.columns, "accepted", "reasons", "index")


def write_cards(resolved: DataFrame, path: str) -> None:
    """Accepted and rejected cards side by side, ``accepted=true`` and ``accepted=false`` under path, by one pass over the cards."""
    resolved.write.mode("overwrite").partitionBy("accepted").parquet(path)
