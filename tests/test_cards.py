"""Cards resolved against a plain walk; chunk counters against the data."""

import random
import re

from pyspark.sql import Observation, functions as F

from pagewright.operators import chunk, markdown, notes

CARD = "note_id long, card_no int, id string, type string, front string, back string, source_path string, tags array<string>, extra int"
NOTE = "note_id long, tags array<string>, chunks array<struct<path:string,content:string>>"


def walk(cards, known):
    """(note_id, card_no, id, tags, accepted, reasons, index) of each card, note by note."""
    out, by_note = [], {}
    for c in sorted(cards, key=lambda c: (c[0], c[1])):
        by_note.setdefault(c[0], []).append(c)
    for note, mine in by_note.items():
        first, verdicts, tags = {}, [], {}
        for _, no, _, kind, front, back, path, own, _ in mine:
            reasons = [r for r, bad in (("note", note not in known), ("front", not (front or "").strip(" ")), ("back", not (back or "").strip(" ")), ("type", kind not in ("qa", "cloze")), ("cloze", kind == "cloze" and "{{c1::" not in (front or "")), ("source_path", note in known and path not in known[note][1])) if bad]
            if not reasons:
                key = front.strip(" ").lower()
                if key in first:
                    reasons = ["duplicate"]
                first.setdefault(key, no)
                tags.setdefault(key, []).extend(re.sub(r"[\s_]+", "-", x.strip(" ").lower()) for x in own or [] if x is not None and x.strip(" "))
            verdicts.append(reasons)
        index = 0
        for (_, no, old, _, front, _, _, own, _), reasons in zip(mine, verdicts, strict=True):
            if reasons:
                out.append((note, no, old, own, False, reasons, None))
            else:
                union = list(dict.fromkeys([*(known[note][0] or []), *tags[front.strip(" ").lower()]]))
                out.append((note, no, f"{note}::{index}", union, True, [], index))
                index += 1
    return sorted(map(repr, out))


def test_resolve_cards(spark, tmp_path):
    draw = random.Random(11)
    known = {n: (draw.choice([["Note Tag", "b"], [], None]), {"p1", "p2"}) for n in range(30)}
    cards = []
    for n in range(33):  # the last three have no note
        for i in range(draw.randrange(0, 14)):
            front = draw.choice(["What?", " what? ", "WHAT?", "{{c1::x}} y", "Why?", "", None, "How"])
            cards.append((n, i, draw.choice([f"{n}::{i}", "x", None]), draw.choice(["qa", "qa", "cloze", None, "basic"]), front, draw.choice(["yes", "yes", " ", None]), draw.choice(["p1", "p2", "p2", "p3", None]), draw.choice([["Some Tag", "b", "a_b  c"], ["b", None, " "], [], None]), 1))
    cards += [(0, 100 + i, "same", "qa", "a hot front", "b", "p1", [f"t{i % 7}"], 2) for i in range(300)]
    frame, table = spark.createDataFrame(cards, CARD), spark.createDataFrame([(n, t, [(p, "") for p in sorted(ps)]) for n, (t, ps) in known.items()], NOTE)
    found = notes.resolve_cards(frame.repartition(5), table)
    got = sorted(repr((r.note_id, r.card_no, r.id, r.tags, r.accepted, r.reasons, r["index"])) for r in found.collect())
    assert got == walk(cards, known) and found.columns == [*frame.columns, "accepted", "reasons", "index"]
    notes.write_cards(found, str(tmp_path / "cards"))
    for accepted in ("true", "false"):
        assert spark.read.parquet(str(tmp_path / f"cards/accepted={accepted}")).count() == found.filter(F.col("accepted") == (accepted == "true")).count() >= 20
    assert notes.resolve_cards(frame.limit(0), table).collect() == []


def test_chunk_counters(spark):
    texts = [(1, "# A\n" + "word " * 500 + "\n## B\nshort\n## C\n" + "x" * 99 + "\n# D\n" + "y" * 100), (2, "tiny"), (3, "")]
    sections = chunk.sections(markdown.to_lines(spark.createDataFrame(texts, "doc_id long, markdown string")))
    counts = Observation()
    kept = chunk.chunks(sections, observation=counts).collect()
    every = chunk.chunks(sections, chunk.ChunkOptions(least=0)).collect()
    thin = [r for r in every if len(r.content) < 100]
    assert counts.get == {"sections": 5, "chunks": len(kept), "thin_chunks": len(thin), "characters": sum(len(r.content) for r in kept), "thin_characters": sum(len(r.content) for r in thin)} and len(thin) == 3
