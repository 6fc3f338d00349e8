"""The fixtures hold every word of the documents."""

from collections import Counter

from pagewright.plans import fixtures

SF = "/root/testdata/sf0.001"


def words_of(texts):
    return Counter(w.rstrip("-") for text in texts for w in text.split(" ") if w.rstrip("-"))


def test_every_word_is_in_a_span_and_in_a_markdown_line(spark):
    wanted = {r.doc_id: words_of((r.text or "").split("\n")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sum(w.total() for w in wanted.values()) > 30_000
    for frame, column in ((fixtures.spans(spark, SF), "text"), (fixtures.lines(spark, SF), "line")):
        found = {}
        for r in frame.select("doc_id", column).collect():
            found.setdefault(r.doc_id, []).append(r[1])
        for doc, words in wanted.items():
            assert not words - words_of(found.get(doc, [])), (column, doc)
