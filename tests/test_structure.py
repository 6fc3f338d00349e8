"""Rules of the structuring operators on literal rows and against plain models."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as t
from pagewright.operators import chunk, clean, headers, layout, markdown, merge, notes
from pagewright.plans import structure


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.r for r in df.select("i", make(F.col("v")).alias("r")).orderBy("i").collect()]


def spans_of(texts, **fields):
    base = {"font_size": 10.0, "y0": 0.0, "is_bold": False, "is_mono": False} | fields
    return [(x, base["font_size"], base["y0"], base["is_bold"], base["is_mono"]) for x in texts]


SPANS = "array<struct<text:string,font_size:double,y0:double,is_bold:boolean,is_mono:boolean>>"


def paragraphs(spark, rows):
    return spark.createDataFrame(rows, f"doc_id long, page_no int, para_no int, spans {SPANS}")


def texts(df):
    return [(r.doc_id, r.page_no, r.para_no, [s.text for s in r.spans]) for r in df.orderBy("doc_id", "page_no", "para_no").collect()]


def test_text_rules(spark):
    assert column(spark, [" a\u0085\x1c", "", None, "  x y "], t.strip) == ["a", "", None, "x y"]
    assert column(spark, ["_x_, Y!", "é²½", "A  b\tc", "1.2"], t.normalize) == ["_x_ y", "é²½", "a b c", "1 2"]
    assert column(spark, ["12 | Title - 3", "3", "a1b"], t.strip_digits) == ["Title", "", "a1b"]
    assert column(spark, ["a-", "a- \n", "a–", ""], t.ends_with_hyphen) == [True, True, False, False]
    assert column(spark, ['x."', "x! ", "x,", ""], t.ends_sentence) == [True, True, False, False]
    assert column(spark, ["Table 1", "TABLE 2-3:", "Table 3 shows x", "Tables 4", "table 5.1. body"], t.strip_caption) == ["", "", "shows x", "Tables 4", "body"]
    assert column(spark, ["14 | X", "X | 14", "a | b", "abc | 1", "abcd | x", "| abc |", "a|b|---", "", "x | abc"], t.is_pipe_candidate) == [True, True, False, True, True, False, False, False, True]


def test_reading_order_uses_the_anchor(spark):
    rows = [(1, 0, i, "x", y, x) for i, (y, x) in enumerate([(1.0, 9.0), (2.0, 1.0), (4.0, 5.0), (5.0, 0.0), (7.9, 0.0)])]
    df = layout.reading_order(spark.createDataFrame(rows, "doc_id long, page int, seq int, text string, y0 double, x0 double"))
    assert [r.line_no for r in df.orderBy("seq").collect()] == [0, 0, 0, 1, 1]


def test_paragraph_gaps(spark):
    rows = [(1, 0, i, 10.0, y, 0.0, i) for i, y in enumerate([0.0, 15.0, 30.1, 5.0])]
    df = layout.paragraph_numbers(spark.createDataFrame(rows, "doc_id long, page int, seq int, font_size double, y0 double, x0 double, line_no int"))
    assert [r.para_no for r in df.orderBy("seq").collect()] == [0, 0, 1, 1]


def test_baseline(spark):
    rows = [(1, 0, i, s) for i, s in enumerate([10.25, 9.9, 11.0, 11.1, 0.0])] + [(2, 0, 0, 0.0)]
    got = {r.doc_id: r.baseline for r in headers.baseline_sizes(spark.createDataFrame(rows, "doc_id long, page int, seq int, font_size double")).collect()}
    assert got == {1: 10.0, 2: 12.0}  # 10.25 rounds to even; of equally frequent sizes the first met


@pytest.mark.parametrize(
    ("text", "ratio", "bold", "before", "spaced", "level"),
    [("A", 1.5, False, True, True, 1), ("A", 1.49, False, True, True, 2), ("A", 1.3, True, True, True, 1), ("A", 1.3, False, True, True, 2), ("A", 1.15, True, True, True, 2), ("A", 1.15, False, True, True, 3),
     ("A", 1.0, True, True, True, 3), ("A", 1.1, False, True, True, 0), ("A", 1.15, False, True, False, 0), ("A", 1.2, True, True, False, 2), ("A", 1.3, False, True, False, 2), ("A", 1.2, False, False, False, 3),
     ("Tokenization", 2.0, True, True, True, 0), ("a (b)", 2.0, True, True, True, 0), (" ".join("x" * 15), 2.0, False, True, True, 1), (" ".join("x" * 16), 2.0, False, True, True, 0), ("", 2.0, False, True, True, 0)],
)
def test_header_levels(spark, text, ratio, bold, before, spaced, level):
    lit = F.lit
    assert spark.range(1).select(headers.header_level(lit(text), lit(ratio), lit(bold), lit(False), lit(before), lit(spaced))).first()[0] == level


def cut(spark, text, *known):
    df = clean.drop_running_headers(paragraphs(spark, [(1, 0, 0, spans_of([text]))]), spark.createDataFrame([(1, h) for h in known], "doc_id long, header string"))
    return [x for *_, found in texts(df) for x in found]


def test_running_headers(spark):
    assert cut(spark, "42 | Deep Nets", "deep nets") == []
    assert cut(spark, "42 | Deep - Nets: Body here", "deep nets") == ["Body here"]
    assert cut(spark, "Deep Nets | 42", "deep nets") == []
    assert cut(spark, "42 | Introduction to X", "intro") == ["duction to X"]  # no word boundary is asked for
    assert cut(spark, "42 | Chapter 1", "chapter 1") == ["42 | Chapter 1"]  # digits at a title's ends
    assert cut(spark, "Chapter 1 | 42", "chapter 1") == []
    assert cut(spark, "42 | deep nets", "deep nets") == ["42 | deep nets"]  # lower-case first letter
    assert cut(spark, "No pipe", "no pipe") == ["No pipe"]
    assert cut(spark, "42 | Deep Nets and more", "deep", "deep nets") == ["and more"]  # longest title first


def model_running_headers(pages, known):
    """pages: lists of texts; known: titles in order. Plain walk over the pages."""
    norm = lambda x: " ".join(re.sub(r"[^\w\s]", " ", x.lower()).split())
    bare = lambda x: re.sub(r"[\s\d\-–—:|]+$", "", re.sub(r"^[\s\d\-–—:|]+", "", x)).strip()

    def scalpel(x):
        for h in known:
            words = r"[\s\W]*".join(h.split())
            if (m := re.match(rf"\s*\d{{1,4}}\s*\|\s*(?:\d+\s*)?[\s\-–—:|]*({words})[\s\-–—:|]*", x, re.I)) and norm(bare(m[0])).startswith(h):
                return re.sub(r"^[\s\-–—:|]+", "", x[m.end() :].strip())
            if re.match(rf"{words}[\s\-–—:|]*\s*\|\s*\d{{1,4}}\s*$", x, re.I):
                return ""
        return None

    def footer(x):
        left, right = (s.strip() for s in x.split("|", 1))
        side = right if re.fullmatch(r"\d{1,4}", left) else left if re.fullmatch(r"\d{1,4}", right) else None
        return side is not None and norm(bare(side)) in known

    open_, out = False, []
    for page in pages:
        kept = []
        for i, x in enumerate(page):
            letter = re.search("[A-Za-z]", x)
            if letter and letter[0].islower() or "|" not in x or i == 0 and open_ and not footer(x):
                kept.append(x)
                continue
            left = scalpel(x)
            if left != "":
                kept.append(x if left is None else left)
        open_ = bool(kept) and not re.search(r'[.!?"]\s*$', kept[-1])
        out.append(kept)
    return out


def test_running_headers_against_a_walk(spark):
    draw = random.Random(6)
    pool = ["Body text.", "Open body", "half-", "1 | Title One", "Title One | 2", "3 | Title One Rest.", "4 | Title One tail", "x | lower", "5 | Other | Thing", "Other | 6", "7 | title one", "A | B"]
    known = ["title one", "other"]
    documents = [[[draw.choice(pool) for _ in range(draw.randint(1, 3))] for _ in range(draw.randint(1, 5))] for _ in range(150)]
    rows = [(d, p, i, spans_of([x])) for d, pages in enumerate(documents) for p, page in enumerate(pages) for i, x in enumerate(page)]
    found = clean.drop_running_headers(paragraphs(spark, rows), spark.createDataFrame([(d, h) for d in range(len(documents)) for h in known], "doc_id long, header string"))
    got = [[[] for _ in pages] for pages in documents]
    for d, p, _, spans in texts(found):
        got[d][p].append(spans[0])
    assert got == [model_running_headers(pages, known) for pages in documents]


def test_first_span_alone_is_replaced(spark):
    df = paragraphs(spark, [(1, 0, 0, spans_of(["Table 1.", "more"])), (1, 0, 1, spans_of(["Table 2"]))])
    assert texts(clean.drop_captions(df)) == [(1, 0, 0, ["more", "more"])]


def model_merge(pages):
    """Plain list walk: each page's last paragraph may go on in the next page's first, once."""
    out, now = [], []
    for i, page in enumerate(pages):
        if i and now and page and not re.search(r'[.!?"]\s*$', now[-1]):
            joined = re.sub(r"\s*-\s*$", "", now[-1]) + page[0].lstrip() if now[-1].rstrip().endswith("-") else f"{now[-1]} {page[0]}"
            out += [*now[:-1], joined]
            now = page[1:]
        else:
            out += now
            now = page
    return out + now


def test_page_merge_against_a_walk(spark):
    kinds = [[], ["a."], ["b"], ["c-"], ["d", "e."], ["f.", "g"]]
    documents = list(itertools.product(kinds, repeat=4))
    rows = [(d, p, i, spans_of([x])) for d, pages in enumerate(documents) for p, page in enumerate(pages) for i, x in enumerate(page)]
    got = {}
    for d, _, _, spans in texts(merge.join_pages(paragraphs(spark, rows))):
        got.setdefault(d, []).append(" ".join(spans))
    assert all(got.get(d, []) == model_merge(pages) for d, pages in enumerate(documents))


def test_code_fences(spark):
    rows = [(1, 0, 0, "A", False, 1, ["A"]), (1, 0, 1, "x", True, 0, [" x "]), (1, 1, 0, "y", True, 0, ["y"]), (1, 1, 1, "B", False, 0, ["B"]), (2, 0, 0, "z", True, 0, ["z"])]
    df = spark.createDataFrame([(d, p, i, x, m, n, spans_of(s)) for d, p, i, x, m, n, s in rows], f"doc_id long, page_no int, para_no int, text string, is_mono boolean, level int, spans {SPANS}")
    got = {r.doc_id: r.markdown for r in markdown.emit(df).collect()}
    assert got == {1: "# A\n\n\n\n```\n x \ny\n```\n\nB", 2: "```\nz\n```"}


def lines(spark, text):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "doc_id long, line_no long, line string")


def test_line_passes(spark):
    first = lambda df: [r.line for r in df.orderBy("line_no").collect()]
    assert first(markdown.drop_page_number(lines(spark, "0 a\n\n12 Word\n\n13 Next"))) == ["0 a", "", "Word", "", "13 Next"]
    assert first(markdown.drop_page_number(lines(spark, "x\n12 Word\n```\n\n5 Code\n```\n\n 7  b"))) == ["x", "12 Word", "```", "", "5 Code", "```", "", " b"]
    assert first(markdown.drop_numbered(lines(spark, "3 days later\n123 x\n# 1 a\n```\n1 x\n```\n1. x"))) == ["123 x", "# 1 a", "```", "1 x", "```", "1. x"]
    assert first(markdown.drop_repeated_headers(lines(spark, "Deep Nets | 3\n# Deep Nets\nDeep Nets | 4\n5 | Deep Nets\n6 | Deep Nets.\nDeep Nets | 7 body"))) == ["Deep Nets | 3", "# Deep Nets", ".", "body"]


def test_sections(spark):
    text = "pre\n# A\nx\n\ny\n## B\n~~~\n# no\n\n~~~\n# A\nz\n#### deep\n### C\n# A\nw\n# D\n# E\nlast"
    got = [(r.content, dict(r.headers)) for r in chunk.sections(lines(spark, text)).orderBy("section_no").collect()]
    a = {"Header 1": "A"}
    assert got == [("pre", {}), ("x  \ny", a), ("~~~\n# no\n\n~~~", a | {"Header 2": "B"}), ("z\n#### deep  \nw", a), ("last", {"Header 1": "E"})]


def model_split(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """The splitter's contract, word by word."""
    separator = next(s for s in separators if s in text)
    rest = separators[separators.index(separator) + 1 :]
    pieces = [p for p in (re.split(f"(?={re.escape(separator)})", text) if separator != "\n\n" and separator else [text[:1], *text[1:]] if not separator else _double(text)) if p]

    def merge_(parts):
        out, window = [], []
        for p in parts:
            if window and sum(map(len, window)) + len(p) > size:
                out.append("".join(window).strip())
                while sum(map(len, window)) > overlap or (window and sum(map(len, window)) + len(p) > size):
                    window = window[1:]
            window = [*window, p]
        return [x for x in [*out, "".join(window).strip()] if x]

    out, good = [], []
    for p in pieces:
        if len(p) < size:
            good.append(p)
        else:
            out, good = out + merge_(good), []
            out += model_split(p, size, overlap, rest) if rest else [p]
    return out + merge_(good)


def _double(text):
    first, *others = text.split("\n\n")
    return [first, *("\n\n" + x for x in others)]


def test_splitter_against_the_contract():
    draw = random.Random(9)
    for _ in range(400):
        text = "".join(draw.choice(["ab", "c", " ", "\n", "\n\n", "longerword", "é"]) for _ in range(draw.randint(1, 80)))
        size = draw.randint(1, 30)
        overlap = draw.choice([0, size, draw.randint(0, size)])
        got = chunk.split_text(text, size, overlap)
        assert got == model_split(text, size, overlap)
        assert all(len(c) <= size for c in got)
    assert chunk.split_section("", chunk.ChunkOptions()) == []
    with pytest.raises(ValueError):
        chunk.ChunkOptions(10, 11)


def test_code_blocks_stand_whole():
    block = "```\n" + "x = 1\n" * 60 + "```"
    got = chunk.split_section(f"Before {block} after.", chunk.ChunkOptions(100, 10, 1))
    assert got == [f"Before {block} after."]
    many = "\n".join(f"```{i}```" for i in range(11))
    assert "```1```0" in chunk.split_section(many, chunk.ChunkOptions(1000, 0, 1))[0]  # placeholder 1 also stands in placeholder 10


def test_chunks(spark):
    text = "# T\n" + "word " * 300 + "\n## S\nthin\n# U\n" + "other " * 30
    got = structure.to_chunks(lines(spark, text), book_title="B").orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(got))) and len(got) == 3
    assert {r.section_name for r in got} == {"T", "U"} and got[0].book_title == "B" and got[0].chapter_name == "" and got[0].metadata == {"Header 1": "T", "book_title": "B"}


def test_partitions_do_not_matter(spark):
    from pagewright.plans import fixtures

    found = fixtures.lines(spark, "/root/testdata/sf0.001").filter("doc_id < 30")
    one, many = ({(r.doc_id, r.chunk_index, r.content) for r in structure.to_chunks(found.repartition(n)).collect()} for n in (1, 7))
    assert one == many and one


def test_cards(spark):
    known = spark.createDataFrame([(1, "t", ["x"], [("p", "c")])], "note_id long, title string, tags array<string>, chunks array<struct<path:string,content:string>>")
    assert notes.render_prompt(known, "<{parsed_json}>").first().prompt.startswith('<{\\"note_id\\":\\"1\\"')
    reply = '{"cards":[{"id":"1::0","type":"qa","front":"Q","back":"A","source_path":"p","tags":["x","y"]},{"id":"1::0","type":"cloze","front":"q","back":"A","source_path":"z","tags":null}]}'
    cards = notes.parse_cards(spark.createDataFrame([(1, reply)], "note_id long, json string"))
    got = [tuple(r)[-7:] for r in notes.check_cards(cards, known).orderBy("card_no").collect()]
    assert got == [(True, False, True, True, True, True, True), (True, False, True, False, False, False, False)]


def test_quirks_can_be_left_out(spark):
    rows = [(1, 0, 0, spans_of(["Start."])), (1, 1, 0, spans_of(["2 | A Known Title Its own", "body."])), (1, 1, 1, spans_of(["3 | A Known Titles OF", "THINGS."])), (1, 1, 2, spans_of(["Table 1. Some", "text."]))]
    known = spark.createDataFrame([(1, "a known title")], "doc_id long, header string")

    def cleaned(compat):
        return [" ".join(x) for *_, x in texts(clean.drop_captions(clean.drop_running_headers(paragraphs(spark, rows), known, compat), compat))]

    assert cleaned(True) == ["Start.", "Its own body. body.", "s OF THINGS. THINGS.", "Some text. text."]
    assert cleaned(False) == ["Start.", "Its own body.", "3 | A Known Titles OF THINGS.", "Some text."]


def test_titles_by_parts_give_the_same_rows(spark):
    """Whether titles are looked through or met by their parts of ten characters, on random lines; short, held, holding and equal titles, above and below."""
    draw = random.Random(12)
    names = ["Alpha", "Deep Learning Basics", "Learning Basics", "A very long title about deep learning basics", "The End", "ten chars!", "nine char", "Größe und Maße", "x"]
    pool = [lambda n: f"## {n}", lambda n: f"{n} | 12", lambda n: f"12 | {n}", lambda n: f"7 | {n} and a body that follows", lambda n: f"see {n.lower()} here | 3", lambda n: "plain text", lambda n: "```", lambda n: f"3 | {n[3:]}", lambda n: f"{n[:12]} | 9"]
    rows = [(d, i, draw.choice(pool)(draw.choice(names))) for d in range(120) for i in range(30)]
    lines = spark.createDataFrame(rows, "doc_id long, line_no long, line string")
    found = [sorted(map(tuple, markdown.drop_repeated_headers(lines, few).collect())) for few in (0, 3, 1000)]
    assert found[0] == found[1] == found[2] and len(found[0]) < len(rows)


def test_many_titles_in_one_document(spark):
    """5,000 titles and 5,000 piped lines or paragraphs of one document: work in proportion to what meets."""
    titles = [f"Section {i:05d} of the book" for i in range(5000)]
    rows = [(1, i, f"# {x}") for i, x in enumerate(titles)] + [(1, 5000 + i, f"{i} | {x} Body {i}") for i, x in enumerate(titles)]
    got = markdown.drop_repeated_headers(spark.createDataFrame(rows, "doc_id long, line_no long, line string")).filter("line_no >= 5000").collect()
    assert len(got) == 0  # the prefix that is taken off is the line's own text, body included
    words = [f"{a}{b} nets {c}" for a in "abcdefghijklmnopq" for b in "rstuvwxyz" for c in map(chr, range(97, 123))]
    paras = spark.createDataFrame([(1, i // 10, i, spans_of([f"{i % 9000} | {x.title()}: Body {i}"])) for i, x in enumerate(words)], f"doc_id long, page_no int, para_no int, spans {SPANS}")
    known = spark.createDataFrame([(1, x) for x in words], "doc_id long, header string")
    cuts = clean.header_cuts(paras.select("doc_id", "page_no", "para_no", layout.paragraph_text(F.col("spans")).alias("text")), known).collect()
    assert len(cuts) == len(words) and all(r["cut"] == f"Body {r['para_no']}" and not r["footer"] for r in cuts)


def test_header_cuts_against_all_titles(spark):
    """The join loses no title that a pattern would find, with folded case, marks, pipes and digits between."""
    draw = random.Random(13)
    known = ["intro", "introduction", "deep nets", "deepnets x", "straße", "kelvin", "größe ½", "chapter 1", "1 intro", "a", "i̇stanbul"]
    heads = ["12 | ", "1234|", "12 | 7 ", " 3 | - ", "12345 | ", "12 | 7-8 ", ""]
    bodies = ["Intro", "INTRODUCTION", "Deep | Nets", "DeepNets x", "STRASSE", "Straße", "Kelvin", "Größe ½", "Chapter 1", "1 Intro", "A", "İstanbul", "Unknown"]
    tails = ["", " | 42", ": Body", " - ", " rest | 7 ", "uction | 12345"]
    texts_ = [draw.choice(heads) + draw.choice(bodies) + draw.choice(tails) for _ in range(600)]
    asked = spark.createDataFrame([(1, 0, i, x) for i, x in enumerate(texts_)], "doc_id long, page_no int, para_no int, text string")
    headers_ = spark.createDataFrame([(1, h) for h in known], "doc_id long, header string")
    for compat in (True, False):
        all_ = asked.crossJoin(headers_.select("header")).withColumn("cut", clean.cut_header(F.col("text"), F.col("header"), compat)).filter("cut is not null")
        want = all_.groupBy("para_no").agg(F.min_by("cut", F.struct(-F.length("header"), "header")).alias("cut")).collect()
        assert {r.para_no: r.cut for r in clean.header_cuts(asked, headers_, compat).collect()} == {r.para_no: r.cut for r in want} and len(want) > 100
