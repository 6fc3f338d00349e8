import random

import pyarrow as pa
import pytest

from pagewright.llm import decontaminate as d
from pagewright.llm import text


def plain_words(t):
    out = [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in (t or "").split()]
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in out if w]


def greedy(a, b, least=5):
    """Greedy string tiling by trying every pair of places."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return sum(x for x, _, _ in out)
        free_a[i : i + k] = free_b[j : j + k] = [False] * k
        out.append(best)


def test_tiles_against_brute_force():
    draw = random.Random(1)
    for _ in range(300):
        a, b = ([draw.randint(0, draw.choice([2, 9])) for _ in range(draw.randint(0, 60))] for _ in range(2))
        b = b + a[5:30] + a[:12]
        got = d.tiles(a, b)
        assert all(a[i : i + k] == b[j : j + k] and k >= 5 for i, j, k in got)
        for n, at in ((len(a), 0), (len(b), 1)):
            seen = [x for t in got for x in range(t[at], t[at] + t[2])]
            assert len(seen) == len(set(seen)) and all(x < n for x in seen)
    a = list(range(30))
    assert sorted(k for _, _, k in d.tiles(a, a[15:] + a[:15])) == [15, 15]
    assert sum(k for _, _, k in d.tiles(a, a)) == greedy(a, a) == 30


def test_words():
    given = ["The, (cat) -- don't É.", "", "a"]
    value, docs = d.words(next(text.slices(pa.array(given)))[2])
    alone = [d.words(next(text.slices(pa.array([w])))[2])[0][0] for t in given for w in plain_words(t)]
    assert value.tolist() == alone and docs.tolist() == [0, 0, 0, 0, 2]


def test_leaks(spark):
    draw = random.Random(2)
    word = lambda: draw.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(draw.randint(0, 400))
    items = {i: " ".join(word() for _ in range(40)) for i in range(6)} | {6: "too short", 7: None, 8: ""}
    w = {i: (t or "").split() for i, t in items.items()}
    noise = lambda n: " ".join(word() for _ in range(n))
    docs = {
        0: noise(300), 1: noise(50) + " " + items[0].upper() + ". " + noise(5000), 2: " ".join(w[1][20:] + [noise(30)] + w[1][:20]), 3: " ".join(w[2][:15]) + " " + noise(90),
        4: ", ".join(w[3]) + "\n" + items[4], 5: None, 6: "", 7: "too short", 8: " ".join(x for i in range(0, 40, 4) for x in [*w[5][i : i + 4], "x"]),
    }
    rows = [(i, t, 1, "y") for i, t in docs.items()] + [(1, docs[1], 1, "y"), (1, noise(10), 1, "y"), (None, items[5], None, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, item_id int, words string")
    benchmark = spark.createDataFrame(list(items.items()) + [(0, items[0])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in d.leaks(documents, benchmark).collect()}
    assert set(got) == {(1, 0), (2, 1), (4, 3), (4, 4), (None, 5)}
    for (doc, item), r in got.items():
        a = plain_words(items[5] if doc is None else docs[doc])
        assert r.covered_words == greedy(a if len(a) < 200 else a[45:95], w[item]) and r.item_words == 40
    assert d.leaks(documents.limit(0), benchmark).collect() == [] and d.leaks(documents, benchmark.limit(0)).collect() == []


def test_leaks_by_unicode(spark):
    items = {
        1: "El niño comió piñas, después ágil cantó canción única según Ángel",
        2: "Où était l'été déçu, près des forêts gelées où naît Noël",
        3: "Größe heißt für müde Füße süße Grüße über schöne Straßen",
    }
    marked = lambda t, a, b: " ".join(f"{a}{w}{b}" for w in t.split())
    docs = {
        1: items[1].upper(), 2: items[2].upper(), 3: items[3].upper(), 4: marked(items[1], "¡", "!"), 5: marked(items[2], "«\u00a0", "\u00a0»"),
        6: marked(items[3], "“", "”."), 7: "Un texto que no tiene nada de lo que hay en los demás",
    }
    found = d.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.coverage) for r in found} == {(k, (k - 1) % 3 + 1, 1.0) for k in range(1, 7)}


def test_shared_boilerplate_makes_no_pairs(spark):
    """Items that share twelve words of forty with each other and with every document: no document is a leak, and none is tiled."""
    draw = random.Random(5)
    word = lambda: f"w{draw.randint(0, 10**9)}"
    common = [word() for _ in range(12)]
    items = [(i, " ".join([*(word() for _ in range(14)), *common, *(word() for _ in range(14))])) for i in range(300)]
    docs = [(i, " ".join([word(), *common, word()])) for i in range(2999)] + [(2999, items[7][1])]
    benchmark, documents = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    own = d.items_of(benchmark, "item_id", "text")
    parts = d.stretches(documents, "doc_id", "text", d.bitmap(own))
    assert [(r.key, r.item) for r in d.candidates(own, parts, 0.5).collect()] == [(2999, 7)]
    assert [(r.doc_id, r.item_id) for r in d.leaks(documents, benchmark).collect()] == [(2999, 7)]


@pytest.mark.parametrize("hot", [0, 2, 16])
def test_all_pairs_against_plain_tiling(spark, monkeypatch, hot):
    monkeypatch.setattr(d, "HOT", hot)
    draw = random.Random(3)
    word = lambda: f"w{draw.randint(0, 500)}"
    common = [word() for _ in range(8)]  # in every item
    items = [(draw.choice([None, None, i]), [word() for _ in range(draw.randint(2, 22))] + common + [word() for _ in range(draw.randint(0, 12))]) for i in range(12)]
    items += [(5, items[0][1][:5]), (5, items[1][1]), (None, items[2][1]), (None, items[2][1])]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(draw.randint(0, 5)):
            own = draw.choice(items)[1]
            at = draw.randrange(len(own))
            parts += own[at : at + draw.randint(3, 16)] + [word() for _ in range(draw.randint(0, 3))]
        docs.append((draw.choice([None, i]), parts))
    frame = lambda rows, key: spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{key} long, text string")
    got = d.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    once = sorted({(k, tuple(w)) for k, w in items}, key=str)
    want = [(k, i, len(w)) for k, t in docs for i, w in once if len(w) >= 5 and 2 * greedy(t, list(w)) >= len(w)]
    key = lambda r: str(tuple(r))
    assert sorted(((r.doc_id, r.item_id, r.item_words) for r in got), key=key) == sorted(want, key=key)
    assert any(i is None for _, i, _ in want) and len(want) > 20
