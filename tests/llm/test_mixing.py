import random
import re
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def sums(lengths, counts):
    out = {0}
    for n, k in zip(lengths, counts, strict=True):
        out = {x + i * n for x in out for i in range(k + 1)}
    return out


def test_knapsack_makes_the_largest_sum():
    draw = random.Random(4)
    for _ in range(300):
        lengths = np.array(draw.sample(range(1, 60), draw.randrange(1, 7)))
        counts = np.array([draw.randrange(5) for _ in lengths])
        budget = draw.randrange(200)
        picks = mixing.knapsack(lengths, counts, np.array(draw.sample(range(len(lengths)), len(lengths))), budget)
        assert (picks >= 0).all() and (picks <= counts).all()
        assert (picks * lengths).sum() == max(x for x in sums(lengths.tolist(), counts.tolist()) if x <= budget)


@pytest.mark.parametrize("table", [0, 7, 1000, 1 << 17])
def test_fitted_comes_near(table):
    draw = random.Random(5)
    for _ in range(60):
        lengths = np.array(draw.sample(range(1, 400), draw.randrange(1, 60)))
        counts = np.array([draw.randrange(1, 40) for _ in lengths])
        total = int((lengths * counts).sum())
        budget = total * draw.random()
        picks = mixing.fitted(lengths, counts, budget, "s", table)
        assert (picks >= 0).all() and (picks <= counts).all()
        off = budget - (picks * lengths).sum()
        assert -0.5 <= off < table + lengths.max()
        if table > 400 and lengths.min() < 5 and len(lengths) > 20:
            assert off < 5
    assert mixing.fitted(np.array([3, 5]), np.array([2, 2]), 16.0, "s").tolist() == [2, 2]


def plain_targets(sizes, weights=(3, 1, 2), percent=150, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, sum(sizes.values()) * percent / 100, set(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * share > most * sizes[s]}
        if not above:
            return out | {s: weight[s] * share for s in open_}
        for s in above:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= above
    return out


def corpus():
    draw = random.Random(6)
    docs = [(i, " ".join("w" * draw.choice([1, 2, 3, 5, 8, 40, 200])), draw.choice(["a", "b", "Z", "é", None, "hot", "hot", "hot"])) for i in range(600)]
    docs += [(i, "same text here", "hot") for i in range(600, 1100)] + [(5000, "x y", "a")] * 5 + [(None, "null id", "b"), (None, None, "b"), (2000, None, None), (2001, "", "a"), (2002, " \n", "empty"), (2003, "\x1c \xa0", "a")]
    return docs + [(3000, "long " * 50_000, "long")]


def test_mixed(spark):
    docs = corpus()
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, target int, n int")
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    want, source = plain_targets(sizes), {d[0]: d[2] for d in docs}
    got = mixing.mixed(frame).collect()
    assert sorted((repr(r.doc_id), r.size) for r in got) == sorted((repr(d[0]), len(WORD.findall(d[1] or ""))) for d in docs)
    taken = Counter()
    for r in got:
        s = source[r.doc_id] if r.doc_id is not None else "b"
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-12) and (r.taken % r.size == 0 and 0 <= r.taken <= 2 * r.size if r.size else r.taken == 0)
        passes = int(want[s] // sizes[s]) if sizes[s] else 0
        assert not r.size or r.taken // r.size in (passes, passes + 1)
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes if s != "long") and "empty" in sizes
    again = mixing.mixed(frame.repartition(7)).collect()
    assert Counter(map(repr, got)) == Counter(map(repr, again))
    small = mixing.mixed(frame.filter("source <> 'long'"), table=10).groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r[2] - r[1]) < 12 for r in small)
    assert mixing.mixed(frame.limit(0)).collect() == []


def test_other_weights(spark):
    docs = [(i, "w " * (i % 9), "abc"[i % 3]) for i in range(300)]
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(t.split())
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mixed(frame, weights=(1, 5), percent=40, most=1).groupBy("target").sum("taken").collect()
    want = plain_targets(sizes, (1, 5), 40, 1)
    assert sorted(r.target for r in got) == pytest.approx(sorted({round(x, 9) for x in want.values()})) and sum(r[1] for r in got) == pytest.approx(sum(sizes.values()) * 0.4, abs=5)  # one source has lengths 0, 3 and 6 alone
