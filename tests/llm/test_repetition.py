import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import repetition, text

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(t):
    words = WORD.findall(t or "")
    n = len(words)
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    again = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                longest[i] = max(longest[i], k)
    longest = [x if x >= repetition.MIN_WORDS else 0 for x in longest]
    cover = {j for i in range(n) for j in range(i, i + longest[i])}
    failed = n < 50 or 100 * len(again) > 50 * n
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(t.count(c) for c in "#*$%&|<>") if t else 0, "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(again), "covered_words": len(cover), "longest_repeat": max(longest, default=0), "base_failed": failed,
        "kept": not failed and len(cover) <= repetition.MAX_COVERED * n and max(longest, default=0) <= repetition.MAX_REPEAT,
    }


def texts():
    draw = random.Random(3)
    out = [None, "", " ", "\n\n", "a", "é\n\né\n é", "a\n\na\n", "x " * 120, "#|<> a\tb\x0bc\x0cd\re\x1cf\xa0g"]
    for _ in range(60):
        words = [draw.choice(["a", "b", "cé", "d", "the", "日本"]) + str(draw.randint(0, draw.choice([1, 3, 50]))) for _ in range(draw.randint(0, 90))]
        part = words[: draw.randint(0, 40)]
        out.append(draw.choice([" ", "\n", "  \t"]).join(words + part * draw.randint(0, 2) + words[5:20]))
    return out


@pytest.mark.parametrize("size", [1, 500, 1 << 20])
def test_against_brute_force(size):
    given = texts()
    column = pa.array(["skipped", *given])[1:]
    got = []
    for _, _, some in text.slices(column, size):
        v = repetition.verdicts(some)
        got += [{c: v[c][i].item() for c in v} for i in range(some.n)]
    assert got == [brute(t) for t in given]


def test_column(spark):
    rows = [(i, t, None) for i, t in enumerate(texts())] + [(5, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, quality int")
    got = sorted((r.doc_id, r.quality.n_words, r.quality.kept) for r in repetition.judged(docs).collect())
    assert got == sorted((i, brute(t)["n_words"], brute(t)["kept"]) for i, t, _ in rows)
    assert repetition.judged(docs.limit(0)).filter(F.col("quality.kept")).collect() == []
