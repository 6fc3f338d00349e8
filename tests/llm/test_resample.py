import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import crc, ranks, resample, skew

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_crc():
    draw = random.Random(1)
    runs = [draw.randbytes(n) for n in [0, 1, 2, 63, 64, 65, 66, 67, 500, 70_000] + [draw.randrange(90) for _ in range(300)]]
    data, ends = np.frombuffer(b"".join(runs), np.uint8), np.cumsum([len(r) for r in runs])
    starts = ends - [len(r) for r in runs]
    got = crc.crc32(data, starts, ends)
    assert got.tolist() == [zlib.crc32(r) for r in runs]
    lengths = (ends - starts)[1:]
    assert (crc.moved(got[:-1], lengths) ^ got[1:]).tolist() == [zlib.crc32(a + b) for a, b in zip(runs, runs[1:], strict=False)]
    assert len(crc.crc32(data, starts[:0], ends[:0])) == 0


def features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target, percent=5, least=20, seed=42):
    found = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    rows = []
    for (key, _), (n, f) in zip(docs, found, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * percent // 100]
    out = [(*r[:4], i + 1) for i, r in enumerate(drawn)] + [(*r[:4], None) for r in [*able[len(drawn) :], *(r for r in rows if r[4] < least)]]
    return sorted(map(repr, out))


def test_against_brute_force(spark):
    draw = random.Random(2)
    words = ["a", "Bc", "é", "ÀB", "x1", "lang" * 30, "日本", "q-r", "\x00z", "[t]", "k{l}"]
    docs = [(None if i % 50 == 7 else i, None if i % 40 == 3 else " ".join(draw.choices(words, k=draw.choice([0, 1, 2, 3, 19, 20, 21, 60])))) for i in range(300)]
    docs += [(i, docs[10][1]) for i in range(300, 500)] + [docs[11]] * 3 + [(None, "only " * 30)] * 2 + [(900, ""), (901, " \n"), (902, "w" * 200_000 + " v" * 50_000)]
    target = [docs[5][1], "a Bc é", None, "", "日本 é " * 9]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, digest int, _hot string")
    benchmark = spark.createDataFrame([(t,) for t in target], "text string")
    for percent, least in ((5, 20), (60, 1), (100, 0)):
        got = resample.resampled(frame, benchmark, percent=percent, least=least).collect()
        assert sorted(repr(tuple(r)) for r in got) == brute(docs, target, percent, least)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 20)], "doc_id long, text string")
    assert resample.resampled(none, some).collect() == []
    assert [tuple(r) for r in resample.resampled(some, none, percent=100).collect()] == [eval(x) for x in brute([(1, "a b c " * 20)], [], 100)]


def test_ranks(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), F.hash("id").alias("b"), F.lit("x").alias("_part"))
    got = ranks.ranked(rows, F.col("a"), F.col("b").desc()).collect()
    order = sorted(got, key=lambda r: r["_rank"])
    assert [r["_rank"] for r in order] == list(range(1000)) and [(r.a, -r.b) for r in order] == sorted((r.a, -r.b) for r in got)


def test_counted_lookup(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    got = skew.counted_lookup(left, right.filter("k <> 3"), ["k"], "n", 3000)
    want = {r.k: r.most for r in right.collect()}
    assert got.count() == 3000 and all(r.most == (None if r.k == 3 else want[r.k]) for r in got.collect())


def test_texts_are_not_shuffled(spark, monkeypatch):
    """Grouping full texts shuffled and wrote all of them, over an executor's memory."""
    docs = spark.createDataFrame([(i, f"some words of text {i % 3}", "other") for i in range(50)], "doc_id long, text string, source string")
    written, given = resample.storage.written, []

    def looked_at(df, name, root=None):
        given.append((name, df.columns, df._jdf.queryExecution().toString()))
        return written(df, name, root)

    monkeypatch.setattr(resample.storage, "written", looked_at)
    got = resample.resampled(docs, spark.createDataFrame([("words of",)], "text string"), least=1, percent=10)
    assert got.count() == 50 and got.filter("rank is not null").count() == 5
    assert all("text" not in columns and "Aggregate [text" not in plan and "Aggregate [coalesce(text" not in plan for _, columns, plan in given)
    assert "texts" not in [name for name, _, _ in given]
