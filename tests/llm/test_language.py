import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import language

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return language.fit(docs.filter(language.fold(F.col("doc_id")) != 2), F.col("doc_id"), 60)


def test_held_out_accuracy(spark, model):
    held = spark.read.parquet(f"{SF}/documents.parquet").filter(language.fold(F.col("doc_id")) == 2)
    got = language.identified(held, model).select("lang", "language.*", "text").toDF("lang", "guess", "score", "text").collect()
    assert sum(r.lang == r.guess for r in got) >= 0.95 * len(got) > 100
    assert all(0 <= r.score <= 1 for r in got)


def brute(texts, langs, asked):
    """Naive Bayes by dictionaries over the same hashed features."""
    counts, prior = {x: Counter() for x in langs}, Counter(langs)
    for t, lang in zip(texts, langs, strict=True):
        _, found, times = language.features([t])
        counts[lang].update(dict(zip(found.tolist(), times.tolist(), strict=True)))
    _, found, times = language.features([asked])
    sums = {}
    for lang, c in counts.items():
        total = sum(c.values()) + language.SMOOTHING * language.FEATURES
        sums[lang] = math.log(prior[lang] / len(langs)) + sum(n * math.log((c[f] + language.SMOOTHING) / total) for f, n in zip(found.tolist(), times.tolist(), strict=True))
    best = max(sorted(sums), key=sums.get)
    return best, 1 / sum(math.exp(v - sums[best]) for v in sums.values())


def test_against_brute_force(spark):
    texts, langs = ["the cat and", "le chat et", "the dog", "la souris été"], ["en", "fr", "en", "fr"]
    rows = spark.createDataFrame([(i, t, x, "y") for i, (t, x) in enumerate(zip(texts, langs, strict=True))] + [(9, None, "xx", None), (10, "zz", None, None)], "doc_id long, text string, lang string, language string")
    own = language.fit(rows, F.col("doc_id"))
    asked = [(1, "the rat"), (2, "et la"), (3, None), (4, ""), (5, "12 ?"), (5, "12 ?"), (6, "x"), (7, "the " * 100_000), (8, "日本 ß")]
    got = {r.doc_id: r.language for r in language.identified(spark.createDataFrame(asked, "doc_id long, text string"), own).collect()}
    for i, t in asked:
        if not any(c.isalpha() for c in t or ""):
            assert tuple(got[i]) == ("und", 0.0)
        else:
            lang, score = brute(texts, langs, t)
            assert got[i].lang == lang and abs(got[i].score - score) < 1e-9


def test_ngrams_stay_in_their_document():
    together, apart = language.features(["ab", "", "cd"]), [language.features([t]) for t in ("ab", "", "cd")]
    assert np.array_equal(together[1], np.concatenate([a[1] for a in apart])) and together[2].sum() == 6


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    own = language.fit(empty, F.col("doc_id"))
    assert language.identified(empty, own).collect() == []
    assert own.guess(["a", None]) == [("und", 0.0), ("und", 0.0)]
