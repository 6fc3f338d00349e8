"""URL filters: rules by host and path, and for the rest naive Bayes over the words of names.

Names are the letter runs of a host's labels and of a path. Each distinct name is split into words by a unigram Viterbi:
its substrings of ``LONGEST`` letters or fewer are joined with the word counts of running text, and the best split is folded
over the name's edges. Multinomial naive Bayes learns from the urls that a rule judges, about ``SAMPLE`` for each verdict (those of smallest hash), but
for the held-out ones (crc32 of the url mod 4 is 2). Names that stand in a rule are no features, neither in learning nor in scoring: what they say is
the rules' own, and only what goes with them can carry over to urls without a rule. Such a url is blocked if its words
speak for that. Words that were not learned say nothing. Names in many urls are scored once; look-ups send what a few keys hold by broadcast.

Defined results: a null url, or one without ``://``, has an empty host and path and no words, and is judged by the prior alone;
an unknown name is one word; names with no letter have no words; equal scores are allowed; urls that repeat are judged alike, and learned from once;
without labelled urls every score is 0; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import storage
from .skew import lookup

LONGEST = 20  # letters of a word at most
SMOOTHING = 1.0
SAMPLE = 20_000  # urls of a verdict that are learned from, about
BLOCK, ALLOW = "block", "allow"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits a host (subdomains too) and path, or null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def names_in(text: Column) -> Column:
    """The lower-cased letter runs of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, n) over all of a column of HTML or plain text, markup left out."""
    plain = F.regexp_replace(F.col(column), r"(?s)<(script|style)\b.*?</\1\s*>|<[^>]*>|&\w+;", " ")
    return texts.select(F.explode(names_in(plain)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words array<string>) for each row of names (name string, distinct, not empty)."""
    total = math.log((counts.agg(F.sum("n")).first()[0] or 0) + 1)
    size = F.length("name")
    lattice = names.select("name", F.explode(F.sequence(F.lit(1), size)).alias("start"), size.alias("size"))
    lattice = lattice.select("name", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.col("size") - F.col("start") + 1))).alias("length"))
    lattice = lattice.select("name", "start", F.expr("substring(name, start, length)").alias("word"))
    edges = lookup(lattice, counts, "word").filter("n is not null").select("name", F.struct("start", F.length("word").alias("length"), F.log("n").alias("score")).alias("edge"))
    grouped = edges.groupBy("name").agg(F.collect_list("edge").alias("edges"))  # LONGEST x length of the name at most

    @F.pandas_udf("array<string>")
    def best(name: pd.Series, edges: pd.Series) -> pd.Series:
        return pd.Series([viterbi(n, [] if e is None else [(x["start"] - 1, x["length"], x["score"] - total) for x in e], -total) for n, e in zip(name, edges, strict=True)])

    return names.select("name").join(grouped, "name", "left").select("name", best("name", "edges").alias("words"))


def viterbi(name: str, edges: list[tuple[int, int, float]], unknown: float) -> list[str]:
    """The most likely split; letters in no known word cost ``unknown`` - 3 each and stay together. Ties: fewer words, then the longer first word."""
    n, by_end = len(name), {}
    for start, length, score in edges:
        by_end.setdefault(start + length, []).append((start, score, True))
    best = [(0.0, 0, 0, True)]  # score, -words, start of the last word, known
    for end in range(1, n + 1):
        ways = [(end - 1, unknown - 3, False), *by_end.get(end, ())]
        best.append(max((best[s][0] + x, best[s][1] - 1, s, known) for s, x, known in ways))
    cuts, end = [], n
    while end:
        _, _, start, known = best[end]
        if cuts and not known and not cuts[-1][2]:
            cuts[-1] = (start, cuts[-1][1], False)
        else:
            cuts.append((start, end, known))
        end = start
    return [name[a:b] for a, b, _ in reversed(cuts)]


def held_out(url: Column) -> Column:
    return F.crc32(F.encode(url, "UTF-8")) % 4 == 2


def rule_names(rules: list[Rule]) -> list[str]:
    """The letter runs of the rules' hosts and paths, lower-cased."""
    return sorted({name for rule in rules for name in re.findall(r"[^\W\d_]+", rule.text.lower())})


def learned(labelled: DataFrame, used: DataFrame, split: DataFrame) -> tuple[DataFrame, float]:
    """((word, odds), prior): log-odds of blocked against allowed for each word of the labelled urls (url, verdict), and of the prior.

    used: (url, name), once for each place; split: (name, words). The sample is taken first, so its few urls bound the joins.
    """
    n = {BLOCK: 0, ALLOW: 0} | {r["verdict"]: r["n"] for r in labelled.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("verdict") == BLOCK, SAMPLE / max(n[BLOCK], 1)).otherwise(SAMPLE / max(n[ALLOW], 1))
    sample = labelled.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < share * (1 << 30))
    names = used.join(sample, "url").groupBy("name", "verdict").agg(F.count("*").alias("n"))
    each = names.join(split, "name").select(F.explode("words").alias("word"), "verdict", "n")
    side = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v)
    counts = storage.written(each.groupBy("word").agg(side(BLOCK), side(ALLOW)), "url-words")
    all_ = counts.agg(F.sum(BLOCK).alias(BLOCK), F.sum(ALLOW).alias(ALLOW), F.count("*").alias("words")).first()
    log_share = lambda v: F.log((F.col(v) + SMOOTHING) / ((all_[v] or 0) + SMOOTHING * (all_["words"] + 1)))
    return counts.select("word", (log_share(BLOCK) - log_share(ALLOW)).alias("odds")), math.log(max(n[BLOCK], 1) / max(n[ALLOW], 1))


def judged(pages: DataFrame, counts: DataFrame, rules: list[Rule], url: str = "url", name: str = "filter") -> DataFrame:
    """pages with a struct column ``name`` (host, path, rule, verdict, score); a column of that name is replaced.

    counts: (word, n) of running text. score: log-odds of blocked against allowed.
    """
    counts = storage.written(counts, "word-counts")
    urls = storage.written(pages.select(F.col(url).alias("url")).filter("url is not null").distinct(), "urls")
    used = urls.select("url", F.explode(names_in(F.concat_ws(" ", host_of(F.col("url")), path_of(F.col("url"))))).alias("name"))
    used = storage.written(used.filter(~F.col("name").isin(rule_names(rules))), "url-names")
    split = storage.written(segmented(used.select("name").distinct(), counts), "split-names")
    labelled = urls.select("url", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("verdict")).filter(~held_out(F.col("url")) & F.col("verdict").isNotNull())
    odds, prior = learned(labelled, used, split)
    names = lookup(split.select("name", F.explode("words").alias("word")), odds, "word").groupBy("name").agg(F.sum("odds").alias("odds"))
    scores = lookup(used, names, "name").groupBy("url").agg(F.sum("odds").alias("score"))
    rows = pages.withColumn(name, F.struct(F.col(url).alias("url"), F.struct(*(F.col(c) for c in pages.columns)).alias("row")))
    found = lookup(rows.select(F.col(f"{name}.url").alias("url"), F.col(f"{name}.row").alias("row")), scores, "url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    score = F.coalesce("score", F.lit(0.0)) + F.lit(prior)
    rule = rule_of(host, path, rules)
    verdict = F.coalesce(rule["verdict"], F.when(score > 0, BLOCK).otherwise(ALLOW))
    struct = F.struct(host.alias("host"), path.alias("path"), rule["rule"].alias("rule"), verdict.alias("verdict"), score.alias("score"))
    return found.select(*(F.col("row").getField(c).alias(c) for c in pages.columns if c != name), struct.alias(name))
