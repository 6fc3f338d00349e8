import itertools
import math
import random
import re
import zlib

import pytest

from pagewright.llm import urls
from pagewright.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, html string, filter string, name string"
URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG", "https://x.example.org/es/1?x#y", "https://example.org/es", "http://example.org/en/12", "http://badexample.org/en/1",
        "http://m.example.com/fr/1", "http://www.example.com/de/1", "http://cheappills.example.net/x", "http://a.net?u=://b.org/z", "http://citylibrary.example.net/about#x", "http://FreeBets.io", "http://日本.jp/é/2", "http://a.net/" + "q" * 3000]


def brute_rule(url, rules=URL_RULES):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text), default=None)


def run(spark, rows):
    pages = spark.createDataFrame(rows, SCHEMA)
    return urls.judged(pages, urls.word_counts(pages, "html"), URL_RULES).collect()


def test_judged(spark):
    rows = [(i, u, "<p>the city library</p><script>x</script> cheap pills", "z", None) for i, u in enumerate(URLS)]
    rows += [(100, URLS[11], None, None, None), (100, URLS[11], None, None, None), (None, URLS[11], "", None, None)]
    got = run(spark, rows)
    assert len(got) == len(rows)
    for r in got:
        host, path, rule = brute_rule(r.url)
        assert (r["filter"].host, r["filter"].path, r["filter"].rule) == (host, path, rule and rule.text)
        if rule:
            assert r["filter"].verdict == rule.verdict
    want = brute_scores({u for u in URLS if u is not None}, ["the", "city", "library", "cheap", "pills"], len(URLS), URL_RULES)
    assert all(abs(r["filter"].score - want[r.url]) < 1e-9 for r in got)
    assert all(r["filter"].verdict == ("block" if want[r.url] > 0 else "allow") for r in got if not r["filter"].rule)


def plain_split(name, counts):
    """The best split, found from the name's end to its start."""
    total, size = math.log(sum(counts.values()) + 1), len(name)
    best = [(0.0, 0, 0, True)] * (size + 1)  # score, -words, next place, known
    for i in reversed(range(size)):
        ways = [(best[i + 1][0] - total - 3, best[i + 1][1] - 1, i + 1, False)]
        for k in range(i + 1, min(i + 20, size) + 1):
            if name[i:k] in counts:
                ways.append((best[k][0] + math.log(counts[name[i:k]]) - total, best[k][1] - 1, k, True))
        best[i] = max(ways, key=lambda w: w[:2])
    words, at, run = [], 0, False
    while at < size:
        _, _, after, known = best[at]
        if run and not known:
            words[-1] += name[at:after]
        else:
            words.append(name[at:after])
        at, run = after, not known
    return words


def brute_scores(given, words, times, rules):
    """The score of each url, and of None, by plain loops."""
    counts = {w: times for w in words}
    own = {n for r in rules for n in re.findall(r"[^\W\d_]+", r.host + r.path)}

    def words_of(url):
        host, path, _ = brute_rule(url, rules)
        return [w for name in re.findall(r"[^\W\d_]+", f"{host} {path}".lower()) if name not in own for w in plain_split(name, counts)]

    n, seen = {"block": 0, "allow": 0}, {"block": [], "allow": []}
    for url in given:
        rule = brute_rule(url, rules)[2]
        if rule and zlib.crc32(url.encode()) % 4 != 2:
            n[rule.verdict] += 1
            seen[rule.verdict] += words_of(url)
    vocabulary = {*seen["block"], *seen["allow"]}
    share = lambda v, w: math.log((seen[v].count(w) + 1) / (len(seen[v]) + len(vocabulary) + 1))
    prior = math.log(max(n["block"], 1) / max(n["allow"], 1))
    return {None: prior} | {u: prior + sum(share("block", w) - share("allow", w) for w in words_of(u) if w in vocabulary) for u in given}


def test_what_is_learned_carries_over(spark):
    """Rules know two hosts; the words that go with them are found in run-together names of other hosts, and held-out urls are judged right without the rules' words."""
    draw = random.Random(4)
    bad, good, both = "casino bets pills loan".split(), "library museum school recipes".split(), "city online best my".split()
    rules = [urls.Rule("block", "farm.test"), urls.Rule("allow", "trust.test", "/en/")]
    name = lambda own: draw.choice(both) + draw.choice(own) + draw.choice(both)
    given = {f"http://{name(bad)}.farm.test/{i}" for i in range(300)} | {f"https://www.trust.test/en/{name(good)}/{i}" for i in range(300)}
    others = {f"http://{name(own)}.io/{i}": v for v, own in (("block", bad), ("allow", good)) for i in range(60)}
    html = "<p>" + " ".join(bad + good + both) + "</p>"
    pages = spark.createDataFrame([(i, u, html) for i, u in enumerate(sorted(given | set(others)))], "page_id long, url string, html string")
    got = {r.url: r["filter"] for r in urls.judged(pages, urls.word_counts(pages, "html"), rules).collect()}
    want = brute_scores(given | set(others), bad + good + both, len(got), rules)
    assert all(abs(f.score - want[u]) < 1e-9 for u, f in got.items())
    assert all(got[u].rule is None and got[u].verdict == v for u, v in others.items())
    held = [u for u in given if zlib.crc32(u.encode()) % 4 == 2]
    assert len(held) > 100 and all((got[u].score > 0) == (got[u].verdict == "block") for u in held)


def test_empty(spark):
    assert run(spark, []) == []


def test_word_counts(spark):
    got = urls.word_counts(spark.createDataFrame([("<style>p{}</style><p>Été the&amp;the x1</p>",), (None,), ("",)], "html string"), "html")
    assert {r.word: r.n for r in got.collect()} == {"été": 1, "the": 2, "x": 1}


@pytest.mark.parametrize("name", ["abcab", "abx", "xyz", "a", "ababab"])
def test_viterbi_against_all_splits(spark, name):
    counts = {"a": 5, "ab": 7, "abc": 1, "b": 2, "ca": 3}
    total = math.log(sum(counts.values()) + 1)

    def score(parts):
        return sum(math.log(counts[p]) - total if p in counts else len(p) * (-total - 3) if len(p) == 1 else -1e9 for p in parts)

    splits = [[name[a:b] for a, b in itertools.pairwise([0, *cut, len(name)])] for k in range(len(name)) for cut in itertools.combinations(range(1, len(name)), k)]
    best = max(score(s) for s in splits)
    rows = spark.createDataFrame([(name,)], "name string")
    words = urls.segmented(rows, spark.createDataFrame(list(counts.items()), "word string, n long")).first().words
    parts = [p for w in words for p in ([w] if w in counts else list(w))]
    assert "".join(words) == name and abs(score(parts) - best) < 1e-9
