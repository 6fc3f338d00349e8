import hashlib
import random
import re
import zlib
from collections import defaultdict

from pagewright.llm import trie

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth int, owner string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).digest(), text or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * (len(WORD.findall(node[-1][1])) if node else 0)
    out = []
    for node, found in members.items():
        ended = ",".join(str(c) for c in found if len(whole[c]) == len(node))
        out.append((found[0], len(node), members[node[:-1]][0] if node else None, len(found), len(children[node]), leaves[node], saved[node], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(map(repr, out))


def talks():
    draw = random.Random(8)
    beginnings = [[("user", draw.choice(["hi there", "", "é ü", None]))] * draw.randrange(4) for _ in range(6)]
    rows = []
    for c in [*range(120), 205, 220, 1_000_007, *range(3000, 3100)]:
        if c in (40, 60):
            continue  # families without a first
        turns = [*draw.choice(beginnings), *[(draw.choice(["user", "assistant", None]), draw.choice(["a b", "c", "d e  f", ""])) for _ in range(draw.randrange(1, 6))]]
        rows += [(c, None if i == 0 and c % 7 == 0 else i * 2, *t) for i, t in enumerate(turns)]
    rows += [(5000 + i, 0, "user", "one") for i in range(40)] + [(6000 + i, k, "user", f"same {k}") for i in range(60) for k in range(3)]  # many without turns or alike
    rows += [(7001, i, "user", f"long {i // 3}") for i in range(90)] + [(7002, i, "user", f"long {i // 3}") for i in range(70)]
    rows += [(8000, 1, "user", "tie a"), (8000, 1, "user", "tie b"), (8000, 1, "bot", "tie a"), (8000, 1, "user", "tie a"), (None, 0, "user", "no id"), (None, 1, None, None)]
    return [(*r, 3, "x") for r in rows]


def test_against_brute_force(spark, monkeypatch):
    rows = talks()
    frame = spark.createDataFrame(rows, SCHEMA)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    for block, piece in ((trie.BLOCK, trie.PIECE), (4, 3)):
        monkeypatch.setattr(trie, "BLOCK", block)
        monkeypatch.setattr(trie, "PIECE", piece)
        got = trie.prefix_trie(frame.repartition(5)).select(*columns).collect()
        assert sorted(repr(tuple(r)) for r in got) == brute(rows)


def test_small_tables(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    for rows in ([(3, 0, "user", "gone", 1, "")], [(20, None, None, None, 1, "")], [(None, 1, "user", "x", 1, "")]):
        got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted(repr(tuple(r)) for r in got) == brute(rows)
