"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased words without punctuation at their ends, both by Unicode (see ``normal``). Documents are read once: a bitmap of fixed size, made from the
benchmark's five-word seeds, leaves the stretches of a document whose every seed may be shared, and these are written. Their seeds
are joined with the benchmark's, with the places that these have in items. Tiles of five words or more cover no more of an item than the spans at those places
do together, so documents and items that share less than a leak covers are left out. Seeds of more than ``HOT`` items are not joined where an item's other seeds
must be met as well: an item leaves out the most frequent ones as long as they cover too little of it by themselves, and its pairs are then held to what those and the seeds met
cover. For each of the others greedy string tiling marks the longest matches of five words
or more that do not overlap, found by running Karp-Rabin, until none is left. An item is in a document if the tiles cover ``COVERED``
of its words; tiles may lie in any order, so reordered passages count.

Defined results: null and empty texts, and items of fewer than five words, share nothing; items of one id (or none: null) with different words are told
apart and found each, those with the same words once; rows
of one key with different texts are judged apart, and give a row each; rows alike in key and text give one row together; a document's length does not matter; an empty table on
either side gives no rows; other columns of documents do not matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import storage
from .skew import counted_lookup
from .text import Texts, slices, windows

SEED, COVERED = 5, 0.5
HOT, SALTS = 16, 16  # items that have a seed, from which on it is left out where it can be; parts of the documents that ask for it where it cannot
BITS = 1 << 22, 1 << 28  # of the bitmap, at least and at most; 32 for each of the benchmark's seeds in between
BITMAPS = 16  # partitions whose bitmaps the driver unites
BASE, PRIME = 1_000_003, (1 << 61) - 1
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


#: Punctuation and symbols of any script, and spaces that do not break, at a word's ends; ``words`` takes ASCII's off.
_MARKS, _SPACES = r"[\p{P}\p{S}\u00a0\u202f\u2007\u2060\ufeff]", r" \t\n\x0B\f\r"
ENDS = rf"(?<![^{_SPACES}]){_MARKS}++|(?<!{_MARKS}){_MARKS}++(?![^{_SPACES}])"


def normal(text: Column) -> Column:
    """text without case (upper-cased first, as one letter may become two; Spark makes lower(upper()) one call unless another is between) or marks at the ends of words. ASCII texts are left to ``words``."""
    return F.when(F.octet_length(text) > F.length(text), F.lower(F.regexp_replace(F.upper(text), ENDS, ""))).otherwise(text)


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, documents) of the lower-cased words, without punctuation at their ends; words of nothing else are left out."""
    starts, ends, docs = texts.spans()
    starts, ends = starts.copy(), ends.copy()
    while len(at := np.flatnonzero((ends > starts) & PUNCTUATION[texts.data[np.maximum(ends - 1, 0)]] & (ends > starts))):
        ends[at] -= 1
    while len(at := np.flatnonzero((ends > starts) & PUNCTUATION[texts.data[np.minimum(starts, len(texts.data) - 1)]])):
        starts[at] += 1
    full = ends > starts
    return texts.hashes(starts[full], ends[full], True), docs[full]


def seeds_of(values: np.ndarray) -> np.ndarray:
    return windows(values, np.zeros(len(values), np.int64), SEED, 1)[0]


def items_of(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """(ident, item, words, seeds) of the items that have a seed, each once; words and seeds are hashes, ident is one of id and words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in slices(batch.column(1)):
                value, docs = words(texts)
                cuts = np.searchsorted(docs, np.arange(to - at + 1))
                parts = [value[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                kept = [i for i, p in enumerate(parts) if len(p) >= SEED]
                lists = lambda found: pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([at + i for i in kept], pa.int64())), lists([parts[i] for i in kept]), lists([seeds_of(parts[i]) for i in kept])], ["item", "words", "seeds"])

    kind = dict(benchmark.dtypes)[key]
    items = benchmark.select(F.col(key).alias("item"), normal(F.col(text)).alias("text")).mapInArrow(hashed, f"item {kind}, words array<long>, seeds array<long>")
    return items.withColumn("ident", F.xxhash64(F.col("item").isNull(), "item", "words")).dropDuplicates(["ident"])


def places_in(seeds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(byte, bit in it) of each seed in a packed bitmap of so many bits."""
    at = seeds % np.uint64(size)
    return at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)


def bitmap(items: DataFrame) -> np.ndarray:
    """Packed bits: which seeds there are, mod the number of bits."""
    seeds = items.agg(F.sum(F.size("seeds"))).first()[0] or 0
    size = min(BITS[1], max(BITS[0], 1 << (32 * seeds).bit_length()))

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            byte, bit = places_in(np.asarray(batch.column(0).flatten()).view(np.uint64), size)
            np.bitwise_or.at(bits, byte, bit)
        yield pa.RecordBatch.from_pydict({"bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros(size // 8, np.uint8)
    for row in items.select("seeds").coalesce(BITMAPS).mapInArrow(united, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
    return out


def stretches(docs: DataFrame, key: str, text: str, bits: np.ndarray) -> DataFrame:
    """(key, row, no, words): the stretches of each document all of whose seeds are in the bitmap; row is a hash of the text."""
    shared = storage.broadcast(docs.sparkSession, bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = shared.value
        for batch in batches:
            for at, _, texts in slices(batch.column(2)):
                value, docs = words(texts)
                seeds, _, first = windows(value, docs, SEED, texts.n)
                byte, bit = places_in(seeds, 8 * len(there))
                hits = first[(there[byte] & bit) > 0]
                if not len(hits):
                    continue
                begins = np.concatenate(([True], (hits[1:] != hits[:-1] + 1) | (docs[hits[1:]] != docs[hits[:-1]])))
                starts = hits[begins]
                sizes = np.append(hits[:-1][begins[1:]], hits[-1]) + SEED - starts
                ends = np.cumsum(sizes)
                flat = value[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])].view(np.int64)
                which = pa.array(at + docs[starts])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(starts), pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat))], ["key", "row", "no", "words"])

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text, F.length(text)).alias("row"), normal(F.col(text)).alias("text"))
    return rows.mapInArrow(cut, f"key {dict(rows.dtypes)['key']}, row long, no long, words array<long>")


def scan(a: list[int], free_a: list[bool], b: list[int], free_b: list[bool], size: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Matches of free words, ``size`` long at least and as long as can be, by rolling hashes; stops at one over twice as long."""
    top, table = pow(BASE, size, PRIME), defaultdict(list)

    def rolled(values: list[int], free: list[bool]) -> Iterator[tuple[int, int]]:
        h = run = 0
        for i, x in enumerate(values):
            if not free[i]:
                h = run = 0
                continue
            h, run = (h * BASE + x) % PRIME, run + 1
            if run > size:
                h = (h - values[i - size] * top) % PRIME
            if run >= size:
                yield h, i - size + 1

    for h, i in rolled(a, free_a):
        table[h].append(i)
    longest, found = 0, []
    for h, j in rolled(b, free_b):
        for i in table.get(h, ()):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                k += 1
            if k >= size:
                longest = max(longest, k)
                found.append((k, i, j))
                if k > 2 * size:
                    return longest, found
    return longest, found


def tiles(a: list[int], b: list[int], least: int = SEED, stops: frozenset[int] = frozenset()) -> list[tuple[int, int, int]]:
    """(start in a, start in b, words) of greedy string tiling. stops: places in a that match nothing, between stretches."""
    free_a, free_b, out, size = [i not in stops for i in range(len(a))], [True] * len(b), [], max(least, 20)
    while True:
        longest, found = scan(a, free_a, b, free_b, size)
        if longest > 2 * size:
            size = longest
            continue
        for k, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_a[i : i + k]) and all(free_b[j : j + k]):
                free_a[i : i + k] = free_b[j : j + k] = [False] * k
                out.append((i, j, k))
            elif k > size:  # partly taken: what is left of it may still be long
                size_left = max((len(run) for run in _free_runs(free_a[i : i + k], free_b[j : j + k])), default=0)
                if size_left >= size:
                    break
        else:
            if size == least:
                return out
            size = max(least, size // 2)


def _free_runs(a: list[bool], b: list[bool]) -> list[list[int]]:
    runs, run = [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x and y:
            run.append(i)
        elif run:
            runs.append(run)
            run = []
    return [*runs, run] if run else runs


def reach(stretches: list[list[int]], own: list[int]) -> int:
    """Words of an item that lie in one of its seeds that the stretches have too: no tiles cover more."""
    seeds = lambda x: seeds_of(np.array(x, np.int64).view(np.uint64))
    hits = np.flatnonzero(np.isin(seeds(own), np.concatenate([seeds(x) for x in stretches])))
    covered = np.zeros(len(own), bool)
    for k in range(SEED):
        covered[hits + k] = True
    return int(covered.sum())


def spans(places: Column) -> Column:
    """The number of words in the five-word spans at these places."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + SEED - 1)))))


def asked_for(items: DataFrame, least: float) -> DataFrame:
    """(ident, item, words, kept array<struct<seed, items, places>>, left array<int>): seeds that documents are asked for, and places of those left out, which cover less than ``least``."""
    own = items.select("ident", F.posexplode("seeds").alias("place", "seed")).groupBy("ident", "seed").agg(F.sort_array(F.collect_list("place")).alias("places"))
    own = storage.written(own, "item-seeds")
    frequent = own.groupBy("seed").agg(F.count("*").alias("items")).withColumn("n", F.col("items"))
    own = counted_lookup(own, frequent, ["seed"], "n", own.count()).groupBy("ident").agg(F.collect_list(F.struct("seed", "items", "places")).alias("own"))
    hot = HOT

    @F.arrow_udf("array<int>")
    def left(own: pa.Array, n_words: pa.Array) -> pa.Array:
        out = []
        for seeds, n in zip(own.to_pylist(), n_words.to_pylist(), strict=True):
            covered, places = set(), []
            for x in sorted((x for x in seeds if x["items"] > hot), key=lambda x: (-x["items"], x["places"])):
                more = covered.union(*(range(p, p + SEED) for p in x["places"]))
                if len(more) / n < least:
                    covered, places = more, places + x["places"]
            out.append(places)
        return pa.array(out, pa.list_(pa.int32()))

    found = items.join(own, "ident").withColumn("left", left("own", F.size("words")))
    kept = F.filter("own", lambda x: ~F.array_contains(F.col("left"), F.element_at(x["places"], 1)))
    return found.select("ident", "item", "words", kept.alias("kept"), "left")


def candidates(items: DataFrame, parts: DataFrame, least: float) -> DataFrame:
    """(key, row, ident, item, words): pairs of stretches (see ``stretches``) and items whose shared seeds may cover ``least`` of the item."""

    @F.arrow_udf("array<bigint>")
    def seeds(column: pa.Array) -> pa.Array:
        return pa.array([np.unique(seeds_of(np.array(x, np.int64).view(np.uint64)).view(np.int64)) for x in column.to_pylist()], pa.list_(pa.int64()))

    asked = storage.written(parts.select("key", "row", F.explode(seeds("words")).alias("seed")).distinct(), "asked")
    chosen = storage.written(asked_for(items, least), "asked-for")
    places = chosen.select("ident", F.explode("kept").alias("k")).select("ident", "k.*")
    few = places.filter(F.col("items") <= HOT).groupBy("seed").agg(F.collect_list(F.struct("ident", "places")).alias("own"))  # HOT at most
    few = few.join(asked.groupBy("seed").agg(F.count("*").alias("n")), "seed")
    met = counted_lookup(asked, few, ["seed"], "n", asked.count()).filter("own is not null").select("key", "row", F.inline("own"))
    many = places.filter(F.col("items") > HOT).select("seed", "ident", "places", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = asked.withColumn("salt", F.pmod(F.xxhash64("key", "row"), F.lit(SALTS)).cast("int"))
    met = met.unionByName(salted.join(many, ["seed", "salt"]).select("key", "row", "ident", "places"))
    pairs = storage.written(met.groupBy("key", "row", "ident").agg(F.flatten(F.collect_list("places")).alias("places")), "met")  # an item's places at most
    needed = chosen.select("ident", "item", "words", "left").join(pairs.groupBy("ident").agg(F.count("*").alias("n")), "ident")
    found = counted_lookup(pairs, needed, ["ident"], "n", pairs.count())
    return found.filter(spans(F.concat("places", "left")) / F.size("words") >= least).select("key", "row", "ident", "item", "words")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: float = COVERED) -> DataFrame:
    """(key, item, item_words, covered_words, n_tiles, coverage) of each document that holds an item. What it writes on the way is deleted."""

    @F.arrow_udf("struct<covered:long,n:long>")
    def tiled(parts: pa.Array, words: pa.Array) -> pa.Array:
        covered, n = [], []
        for stretch, own in zip(parts.to_pylist(), words.to_pylist(), strict=True):
            a, stops = [], set()
            for s in stretch:
                a += [*s, 0]
                stops.add(len(a) - 1)
            found = tiles(a, own, SEED, frozenset(stops)) if reach(stretch, own) / len(own) >= least else []
            covered.append(sum(k for _, _, k in found))
            n.append(len(found))
        return pa.StructArray.from_arrays([pa.array(covered, pa.int64()), pa.array(n, pa.int64())], ["covered", "n"])

    with storage.scratch(docs.sparkSession) as keep:
        items = storage.written(items_of(benchmark, item, item_text), "items")
        parts = storage.written(stretches(docs, key, text, bitmap(items)).dropDuplicates(["key", "row", "no"]), "stretches")
        pairs = storage.written(candidates(items, parts, least), "pairs").alias("m")
        whole = parts.groupBy("key", "row").agg(F.sort_array(F.collect_list(F.struct("no", "words"))).alias("parts")).alias("p")
        found = pairs.join(whole, F.expr("m.key <=> p.key and m.row = p.row")).select("m.key", "m.item", "m.words", F.col("p.parts.words").alias("parts"))
        found = found.withColumn("tiled", tiled("parts", "words"))
        found = found.select(F.col("key").alias(key), F.col("item").alias(item), F.size("words").cast("long").alias("item_words"), F.col("tiled.covered").alias("covered_words"), F.col("tiled.n").alias("n_tiles"))
        return keep(found.withColumn("coverage", F.col("covered_words") / F.col("item_words")).filter(F.col("coverage") >= least), "leaks")
