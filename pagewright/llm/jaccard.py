"""N-gram Jaccard join with set-relation skipping: links between texts whose word n-gram sets are alike.

Texts with equal sets are one class from the start. A class's n-grams are put in one order for all (the more texts have them the later,
then by hash), and two classes can be linked only if the first (1 - t) * size + 1 of both share one (prefix filter). An index list has the
classes that share one such n-gram, by set size and by position in the prefix.

*Lists skipped by blocks.* A class looks only at the block of sizes that can reach the threshold, and within it skips the
positions from which too few n-grams are left. What is left is held against parity bitmaps (each n-gram flips one bit; two sets differ in as many
n-grams at least as their bitmaps do in bits), which leave out pairs without sets being sent. Lists of ``SHORT`` classes or fewer give their pairs so.

*Answers derived from a similar set's.* In a longer list leaders are chosen until each class that may have a link is led by one it may be linked with. What two
classes linked with one leader have in common with each other is not asked: they are in its component; where links are asked for they are counted from the n-grams in which
the two differ from the leader, in blocks of members. Lists over ``TOGETHER`` classes get their leaders by aggregation, and only these are compared with all. A class
linked with such a leader can be linked only with what is near it (1 - 2 * (1 - t) or more alike, as the Jaccard distance is a metric); those links are
derived from differences from the leader, without the sets: see ``difference_links``. What is far from the leaders goes on to the next round.

N-grams and sets are told apart by 64-bit hashes. Defined results: null, empty and blank texts have no n-gram and no link; a text with fewer words than
an n-gram has its whole word sequence as the one; the smallest key counts, null keys only where there is no other; rows alike
are all returned; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import storage
from .components import components
from .lattice import frequent
from .skew import lookup
from .text import Texts, mix, slices, windows

HEAVY = 1 << 19  # n-grams that count as heavy, at most; an order alone depends on them
HEAVY_SLICE, HEAVY_LOCAL, HEAVY_TEXTS = 1 << 22, 2, 16  # bytes looked at together, texts there and texts in all from which on an n-gram may be heavy
BATCH, ENTRY_BATCH = 2000, 1 << 16  # rows sent to Python at once: texts, index entries
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SHORT = 8  # classes of a list up to which its pairs are looked at
TOGETHER = 128  # classes of a list up to which a task chooses all its leaders; a longer one gets 1, 4, 16 ... in a round, by aggregation
NEAR, NEAR_ROUNDS = 256, 3  # classes that may share a difference from a leader to be compared by it; rounds for which that holds
LEAST_BITS, MOST_BITS = 64, 1 << 16  # of a class's parity bitmap
BLOCK, COLUMNS = 512, 4096  # members compared with as many at once to count links; differences looked at together
NEEDED_BITS = 1 << 20, 1 << 27  # of the bitmap of classes whose sets are needed, at least and at most
BROADCAST = 1 << 18  # class numbers that are broadcast, at most


def grams(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram hashes, documents), by document and hash."""
    starts, ends, docs = texts.spans()
    words = texts.hashes(starts, ends, True)
    value, of, _ = windows(words, docs, width, texts.n)
    count = np.bincount(docs, minlength=texts.n)
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        cuts = np.searchsorted(docs, few)
        whole = np.zeros(len(few), np.uint64)
        for k in range(width - 1):
            there = k < count[few]
            whole[there] = mix(whole[there] * np.uint64(0x9E3779B97F4A7C15) + words[cuts[there] + k] + np.uint64(width))
        value, of = np.concatenate((value, whole)), np.concatenate((of, few))
        order = np.argsort(of, kind="stable")
        value, of = value[order], of[order]
    for at, to in pairwise(np.searchsorted(of, np.arange(texts.n + 1)).tolist()):
        value[at:to].sort()  # a document is sorted by itself, which takes less than a sort of all by two keys
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[new], of[new]


def signatures(value: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, size, first place) of each document's set; the class is a hash of the set, 0 for the empty one."""
    cuts = np.searchsorted(of, np.arange(n + 1))
    size = np.diff(cuts)
    out, full = np.zeros(n, np.uint64), np.flatnonzero(size)
    if len(full):
        added = np.add.reduceat(mix(value + np.uint64(7)), cuts[full])
        crossed = np.bitwise_xor.reduceat(mix(value ^ np.uint64(0x5851F42D4C957F2D)), cuts[full])
        out[full] = mix(mix(added) + crossed + size[full].astype(np.uint64)) >> np.uint64(1)
    return out.astype(np.int64), size, cuts


def parities(value: np.ndarray, of: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each document's parity bitmap: about two bits for each n-gram, a power of two of them; none where size is 0."""
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    bits[size == 0] = 0
    offsets = np.concatenate(([0], np.cumsum(bits)))
    value, of = value[bits[of] > 0], of[bits[of] > 0]
    place = offsets[of] + (value & (bits[of] - 1).astype(np.uint64)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=offsets[-1]) & 1), offsets // 8


def ordered(value: np.ndarray, of: np.ndarray, level: np.ndarray, cuts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, documents, whether heavy), each document's n-grams by level and hash, from those by hash; only the heavy ones are sorted."""
    heavy = np.flatnonzero(level)
    heavy = heavy[np.lexsort((value[heavy], level[heavy], of[heavy]))]
    light = np.flatnonzero(level == 0)
    n_light = np.bincount(of[light], minlength=len(size))
    out, is_heavy = np.empty_like(value), np.zeros(len(value), bool)
    for at, begin, n in ((light, cuts[:-1], n_light), (heavy, cuts[:-1] + n_light, size - n_light)):
        place = np.arange(len(at)) + np.repeat(begin - np.cumsum(n) + n, n)  # a document's go in a row from begin on
        out[place], is_heavy[place] = value[at], at is heavy
    return out, of, is_heavy


def apart_at_least(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """For one bitmap (uint64 words) and others: n-grams that are in one of the two sets alone, at least. Longer bitmaps are folded."""
    out, folded = np.zeros(len(others), np.int64), {len(one): one}
    sizes = np.array([len(x) for x in others])
    for k in np.unique(sizes).tolist():
        at, own = np.flatnonzero(sizes == k), one
        while len(own) > k:
            own = own[: len(own) // 2] ^ own[len(own) // 2 :]
        both = np.stack([others[i] for i in at])
        while both.shape[1] > len(own):
            both = both[:, : both.shape[1] // 2] ^ both[:, both.shape[1] // 2 :]
        out[at] = np.bitwise_count(both ^ own).sum(1)
    return out


def within(apart, size_a, size_b, percent: int):
    """Whether sets that differ in so many n-grams are ``percent`` alike, or more."""
    return apart * (100 + percent) <= (100 - percent) * (size_a + size_b)


def reachable(place_a, size_a, place_b, size_b, percent: int):
    """Whether sets that share an n-gram at these positions can be ``percent`` alike: what comes before and after is bounded by the shorter."""
    most = np.minimum(place_a, place_b) + np.minimum(size_a - place_a, size_b - place_b)
    return most * (100 + percent) >= (size_a + size_b) * percent


def heavy_grams(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of at most HEAVY n-grams that many texts have, and a level from 1 on for each, by how many; found from slices where some texts share them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in slices(batch.column(0), HEAVY_SLICE):
                value, times = np.unique(grams(texts, width)[0], return_counts=True)
                kept = times >= HEAVY_LOCAL
                yield pa.RecordBatch.from_arrays([pa.array(value[kept].view(np.int64)), pa.array(times[kept])], ["gram", "n"])

    met = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY_TEXTS)
    met = storage.written(met, "heavy")
    top = met.filter(F.col("n") >= frequent(met, HEAVY)).select("gram", (F.floor(F.log2("n") * 2) + 1).cast("int").alias("level")).toArrow()
    grams_, levels = (np.asarray(top[c].combine_chunks()) for c in ("gram", "level"))
    order = np.argsort(grams_.view(np.uint64))
    return grams_.view(np.uint64)[order], levels[order].astype(np.int8)


def profiles(docs: DataFrame, width: int, percent: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, class, size, weight, rare, prefix, bits) of each text. prefix: its first n-grams in order, ``rare`` of which are not heavy; weight: per mille of the
    set that is heavy; bits: the parity bitmap.

    A task gives prefix and bits of a class once and leaves them null for further texts of the class. A set that only its like can be linked with has no prefix.
    """
    shared = storage.broadcast(docs.sparkSession, heavy)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, levels), given = shared.value, set()
        for batch in batches:
            for at, to, texts in slices(batch.column(1)):
                value, of = grams(texts, width)
                found, size, cuts = signatures(value, of, texts.n)
                place = np.searchsorted(known, value)
                level = np.zeros(len(value), np.int8)
                if len(known):
                    place = np.minimum(place, len(known) - 1)
                    level = np.where(known[place] == value, levels[place], 0)
                first = np.array([n > 0 and c not in given and given.add(c) is None for c, n in zip(found.tolist(), size.tolist(), strict=True)], bool)
                length = size - -(-size * percent // 100) + 1
                length[~first | (100 * size < percent * (size + 1))] = 0
                data, ends = parities(value, of, size * first)
                is_heavy = level > 0
                share = np.bincount(of, is_heavy, texts.n) * 1000 // np.maximum(size, 1)
                value, of, is_heavy = ordered(value, of, level, cuts, size)
                in_prefix = np.arange(len(value)) - np.repeat(cuts[:-1], size) < np.repeat(length, size)
                rare = np.bincount(of[in_prefix & ~is_heavy], minlength=texts.n)
                none = pa.array(~first)
                offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[in_prefix].view(np.int64)), mask=none)
                bits = pa.BinaryArray.from_buffers(pa.binary(), texts.n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)]).filter(pa.array(first))
                bits = bits.take(pa.array(np.cumsum(first) - 1, mask=~first))
                columns = [pa.array(found), pa.array(size.astype(np.int32)), pa.array(share.astype(np.int32)), pa.array(rare.astype(np.int32)), prefix, bits]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *columns], ["key", "class", "size", "weight", "rare", "prefix", "bits"])

    return docs.select("key", "text").mapInArrow(profile, f"key {dict(docs.dtypes)['key']}, class long, size int, weight int, rare int, prefix array<long>, bits binary")


ENTRY = ["gram", "class", "size", "place", "weight"]


def short_pairs(entries: DataFrame, percent: int, partitions: int) -> DataFrame:
    """(a, b, gram, size, place, weight) from entries (gram, class, size, place, weight), which may repeat: pairs (a, b) of lists of SHORT classes or
    fewer that can be linked, and (a, null, ...), the entries of longer lists. A task keeps no more of a list than SHORT entries.
    """
    names, none = ["a", "b", "gram", "size", "place", "weight"], np.zeros(0, np.int64)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, long = [none] * 5, None  # entries of the last list so far, unless it is long and has been given
        for batch in chain(batches, [None]):
            columns = tail if batch is None else [np.concatenate((t, np.asarray(c).astype(np.int64))) for t, c in zip(tail, batch.columns, strict=True)]
            tail = [none] * 5
            gram, cls = columns[:2]
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1])  # else a class that several tasks gave
            gram, cls, size, place, weight = columns = [x[new] for x in columns]
            if not len(gram):
                continue
            starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            n = np.diff(np.r_[starts, len(gram)])
            is_long = n > SHORT
            if long is not None:
                is_long |= gram[starts] == long
            if batch is not None:
                long = gram[-1] if is_long[-1] else None
                if long is None:  # the list may go on
                    tail, (gram, cls, size, place, weight) = [x[starts[-1] :] for x in columns], [x[: starts[-1]] for x in columns]
                    starts, n, is_long = starts[:-1], n[:-1], is_long[:-1]
            at = np.flatnonzero(np.repeat(is_long, n))
            entry = [pa.array(x[at].astype(k)) for x, k in ((gram, np.int64), (size, np.int32), (place, np.int32), (weight, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.nulls(len(at), pa.int64()), *entry], names)
            left = np.repeat(starts + n, n) - np.arange(len(gram))  # entries of the list from here on
            at, step = np.flatnonzero(np.repeat((n > 1) & ~is_long, n)), 1
            while len(at := at[left[at] > step]):
                at = at[size[at + step] * percent <= size[at] * 100]  # else this block of sizes and all after it are too large
                kept = at[reachable(place[at], size[at], place[at + step], size[at + step], percent)]
                a, b = cls[kept], cls[kept + step]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64()), *[pa.nulls(len(a), pa.int32())] * 3], names)
                step += 1

    with storage.setting(entries.sparkSession, ARROW_ROWS, ENTRY_BATCH):
        ordered = entries.select(*ENTRY).repartition(partitions, "gram").sortWithinPartitions("gram", "size", "place", "class")
        return storage.written(ordered.mapInArrow(listed, "a long, b long, gram long, size int, place int, weight int"), "listed")


def needed_sets(docs: DataFrame, width: int, needed: DataFrame) -> DataFrame:
    """(class, set array<long>) of the classes in needed (class, least), from the text whose key is least. A class may come twice.

    A bitmap of fixed size leaves most other texts out; a join by class does the rest."""
    spark = docs.sparkSession
    bits = min(NEEDED_BITS[1], max(NEEDED_BITS[0], 1 << (16 * needed.count()).bit_length()))
    hashed = lambda df, key: df.withColumn("_hash", F.xxhash64(key))

    def places(found: np.ndarray, hashes: pa.Array) -> np.ndarray:
        return (mix(found.view(np.uint64) ^ np.asarray(hashes).view(np.uint64)) % np.uint64(bits)).astype(np.int64)

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            own[places(np.asarray(batch.column(0)), batch.column(1))] = True
        yield pa.RecordBatch.from_pydict({"bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    bitmap = np.zeros(bits // 8, np.uint8)
    for row in hashed(needed, "least").select("class", "_hash").coalesce(16).mapInArrow(united, "bits binary").toLocalIterator():
        bitmap |= np.frombuffer(row["bits"], np.uint8)
    shared = storage.broadcast(spark, bitmap)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            for at, to, texts in slices(batch.column(0)):
                value, of = grams(texts, width)
                found, size, cuts = signatures(value, of, texts.n)
                kept = np.flatnonzero((size > 0) & there[places(found, batch.column(1).slice(at, to - at))])
                parts = [value[cuts[i] : cuts[i + 1]] for i in kept]
                yield pa.RecordBatch.from_arrays([pa.array(found[kept]), pa.array([p.view(np.int64) for p in parts], pa.list_(pa.int64()))], ["class", "set"])

    return hashed(docs, "key").select("text", "_hash").mapInArrow(sets, "class long, set array<long>")


def nearness(percent: int) -> int:
    """Similarity to a leader from which on a set can be linked with one that is linked with the leader."""
    return max(1, 2 * percent - 100)


def chosen(size, place, weight, cls, home, bits: list[np.ndarray], percent: int, cover: bool) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(class, classes that may be linked with it, whether it leads them), by places in one list that is sorted by size and position.

    home: 0, or a leader that a class is linked with; two of one home are done with each other. If ``cover``, leaders are chosen until all that may have
    a link are led; two that one leader leads are left to it, other pairs are given as they are.
    """
    n = len(size)
    may = np.zeros((n, n), bool)
    for i in range(n - 1):
        at = np.arange(i + 1, np.searchsorted(size, size[i] * 100 // percent, "right"))  # the block of sizes
        at = at[reachable(place[at], size[at], place[i], size[i], percent) & ((home[at] != home[i]) | (home[i] == 0))]
        if len(at):
            may[i, at] = within(apart_at_least(bits[i], [bits[k] for k in at]), size[at], size[i], percent)
    may |= may.T
    if cover:
        open_, together = may.any(1), np.zeros((n, n), bool)
        for i in np.lexsort((cls, weight))[::-1]:
            if open_[i] and (led := np.flatnonzero(may[i])).size:
                yield i, led, True
                together[np.ix_(led, led)] = True
                may[i] = may[:, i] = open_[i] = open_[led] = False
        may &= ~together
    for i in np.flatnonzero(may.any(1)):
        if len(at := i + 1 + np.flatnonzero(may[i, i + 1 :])):
            yield i, at, False


def led_lists(lists: DataFrame, percent: int, partitions: int, cover: bool) -> DataFrame:
    """(gram, a, b, leads): pairs that may be linked, of lists (gram, class, size, place, weight, home, bits) of TOGETHER entries or fewer; see ``chosen``."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in chain(batches, [None]):
            table = pa.Table.from_batches([b for b in (tail, batch) if b is not None and b.num_rows]) if tail or batch else None
            tail = None
            if table is None or not table.num_rows:
                continue
            table = table.combine_chunks().to_batches()[0]
            gram = np.asarray(table["gram"])
            starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]).tolist()
            if batch is not None:
                tail = table.slice(starts[-1])
            columns = [np.asarray(table[c]) for c in ("size", "place", "weight", "class", "home")]
            bits = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["bits"]]
            found = [], [], [], []
            for at, to in pairwise([*starts, *[len(gram)] * (batch is None)]):
                for i, others, leads in chosen(*(c[at:to] for c in columns), bits[at:to], percent, cover):
                    for column, value in zip(found, (gram[at], columns[3][at + i], None, leads), strict=True):
                        column.append(columns[3][at:to][others] if value is None else np.full(len(others), value))
            kinds = (np.int64, np.int64, np.int64, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, k), *x])) for x, k in zip(found, kinds, strict=True)], ["gram", "a", "b", "leads"])

    return lists.repartition(partitions, "gram").sortWithinPartitions("gram", "size", "place", "class").mapInArrow(lead, "gram long, a long, b long, leads boolean")


def possible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The rows of pairs (a, b, ...) that the parity bitmaps leave."""

    @F.arrow_udf("boolean")
    def may_be(bits_a: pa.Array, bits_b: pa.Array, size_a: pa.Array, size_b: pa.Array) -> pa.Array:
        both = [[np.frombuffer(x.as_buffer(), np.uint64) for x in side] for side in (bits_a, bits_b)]
        apart = np.array([apart_at_least(x, [y])[0] for x, y in zip(*both, strict=True)], np.int64)
        return pa.array(within(apart, np.asarray(size_a), np.asarray(size_b), percent))

    side = lambda c: bits.select(F.col("class").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("size").alias(f"size_{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").filter(may_be("bits_a", "bits_b", "size_a", "size_b")).select(*pairs.columns)


def semi(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in wanted, a written table; that is broadcast if it is small."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted, key, "left_semi")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, size_a, size_b, common, delta) of pairs (a, b). delta: where they are near enough for a leader and its class, what b alone has, then what a alone has."""
    near = nearness(percent)
    wanted = storage.written(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "wanted")
    side = lambda c: semi(sets, wanted, "class").select(F.col("class").alias(c), F.col("set").alias(f"set_{c}"))

    @F.arrow_udf("struct<size_a:long,size_b:long,common:long,delta:array<bigint>>")
    def compare(first: pa.Array, second: pa.Array) -> pa.Array:
        sizes_a, sizes_b, common, deltas = [], [], [], []
        for x, y in zip(first, second, strict=True):
            x, y = np.asarray(x.values).view(np.uint64), np.asarray(y.values).view(np.uint64)
            apart = np.concatenate((np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)))
            sizes_a.append(len(x)), sizes_b.append(len(y)), common.append((len(x) + len(y) - len(apart)) // 2)
            deltas.append(apart.view(np.int64) if within(len(apart), len(x), len(y), near) else None)
        return pa.StructArray.from_arrays([pa.array(sizes_a, pa.int64()), pa.array(sizes_b, pa.int64()), pa.array(common, pa.int64()), pa.array(deltas, pa.list_(pa.int64()))], ["size_a", "size_b", "common", "delta"])

    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", compare("set_a", "set_b").alias("x"))
    return joined.groupBy("a", "b").agg(F.first("x").alias("x")).select("a", "b", "x.*")


def is_link(common, size_a, size_b, percent: int):
    return 100 * common >= percent * (size_a + size_b - common)


def difference_links(led: DataFrame, percent: int, most: int | None) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between two classes near one leader of which one at least is not linked with it, from their differences from it alone;
    and (a leader, b class) of those that are not done at that leader, as they share a difference with more than ``most`` others.

    led: (a leader, b, size_a, size_b, common, delta, linked), near pairs only. With differences D and E two classes are linked if (|D| + |E| - 2 |D & E|) * (100 + t) <= (100 - t) * (|y| + |z|). If z is not linked with the leader, |E| is over what a link allows, so
    |D & E| has to be about half of |D| or more; if z may meet classes that are linked, |D & E| has a smaller bound. It is enough to join so many of each
    class's differences that what is left out is less than the bound, in one order: those that the leader lacks are the rare ones, and come first.
    """
    up, down = 100 + percent, 100 - percent
    apart = F.col("size_a") + F.col("size_b") - 2 * F.col("common")
    rows = led.select(F.col("a").alias("leader"), F.col("b").alias("class"), "linked", F.col("size_b").alias("size"), F.col("size_a").alias("base"), apart.alias("apart"), "delta")
    rows = rows.join(rows.filter("not linked").select("leader").distinct(), "leader", "left_semi")
    own = F.greatest(F.floor((F.col("apart") * up + down * (F.col("base") - F.col("size"))) / (2 * up)) + 1, F.lit(1))  # with a class that is not linked
    any_ = F.greatest(F.ceil((F.col("apart") * up - down * (F.col("base") + F.col("size"))) / (2 * up)), F.lit(1))  # of a class not linked, with any
    left = lambda least: (F.col("apart") - least + 1).cast("int")
    first = rows.withColumns({"strict": left(own), "wide": F.greatest(F.when(F.col("linked"), left(own)).otherwise(left(any_)), F.lit(0))})
    first = first.select("leader", "class", "linked", "strict", F.posexplode(F.slice("delta", F.lit(1), F.col("wide"))).alias("place", "gram"))
    first = storage.written(first.select("leader", "gram", "class", "linked", (F.col("place") < F.col("strict")).alias("strict")), "differences")
    if most is None:
        late = first.filter("false")
    else:
        counts = storage.written(first.filter("not linked").groupBy("leader", "gram").agg(F.count("*").alias("n")).filter(F.col("n") > most), "common")
        late = first.join(counts, ["leader", "gram"], "left_semi")
        first = first.join(counts, ["leader", "gram"], "left_anti")
    late = late.select(F.col("leader").alias("a"), F.col("class").alias("b")).distinct()
    met = first.filter("strict").alias("y").join(first.filter("not linked").alias("z"), F.expr("y.leader = z.leader and y.gram = z.gram and (y.linked or z.strict and y.class < z.class)"))
    met = met.select("y.leader", F.col("y.class").alias("y"), F.col("z.class").alias("z")).distinct()
    side = lambda c: rows.select("leader", F.col("class").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("size", "apart", "delta")))
    both = met.join(side("y"), ["leader", "y"]).join(side("z"), ["leader", "z"])
    same = F.size(F.array_intersect("delta_y", "delta_z"))
    links = both.filter((F.col("apart_y") + F.col("apart_z") - 2 * same) * up <= down * (F.col("size_y") + F.col("size_z"))).select(F.col("y").alias("a"), F.col("z").alias("b"))
    return links, late


def shared_counts(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """How many values each of first's arrays shares with each of second's; an array has a value once."""
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (first, second))
    own_a, own_b = (np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (first, second))
    both = np.intersect1d(a, b)
    out = np.zeros((len(first), len(second)), np.float32)
    for at in range(0, len(both), COLUMNS):
        part, sides = both[at : at + COLUMNS], []
        for value, own, n in ((a, own_a, len(first)), (b, own_b, len(second))):
            place = np.minimum(np.searchsorted(part, value), len(part) - 1)
            there = part[place] == value
            side = np.zeros((n, len(part)), np.float32)
            side[own[there], place[there]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def member_counts(members: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """(node, n): links of each class with others that have a leader in common with it, each counted once.

    members: (leader, node, size, apart, delta); leaders: (node, leaders). A pair counts at the least leader that both are linked with.
    """
    parts = members.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    rows = members.join(leaders, "node").join(parts, "leader")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lesser = F.filter("leaders", lambda x: x < F.col("leader"))
    rows = rows.select("leader", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "size", "apart", "delta", lesser.alias("lesser"))

    def count(table: pa.Table) -> pa.Table:
        columns = {c: table[c].combine_chunks() for c in table.column_names}
        node, size, apart, own = (np.asarray(columns[c]) for c in ("node", "size", "apart", "own"))
        lists = {c: [np.asarray(x.values) for x in columns[c]] for c in ("delta", "lesser")}
        low, high = columns["low"][0].as_py(), columns["high"][0].as_py()
        i, j = np.flatnonzero(own == low), np.flatnonzero(own == high)
        met = {c: shared_counts([x[k] for k in i], [x[k] for k in j]) for c, x in lists.items()}
        link = (apart[i][:, None] + apart[j] - 2 * met["delta"]) * (100 + percent) <= (100 - percent) * (size[i][:, None] + size[j])
        link &= (met["lesser"] == 0) & (node[i][:, None] != node[j])
        found, n = (node[i], link.sum(1)) if low == high else (np.concatenate((node[i], node[j])), np.concatenate((link.sum(1), link.sum(0))))
        return pa.table({"node": found, "n": n.astype(np.int64)})

    return rows.groupBy("leader", "low", "high").applyInArrow(count, "node long, n long")


def degrees(links: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(node, n_links): the distinct classes that each class is linked with. links: (u, v) distinct, with all links but those between two members of a leader."""
    leaders = storage.written(members.groupBy("node").agg(F.collect_set("leader").alias("leaders")), "leaders")
    side = lambda c: leaders.select(F.col("node").alias(c), F.col("leaders").alias(f"leaders_{c}"))
    single = links.join(side("u"), "u", "left").join(side("v"), "v", "left").filter(~F.coalesce(F.arrays_overlap("leaders_u", "leaders_v"), F.lit(False)))
    counts = single.select(F.explode(F.array("u", "v")).alias("node"), F.lit(1).cast("long").alias("n")).unionByName(member_counts(members, leaders, percent))
    return counts.groupBy("node").agg(F.sum("n").alias("n_links"))


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85, links: bool = True) -> DataFrame:
    """(key, size, component, class_size, n_links) of each row of docs; component is the smallest key reachable by links.

    class_size: rows with the same set; n_links: other classes whose sets are linked with the row's, all counted. It is left out if not ``links``.
    """
    with storage.setting(docs.sparkSession, ARROW_ROWS, BATCH):
        return _joined(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), key, width, percent, links)


def all_links(docs: DataFrame, rows: DataFrame, classes: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (u, v), all but those between two members of a leader; and (leader, node, size, apart, delta) of each leader's members."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = rows.filter("prefix is not null").select(F.posexplode("prefix").alias("place", "gram"), "class", "size", "weight", "rare")
    listed = short_pairs(entries.filter("place < rare"), percent, partitions)
    rest = listed.filter("b is null").select("gram", F.col("a").alias("class"), "size", "place", "weight").unionByName(entries.filter("place >= rare").select(*ENTRY))
    rest = storage.written(rest.distinct().withColumn("home", F.lit(0).cast("long")), "entries")
    short = possible(listed.filter("b is not null").select("a", "b").distinct(), classes, percent)
    found, members, sets, round_ = [], [], None, 0
    while True:
        hashed = F.xxhash64("class")
        slots = rest.groupBy("gram", F.pmod(F.xxhash64("class", F.lit(1)), F.lit(4**round_)).alias("slot"))
        slots = slots.agg(F.count("*").alias("n"), F.bit_xor(hashed).alias("x"), F.sum(F.shiftright(hashed, 8)).alias("s"), F.max(F.struct("weight", "class")).alias("top"), F.min("home").alias("low"), F.max("home").alias("high"))
        lists = slots.groupBy("gram").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"), F.collect_list("top.class").alias("leaders"), F.min("low").alias("low"), F.max("high").alias("high"))
        lists = lists.filter("n > 1 and (low = 0 or low < high)")  # classes of one home are done with each other
        lists = lists.groupBy("n", "x", "s").agg(F.min("gram").alias("gram"), F.min_by("leaders", "gram").alias("leaders"))  # lists of the same classes are looked at once
        lists = storage.written(lists.select("gram", F.when(F.col("n") > TOGETHER, F.col("leaders")).alias("leaders")), "lists")
        if lists.isEmpty() and round_:
            break
        rest = rest.join(lists, "gram")
        small, large = rest.filter("leaders is null").drop("leaders"), rest.filter("leaders is not null")
        near = storage.written(led_lists(small.join(classes.select("class", "bits"), "class"), percent, partitions, not round_), "near")
        star = storage.written(large.select("gram", F.explode("leaders").alias("a"), F.col("class").alias("b")), "star")
        pairs = near.select("a", "b").unionByName(possible(star.filter("a <> b").select("a", "b").distinct(), classes, nearness(percent)))
        if sets is None:
            pairs = storage.written(pairs.unionByName(short), "pairs")
            # later rounds look at pairs of the same classes again, or at those of long lists
            needed = pairs.select(F.explode(F.array("a", "b")).alias("class")).unionByName(star.select(F.col("b").alias("class"))).distinct()
            sets = storage.written(needed_sets(docs, width, storage.written(needed.join(classes.select("class", "least"), "class"), "needed")), "sets")
        seen = storage.written(compared(pairs.distinct(), sets, percent), "compared").withColumn("linked", is_link(F.col("common"), F.col("size_a"), F.col("size_b"), percent))
        found.append(seen.filter("linked").select("a", "b"))
        met = near.filter("leads").select("a", "b").unionByName(star.select("a", "b")).distinct()
        members.append(seen.filter("linked").join(met, ["a", "b"], "left_semi").select(F.col("a").alias("leader"), F.col("b").alias("node"), F.col("size_b").alias("size"), (F.col("size_a") + F.col("size_b") - 2 * F.col("common")).alias("apart"), "delta"))
        # what a leader leads is looked at again if one of it is not linked with the leader after all
        led = near.filter("leads").join(seen.select("a", "b", "linked"), ["a", "b"])
        again = led.join(led.filter("not linked").select("gram", "a").distinct(), ["gram", "a"], "left_semi").groupBy("gram", F.col("b").alias("class")).agg(F.min(F.when(F.col("linked"), F.col("a"))).alias("new"))
        home = lambda new: F.when(F.col("home") == 0, F.coalesce(new, F.lit(0))).otherwise(F.col("home")).alias("home")
        left = small.join(again, ["gram", "class"]).select(*ENTRY, home(F.col("new")))
        if not star.isEmpty():
            led = storage.written(seen.filter("delta is not null").join(star.select("a", "b").distinct(), ["a", "b"], "left_semi"), "led")
            links, late = difference_links(led, percent, NEAR if round_ < NEAR_ROUNDS else None)
            found.append(storage.written(links, "derived"))
            # a class that led is done with its list, as is one that is linked with a leader and done there; one that is near has a home
            done = star.join(led.select("a", "b", "linked").join(late, ["a", "b"], "left_anti"), ["a", "b"]).select("gram", "b", F.col("linked").alias("gone"), F.col("a").alias("new"))
            done = done.unionByName(star.filter("a = b").select("gram", "b", F.lit(True).alias("gone"), F.col("a").alias("new")))
            done = done.groupBy("gram", F.col("b").alias("class")).agg(F.max("gone").alias("gone"), F.min("new").alias("new"))
            left = left.unionByName(large.drop("leaders").join(done, ["gram", "class"], "left").filter("not coalesce(gone, false)").select(*ENTRY, home(F.col("new"))))
        rest = storage.written(left, "rest")
        round_ += 1
    links, more = reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, members)
    return storage.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"), more


def _joined(docs: DataFrame, key: str, width: int, percent: int, with_links: bool) -> DataFrame:
    names = ["component", "class_size"] + ["n_links"] * with_links
    with storage.scratch(docs.sparkSession) as kept:
        rows = storage.written(profiles(docs, width, percent, heavy_grams(docs, width)), "profiles")
        full = rows.filter("size > 0").groupBy("class").agg(F.min("key").alias("least"), F.count("*").alias("class_size"), F.first("size").alias("size"), F.first("bits", True).alias("bits"))
        classes = storage.written(full, "classes")
        links, members = all_links(docs, rows, classes, width, percent)
        of_class = classes.select("class", "least", "class_size").join(components(links).withColumnRenamed("node", "class"), "class", "left")
        if with_links:
            members = storage.written(members.dropDuplicates(["leader", "node"]), "members")
            of_class = of_class.join(degrees(links, members, percent).withColumnRenamed("node", "class"), "class", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
        of_class = of_class.withColumn("k", F.coalesce("component", "class").cast("string")).drop("component")
        of_class = kept(of_class, "of-class")
        rows = kept(rows.select("key", "size", F.when(F.col("size") > 0, F.col("class").cast("string")).alias("k")), "classes-of-rows")
    named = lookup(of_class, of_class.groupBy("k").agg(F.min("least").alias("component")), "k").select(F.col("class").cast("string").alias("k"), *names)
    return lookup(rows, named, "k").select(
        F.col("key").alias(key), F.col("size").cast("long").alias("size"), F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("key")).alias("component"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), *[F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")] * with_links,
    )
