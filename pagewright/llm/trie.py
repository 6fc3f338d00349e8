"""The prefix trie of conversations: shared beginnings, stored as chains of nodes.

A node is a distinct sequence of first turns; its members are the conversations that begin with it, and the smallest of them owns it. Who owns a
node owns all nodes of its own further on, so each conversation owns a chain: from its first owned depth to its end. That depth is found by binary search:
in each round every conversation that is not done looks one depth up, and all look-ups of a round are one join with the minima of prefix digests. The owner
met just above is the chain's parent. Chains are then aggregated bottom-up: sums from each node of a chain to its end, and each chain's total added to the
nodes above its top, which its conversation's own digests name; so one aggregation does for all levels of the tree.

A digest is the exclusive or of two 64-bit hashes of (depth, role, MD5 of the text), so that it can be summed by blocks of ``BLOCK`` depths: no task needs a whole
conversation, whatever its length. Places of turns come from one range shuffle (ranks.ranked). Texts are read once and not shuffled. The decimal ids of conversations that
end at a node are hashed in order as a stream: joined to pieces of up to ``PIECE`` ids in many tasks first, then piece by piece in one task a node, with one piece in memory.

Defined results: rows with a null conversation id belong to none and are passed over; null role or text is empty; turns of equal number go by role, then by the MD5 of
the text; repeated rows are turns each; a conversation is there if it has a row, and without turns after its rebuilding it is a member of the root alone; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import ranks, storage

BLOCK = 4096  # depths summed together
PIECE = 4096  # ids joined together
WORD = r"[^\x20\x09-\x0D]+"
NODE = ("conv_id", "depth")


def digested(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text_md5, words): turns numbered from 0 in each conversation."""
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.unhex(F.md5(text)).alias("text_md5"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    order = ("conv_id", F.col("turn").asc_nulls_first(), "role", "text_md5")
    placed = ranks.ranked(storage.written(turns, "turns"), *(F.col(c) if isinstance(c, str) else c for c in order))
    first = placed.groupBy("conv_id").agg(F.min("_rank").alias("_first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("_rank") - F.col("_first")).alias("place"), "role", "text_md5", "words")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation's first h turns replaced by those of the first of its family, h = crc32(id) mod ``most``.

    turns: (conv_id, depth from 1, role, text_md5, words); conversations: (conv_id, length). A family's first turns go to ``family`` conversations at most.
    """
    head = F.pmod(F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")), F.lit(most))
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"head": head, "base": F.col("conv_id") - F.col("conv_id") % family})
    firsts = turns.filter((F.col("place") < most - 1) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")
    had = firsts.groupBy("base").agg(F.count("*").alias("had"))
    convs = storage.written(own.join(had, "base", "left").select("conv_id", "own", "head", "base", F.least("head", F.coalesce("had", F.lit(0))).alias("given")), "heads")
    given = firsts.join(convs.select("conv_id", "base", "given"), "base").filter("place < given").select("conv_id", (F.col("place") + 1).alias("depth"), "role", "text_md5", "words")
    rest = turns.join(convs.select("conv_id", "head", "given"), "conv_id").filter("place >= head").select("conv_id", (F.col("place") - F.col("head") + F.col("given") + 1).alias("depth"), "role", "text_md5", "words")
    return given.unionByName(rest), convs.select("conv_id", (F.col("given") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length"))


def running(rows: DataFrame, columns: list[str], total: Callable[[str], Column], put: Callable[[Column, Column], Column]) -> DataFrame:
    """rows (conv_id, depth, ...) with ``columns`` totalled from depth 1 on; blocks of depths first, then what is before each block. put: two totals as one."""
    rows = rows.withColumn("_block", F.floor((F.col("depth") - 1) / BLOCK))
    inside = W.partitionBy("conv_id", "_block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("conv_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "_block").agg(*(total(c).alias(c) for c in columns)).select("conv_id", "_block", *(total(c).over(before).alias(f"_{c}") for c in columns)).filter("_block > 0")
    summed = rows.withColumns({c: total(c).over(inside) for c in columns})
    return summed.join(blocks, ["conv_id", "_block"], "left").withColumns({c: put(F.col(c), F.coalesce(F.col(f"_{c}"), F.lit(0))) for c in columns}).drop("_block", *(f"_{c}" for c in columns))


def first_owned(prefixes: DataFrame, minima: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, length, first, parent): the first owned depth, length + 1 if there is none, and the owner of the node above it, null for the root's."""
    state = convs.select("conv_id", "length", F.lit(1).cast("long").alias("lo"), (F.col("length") + 1).alias("hi"), F.lit(None).cast("long").alias("parent"))
    owners = minima.select("depth", "a", "b", F.col("owner"))
    done = None
    while True:
        state = storage.written(state, "search")
        found = state.filter("lo = hi")
        done = found if done is None else done.unionByName(found)
        state = state.filter("lo < hi")
        if state.isEmpty():
            return done.select("conv_id", "length", F.col("lo").alias("first"), "parent")
        asked = state.withColumn("depth", F.floor((F.col("lo") + F.col("hi")) / 2)).join(prefixes.select("conv_id", "depth", "a", "b"), ["conv_id", "depth"])
        met = asked.join(owners, ["depth", "a", "b"])
        owned = F.col("owner") == F.col("conv_id")
        state = met.select("conv_id", "length", F.when(owned, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(owned, F.col("depth")).otherwise(F.col("hi")).alias("hi"), F.when(owned, F.col("parent")).otherwise(F.col("owner")).alias("parent"))


def ends(members: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of members (conv_id, depth, member): SHA-256 of the comma-joined members in order."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, ids, out = None, [], ([], [], [], [])

            def put():
                if ids:
                    for column, value in zip(out, (*node, ids[0], ",".join(map(str, ids))), strict=True):
                        column.append(value)

            for at, depth, member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (at, depth) != node or len(ids) == PIECE:
                    put()
                    node, ids = (at, depth), []
                ids.append(member)
            put()
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["conv_id", "depth", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for at, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (at, depth) == node:
                    state.update(b"," + ids.encode())
                else:
                    out += [(*node, state.hexdigest())] if node else []
                    node, state = (at, depth), hashlib.sha256(ids.encode())
            yield named(out)
        yield named([(*node, state.hexdigest())] if node else [])

    def named(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "ends_sha256"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("conv_id", "depth", "member")
    joined = members.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pieces, "conv_id long, depth long, first long, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, "conv_id long, depth long, ends_sha256 string")


def nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of conversations (conv_id, length) with turns (conv_id, depth, role, text_md5, words).

    Gives conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    hashes = {n: F.xxhash64(F.lit(i), F.col("depth"), F.col("role"), F.col("text_md5")) for i, n in enumerate("ab")}
    prefixes = running(turns.select("conv_id", "depth", "words", *(h.alias(n) for n, h in hashes.items())), ["a", "b"], F.bit_xor, lambda x, y: x.bitwiseXOR(y))
    prefixes = storage.written(prefixes, "prefixes")
    minima = storage.written(prefixes.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("words").alias("words")), "minima")
    convs = storage.written(convs, "conversations")
    search = first_owned(prefixes, minima, convs)
    least = convs.agg(F.min("conv_id")).first()[0]
    chains = storage.written(search.withColumn("parent", F.coalesce("parent", F.lit(least).cast("long"))), "chains")

    tops = chains.filter("first <= length").groupBy(F.col("parent").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("tops"))
    tops = storage.written(tops, "tops")
    own = minima.withColumnRenamed("owner", "conv_id").join(chains, "conv_id").join(tops.filter("depth > 0"), list(NODE), "left")
    n_children = F.coalesce("tops", F.lit(0)) + (F.col("depth") < F.col("length")).cast("long")
    own = own.withColumn("n_children", n_children).withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    own = own.withColumns({"leaves_to": F.col("leaf"), "saved_to": F.col("saved")})
    own = storage.written(running(own, ["leaves_to", "saved_to"], F.sum, lambda x, y: x + y), "owned")  # from the chain's top to the node
    sums = storage.written(own.filter("depth = length").select("conv_id", "first", F.col("leaves_to").alias("leaves"), F.col("saved_to").alias("saved")), "sums")  # of whole chains

    above = prefixes.join(sums, "conv_id").filter("depth < first").groupBy("depth", "a", "b").agg(F.sum("leaves").alias("leaves_below"), F.sum("saved").alias("saved_below"))
    at_end = F.when(F.col("length") == 0, F.lit(least).cast("long")).when(F.col("first") <= F.col("length"), F.col("conv_id")).otherwise(F.col("parent"))
    ended = storage.written(ends(chains.select(at_end.alias("conv_id"), F.col("length").alias("depth"), F.col("conv_id").alias("member"))), "ends")

    whole = sums.select("conv_id", F.col("leaves").alias("_leaves"), F.col("saved").alias("_saved"))
    below = own.join(whole, "conv_id").join(above, ["depth", "a", "b"], "left")
    total = lambda kind, this: F.col(f"_{kind}") - F.col(f"{kind}_to") + F.col(this) + F.coalesce(f"{kind}_below", F.lit(0))
    parent = F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent"))
    inner = below.select(*NODE, parent.alias("parent_conv_id"), "n_convs", "n_children", total("leaves", "leaf").alias("n_leaves"), total("saved", "saved").alias("saved_tokens"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    of_root = tops.filter("depth = 0").agg(F.coalesce(F.sum("tops"), F.lit(0)).alias("n_children"))
    all_sums = sums.agg(F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    root = root.join(F.broadcast(of_root)).join(F.broadcast(all_sums))  # a row each
    root = root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), "saved_tokens")
    found = inner.unionByName(root).join(ended, list(NODE), "left")
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the rebuilt conversations (conv_id, turn, role, text)."""
    with storage.scratch(conversations.sparkSession) as keep:
        turns, convs = rebuilt(storage.written(digested(conversations), "digested"))
        return keep(nodes(turns, convs), "trie")
