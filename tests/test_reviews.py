"""SM-2 schedules: pieces put together against one fold, the batch against a plain fold, the stream against the batch."""

import random
from datetime import datetime, timedelta

from hypothesis import given, settings, strategies as st

from pagewright.operators import reviews
from pagewright.streaming import reviews as stream

QUALITIES = st.lists(st.one_of(st.integers(0, 5), st.integers(3, 5), st.just(3)), max_size=120)
SCHEMA = "deck string, card long, at timestamp_ntz, quality int, first int, last string"


def plain(qualities):
    """The published rule, with the ease in hundredths."""
    n, ease, days = 0, 250, 0
    for q in qualities:
        if q >= 3:
            days = 1 if n == 0 else 6 if n == 1 else min(36_500, (days * ease + 99) // 100)
            n += 1
        else:
            n, days = 0, 1
        ease = max(130, ease + {5: 10, 4: 0, 3: -14, 2: -32, 1: -54, 0: -80}[q])
    return reviews.Card(len(qualities), n, ease, days)


def piece(qualities):
    out = reviews.Piece()
    for q in qualities:
        out.review(q)
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(QUALITIES, max_size=6))
def test_pieces_make_one_fold(parts):
    run = reviews.Piece()
    for part in parts:
        run.follow(piece(part))
    whole = [q for part in parts for q in part]
    assert run.card() == piece(whole).card() == plain(whole)


def test_long_rows_of_successes():
    assert reviews.TAIL == 35
    for worst in ([3] * 200, [0] * 9 + [3] * 34, [0] * 9 + [3] * 36, [5] * 200, [0, *[4] * 80, 3, 3]):
        for cut in (0, 1, 35, 36, 60):
            assert piece(worst[:cut]).follow(piece(worst[cut:])).card() == plain(worst)


def log():
    draw = random.Random(9)
    begin = datetime(2024, 1, 1)
    rows = []
    for i in range(1500):
        deck, card = draw.choice([("a", 1), ("a", 1), ("a", 1), ("b", 1), (None, 2), ("b", None), ("c", draw.randrange(40))])
        at = None if i % 97 == 5 else begin + timedelta(hours=i // 3)  # ties
        rows.append((deck, card, at, None if i % 89 == 3 else draw.choice([-2, 0, 1, 2, 3, 4, 4, 4, 5, 5, 9]), 1, "x"))
    return rows + [rows[0]] * 3 + [("only nulls", 1, None, 3, 1, "x"), ("only nulls", 2, begin, None, 1, "x")]


def wanted(rows):
    cards = {}
    for deck, card, at, q, *_ in rows:
        if at is not None and q is not None:
            cards.setdefault((deck, card), []).append((at, min(5, max(0, q))))
    out = []
    for key, found in cards.items():
        end = plain([q for _, q in sorted(found)])
        out.append((*key, end.reviews, end.streak, end.ease / 100, end.days, max(found)[0].date() + timedelta(days=end.days)))
    return sorted(map(repr, out))


def test_batch(spark):
    rows = log()
    got = reviews.schedule(spark.createDataFrame(rows, SCHEMA).repartition(6), ["deck", "card"], "at", "quality").collect()
    assert sorted(repr(tuple(r)) for r in got) == wanted(rows)
    assert reviews.schedule(spark.createDataFrame([], SCHEMA), ["deck", "card"], "at", "quality").collect() == []


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = sorted((r for r in log() if r[2] is not None), key=lambda r: r[2])
    cuts = [0, *(next(i for i in range(n, len(rows)) if rows[i][2] != rows[i - 1][2]) for n in (300, 304, 1000)), len(rows)]
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = {}

    def keep(batch, _):
        seen.update({(r.deck, r.card): tuple(r) for r in batch.collect()})

    try:
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):  # each run is a restart from the checkpoint
            spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
            source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
            out = stream.schedule(source, ["deck", "card"], "at", "quality")
            out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(store)
    batch = reviews.schedule(spark.createDataFrame(rows, SCHEMA), ["deck", "card"], "at", "quality").collect()
    assert sorted(map(repr, seen.values())) == sorted(repr(tuple(r)) for r in batch)
