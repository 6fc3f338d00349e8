"""SM-2 on a stream of reviews: the state of each card after each micro-batch, by the rule of ``operators.reviews``.

Reviews of a micro-batch are in order of time, by quality at equal times; those of later batches come after them, whatever their time. So the last state of each card is that of
``reviews.schedule`` over all reviews if batches come in the order of time. State: five numbers a card. Defined results: as there.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.reviews import Card

STATE = StructType([StructField(c, LongType()) for c in ("reviews", "streak", "ease", "days", "last")])  # last: microseconds


class Scheduler(StatefulProcessor):
    """Folds the reviews of one card at a time."""

    def __init__(self, card: list[str]):
        self.card = card

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("card", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        card, last = Card(), None
        if self.state.exists():
            *numbers, last = self.state.get()
            card = Card(*numbers)
        for at, quality in sorted((r["at"], r["quality"]) for r in rows):  # one micro-batch of one card
            card.review(quality)
            last = at if last is None else max(at, last)
        self.state.update((card.reviews, card.streak, card.ease, card.days, last))
        return iter([Row(**dict(zip(self.card, key, strict=True)), n_reviews=card.reviews, repetitions=card.streak, ease=card.ease / 100, interval_days=card.days, last=last)])

    def close(self) -> None:
        pass


def schedule(reviews: DataFrame, card: list[str], at: str, quality: str) -> DataFrame:
    """Streaming (card columns, n_reviews, repetitions, ease, interval_days, due); write it in update mode. The session needs the RocksDB state store."""
    kept = reviews.filter(F.col(at).isNotNull() & F.col(quality).isNotNull())
    rows = kept.select(*card, F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.greatest(F.lit(0), F.least(F.lit(5), F.col(quality))).cast("int").alias("quality"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in card]
    schema = ", ".join([*kinds, "n_reviews long, repetitions long, ease double, interval_days long, last long"])
    found = rows.groupBy(*card).transformWithState(Scheduler(card), schema, "update", "none")
    due = F.date_add(F.timestamp_micros("last").cast("date"), F.col("interval_days").cast("int"))
    return found.withColumn("due", due).drop("last")
