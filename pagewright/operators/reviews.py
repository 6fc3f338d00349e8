"""Spaced repetition by the published SM-2 rule: repetitions, ease, interval and due day of each card from its reviews.

A review has a quality of 0 to 5. From 3 on it is a success: the interval is 1 day after the first success in a row, 6 after the second, then the one before times the ease, rounded up,
``MOST_DAYS`` at most. Below 3 the row of successes ends and the interval is 1 day. Either way the ease then changes by 0.1 - (5 - q)(0.08 + 0.02 (5 - q)), and is
1.3 at least; it starts at 2.5 and is kept in hundredths, so that all steps are of whole numbers.

Reviews are in order of time, by quality at equal times. Their fold is cut where a range shuffle cuts them, so a card with a third of all reviews is folded by many tasks: a piece's effect on the ease is
x -> max(x + add, least), which can be put together, and the interval depends on the last ``TAIL`` successes in a row alone, after which it is MOST_DAYS whatever
the ease. A second pass puts the few pieces of a card together, in one task a card, with one piece in memory.

Defined results: reviews without time or quality are passed over, and so cards without others; qualities beyond 0 and 5 count as those; null is a value like any other in the columns that name a
card; repeated rows are reviews each; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, LongType, StructField, StructType

FIRST_EASE, LEAST_EASE, FIRST_DAYS, MOST_DAYS = 250, 130, (1, 6), 36_500


def gain(quality: int) -> int:
    """Change of the ease, in hundredths."""
    return 10 - (5 - quality) * (8 + 2 * (5 - quality))


@dataclass
class Card:
    """What a card's reviews so far have led to."""

    reviews: int = 0
    streak: int = 0
    ease: int = FIRST_EASE
    days: int = 0

    def review(self, quality: int) -> Card:
        if quality < 3:
            self.streak, self.days = 0, FIRST_DAYS[0]
        else:
            self.days = FIRST_DAYS[self.streak] if self.streak < len(FIRST_DAYS) else min(MOST_DAYS, -(-self.days * self.ease // 100))
            self.streak += 1
        self.reviews += 1
        self.ease = max(LEAST_EASE, self.ease + gain(quality))
        return self


def _tail() -> int:
    """Successes in a row after which the interval is MOST_DAYS at any ease."""
    card = Card(ease=LEAST_EASE)
    while card.days < MOST_DAYS:
        card.review(4)
        card.ease = LEAST_EASE
    return card.streak


TAIL = _tail()


@dataclass
class Piece:
    """A run of reviews: its number, whether it has a failure, the successes since, the last TAIL of those, and the effect of what is before these on the ease."""

    reviews: int = 0
    failed: bool = False
    streak: int = 0
    tail: list[int] = field(default_factory=list)
    add: int = 0
    least: int = 0  # eases are never that small, so 0 has no effect

    def _settle(self, qualities: list[int]) -> None:
        for q in qualities:
            self.add, self.least = self.add + gain(q), max(self.least + gain(q), LEAST_EASE)

    def review(self, quality: int) -> Piece:
        self.reviews += 1
        if quality < 3:
            self._settle([*self.tail, quality])
            self.failed, self.streak, self.tail = True, 0, []
        else:
            self.streak += 1
            self.tail.append(quality)
            self._settle(self.tail[:-TAIL])
            self.tail = self.tail[-TAIL:]
        return self

    def follow(self, other: Piece) -> Piece:
        """This run and then the other."""
        self.reviews += other.reviews
        if other.failed or other.streak > len(other.tail):  # what is before the other's tail comes after all of this one's
            self._settle(self.tail)
            self.add, self.least = self.add + other.add, max(self.least + other.add, other.least)
            self.streak = other.streak + (0 if other.failed else self.streak)
            self.failed, self.tail = self.failed or other.failed, list(other.tail)
        else:
            self.streak += other.streak
            self.tail = self.tail + other.tail
            self._settle(self.tail[:-TAIL])
            self.tail = self.tail[-TAIL:]
        return self

    def card(self) -> Card:
        """Where a new card is after this run."""
        card = Card(days=FIRST_DAYS[0] if self.failed else 0, ease=max(FIRST_EASE + self.add, self.least))
        if self.streak > len(self.tail):
            card.streak, card.days = self.streak - len(self.tail), MOST_DAYS
        for q in self.tail:
            card.review(q)
        card.reviews = self.reviews
        return card


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, tuple | None]]:
    """(card, rest) of sorted rows; a None at the end of each batch and of all."""
    for batch in batches:
        for card, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield card, tuple(rest)
        yield None, None


def schedule(reviews: DataFrame, card: list[str], at: str, quality: str) -> DataFrame:
    """(card columns, n_reviews, repetitions, ease, interval_days, due) of reviews (card columns, at timestamp or date, quality integer)."""
    kept = reviews.filter(F.col(at).isNotNull() & F.col(quality).isNotNull())
    rows = kept.select(F.struct(*card).alias("card"), F.col(at).cast("timestamp_ntz").alias("at"), F.greatest(F.lit(0), F.least(F.lit(5), F.col(quality))).cast("int").alias("quality"))
    kind = rows.schema["card"].dataType
    moment = rows.schema["at"].dataType
    piece = StructType([StructField("card", kind), StructField("first", moment), StructField("first_quality", LongType()), StructField("last", moment), StructField("reviews", LongType()), StructField("failed", BooleanType()), StructField("streak", LongType()), StructField("tail", ArrayType(LongType())), StructField("add", LongType()), StructField("least", LongType())])
    found = StructType([StructField("card", kind), StructField("n_reviews", LongType()), StructField("repetitions", LongType()), StructField("ease", DoubleType()), StructField("interval_days", LongType()), StructField("last", moment)])

    def batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(schema)], schema.names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, last, run, out = None, None, None, Piece(), []
        ended = lambda: (now, *first, last, run.reviews, run.failed, run.streak, run.tail, run.add, run.least)
        for card, rest in _runs(batches):
            if card is None:
                yield batch(out, piece)
                out = []
            else:
                if card != now or not run.reviews:
                    out += [ended()] if run.reviews else []
                    now, first, run = card, rest, Piece()
                run.review(rest[1])
                last = rest[0]
        yield batch([ended()] if run.reviews else [], piece)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, run, out = None, None, Piece(), []

        def ended():
            card = run.card()
            return now, card.reviews, card.streak, card.ease / 100, card.days, last

        for card, rest in _runs(batches):
            if card is None:
                yield batch(out, found)
                out = []
            else:
                if card != now or not run.reviews:
                    out += [ended()] if run.reviews else []
                    now, run = card, Piece()
                run.follow(Piece(*rest[3:]))
                last = rest[2]
        yield batch([ended()] if run.reviews else [], found)

    parts = int(reviews.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("card", "at", "quality")
    pieces = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(fold, piece)
    cards = pieces.repartition("card").sortWithinPartitions("card", "first", "first_quality").mapInArrow(join, found)
    due = F.date_add(F.col("last").cast(DateType()), F.col("interval_days").cast("int"))
    return cards.select("card.*", "n_reviews", "repetitions", "ease", "interval_days", due.alias("due"))
