"""Quality rules: Gopher-style base counts, and repetition inside a text by a suffix array over its words.

The suffixes of many texts are sorted together by prefix doubling; only suffixes that are still tied are sorted again.
Neighbours in that order share the longest prefix, so the longest repeat that starts at a word is the larger of its
two common prefixes (the LCP interval it lies in). Repeats of ``MIN_WORDS`` words or more are kept, their spans are united, and a
text goes if they cover more than ``MAX_COVERED`` of its words or one is longer than ``MAX_REPEAT`` words.

Defined results: null, empty and blank texts have zeros everywhere and fail the base rule; texts of any length are taken whole;
rows alike are judged alike, each by itself; the caller's other columns are kept by the join-free form ``judged``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .text import IS_SPACE, Texts, slices

MIN_WORDS, MAX_COVERED, MAX_REPEAT = 8, 0.4, 400
MIN_COUNT, MAX_WINDOWS = 50, 50  # the base rule: words at least, percent of words in repeated windows at most
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
VERDICT = StructType([StructField(c, LongType()) for c in COUNTS] + [StructField(c, BooleanType()) for c in ("base_failed", "kept")])


def dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


class Suffixes:
    """The sorted suffixes of word sequences in a row.

    ranks[k][i] is the place, in the order of their first 2**k words, of the first suffix that is like suffix i; order
    is the suffix array. Suffixes end with their document, and those of other documents are never alike.
    """

    def __init__(self, words: np.ndarray, documents: np.ndarray):
        n = len(words)
        self.documents, self.n = documents, n
        self.ends = np.searchsorted(documents, documents, "right") if n else np.zeros(0, np.int64)
        key = documents * (int(words.max()) + 1) + words if n else words
        self.order = np.argsort(key, kind="stable")
        ranked = key[self.order]
        head = np.concatenate(([True], ranked[1:] != ranked[:-1])) if n else np.zeros(0, bool)
        rank = np.empty(n, np.int64)
        rank[self.order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        self.ranks = [rank]
        tied = self.order[~(head & np.concatenate((head[1:], [True])))] if n else self.order
        step = 1
        while len(tied):
            tied, rank = self._refined(tied, self.ranks[-1], step)
            self.ranks.append(rank)
            step *= 2

    def _refined(self, tied: np.ndarray, rank: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes still tied after twice as many words, and the new ranks. tied: by rank."""
        after = tied + step
        inside = after < self.ends[tied]
        second = np.zeros(len(tied), np.int64)
        second[inside] = rank[after[inside]] + 1
        heads = rank[tied]
        at = np.argsort(heads * (self.n + 2) + second, kind="stable")
        tied, heads, second = tied[at], heads[at], second[at]
        new_group = np.concatenate(([True], heads[1:] != heads[:-1]))
        head = new_group | np.concatenate(([True], second[1:] != second[:-1]))
        here = np.arange(len(tied))
        group_at = np.maximum.accumulate(np.where(new_group, here, 0))
        self.order[heads + here - group_at] = tied
        refined = rank.copy()
        refined[tied] = heads + np.maximum.accumulate(np.where(head, here, 0)) - group_at
        single = head & np.concatenate((head[1:], [True]))
        return tied[~single], refined

    def common(self, least_level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left, right, words in common) of neighbours in the order that share 2**least_level words or more."""
        if self.n < 2 or least_level >= len(self.ranks):
            return (np.zeros(0, np.int64),) * 3
        rank = self.ranks[least_level]
        left, right = self.order[:-1], self.order[1:]
        room = (left + (1 << least_level) <= self.ends[left]) & (right + (1 << least_level) <= self.ends[right])
        same = (rank[left] == rank[right]) & room
        left, right = left[same], right[same]
        a, b = left.copy(), right.copy()
        for k in reversed(range(len(self.ranks))):
            fits = (a + (1 << k) <= self.ends[left]) & (b + (1 << k) <= self.ends[right])
            fits[fits] = self.ranks[k][a[fits]] == self.ranks[k][b[fits]]
            a[fits] += 1 << k
            b[fits] += 1 << k
        return left, right, a - left

    def longest(self, least: int) -> np.ndarray:
        """For each suffix, the words of its longest repeat in its document; 0 if below ``least``."""
        found = np.zeros(self.n, np.int64)
        left, right, size = self.common(max(0, least.bit_length() - 1))
        np.maximum.at(found, left, size)
        np.maximum.at(found, right, size)
        found[found < least] = 0
        return found


def covered(starts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n words lies in a span."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(starts + sizes, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def counts(texts: Texts) -> dict[str, np.ndarray]:
    """COUNTS for each document."""
    n = texts.n
    starts, ends, documents = texts.spans()
    per = lambda at, weight=None: np.bincount(at, weight, n).astype(np.int64)
    of_byte = np.repeat(np.arange(n), np.diff(texts.offsets))
    out = {"n_words": per(documents)}
    out["word_chars"] = per(of_byte, ~IS_SPACE[texts.data] & (texts.data & 0xC0 != 0x80))
    out["n_symbols"] = per(of_byte, SYMBOLS[texts.data])

    cuts = np.flatnonzero(texts.data == 10)
    line_starts = np.unique(np.concatenate((texts.offsets[:-1], cuts + 1)))
    line_starts = line_starts[line_starts < len(texts.data)]
    line_ends = np.minimum(np.append(line_starts[1:], len(texts.data)), len(texts.data))
    line_ends = line_ends - (texts.data[line_ends - 1] == 10) if len(line_starts) else line_ends
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    of_line = texts.documents(line_starts)
    lines = np.stack((of_line.astype(np.uint64), texts.hashes(line_starts, line_ends, False)), 1)
    first = np.unique(lines, axis=0)[:, 0].astype(np.int64) if len(lines) else np.zeros(0, np.int64)
    out["n_dup_lines"] = per(of_line) - per(first)

    suffixes = Suffixes(dense(texts.hashes(starts, ends, False)), documents)
    m = len(starts)
    if m >= 3 and len(suffixes.ranks) > 1:
        at = np.flatnonzero(documents[: m - 2] == documents[2:])
        key = suffixes.ranks[1][at] * (m + 1) + suffixes.ranks[0][at + 2]
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        again = at[times[which] > 1]
        out["n_repeat_words"] = per(documents, covered(again, np.full(len(again), 3), m))
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)
    longest = suffixes.longest(MIN_WORDS)
    again = np.flatnonzero(longest)
    out["covered_words"] = per(documents, covered(again, longest[again], m)) if m else np.zeros(n, np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, documents, longest)
    out["longest_repeat"] = most
    return out


def verdicts(texts: Texts) -> dict[str, np.ndarray]:
    out = counts(texts)
    words = out["n_words"]
    out["base_failed"] = (words < MIN_COUNT) | (100 * out["n_repeat_words"] > MAX_WINDOWS * words)
    out["kept"] = ~out["base_failed"] & (out["covered_words"] <= MAX_COVERED * words) & (out["longest_repeat"] <= MAX_REPEAT)
    return out


def judged(docs: DataFrame, text: str = "text", name: str = "quality") -> DataFrame:
    """docs with a struct column ``name`` (VERDICT); a column of that name is replaced."""

    @F.arrow_udf(VERDICT)
    def judge(column: pa.Array) -> pa.Array:
        parts = [verdicts(texts) for _, _, texts in slices(column)]
        names = [f.name for f in VERDICT.fields]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.bool_() if c in ("base_failed", "kept") else pa.int64()) for c in names], names)

    return docs.withColumn(name, judge(F.col(text)))
