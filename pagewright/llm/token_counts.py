"""Token counts by byte-pair merging: a heap of adjacent pairs over a linked list of symbols, no ids.

Symbols of a word start as characters; the pair of lowest rank (leftmost on a tie) merges again and again. The count is
the initial symbols less the merges; a character that the vocabulary lacks counts its UTF-8 bytes. No piece spans the
step from another character to a space mark, so words merge apart and a word's count can be kept.

Defined results: null and empty texts have 0 tokens; texts may be of any length, with or without spaces.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType

MARK = "▁"  # stands for a space inside pieces
KEPT_WORDS, KEPT_LENGTH = 400_000, 64  # bound of a worker's memory of counted words
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Merger(dict):
    """Counts of words by word; a word that is not there yet is merged when asked for.

    A key stands for the characters after a space mark; one that starts with a line end stands for itself alone.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        """pieces: (text, score); a higher score merges first."""
        super().__init__()
        self.rank = {text: -score for text, score in pieces}

    def __missing__(self, word: str) -> int:
        count = self.merged(word if word[:1] == "\n" else MARK + word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = count
        return count

    def merged(self, text: str) -> int:
        """Initial symbols minus merges."""
        rank, n = self.rank, len(text)
        symbols = list(text)
        weight = [1 if c in rank else len(c.encode()) for c in symbols]
        count, before, after = sum(weight), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank[p], i, i + 1, 2) for i in range(n - 1) if (p := text[i : i + 2]) in rank]
        heapify(heap)
        while heap:
            _, i, j, size = heappop(heap)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of the two has merged meanwhile
            count -= weight[i] + weight[j] - 1
            symbols[i] += symbols[j]
            symbols[j], weight[i] = "", 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get(p := symbols[i] + symbols[k])) is not None:
                    heappush(heap, (r, i, k, len(p)))
            if (h := before[i]) >= 0 and (r := rank.get(p := symbols[h] + symbols[i])) is not None:
                heappush(heap, (r, h, i, len(p)))
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace("\n", " \n").split(" ")
        if "" in words or MARK in text:  # runs of spaces belong to the word they stand before
            return sum(self[w[1:]] if w[1:2] != "\n" else self.merged(w) for w in WORDS.findall(MARK + text.replace(" ", MARK)))
        return sum(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    """The merger of a sentencepiece BPE model file; its pieces and scores are read with the library."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = (model.is_byte, model.is_control, model.is_unknown, model.is_unused)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not any(f(i) for f in odd)]
    for text, _ in pieces:
        if re.search(f"[^{MARK}]{MARK}", text):
            raise ValueError(f"piece {text!r} spans words")
    return Merger(pieces)


def token_count(text: Column, path: str) -> Column:
    """bigint: the tokens of the text under the model at path, without begin or end tokens."""

    @F.pandas_udf(LongType())
    def counted(texts: pd.Series) -> pd.Series:
        count = merger(path).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    return counted(text)
