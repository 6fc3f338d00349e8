"""Words of Arrow text columns as numpy arrays: places, documents and hashes, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20  # bytes of text looked at together; a longer text is looked at alone
SPACES = b" \t\n\x0b\x0c\r"
_ODD, _EVEN_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)  # a random number for each byte
_LOWERED = _TABLE.copy()
_LOWERED[65:91] = _TABLE[97:123]


def mix(h: np.ndarray) -> np.ndarray:
    """Bits of h spread over the whole number."""
    h = (h ^ (h >> np.uint64(30))) * _EVEN_MIX
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    return tuple(np.concatenate((one, np.cumprod(np.full(size, p, np.uint64)))) for p in (_ODD, inverse))


@dataclass
class Texts:
    """Some documents' UTF-8 bytes in a row; document i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def spans(self, gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, documents) of the words; gap: for each byte whether it parts words."""
        if not len(self.data):
            return (np.zeros(0, np.int64),) * 3
        word = ~gap[self.data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        full = self.offsets[:-1][np.diff(self.offsets) > 0]
        first[full] = word[full]
        last[full[1:] - 1] = word[full[1:] - 1]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, self.documents(starts)

    def documents(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lowered: bool) -> np.ndarray:
        """64-bit hashes of the bytes in each span: a sum of table entries times powers of an odd number, mixed."""
        size = 1 << max(20, (len(self.data) - 1).bit_length() if len(self.data) else 0)
        up, down = _powers(size)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_LOWERED if lowered else _TABLE)[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, Texts]]:
    """(from, to, texts) for runs of rows of about so many bytes; nulls are empty texts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to, Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
    del column, offsets, data
    release()


def release() -> None:
    """Gives the memory that Arrow keeps for later back to the system: workers wait between tasks, several beside each executor, and Arrow alone would keep the largest batch's."""
    pa.default_memory_pool().release_unused()


def windows(hashes: np.ndarray, documents: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, documents, first words) of each run of ``width`` words of a document; runs do not cross documents."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = len(hashes) - width + 1
    at = np.flatnonzero(documents[:m] == documents[width - 1 :])
    value = np.zeros(len(at), np.uint64)
    for k in range(width):
        value = mix(value * _ODD + hashes[at + k])
    return value, documents[at], at
