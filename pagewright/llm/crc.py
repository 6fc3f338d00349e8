"""CRC-32 of many byte runs at once, and of runs put together, in numpy.

A CRC is linear: that of a run followed by another is the first's, moved on by the other's length, xor the other's. Moving on by a
length is one look-up for each byte of the value.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

POLYNOMIAL = 0xEDB88320
SHORT = 64  # runs up to this length are taken byte by byte together, others one by one


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(POLYNOMIAL), value >> 1)
    return value


def _moved(value: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """value by the move that tables (4, 256) state."""
    return tables[0][value & 255] ^ tables[1][(value >> 8) & 255] ^ tables[2][(value >> 16) & 255] ^ tables[3][value >> 24]


@lru_cache(maxsize=1)
def _moves() -> tuple[np.ndarray, list[np.ndarray]]:
    """Moves by 0 to SHORT + 1 bytes as one array (moves, 4, 256), and moves by 1, 2, 4, ... bytes."""
    none = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    near = [none]
    for _ in range(SHORT + 1):
        near.append(_table()[near[-1] & 255] ^ (near[-1] >> 8))
    powers = [near[1]]
    for _ in range(40):
        powers.append(_moved(powers[-1], powers[-1]))
    return np.stack(near), powers


def moved(value: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs moved on by so many bytes each."""
    near, powers = _moves()
    flat, at = near.reshape(-1), np.minimum(lengths, SHORT + 1) * 1024
    out = flat[at + (value & 255)] ^ flat[at + 256 + ((value >> 8) & 255)] ^ flat[at + 512 + ((value >> 16) & 255)] ^ flat[at + 768 + (value >> 24)]
    far = np.flatnonzero(lengths > SHORT + 1)
    rest = lengths[far] - (SHORT + 1)
    for k, tables in enumerate(powers):
        if not len(far) or not (rest >> k).any():
            break
        on = far[(rest >> k) & 1 > 0]
        out[on] = _moved(out[on], tables)
    return out


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """uint32 CRC-32 of each data[starts[i]:ends[i]]."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros(len(starts), np.uint32)
    long = order[: np.searchsorted(-lengths[order], -SHORT)]
    for i in long:
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    short = order[len(long) :]
    value, at, table = np.full(len(short), 0xFFFFFFFF, np.uint32), starts[short], _table()
    by_length = -lengths[short]
    for k in range(int(-by_length[0]) if len(short) else 0):
        m = np.searchsorted(by_length, -k)  # those longer than k
        value[:m] = table[(value[:m] ^ data[at[:m] + k]) & 255] ^ (value[:m] >> 8)
    out[short] = ~value
    return out
