"""Token ids in files of directly addressable codes (DAC).

A file holds the ids of some documents, in ascending document order. Ids are cut into 8-bit chunks, lowest first. Level k
holds the k-th chunk of every id that reaches that far, and a bitmap that says which ids go on; the place of an id on
the next level is the number of set bits before it, found from a directory with the running count of each 512-bit
block. So any id is read from a few bytes, and no block is decoded.

    magic "PWDAC001" | uint32 length of the JSON header | header | sections
    header: docs, tokens, levels (number of codes on each), crc32 of the sections
    sections: document ids (int64), null document ids (uint8), document starts (uint64, docs + 1),
              then for each level: chunks (uint8), bitmap (uint8, lowest bit first), directory (uint32)

Tasks write range-sorted documents, roll to a new file after ``roll`` tokens, and put files in place under a temporary name
first; the manifest (one row per file) is written by Spark's own committer, and only files in it are read.

Defined results: null and empty texts are documents with the end id alone; documents with null ids come first; rows alike in
every column are documents of their own, next to each other; an empty table writes no file.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from . import storage
from .text import Texts

MAGIC, BLOCK = b"PWDAC001", 512
ROLL = 16_000_000  # tokens in a file
KEPT_WORDS, KEPT_LENGTH, TOGETHER = 400_000, 64, 500  # bound of a worker's memory of encoded words
STEP = 1 << 20  # characters encoded at a time
PARTS = np.zeros(256, bool)  # bytes between words
PARTS[[10, 32]] = True
LETTERS = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+"
PLAIN, MARKED = re.compile(LETTERS), re.compile(rb"(" + LETTERS + rb")([!-/:-@\[-`{-~]+)")
BYTES = {0x9F: 0x141, 0xA0: 0x142, 0xAD: 0x143}  # characters that stand for these bytes; others of letters stand for themselves


# --- the codes


def rank_directory(bits: np.ndarray) -> np.ndarray:
    """Set bits before each block of BLOCK bits."""
    padded = np.zeros(-(-len(bits) // BLOCK) * BLOCK, np.uint8)
    padded[: len(bits)] = bits
    return np.concatenate(([0], np.cumsum(padded.reshape(-1, BLOCK).sum(1, dtype=np.uint32))[:-1])).astype("<u4") if len(bits) else np.zeros(0, "<u4")


def encode(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, directory) of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest):
        goes_on = rest > 255
        levels.append(((rest & 255).astype(np.uint8), np.packbits(goes_on, bitorder="little"), rank_directory(goes_on)))
        rest = rest[goes_on] >> 8
    return levels


def pack(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """A file's bytes, in pieces."""
    levels = encode(ids)
    sections = [
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.asarray(starts, "<u8").tobytes(),
        *(x.tobytes() for level in levels for x in level),
    ]
    crc = 0
    for s in sections:
        crc = zlib.crc32(s, crc)
    header = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "levels": [len(c) for c, _, _ in levels], "crc32": crc}).encode()
    return [MAGIC, len(header).to_bytes(4, "little"), header, *sections]


class TokenFile:
    """Reads a file's bytes: single tokens at once, or whole spans."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        at = 12 + int.from_bytes(data[8:12], "little")
        header = json.loads(data[12:at])
        if zlib.crc32(memoryview(data)[at:]) != header["crc32"]:
            raise ValueError("damaged token file")

        def section(kind: str, n: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(data, kind, n, at)
            at += part.nbytes
            return part

        n = header["docs"]
        numbers, nulls = section("<i8", n), section("u1", n)
        self.doc_ids = [None if null else int(d) for d, null in zip(numbers, nulls, strict=True)]
        self.starts, self.tokens = section("<u8", n + 1).astype(np.int64), header["tokens"]
        self.levels = [(section("u1", m), section("u1", -(-m // 8)), section("<u4", -(-m // BLOCK))) for m in header["levels"]]

    def __getitem__(self, i: int) -> int:
        """Token i of the file, by one chunk and one rank a level."""
        value, shift = 0, 0
        for chunks, bitmap, directory in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            inside = np.unpackbits(bitmap[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i, shift = int(directory[block]) + int(inside.sum()), shift + 8
        return value

    def all(self) -> np.ndarray:
        """Every id, as uint32."""
        values: np.ndarray | None = None
        for chunks, bitmap, _ in reversed(self.levels):
            level = chunks.astype("<u4")
            if values is not None:
                goes_on = np.unpackbits(bitmap, count=len(chunks), bitorder="little").view(bool)
                level[goes_on] |= values << np.uint32(8)
            values = level
        return np.zeros(0, "<u4") if values is None else values


# --- the ids


def parted(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(each word's place among the different words, these, the words up to each text's end) of texts parted at spaces and line ends; A-Z are lower-cased, but in texts with special tokens, which count as written."""
    data = b"".join([t if b"<|" in t else t.lower() for t in texts])
    offsets = np.cumsum([0, *map(len, texts)])
    texts = Texts(np.frombuffer(data, np.uint8), offsets)
    starts, ends, _ = texts.spans(PARTS)
    kept = texts.data[~PARTS[texts.data]]
    limits = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(limits), pa.py_buffer(kept)]).dictionary_encode()
    _, limits, kept = words.dictionary.buffers()
    limits, kept = np.frombuffer(limits, np.int32, len(words.dictionary) + 1).tolist(), kept.to_pybytes() if kept else b""
    return words.indices.to_numpy(), [kept[a:b] for a, b in pairwise(limits)], np.searchsorted(starts, offsets[1:])


class Encoder(dict):
    """Ids (uint32, as bytes) of texts under a tokenizers file that lower-cases and never keeps white space.

    Such a text's ids are those of its space-parted words in a row, so words met before are not encoded again. Words are
    kept in two generations: when the young one is full it becomes the old one, and old words that are met move up.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.old = Tokenizer.from_file(path), {}
        self.mark_id, self.mark = max((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items())
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        if ids(" Ab1  cD\nE, f's.") != [i for part in ("ab1", "cd", "e", ",", "f's", ".") for i in ids(part)]:
            raise ValueError(f"{path}: its ids are not those of lower-cased words in a row")
        self.model, added = self.tokenizer.model, [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = ["q", "the", "zxqvning", *(w for c in range(0xDF, 0x100) if c != 0xF7 for w in (chr(c), f"t{chr(c)}e"))]
        if any(self.is_plain(t.encode()) for t in added) or any(ids(w) != [t.id for t in self.model.tokenize(self.letters(w.encode()))] for w in plain):
            raise ValueError(f"{path}: its ids of plain words are not those of its model")

    def texts(self, texts: list[str]) -> list[bytes]:
        index, words, ends = parted([t.encode() for t in texts])
        new, old = [w for w in words if w not in self], self.old
        if len(self) + len(new) > KEPT_WORDS:
            self.old = dict(self)
            self.clear()
            old, new = old | self.old, words
        marked, stems = [], {}
        for word in new:
            if (known := old.get(word)) is not None:
                self[word] = known
                continue
            stem, end = self.stem(word)
            if end:
                marked.append((word, stem, end))
                stems[end] = None
            stems[stem] = None
        stems = [s for s in stems if s not in self]
        others = []
        for stem in stems:
            if self.is_plain(stem):
                self[stem] = array("I", [t.id for t in self.model.tokenize(self.letters(stem))]).tobytes()
            else:
                others.append(stem)
        for stem, ids in zip(others, self.encoded(others), strict=True):
            self[stem] = ids
        for word, stem, end in marked:
            self[word] = self[stem] + self[end]
        found = list(map(self.__getitem__, words))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, size = (np.cumsum(sizes) - sizes)[index], sizes[index]
        upto = np.append(0, np.cumsum(size))
        places = np.repeat(first - upto[:-1], size)
        places += np.arange(upto[-1])
        data = np.frombuffer(b"".join(found), "<u4")[places].tobytes()
        cuts = (4 * upto[ends]).tolist()
        out = [data[a:b] for a, b in pairwise([0, *cuts])]
        for word in [*stems, *(word for word, _, _ in marked)]:
            if len(word) > KEPT_LENGTH:
                del self[word]
        return out

    @staticmethod
    def stem(word: bytes) -> tuple[bytes, bytes]:
        """The word without the marks of ASCII at its end that follow plain letters, or a last full stop or comma after an ASCII letter or digit, where the pre-tokenizer parts it anyway; and those marks."""
        if found := MARKED.fullmatch(word):
            return found.groups()
        return (word[:-1], word[-1:]) if word[-1:] in (b".", b",") and word[-2:-1].isalnum() else (word, b"")

    @staticmethod
    def is_plain(word: bytes) -> bool:
        """Small letters of ASCII and Latin-1 alone: what precedes the library's model leaves them in one piece, as they are or as characters for their bytes."""
        return PLAIN.fullmatch(word) is not None

    @staticmethod
    def letters(word: bytes) -> str:
        """A plain word as the model gets it: a character for each byte."""
        return word.decode("latin-1").translate(BYTES)

    def encoded(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word; many are encoded at once with a special token between them, which parts any text."""
        out: list[bytes] = []
        for at in range(0, len(words), TOGETHER):
            some = [w.decode() for w in words[at : at + TOGETHER]]
            if any("<|" in w for w in some):
                out += [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            data = ids.tobytes()
            out += [data[4 * a : 4 * b] for a, b in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True)]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, path: str, end_id: int, folder: str, partitions: int, roll: int = ROLL) -> DataFrame:
    """Encodes docs (doc_id bigint, text string) into files in folder; gives the manifest (file, tokens, docs), written."""

    def encode_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoding = TaskContext.get(), encoder(path)
        end, doc_ids, pieces, held, made = np.array([end_id], "<u4").tobytes(), [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, pieces, held, made
            starts = np.concatenate(([0], np.cumsum([len(p) // 4 for p in pieces])))
            name = f"part-{task.partitionId():06d}-{made:04d}.dac"
            storage.put(folder, name, task.taskAttemptId(), pack(doc_ids, starts, np.frombuffer(b"".join(pieces), "<u4")))
            row = pa.RecordBatch.from_pydict({"file": [name], "tokens": pa.array([held], pa.int64()), "docs": pa.array([len(doc_ids)], pa.int64())})
            doc_ids, pieces, held, made = [], [], 0, made + 1
            return row

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                some, size = [], 0
                while at + len(some) < len(ids) and size < STEP:
                    some.append(texts[at + len(some)].as_py() or "")
                    size += len(some[-1])
                for one, got in zip(ids[at : at + len(some)], encoding.texts(some), strict=True):
                    doc_ids.append(one)
                    pieces.append(got + end)
                    held += len(pieces[-1]) // 4
                    if held >= roll:
                        yield close()
                at += len(some)
        if doc_ids:
            yield close()

    sorted_docs = docs.select("doc_id", "text").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    return storage.written(sorted_docs.mapInArrow(encode_part, "file string, tokens long, docs long"), "token-manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the manifest's files."""
    spark = manifest.sparkSession
    starts = manifest.select("file", (F.sum("tokens").over(W.partitionBy(F.lit(0)).orderBy("file")) - F.col("tokens")).alias("before"))  # a row per file

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                got = TokenFile(batch.column(1)[row].as_py())
                data, starts = memoryview(got.all()).cast("B"), got.starts
                yield pa.RecordBatch.from_pydict({
                    "file": pa.array([batch.column(0)[row].as_py()] * len(got.doc_ids), pa.string()),
                    "doc_id": pa.array(got.doc_ids, pa.int64()),
                    "inside": pa.array(starts[:-1]),
                    "n_tokens": pa.array(np.diff(starts)),
                    "ids_crc32": pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.int64()),
                })

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.dac").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    kept = files.join(manifest.select("file"), "file", "left_semi")
    docs = kept.mapInArrow(decode, "file string, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(starts, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
