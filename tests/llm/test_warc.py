import base64
import gzip
import hashlib
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagewright.llm import skew, storage, warc

ROWS = [(1, "http://a/x y\n", "<p>é</p>", 5), (2, None, None, 5), (3, "u", "", None), (4, "u", "<p>é</p>", 0), (None, "u", "<p>é</p>", 0), (None, None, "own", 1), (7, "u", "z" * 300_000, 1), (7, "v", "other", 1), (8, "v", "other", 1), (8, "v", "other", 1)]
SCHEMA = "page_id long, url string, html string, kept_page int"


def expected(rows):
    out = []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        kept = max(same, default=None)
        revisit = kept is not None and kept != page_id
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", kept if revisit else None))
    return sorted(out, key=str)


def run(spark, rows, roll=200):
    folder = storage.new_file_folder(spark, "warc")
    manifest = warc.write(spark.createDataFrame(rows, SCHEMA), folder, 3, roll)
    return folder, manifest, sorted((tuple(r) for r in warc.read(manifest, folder).collect()), key=str)


def contents(folder):
    return {p.name: p.read_bytes() for p in Path(storage._local(folder)).glob("part-*")}


def test_round_trip(spark):
    folder, manifest, got = run(spark, ROWS)
    assert got == expected(ROWS)
    assert {r.file for r in manifest.collect()} == set(contents(folder)) and manifest.count() > 3
    plain = b"".join(map(gzip.decompress, contents(folder).values()))
    assert plain.count(b"WARC-Type: revisit") == 4 and b"WARC-Target-URI: http://a/x%20y%0A\r\n" in plain


def test_bytes_depend_on_the_rows_alone(spark):
    first, second = run(spark, ROWS)[0], run(spark, ROWS[::-1])[0]
    assert contents(first) == contents(second)


def test_empty_table(spark):
    assert run(spark, [])[2] == []


def test_damage_is_seen():
    data = warc.page_record(1, "u", b"abc", None)
    assert list(warc.records(data))[0][0]["page-id"] == "1"
    with pytest.raises((ValueError, Exception)):
        list(warc.records(data[:-4]))


def test_lookup_with_hot_and_null_keys(spark):
    left = spark.range(3000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("4", 2), ("x", 3)], "k string, v int")
    got = {r.i: r.v for r in skew.lookup(left, right, "k").collect()}
    assert len(got) == 3000 and all(v == (1 if i % 3 == 0 else 2 if i == 4 else None) for i, v in got.items())


def test_reading_grows_with_the_file(monkeypatch):
    """Each member was given the whole rest of its file, which was copied for each record."""
    payloads = [b"", b"x" * 100_000, hashlib.sha256(b"1").digest() * 3, *(b"%d" % i for i in range(500)), b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(4000))]
    data = b"".join(warc.page_record(i, "u", p, None) for i, p in enumerate(payloads))
    given, made = [], zlib.decompressobj

    class Counted:
        def __init__(self, *how):
            self.own = made(*how)

        def decompress(self, part, *most):
            given.append(len(part))
            return self.own.decompress(part, *most)

        def __getattr__(self, name):
            return getattr(self.own, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counted)
    assert [block.partition(b"\r\n\r\n")[2] for _, block in warc.records(data)] == payloads
    assert sum(given) <= len(data) + len(payloads) * warc.PART
