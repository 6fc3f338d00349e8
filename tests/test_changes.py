"""Diff-only processing: restart, replay, deletion, a text that comes back, compaction."""

import json

import pytest

from pagewright.streaming import changes, notes

SCHEMA = "path string, content string, saved long, digest string"


def versions_of(spark, table, rows, version, **options):
    found = table.apply(spark.createDataFrame([(*r, None) for r in rows], SCHEMA), version, order="saved", **options)
    return sorted((r.path, r.change, r.content, r.version) for r in found.collect())


def test_versions(spark, tmp_path):
    table = changes.Changes(spark, str(tmp_path / "seen"))
    assert table.versions() == [] and table.before(5).collect() == []
    first = [("a", "A", 1), ("b", "X", 1), ("b", "B", 2), ("c", None, 1), (None, "no path", 1), ("d", "tie 1", 3), ("d", "tie 2", 3)]
    one = versions_of(spark, table, first, 0)
    assert [x[:3] for x in one if x[0] != "d"] == [("a", "insert", "A"), ("b", "insert", "B")] and len(one) == 3
    assert versions_of(spark, table, first, 0) == one  # done again: the same
    assert versions_of(spark, table, first, 1) == []
    assert versions_of(spark, table, [("a", "A2", 3), ("b", "B", 4)], 2) == [("a", "update", "A2", 2)]
    assert versions_of(spark, table, [("a", "A", 5), ("b", None, 5), ("gone", None, 1)], 3) == [("a", "update", "A", 3), ("b", "delete", None, 3)]  # A comes back
    assert versions_of(spark, table, [("a", "A2", 3), ("b", "B", 4)], 2) == [("a", "update", "A2", 2)]  # an earlier one done again
    assert versions_of(spark, table, [("b", "B", 6)], 4) == [("b", "insert", "B", 4)]
    assert versions_of(spark, table, [], 5) == []
    state = {r.path: r.deleted for r in table.before(4).collect()}
    assert state == {"a": False, "b": True, "d": False}
    table.compact(4)
    assert table.versions("base") == [4] and table.versions() == [5] and {r.path for r in table.before(6).collect()} == {"a", "b", "d"}
    assert versions_of(spark, table, [("a", "A", 9), ("b", "B3", 9)], 6) == [("b", "update", "B3", 6)]
    table.compact(6)
    assert table.versions("base") == [6] and table.versions() == []
    with pytest.raises(ValueError):
        versions_of(spark, table, [], 6)


def test_complete_listings(spark, tmp_path):
    table = changes.Changes(spark, str(tmp_path / "seen"))
    versions_of(spark, table, [("a", "A", 1), ("b", "B", 1)], 1, complete=True)
    assert versions_of(spark, table, [("b", "B", 1), ("c", "C", 1)], 2, complete=True) == [("a", "delete", None, 2), ("c", "insert", "C", 2)]
    assert versions_of(spark, table, [("b", "B", 1), ("c", "C", 1), ("a", "A", 4)], 3, complete=True) == [("a", "insert", "A", 3)]
    assert versions_of(spark, table, [], 4, complete=True) == [(p, "delete", None, 4) for p in "abc"]


def test_unfinished_version_does_not_count(spark, tmp_path):
    table = changes.Changes(spark, str(tmp_path / "seen"))
    versions_of(spark, table, [("a", "A", 1)], 0)
    (tmp_path / "seen/delta=0/_SUCCESS").unlink()
    assert table.versions() == [] and versions_of(spark, table, [("a", "A", 1)], 0) == [("a", "insert", "A", 0)]


def test_vault_folder(spark, tmp_path):
    """Snapshots of a folder of notes that are edited in place."""
    vault, table = tmp_path / "vault", changes.Changes(spark, str(tmp_path / "seen"))
    vault.mkdir()
    names = lambda found: sorted((r.path.rpartition("/")[2], r.change) for r in found.collect())
    (vault / "a.md").write_text("one #study")
    (vault / "b.md").write_text("two")
    assert names(table.apply(notes.listed(spark, str(vault)), 0, complete=True)) == [("a.md", "insert"), ("b.md", "insert")]
    (vault / "a.md").write_text("one, edited #study")
    (vault / "b.md").unlink()
    assert names(table.apply(notes.listed(spark, str(vault)), 1, complete=True)) == [("a.md", "update"), ("b.md", "delete")]
    (vault / "a.md").write_text("one #study")
    assert names(notes.marked(table.apply(notes.listed(spark, str(vault)), 2, complete=True))) == [("a.md", "update")]


class Crash(Exception):
    pass


def test_stream_with_crash_and_restart(spark, tmp_path):
    """Batches of edits as they come; one fails after its version was written and is done again after a restart."""
    drop, out = tmp_path / "drop", []
    drop.mkdir()
    table = changes.Changes(spark, str(tmp_path / "seen"))
    fails = [2]

    def process(changed, batch):
        rows = sorted((r.path, r.change) for r in changed.collect())
        if batch in fails:
            fails.remove(batch)
            raise Crash
        out.append((batch, rows))

    def run():
        source = spark.readStream.schema("path string, content string, saved long").json(str(drop))
        query = source.writeStream.foreachBatch(table.sink(process, order="saved")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()

    edits = [[("a", "A"), ("b", "B")], [("a", "A"), ("b", "B2")], [("a", "A3"), ("b", None)], [("a", "A"), ("b", "B")]]
    for i, rows in enumerate(edits):
        (drop / f"{i}.json").write_text("\n".join(json.dumps({"path": p, "content": c, "saved": i}) for p, c in rows))
        if i == 2:
            with pytest.raises(Exception, match="Crash"):
                run()
        run()
    assert out == [(0, [("a", "insert"), ("b", "insert")]), (1, [("b", "update")]), (2, [("a", "update"), ("b", "delete")]), (3, [("a", "update"), ("b", "insert")])]
