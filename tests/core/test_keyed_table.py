"""Bucketed tables with manifests: latest rows, replayed batches, pinned readers, writers that collide; files that appear whole."""

import pytest

from lectern.sources.files import publish, read_text, write_json_lines
from lectern.streaming.keyed_table import ConcurrentWrite, KeyedTable

KIND = "id long, name string, at int"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), KIND)


def held(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "table"), KIND, ["id"], "at", buckets=4)


def test_latest_rows_and_replayed_batches(spark, table):
    assert held(table.snapshot()) == [] and table.versions() == []
    assert table.upsert(batch(spark, (1, "a", 1), (2, "b", 1), (1, "c", 3), (None, "x", 1), (3, "y", None)), "s", 0) == 1
    assert held(table.snapshot()) == [(1, "c", 3), (2, "b", 1)]
    assert table.upsert(batch(spark, (1, "old", 2), (2, "new", 2), (4, "tie", 1), (4, "tied", 1)), "s", 1) == 2
    want = [(1, "c", 3), (2, "new", 2), (4, "tied", 1)]
    assert held(table.snapshot()) == want
    assert table.upsert(batch(spark, (1, "again", 99)), "s", 1) == table.upsert(batch(spark, (1, "again", 99)), "s", 0) == 2
    assert held(table.snapshot()) == want
    assert table.upsert(batch(spark, (1, "other stream", 9)), "t", 0) == 3
    assert table.upsert(batch(spark), "t", 1) == 4 and len(held(table.snapshot())) == 3


def test_only_touched_buckets_are_written(spark, table):
    table.upsert(batch(spark, *((i, "a", 1) for i in range(40))))
    first = table.manifest()["buckets"]
    table.upsert(batch(spark, (7, "b", 2)))
    second = table.manifest()["buckets"]
    assert len(first) == 4 and sum(first[b] != second[b] for b in first) == 1
    assert len(held(table.snapshot())) == 40


def test_readers_stay_on_their_version(spark, table):
    table.upsert(batch(spark, (1, "a", 1), (2, "a", 1)))
    pinned = table.snapshot()
    table.upsert(batch(spark, (1, "b", 2), (3, "b", 2)))
    table.upsert(batch(spark, (2, "c", 3)))
    assert held(pinned) == [(1, "a", 1), (2, "a", 1)] == held(table.snapshot(1))
    assert held(table.snapshot()) == [(1, "b", 2), (2, "c", 3), (3, "b", 2)]
    gone = table.vacuum(keep=1)
    assert table.versions() == [3] and gone and held(table.snapshot()) == [(1, "b", 2), (2, "c", 3), (3, "b", 2)]


def test_writers_that_collide(spark, table):
    table.upsert(batch(spark, (1, "a", 1)))
    other, seen = KeyedTable(spark, table.folder, KIND, ["id"], "at", buckets=4), table.manifest
    table.manifest = lambda version=None: {**seen(version), "version": 1} if version is None else seen(version)
    other.upsert(batch(spark, (2, "b", 1)))
    with pytest.raises(ConcurrentWrite):
        table.upsert(batch(spark, (3, "c", 1)), attempts=2)
    table.manifest = seen
    table.upsert(batch(spark, (3, "c", 1)))
    assert held(table.snapshot()) == [(1, "a", 1), (2, "b", 1), (3, "c", 1)]


def test_files_appear_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "deep" / "one.json")
    assert publish(spark, path, "é") and read_text(spark, path) == "é"
    assert not publish(spark, path, "other") and read_text(spark, path) == "é"
    assert [p.name for p in (tmp_path / "deep").iterdir() if not p.name.endswith(".crc")] == ["one.json"]
    lines = str(tmp_path / "lines")
    write_json_lines(spark.createDataFrame([(1, None)], "a int, b string"), lines)
    assert [r.value for r in spark.read.text(lines).collect()] == ['{"a":1,"b":null}']
    with pytest.raises(FileExistsError):
        write_json_lines(spark.range(1), lines)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["deep", "lines"]
