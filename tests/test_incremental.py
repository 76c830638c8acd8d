import pytest

from cairnlake import session
from cairnlake.operators.incremental import Manifest, VersionConflict, VersionedTable, indexed_state, paths_to_process, present_content, process_new


@pytest.fixture
def table(spark):
    return VersionedTable(spark, session.fresh_dir(spark, "t"), "k long, v string")


def rows(spark, *r):
    return spark.createDataFrame(list(r), "k long, v string")


def same(old, new):
    return old("v").eqNullSafe(new("v"))


def test_versions_and_changes(spark, table):
    assert table.latest() == 0 and table.read().count() == 0
    table.append(rows(spark, (1, "a"), (2, "b"), (3, None)))
    assert table.merge(rows(spark, (1, "a"), (2, "x"), (4, "n")), ["k"], same) == 2
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "x"), (4, "n")]
    assert sorted(map(tuple, table.read(1).collect())) == [(1, "a"), (2, "b"), (3, None)]
    assert sorted(map(tuple, table.changes(1).collect())) == [("delete", 2, "b"), ("delete", 3, None), ("insert", 2, "x"), ("insert", 4, "n")]
    assert table.changes(2).count() == 0 and table.merge(table.read(), ["k"], same) == 2
    table.replace(rows(spark, (9, "z")))
    assert sorted(map(tuple, table.changes(2).collect())) == [("delete", 1, "a"), ("delete", 2, "x"), ("delete", 4, "n"), ("insert", 9, "z")]
    with pytest.raises(VersionConflict):
        table._publish(Manifest(2))


def test_compaction_changes_no_row(spark, table):
    for i in range(4):
        table.append(rows(spark, (i, "a")))
    table.merge(rows(spark, (0, "a"), (1, "b"), (2, "a")), ["k"], same)
    at = table.compact(1)
    assert at == 6 and len(table.manifest().files) == 1 and not table.manifest().vectors
    assert sorted(map(tuple, table.read().collect())) == [(0, "a"), (1, "b"), (2, "a")] == sorted(map(tuple, table.read(5).collect()))
    assert table.changes(5).count() == 0 == table.changes(6).count()
    table.append(rows(spark, (9, "z")))
    assert sorted(map(tuple, table.changes(4).collect())) == [("delete", 1, "a"), ("delete", 3, "a"), ("insert", 1, "b"), ("insert", 9, "z")]
    assert VersionedTable(spark, table.root + "x", table.schema).compact() == 1


def test_unchanged_files_are_not_opened(spark, table):
    for i in range(6):
        table.append(rows(spark, (i, "a")))
    v = table.latest()
    table.merge(rows(spark, *[(i, "b" if i == 3 else "a") for i in range(6)]), ["k"], same)
    opened = []
    read, table._rows = table._rows, lambda files: opened.extend(files) or read(files)
    assert sorted(map(tuple, table.changes(v).collect())) == [("delete", 3, "a"), ("insert", 3, "b")] and len(opened) == 2


def test_a_failed_run_is_repeated_whole_and_a_done_one_is_not(spark, table):
    out = VersionedTable(spark, session.fresh_dir(spark, "o"), "k long")
    table.append(rows(spark, (1, "a"), (2, "b")))
    keys = lambda c: c.filter("_change = 'insert'").select("k")

    def dies(c):
        out._store(keys(c), "data")  # files are written, but nothing is published
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        process_new(table, out, dies)
    assert out.read().count() == 0
    assert process_new(table, out, keys) == 1 and process_new(table, out, keys) is None
    table.append(rows(spark, (3, "c")))
    assert process_new(table, out, keys) == 2
    assert sorted(r["k"] for r in out.read().collect()) == [1, 2, 3]


H = ["a" * 64, "b" * 64, "c" * 64]
INDEX = "path string, content_hash string, mtime long, size long, indexed_at long, scan_id string"
SCAN = "scan_id long, path string, content_hash string, mtime long, size long, scanned_at long"
RUNS = "run_id long, started_at long, finished_at long, status string"


def test_paths_to_process(spark):
    runs = spark.createDataFrame([(1, 10, 20, "ok"), (2, 30, 40, "failed"), (3, 50, None, "killed"), (4, 60, 70, "ok")], RUNS)
    index = spark.createDataFrame([
        ("same", "sha256:" + H[0].upper(), 1, 1, 20, "x"), ("same", "sha256:" + H[0].upper(), 1, 1, 20, "x"), ("changed", H[0], 1, 1, 10, "x"), ("half", H[0], 1, 1, 15, "x"), ("half", H[1], 1, 1, 35, "x"),
        ("killed", H[1], 1, 1, 55, "x"), ("back", H[1], 1, 1, 65, "x"), ("back", H[0], 1, 1, 12, "x"), ("gone", H[0], 1, 1, 12, "x"), (None, H[0], 1, 1, 12, "x"), ("unread", H[0], 1, 1, 12, "x"),
    ], INDEX)
    scan = spark.createDataFrame([
        (1, "same", " " + H[0] + "\n", 1, 1, 5), (2, "changed", H[1], 1, 1, 5), (3, "half", H[1], 1, 1, 5), (4, "killed", H[1], 1, 1, 5), (5, "back", H[1], 1, 1, 5), (6, "new", H[2], 1, 1, 5), (6, "new", H[2], 1, 1, 5),
        (7, "unread", None, 1, 1, 9), (8, "twice", H[0], 1, 1, 1), (9, "twice", H[1], 1, 1, 2), (10, "same", None, 1, 1, 9),
    ], SCAN)
    root = session.fresh_dir(spark, "p2")
    assert sorted(r["path"] for r in paths_to_process(index, runs, scan, root).collect()) == ["changed", "half", "killed", "new", "twice"]
    # a repeated call redoes nothing, one that died before its commit is made up for
    again = VersionedTable(spark, f"{root}/todo", "path string")
    before = again.latest()
    assert paths_to_process(index, runs, scan, root).count() == 5 and again.latest() == before
    later = spark.createDataFrame([(11, "same", H[1], 1, 1, 20)], SCAN)
    content = VersionedTable(spark, f"{root}/content", "path string, hash string")
    content.merge(present_content(scan.unionByName(later)), ["path"], lambda old, new: old("hash").eqNullSafe(new("hash")))
    got = paths_to_process(index, runs, scan.unionByName(later), root)
    assert sorted(r["path"] for r in got.collect()) == ["changed", "half", "killed", "new", "same", "twice"] and again.read().count() == 6
    assert {tuple(r) for r in present_content(scan).filter("path = 'twice'").collect()} == {("twice", H[1])}
    assert indexed_state(index, runs.limit(0)).count() == 0
    assert paths_to_process(index.limit(0), runs, scan.limit(0), root + "e").count() == 0
