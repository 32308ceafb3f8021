import json
import datetime as dt

import pytest

from fernglass.operators.incremental import LAYERS, VERSIONS, ConflictError, VersionedTarget, WriterLock, committed_versions, instant, pending_documents, process_changes, succeeded_runs
from pyspark.sql import functions as F

DOCS = "doc_id long, content_hash string, mtime double, last_seen_run string, lifecycle string, status string"
LOG = "run_id string, doc_id long, content_hash string, outcome string, recorded_at timestamp, status string"
RUNS = "run_id string, started_at string, finished_at string, status string, doc_id long"


def at(n):
    return dt.datetime(2026, 1, n, 12)


@pytest.fixture(scope="module")
def tables(spark):
    runs = spark.createDataFrame(
        [
            ("r1", None, "2026-01-01T10:00:00Z", "OK", 1),
            ("r2", None, "2026-01-02T10:00:00+05:00", "ok", 1),
            ("r2", None, "2026-01-02T09:00:00Z", "failed", 1),  # later as an instant
            ("r3", None, None, "ok", 1),
            ("r4", None, "2026-01-01T23:30:00-02:00", " ok ", 1),  # finished last
            (None, None, "2026-01-09T00:00:00Z", "ok", 1),
            ("r5", None, "soon", "ok", 1),
        ],
        RUNS,
    )
    log = spark.createDataFrame(
        [
            ("r1", 1, "aa", "indexed", at(1), "x"),
            ("r4", 1, "bb", "skipped", at(1), "x"),
            ("r4", 1, "cc", "skipped", at(2), "x"),  # the latest record of the last run
            ("r1", 2, "AA", "empty", at(1), "x"),
            ("r2", 3, "aa", "indexed", at(1), "x"),  # its run failed
            ("r1", 4, "aa", "failed", at(1), "x"),
            ("r1", 5, None, "indexed", at(1), "x"),
            ("r1", 7, "aa", "indexed", at(1), "x"),
            ("r9", 7, "zz", "indexed", at(9), "x"),  # no such run
            ("r1", 7, "aa", "indexed", at(1), "x"),
        ],
        LOG,
    )
    docs = spark.createDataFrame(
        [(1, "CC", 1.0, None, "active", "s"), (2, "aa", None, "r1", None, "s"), (3, "aa", 1.0, None, "stale", "s"), (4, "aa", 1.0, None, "active", "s"), (5, "aa", 1.0, None, "active", "s"), (6, " ", 1.0, None, "active", "s"), (6, " ", 1.0, None, "active", "s"), (7, None, 1.0, None, "active", "s"), (8, "aa", 1.0, None, "Retracted", "s"), (None, "aa", 1.0, None, "active", "s")],
        DOCS,
    )
    return docs, log, runs


def test_instants_of_any_offset(spark):
    rows = spark.createDataFrame([("2026-01-01T00:00:00+05:30",), ("2026-01-01 00:00:00Z",), ("2026-01-01T00:00:00.123456",), ("2026-01-01T00:00:00-0200",), ("2026-01-01T00:00:00-02",), ("x",), (None,), ("",)], "t string")
    got = [r[0] for r in rows.select(F.unix_seconds(instant(F.col("t")))).collect()]
    base = 1767225600
    assert got == [base - 19800, base, base, base + 7200, base + 7200, None, None, None]


def test_runs_succeed_by_their_last_row(tables):
    assert {r["run_id"] for r in succeeded_runs(tables[2]).collect()} == {"r1", "r4"}


def test_committed_is_the_last_record_of_the_last_run(tables):
    assert {r["doc_id"]: r["committed_hash"] for r in committed_versions(*tables[1:]).collect()} == {1: "cc", 2: "aa", 5: None, 7: "aa"}


def test_pending_each_once(tables):
    assert sorted(r["doc_id"] for r in pending_documents(*tables).collect()) == [3, 4, 5, 6, 7]


def test_empty_tables(spark, tables):
    empty = [spark.createDataFrame([], s) for s in (DOCS, LOG, RUNS)]
    assert pending_documents(*empty).count() == 0
    assert sorted(r["doc_id"] for r in pending_documents(tables[0], *empty[1:]).collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_target_publishes_whole_versions(spark, tmp_path):
    target = VersionedTarget(spark, str(tmp_path))
    assert target.current() is None and target.read() is None
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, content_hash string, n long")
    seen = []

    def transform(df):
        seen.append(sorted(r["doc_id"] for r in df.collect()))
        return df

    process_changes(target, rows((1, "a", 1), (2, "b", 1), (2, "b", 1)), transform, "run1")
    process_changes(target, rows((1, "A", 2), (2, "c", 2), (3, None, 2)), transform, "run2")
    process_changes(target, rows((1, "a", 3), (2, "c", 3)), transform, "run2")
    assert seen == [[1, 2], [2, 3], []]
    assert sorted((r["doc_id"], r["n"]) for r in target.read().collect()) == [(1, 1), (2, 2)]


def test_a_failed_run_changes_nothing(spark, tmp_path):
    target = VersionedTarget(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a")], "doc_id long, content_hash string")
    process_changes(target, rows, lambda d: d, "run1")
    with pytest.raises(Exception):
        process_changes(target, spark.createDataFrame([(1, "b")], "doc_id long, content_hash string"), lambda d: d.withColumn("x", F.raise_error(F.lit("crash")).cast("string")), "run2")
    assert [tuple(r) for r in target.read().collect()] == [(1, "a")]


def test_only_changes_are_written_and_layers_are_put_together(spark, tmp_path):
    target = VersionedTarget(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, content_hash string")
    process_changes(target, rows(*((n, "a") for n in range(50))), lambda d: d, "r0")
    state = {n: "a" for n in range(50)}
    for k in range(1, 11):
        state[k] = f"v{k}"
        state.pop(k + 20)
        process_changes(target, rows(*state.items()), lambda d: d, f"r{k}")
        if k == 1:
            newest = target.current()["layers"][-1]
            assert spark.read.parquet(f"{tmp_path}/{newest}/rows").count() == 1 and spark.read.parquet(f"{tmp_path}/{newest}/gone").count() == 2
    assert {r["doc_id"]: r["content_hash"] for r in target.read().collect()} == state
    assert len(target.current()["layers"]) < LAYERS and target.number() == 11
    versions = [p.name for p in (tmp_path / "versions").iterdir() if p.suffix == ".json"]
    named = {x for v in versions for x in json.loads((tmp_path / "versions" / v).read_text())["layers"]}
    assert len(versions) == VERSIONS and {f"layers/{p.name}" for p in (tmp_path / "layers").iterdir()} == named
    process_changes(target, rows(*state.items()), lambda d: d, "again")
    assert target.number() == 11


def test_of_two_runs_from_one_base_the_second_raises(spark, tmp_path):
    target = VersionedTarget(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a")], "doc_id long, content_hash string")
    target.publish(rows, "r1")
    base = target.number()
    target.apply(rows.withColumn("content_hash", F.lit("b")), rows, "r2", base)
    with pytest.raises(ConflictError):
        target.apply(rows.withColumn("content_hash", F.lit("c")), rows, "r3", base)
    assert [tuple(r) for r in target.read().collect()] == [(1, "b")]


def test_one_writer_at_a_time(spark, tmp_path):
    with WriterLock(spark, str(tmp_path)):
        with pytest.raises(ConflictError), WriterLock(spark, str(tmp_path), wait=0.3):
            pass
        with WriterLock(spark, str(tmp_path), abandoned=-1):
            pass
        (tmp_path / "LOCK").write_text('{"holder": "another", "since": 9e18}')
    assert (tmp_path / "LOCK").exists()  # another's lock is left alone
