"""Ranges proved by a hash tree, lines of files without whole texts, and synchronization patterns on made threads."""

import pytest
from pyspark.sql import functions as F

from capturelake.operators import patterns
from capturelake.sources import captures


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(captures, "LEAF", 7)
    monkeypatch.setattr(captures, "FAN", 3)
    monkeypatch.setattr(captures, "HEIGHT", 5)


def made(spark, change=None):
    rows = [(c, i, "changed" if (c, i) == change else f"{c} line {i}") for c in ("a", "b") for i in range(1, 400)]
    return spark.createDataFrame(rows, "capture_id string, line_no int, text string").repartition(3)


def test_ranges_are_proved_by_their_leaves(spark, small):
    lines = made(spark)
    tree = captures.hash_tree(lines)
    root = {r.capture_id: r.root for r in captures.roots(tree).collect()}
    assert len(set(root.values())) == 2
    wanted = spark.createDataFrame([("a", root["a"], 5, 30), ("a", root["a"], 399, 500), ("b", root["b"], -3, 2), ("b", root["b"], 9, 8)], "capture_id string, root string, first_line int, last_line int")
    got = sorted((r.capture_id, r.first_line, r.line_no, r.text) for r in captures.proved_ranges(lines, tree, wanted).collect())
    assert got == sorted([("a", 5, i, f"a line {i}") for i in range(5, 31)] + [("a", 399, 399, "a line 399")] + [("b", -3, i, f"b line {i}") for i in (1, 2)])
    one = wanted.where("first_line = 5")
    assert captures.proved_ranges(made(spark, ("a", 300)), tree, one).count() == 26  # a line outside the range's leaves
    for changed in (made(spark, ("a", 20)), made(spark, ("a", 2))):  # in the range, or in a leaf that it touches
        with pytest.raises(Exception, match="capture changed: a"):
            captures.proved_ranges(changed, tree, one).count()
    for level in (0, 2, 5):  # a node beside the path, or on it
        forged = tree.withColumn("digest", F.when((F.col("level") == level) & (F.col("node") == 0) & (F.col("capture_id") == "a"), "0").otherwise(F.col("digest")))
        with pytest.raises(Exception, match="capture changed: a"):
            captures.proved_ranges(lines, forged, one).count()
    with pytest.raises(Exception, match="capture changed: a"):
        captures.proved_ranges(lines, tree, one.withColumn("root", F.lit("other"))).count()
    with pytest.raises(Exception, match="capture changed: a"):
        captures.proved_ranges(lines.where("capture_id = 'b'"), tree.where("capture_id = 'b'"), one.withColumn("first_line", F.lit(1))).count()


def test_lines_of_files(spark, tmp_path):
    texts = {"one.log": "﻿first\r\nsecond\n\nlast", "two.log": "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(1, 40_001)), "empty.log": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = {}
        for r in captures.file_lines(spark, str(tmp_path)).collect():
            got.setdefault(r.capture_id, {})[r.line_no] = r.text
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = sorted(([rows[i] for i in range(1, len(rows) + 1)] for rows in got.values()), key=len)
    assert found == [["first", "second", "", "last"], texts["two.log"].splitlines()]


def test_synchronization_patterns_of_made_threads(spark):
    juc, aqs = "java.util.concurrent.", "java.util.concurrent.locks.AbstractQueuedSynchronizer"
    rows = [
        (1, [f"at {aqs}$ConditionObject.awaitNanos(A.java:1)", "at java.base@17/jdk.internal.misc.Unsafe.park(Native Method)"], "TIMED_WAITING"),
        (2, ["at java.lang.Object.wait(Native Method)"], "RUNNABLE"),
        (3, [f"at {juc}locks.ReentrantLock.tryLock(X.java:1)", f"at {juc}CountDownLatch.await(X.java:2)"], None),
        (4, ["at app.X.y(X.java:1)"], "WAITING"),
        (5, [f"at {juc}locks.ReentrantReadWriteLock$ReadLock.lock(X.java:1)", f"at {juc}locks.ReentrantReadWriteLock$WriteLock.lock(X.java:1)"], "WAITING"),
        (6, None, "WAITING"),
    ]
    threads_ = spark.createDataFrame([("c", 0, *r) for r in rows], "capture_id string, snapshot_index int, start_line int, frames array<string>, java_state string")
    locks = spark.createDataFrame([("c", 0, 4, "0x1", "monitor-wait", "app.ReentrantLock"), ("c", 0, 5, "0x2", "synchronizer-park", None), ("c", 0, 2, "0x1", "synchronizer-park", "x")], "capture_id string, snapshot_index int, start_line int, lock_id string, kind string, lock_type string")
    got = {r.start_line: [(p.key, p.score, p.confidence, p.severity) for p in r.synchronization] for r in patterns.synchronization(patterns.evidence(threads_, locks)).collect()}
    assert got == {
        1: [("condition-await", 95, "high", "medium")], 2: [("object-wait", 45, "low", "medium")], 3: [("latch-await", 70, "medium", "medium"), ("reentrant-lock-contention", 75, "medium", "high")],
        4: [("reentrant-lock-contention", 70, "medium", "high")], 5: [("rwlock-reader-wait", 90, "high", "high"), ("rwlock-writer-lock", 90, "high", "medium")], 6: [],
    }
    chains = patterns.contention_chains(patterns.classified(threads_, locks), locks).collect()
    assert [(r.lock_id, r.owners, r.waiters) for r in chains] == [("0x2", 0, 1)]  # 0x1 is parked on by a thread in Object.wait
