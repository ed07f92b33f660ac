"""Answers that must not depend on a fixed choice of lines, intervals or days."""

import pytest
from pyspark.sql import functions as F

from capturelake.operators import evidence
from capturelake.plans import findings  # noqa: F401
from capturelake.sources import captures


def test_interval_rows_show_and_rank_every_interval(spark):
    rates = spark.createDataFrame([("s", "late", i, 90.0 if i == 29 else 1.0) for i in range(2, 31)] + [("s", "early", 3, 50.0), ("s", "none", 4, None)], "session string, thread_name string, snapshot int, percent double")
    got = evidence.interval_rows(rates, "session", "thread_name", "snapshot", "percent", 2).collect()
    assert {(r.thread_name, r.highest, r["rank"]) for r in got} == {("late", 90.0, 1), ("early", 50.0, 2)}
    assert sorted(r.snapshot for r in got if r.thread_name == "early") == list(range(2, 31))
    assert [r.snapshot for r in got if r.thread_name == "early" and r.percent is not None] == [3]


def test_ranges_anywhere_with_the_hash_of_the_text(spark):
    logs = spark.createDataFrame([("a", "\n".join(f"l{i}" for i in range(1, 101))), ("b", "x")], "capture_id string, text string")
    hashed = logs.select("capture_id", F.sha2("text", 256).alias("sha256"))
    asked = spark.createDataFrame([("a", 98, 100), ("a", 99, 10**9), ("b", 1, 1), ("b", 2, 3)], "capture_id string, first_line int, last_line int").join(hashed, "capture_id")
    got = sorted((r.capture_id, r.first_line, r.line_no, r.text) for r in captures.checked_ranges(logs, asked).collect())
    assert got == [("a", 98, 98, "l98"), ("a", 98, 99, "l99"), ("a", 98, 100, "l100"), ("a", 99, 99, "l99"), ("a", 99, 100, "l100"), ("b", 1, 1, "x")]
    for changed in (logs.withColumn("text", F.concat("text", F.lit("!"))), logs.where("capture_id = 'b'")):
        with pytest.raises(Exception, match="capture changed: a"):
            captures.checked_ranges(changed, asked.where("capture_id = 'a'")).collect()
