"""Where findings go: JSON rows in a stated order with an escaped report line each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_line(*columns: str):
    """`a | b | c` with the characters that a Markdown table reads escaped; nulls are a dash."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), r"([\\|`*_<>\[\]])", r"\\$1"), r"\s+", " ")
    return F.concat_ws(" | ", *[cell(c) for c in columns])


def write_findings(found: DataFrame, path: str, columns: list[str]) -> None:
    """Findings as JSON files under path, ordered by the columns inside each file range, with `report`."""
    found.withColumn("report", report_line(*columns)).repartitionByRange(*columns).sortWithinPartitions(*columns).write.json(path)
