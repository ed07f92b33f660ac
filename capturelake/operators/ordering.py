"""Orders with a null rule and stable ties, as columns, so that a place survives later shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Severities and confidences, highest first.
SEVERITIES = ("critical", "high", "medium", "low", "info")
CONFIDENCES = ("high", "medium", "low")


def placed_by(rows: DataFrame, group: str | None, by: list[tuple[str, bool]], ties: list[str], nulls_lowest: bool = False) -> DataFrame:
    """rows with `place` (from 1) by (column, descending) pairs; ties by `ties`, ascending in both directions.

    Nulls come last, or count as the lowest value. Without a group the whole table is ordered in one window: give one.
    """
    def one(name, down):
        c = F.col(name)
        if nulls_lowest:
            return c.desc_nulls_last() if down else c.asc_nulls_first()
        return c.desc_nulls_last() if down else c.asc_nulls_last()

    window = Window.partitionBy(*([group] if group else [])).orderBy(*[one(*b) for b in by], *ties)
    return rows.withColumn("place", F.row_number().over(window))


def rank_of(value, ranked: tuple[str, ...]):
    """Place of a word in a fixed list, from 0; others after all."""
    at = F.array_position(F.lit(list(ranked)), value)
    return F.when(at > 0, at - 1).otherwise(len(ranked)).cast("int")


def finding_order(rows: DataFrame, group: str) -> DataFrame:
    """Findings with `place`: severity, then confidence, then title."""
    ranked = rows.withColumn("_s", rank_of(F.col("severity"), SEVERITIES)).withColumn("_c", rank_of(F.col("confidence"), CONFIDENCES))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_s", "_c", "title"))).drop("_s", "_c")
