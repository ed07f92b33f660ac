"""Running sums, maxima and last values, places and neighbours in sequences of any length.

A sequence (the lines of a capture) is cut into buckets that follow its order. Inside a bucket a window does the work; what
a bucket passes on is one row. A window over the rows of a thousand buckets, a shelf, carries them on; what all shelves
before one pass on is put together from blocks of 1, 2, 4, ... shelves, as the ones of the shelf's number written in binary
ask for. So no task holds a sequence, nor the totals of all its buckets; the steps beyond a bucket are short tables.
A caller may ask that sequences of at most so many rows, WHOLE by custom, are one bucket without steps beyond it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturelake.operators import generic

#: Rows of a bucket where the caller names no other width; results don't depend on it.
WIDTH = 100_000
#: Rows of a sequence that is one bucket where a caller asks for it; results don't depend on it.
WHOLE = 100_000
#: Buckets of a shelf as a power of two, and doublings of the blocks: bucket numbers are below 2 ** (SHELF + LEVELS).
SHELF, LEVELS = 10, 30


class Carried(NamedTuple):
    how: str
    value: Column
    own: bool = True


def total(value: Column, own: bool = True) -> Carried:
    """The sum over the rows up to this one (`own`: with it); 0 where there is none."""
    return Carried("sum", value, own)


def largest(value: Column, own: bool = True) -> Carried:
    return Carried("max", value, own)


def latest(value: Column, own: bool = True) -> Carried:
    """The value of the nearest row before (`own`: or this one) that is not null."""
    return Carried("last", value, own)


def stretch(column: str, width: int | None = None) -> Column:
    """The bucket of a whole number that grows with the order."""
    return F.floor(F.col(column) / (width or WIDTH)).cast("long")


def _merged(how: str, value: str, at: str) -> Column:
    return {"sum": F.sum(value), "max": F.max(value), "last": F.max_by(value, F.when(F.col(value).isNotNull(), F.col(at)))}[how]


def before_buckets(totals: DataFrame, key: list[str], bucket: str, hows: dict[str, str]) -> DataFrame:
    """totals (key, bucket, one column for each of `hows`: sum, max or last): per row the columns over the buckets before.

    Buckets are whole numbers from 0; those without a row pass nothing on.
    """
    fits = F.when((F.col(bucket) >= 0) & (F.col(bucket) < 2 ** (SHELF + LEVELS)), F.expr(f"shiftright({bucket}, {SHELF})"))
    rows = totals.withColumn("_shelf", F.coalesce(fits, F.raise_error(F.lit("a bucket number is out of range")).cast("long")))
    past = Window.partitionBy(*key, "_shelf").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    inner = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    inside = rows.select(*key, bucket, "_shelf", *[inner[how](c).over(past).alias(c) for c, how in hows.items()])
    shelves = rows.groupBy(*key, "_shelf").agg(*[_merged(how, c, bucket).alias(c) for c, how in hows.items()])
    odd = lambda n: F.expr(f"shiftright(_shelf, {n})").bitwiseAND(F.lit(1)) == 1
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("_level")
    # a block with an even number is the left half of the next larger one: only those are ever asked for
    halves = shelves.select("*", level).where(~odd("_level"))
    blocks = halves.groupBy(*key, "_level", F.expr("shiftright(_shelf, _level)").alias("_block")).agg(*[_merged(how, c, "_shelf").alias(c) for c, how in hows.items()], F.max("_shelf").alias("_at"))
    asked = shelves.where("_shelf > 0").select(*key, "_shelf", level).where(odd("_level")).withColumn("_block", F.expr("shiftright(_shelf, _level)") - 1)
    below = asked.join(blocks, [*key, "_level", "_block"]).groupBy(*key, "_shelf").agg(*[_merged(how, c, "_at").alias(f"_b{c}") for c, how in hows.items()])
    met = inside.join(below, [*key, "_shelf"], "left")
    return met.select(*key, bucket, *[_added(how, F.col(c), F.col(f"_b{c}")).alias(c) for c, how in hows.items()])


def _added(how: str, near: Column, far: Column) -> Column:
    """What rows nearby and rows further back say together."""
    if how == "sum":
        return F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0))
    return F.greatest(near, far) if how == "max" else F.coalesce(near, far)


def carried(rows: DataFrame, key: list[str], bucket: Column, order: list[str], most: int = 0, short: bool = False, **wanted: Carried) -> DataFrame:
    """rows with a column for each of `wanted`, over the rows of the key in order; the bucket must follow the order.

    Keys and order columns are not null. Rows that tie in the order take any of the tied orders. With `most`,
    keys of more rows are counted first, and only those are cut into buckets. A caller that has counted and found no such
    key says so (`short`).
    """
    long = rows.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*key, F.lit(True).alias("_long"))
    if most and not short:
        long = generic.cut(long)
    cut_up = not short and (not most or not long.isEmpty())
    here = Window.partitionBy(*key, "_bucket").orderBy(*order) if cut_up else Window.partitionBy(*key).orderBy(*order)
    upto = {True: here.rowsBetween(Window.unboundedPreceding, 0), False: here.rowsBetween(Window.unboundedPreceding, -1)}
    inner = {"sum": lambda v: F.sum(v), "max": lambda v: F.max(v), "last": lambda v: F.last(v, ignorenulls=True)}
    if not cut_up:
        placed = rows.select("*", *[inner[w.how](w.value).over(upto[w.own]).alias(f"_c_{name}") for name, w in wanted.items()])
        zero = lambda w, c: F.coalesce(c, F.lit(0)) if w.how == "sum" else c
        return placed.select(*[c for c in rows.columns if c not in wanted], *[zero(w, F.col(f"_c_{name}")).alias(name) for name, w in wanted.items()])
    own = rows.withColumn("_bucket", F.greatest(F.lit(0).cast("long"), bucket))  # what lies before 0 shares its bucket
    if most:
        rows = own.join(F.broadcast(long), key, "left").withColumn("_bucket", F.when(F.col("_long"), F.col("_bucket")).otherwise(F.lit(0).cast("long")))
    else:
        rows = own.withColumn("_long", F.lit(True))
    at = F.struct(*order)
    whole = {"sum": lambda v: F.sum(v), "max": lambda v: F.max(v), "last": lambda v: F.max_by(v, F.when(v.isNotNull(), at))}
    totals = rows.where("_long").groupBy(*key, "_bucket").agg(*[whole[w.how](w.value).alias(f"_c_{name}") for name, w in wanted.items()])
    earlier = before_buckets(totals, key, "_bucket", {f"_c_{name}": w.how for name, w in wanted.items()})
    placed = rows.select("*", *[inner[w.how](w.value).over(upto[w.own]).alias(name) for name, w in wanted.items()])
    both = placed.join(earlier, [*key, "_bucket"], "left")

    kept = [c for c in rows.columns if c not in ("_bucket", "_long") and c not in wanted]
    return both.select(*kept, *[_added(w.how, F.col(name), F.col(f"_c_{name}")).alias(name) for name, w in wanted.items()])


def numbered(rows: DataFrame, key: list[str], bucket: Column, order: list[str], name: str = "place", most: int = 0) -> DataFrame:
    """rows with their place (from 1) in the order of the key."""
    return carried(rows, key, bucket, order, most, **{name: total(F.lit(1).cast("long"))})


def beside(rows: DataFrame, key: list[str], number: str, reach: int, width: int | None = None, **wanted: tuple[int, Column]) -> DataFrame:
    """rows with values of rows nearby: name = (offset, value), offsets from -reach to reach, numbers of a key without gaps.

    A row close to the edge of its bucket is lent to the next bucket, so a window inside buckets sees every neighbour.
    """
    width = max(width or WIDTH, reach + 1)
    own, inside = stretch(number, width), F.pmod(F.col(number), F.lit(width))
    lent = F.explode(F.array_compact(F.array(own, F.when(inside < reach, own - 1), F.when(inside >= width - reach, own + 1))))
    order = Window.partitionBy(*key, "_bucket").orderBy(number)
    near = lambda offset, value: F.lead(value, offset).over(order) if offset > 0 else F.lag(value, -offset).over(order)
    seen = rows.withColumn("_bucket", lent).select("*", *[near(*w).alias(name) for name, w in wanted.items()])
    return seen.where(F.col("_bucket") == own).drop("_bucket")
