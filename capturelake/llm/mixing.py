"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Every source gets a mean repetition rate, target documents over documents at hand. A document's count is the inverse of
the Poisson distribution with that mean at a uniform number hashed from the seed and its doc_id; it is exploded by its
count and all copies are dealt and ordered by a hash. The result depends on the rows and the seed alone.

Targets: weights by source, or each source's document count to the power `alpha` where none are given. Null source is a
source of its own; sources without a weight, or with one of zero, go. Rows with a null doc_id share one hash per text.
Repeated rows are drawn alike. An empty table stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import cut_lineage, shuffle_width

ALPHA = 0.5
#: Rate tables of up to so many bytes are broadcast; larger ones are joined with salted keys.
BROADCAST_BYTES = 64 << 20
BLOCK = 128
SALTS = 32
_UNIT = float(16**13)


def _hash(seed: int, *parts) -> F.Column:
    """13 hexadecimal digits of an MD5 as a long."""
    text = F.concat_ws(":", F.lit(str(seed)), *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def poisson_table(rate) -> F.Column:
    """struct(base, cdf): cumulative probabilities of base, base + 1, ... up to where a double cannot tell them from 1.

    `base` is the first count whose cumulative probability a double can tell from 0; each is the chance to stay at or below it.
    """
    spread = 12 * F.sqrt(rate) + 20
    base = F.greatest(F.lit(0), F.floor(rate - spread)).cast("int")
    steps = F.sequence(base, F.ceil(rate + spread).cast("int"))
    table = F.transform(steps, lambda k: F.exp(k * F.log(rate) - rate - _log_factorial(k)))
    block = F.transform(F.sequence(F.lit(0), F.floor((F.size(table) - 1) / BLOCK).cast("int")), lambda i: F.slice(table, i * BLOCK + 1, F.lit(BLOCK)))
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    summed = F.aggregate(
        block,
        F.struct(F.lit(0.0).alias("at"), F.array().cast("array<array<double>>").alias("out")),
        lambda acc, xs: F.struct(
            F.aggregate(xs, acc["at"], lambda a, x: a + x).alias("at"),
            F.concat(acc["out"], F.array(F.slice(F.aggregate(xs, F.array(acc["at"]), grow), F.lit(2), F.size(xs)))).alias("out"),
        ),
    )
    return F.struct(base.alias("base"), F.flatten(summed["out"]).alias("cdf"))


def _log_factorial(k) -> F.Column:
    """ln k!: exact sums below 10, Stirling's series (error below 1e-12) from there on."""
    x = F.greatest(k, F.lit(10)).cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    return F.when(k < 10, F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(10)]), F.least(k, F.lit(9)) + 1)).otherwise(series)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, alpha: float = ALPHA) -> DataFrame:
    """source, rate, base, cdf. `total`: expected number of documents out; as many as come in by default."""
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.lit(None).cast("map<string,double>")
        weighted = sizes.withColumn("weight", F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0)))
    sums = weighted.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    want = float(total if total is not None else sums.n or 0)
    rated = weighted.where("weight > 0").select("source", (F.col("weight") / F.lit(sums.weight or 1.0) * F.lit(want) / F.col("n")).alias("rate"))
    return rated.withColumn("table", poisson_table(F.col("rate"))).select("source", "rate", "table.base", "table.cdf")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, alpha: float = ALPHA, seed: int = 11) -> DataFrame:
    """The documents' columns, repeated to the target weights and shuffled, with replica (from 1) and mix_key.

    Columns of docs named replica or mix_key are replaced; other names, whatever they are, stay.
    """
    columns = [c for c in docs.columns if c not in ("replica", "mix_key")]
    table = cut_lineage(rates(docs.select("source"), weights, total, alpha))  # a row for each source
    size = table.agg(F.coalesce(F.sum(F.size("cdf") * 8 + F.coalesce(F.length("source"), F.lit(0)) + 64), F.lit(0)).alias("bytes")).first().bytes
    identity = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("source"), F.col("doc_id"), identity.alias("identity"))
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(table), rows["source"].eqNullSafe(table["source"]))
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(salted, rows["source"].eqNullSafe(salted["source"]) & (F.pmod(F.xxhash64("identity"), F.lit(SALTS)).cast("int") == salted["salt"]))
    u = _hash(seed, F.col("identity")) / F.lit(_UNIT)
    times = F.col("base") + F.size(F.filter("cdf", lambda c: c <= u))
    counted = joined.select("row", rows["doc_id"], "identity", times.alias("times")).where("times > 0")
    copies = counted.select("row", "doc_id", "identity", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("replica"))
    keyed = copies.withColumn("mix_key", _hash(seed + 1, F.col("identity"), F.col("replica").cast("string")))
    dealt = keyed.repartition(shuffle_width(docs.sparkSession), "mix_key").sortWithinPartitions("mix_key", "doc_id", "replica")
    return dealt.select(*[F.col("row").getField(c).alias(c) for c in columns], "replica", "mix_key")


def oracle(alpha: float = ALPHA, seed: int = 11) -> str:
    """The same rows in SQL, for the default weights."""
    unit = lambda s: f"('0x' || substr(md5({s}), 1, 13))::BIGINT"
    return f"""
WITH sizes AS (SELECT source, count(*) AS n, pow(count(*), {alpha}) AS weight FROM documents GROUP BY source),
rated AS (SELECT source, weight / (SELECT sum(weight) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes),
steps AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1.0)) AS p FROM rated, LATERAL (SELECT unnest(range(0, cast(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM steps),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) AS m
  FROM documents d JOIN cdf ON cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= {unit(f"concat_ws(':', '{seed}', cast(d.doc_id AS VARCHAR))")} / {_UNIT}
  GROUP BY ALL),
copies AS (SELECT doc_id, text, lang, source, n_chars, cast(unnest(range(1, m + 1)) AS INTEGER) AS replica FROM counted)
SELECT *, {unit(f"concat_ws(':', '{seed + 1}', cast(doc_id AS VARCHAR), cast(replica AS VARCHAR))")} AS mix_key FROM copies
"""
