"""Mixing of sources to target weights by Poisson replication, with DataFrame functions alone.

A document's number of copies is the inverse of a Poisson distribution, whose mean is its source's target share over
its actual share of bytes, at a number hashed from the seed and the document. So a lost task makes the same copies
again, and documents need not meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh, sized, stage

#: A mean over it is drawn as a sum of so many more draws, each of an equal part of it.
PART = 256.0
#: The target weights of the query's sources; others weigh 1.
WEIGHTS = {f"src{k}": 0.5 + k % 4 for k in range(20)}


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) hashed from the parts: 52 bits of their md5."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(2.0**52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, other: float = 1.0, epochs: float = 1.0, column: str = "text", by: str = "source") -> DataFrame:
    """source, bytes, rate: the mean number of copies of a source's documents.

    Weights are shares of the bytes to come, epochs times those there are; sources that aren't named weigh `other`.
    """
    size = F.octet_length(F.coalesce(F.col(column).cast("string"), F.lit(""))).cast("bigint")
    sums = docs.groupBy(F.col(by).alias("source")).agg(F.sum(size).alias("bytes"))
    named = F.create_map(*[F.lit(x) for k, w in (weights or {}).items() for x in (k, float(w))]) if weights else None
    weight = F.coalesce(named[F.col("source")], F.lit(float(other))) if weights else F.lit(float(other))
    sums = sums.withColumn("weight", F.when(F.col("bytes") > 0, weight).otherwise(0.0))
    sums = stage(sums, "bytes")  # a row for each source
    whole = sums.agg(F.sum("bytes").alias("bytes"), F.sum("weight").alias("weight")).first()
    rate = F.try_divide(F.col("weight") * F.lit(float(epochs)) * F.lit(whole.bytes or 0), F.lit(float(whole.weight or 0.0)) * F.col("bytes"))
    return sums.select("source", "bytes", F.coalesce(F.when(F.col("bytes") > 0, rate), F.lit(0.0)).alias("rate"))


def steps(rate: Column) -> Column:
    """The Poisson distribution's probabilities of k or fewer, for k from 0 to where they round to 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    logs = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.lit(0.0).alias("log"), F.array(F.lit(0.0)).alias("all")),
        lambda a, k: F.struct((a["log"] + F.ln(k.cast("double"))).alias("log"), F.array_append(a["all"], a["log"] + F.ln(k.cast("double"))).alias("all")),
        lambda a: a["all"],
    )
    chance = F.transform(logs, lambda x, k: F.exp(k * F.ln(rate) - rate - x))
    return F.aggregate(
        chance,
        F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all")),
        lambda a, p: F.struct((a["sum"] + p).alias("sum"), F.array_append(a["all"], a["sum"] + p).alias("all")),
        lambda a: a["all"],
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, other: float = 1.0, epochs: float = 1.0, seed: int = 0, column: str = "text", by: str = "source", key: str = "doc_id") -> DataFrame:
    """Each document of docs as often as drawn, shuffled, with `copy` (int, from 0) and `order_key` (its place's hash).

    Rows go to partitions by order_key and are sorted by it there. A null source is a source of its own. A source of
    empty texts alone has no bytes to weigh, so none of it comes. Rows with the same doc_id are drawn alike; with a
    null one, those of the same text. An empty table gives an empty table. Columns of docs named copy or order_key are
    replaced.
    """
    own = [c for c in docs.columns if c.lower() not in ("copy", "order_key")]
    rate, id_, n, told = (fresh(docs, x) for x in ("_rate", "_key", "_n", "_source"))
    table = rates(docs, weights, other, epochs, column, by)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    table = table.select(F.col("source").alias(told), F.struct(parts.alias("parts"), F.when(F.col("rate") > 0, steps(F.col("rate") / parts)).alias("steps")).alias(rate))
    table = stage(table, "rates")
    row = docs.select(*[F.col(f"`{c}`") for c in own])
    row = row.join(sized(table, f"{rate}.steps", 8, 96), row[by].eqNullSafe(table[told])).drop(told)
    row = row.withColumn(id_, F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))))))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col(rate)["parts"]),
        F.lit(0),
        lambda a, j: a + F.coalesce(F.size(F.filter(F.col(rate)["steps"], lambda c: c <= uniform(F.lit(seed), F.col(id_), j))), F.lit(0)),
    )
    drawn = F.when(F.col(rate)["steps"].isNotNull(), drawn).otherwise(0)
    row = row.withColumn(n, drawn).drop(rate).filter(F.col(n) > 0)
    row = row.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop(n)
    row = row.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), id_, "copy"))).drop(id_)
    return row.repartition("order_key").sortWithinPartitions("order_key")


#: Of the query, for DuckDB.
ORACLE_SQL = f"""
WITH w(source, weight) AS (VALUES {", ".join(f"('{k}', {v}e0)" for k, v in WEIGHTS.items())}),
s AS (SELECT source, sum(strlen(coalesce(text, '')))::DOUBLE AS bytes FROM documents GROUP BY source),
b AS (SELECT s.source, bytes, coalesce(weight, 1e0) AS weight FROM s LEFT JOIN w ON s.source = w.source WHERE bytes > 0),
r AS (SELECT source, (weight * (SELECT sum(bytes) FROM s)) / ((SELECT sum(weight) FROM b) * bytes) AS rate FROM b),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k FROM r),
p AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM k),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
u AS (SELECT doc_id, source, text, ('0x' || substr(md5('0:' || doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496e0 AS u FROM documents),
n AS (SELECT u.doc_id, u.source, u.text, count(*) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.c <= u.u GROUP BY u.doc_id, u.source, u.text),
x AS (SELECT doc_id, source, text, unnest(range(0, n))::INT AS copy FROM n)
SELECT doc_id, source, copy, md5('order0:' || doc_id || ':' || copy) AS order_key, text FROM x
"""
