"""Mixing of sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Sources up to which the table of rates is broadcast; beyond it the join is shuffled.
BROADCAST_SOURCES = 2_000


def rates(docs: DataFrame, weights: DataFrame | None = None, flatten: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, rate, cdf): the mean number of copies of a document of each source.

    weights (source, weight) are the targets, by default each source's size to the power
    flatten; they are scaled to sum to 1 over the sources present, and a source without a
    positive weight gets rate 0. cdf lists the Poisson distribution function from 0 up,
    as far as it differs from 1.
    """
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        w = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(flatten)))
    else:
        given = weights.groupBy("source").agg(F.sum("weight").alias("w"))
        w = n.join(given.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)).alias("w"))
    total = w.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    r = w.crossJoin(F.broadcast(total)).select("source", F.coalesce(F.try_divide(F.lit(epochs) * F.col("all_n") * F.col("w"), F.col("all_w") * F.col("n")), F.lit(0.0)).alias("rate"))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    logs = F.transform(F.sequence(F.lit(1), last), lambda k: F.ln("rate") - F.ln(k.cast("double")))
    steps = F.aggregate(logs, F.array(-F.col("rate")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    sums = F.aggregate(steps, F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1), F.lit(0.0)) + F.exp(x))))
    return r.withColumn("cdf", F.when(F.col("rate") > 0, sums).otherwise(F.array(F.lit(1.0))))


def unit_hash(*parts) -> F.Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts."""
    digest = F.md5(F.concat_ws("/", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def poisson_mix(docs: DataFrame, weights: DataFrame | None = None, flatten: float = 0.5, epochs: float = 1.0, seed: int = 7) -> DataFrame:
    """docs replicated to the target weights and shuffled, with copy (from 1) and shuffle_key.

    The number of copies of a document is the Poisson quantile, at its source's rate, of a
    hash of seed and doc_id, so a rerun or a lost executor gives the same copies. Rows are
    dealt to partitions by a hash of shuffle_key and sorted by it within them; sorting by
    (shuffle_key, doc_id, copy) gives a reproducible global order. A null source is a source
    of its own; a null doc_id hashes as an empty one; rows that repeat a doc_id get the same
    number of copies. Texts are not looked at. Columns copy and shuffle_key are replaced.
    """
    names = [f"`{c}`" for c in docs.columns if c not in ("copy", "shuffle_key")]
    docs = docs.select(names)
    r = cut(rates(docs, weights, flatten, epochs)).select(F.col("source").alias("__source"), F.col("cdf").alias("__cdf"))
    if r.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        r = F.broadcast(r)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = docs.select("*", unit_hash(F.lit(str(seed)), key).alias("__u"))
    counted = drawn.join(r, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__n", F.expr("size(filter(__cdf, c -> c <= __u))"))
    copies = counted.where("__n > 0").select(*names, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy"))
    keyed = copies.withColumn("shuffle_key", F.substring(F.md5(F.concat_ws("/", F.lit(f"{seed}s"), key, F.col("copy").cast("string")).cast("binary")), 1, 16))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


ORACLE = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, sqrt(n::DOUBLE) AS w FROM n),
r AS (SELECT source, (SELECT sum(n) FROM w) * w / ((SELECT sum(w) FROM w) * n) AS rate FROM w),
p AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM r, generate_series(0, 400) AS g(k)),
d AS (SELECT *, ('0x' || substr(md5('7/' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
c AS (SELECT d.doc_id, count(*) AS n FROM d JOIN p ON d.source = p.source AND p.cdf <= d.u GROUP BY d.doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, g.copy::INTEGER AS copy,
       substr(md5('7s/' || d.doc_id || '/' || g.copy), 1, 16) AS shuffle_key
FROM documents d JOIN c USING (doc_id), generate_series(1, c.n) AS g(copy)
"""
