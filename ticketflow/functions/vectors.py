"""Vector expressions in double precision."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; NULL if one of them is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


@F.arrow_udf(StringType())
def _literal(vectors: pa.Array) -> pa.Array:
    shown = []
    for v in vectors.to_pylist():
        known = None if v is None else [f"{x:.6f}" for x in v if x is not None]
        shown.append(None if known is None or v and not known else f"[{','.join(known)}]")
    return pa.array(shown, pa.string())


def literal(v: Column) -> Column:
    """[a,b,...] with six decimals, of the exact binary value and halves to even, as C and SQL write them; Java's format rounds halves up.

    NULL components are left out; NULL where there is nothing else.
    """
    return _literal(v.cast("array<double>"))


def softmax(logits: Column) -> Column:
    raised = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda s, y: s + y))


def best_label(values: Column, labels: tuple[str, ...]) -> Column:
    """The label at the first largest value."""
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(values, F.array_max(values)).cast("int"))


def hashed_embeddings(rows: DataFrame, key: str, tokens: Column, length: int = 64) -> DataFrame:
    """(key, vector): unit vectors that count hashed tokens, a stand-in where no model is installed."""
    slots = rows.select(key, F.explode(tokens).alias("t")).select(key, F.pmod(F.xxhash64("t"), F.lit(length)).cast("int").alias("slot"))
    counts = slots.groupBy(key, "slot").agg(F.count("*").cast("double").alias("n"))
    found = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    value = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).cast("float"))
    return found.select(key, value.alias("vector"))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """The mean of those of an array of vectors whose mask is 1; zeros if there is none."""
    zeros = F.transform(F.get(vectors, 0), lambda x: F.lit(0.0))
    kept = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    total = F.aggregate(kept, zeros, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    n = F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m)
    return F.transform(total, lambda x: x / F.greatest(n, F.lit(1e-9)))
