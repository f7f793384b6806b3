"""Labelled samples of bounded size for the operators that learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y) of at most so many labelled training rows, chosen by a hash of doc_id.

    Contradictory labels of one doc_id are dropped. The chosen ids are bounded by most, so
    they are broadcast and the texts are not shuffled.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out())
    y = y.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("hi")).where("y = hi").select("doc_id", "y")
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return base.join(F.broadcast(chosen), "doc_id")
