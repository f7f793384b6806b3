"""Full-text ranking and the fusion of ranked lists."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shared_folder


def bm25(docs: DataFrame, key: str, column: str, terms: tuple[str, ...], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the texts that hold a term; texts without a word do not count.

    Texts are read once: their lengths and numbers of terms are kept as a table in the shared folder, which all else is made of.
    """
    spark, w = docs.sparkSession, F.col("w")
    # only the first and the last part of a text can be empty
    empty = (F.get(w, 0) == "").cast("int") + ((F.size(w) > 1) & (F.get(w, F.size(w) - 1) == "")).cast("int")
    named = [f"__{i}" for i in range(len(terms))]
    numbers = [(F.size(w) - F.size(F.array_remove(w, t)) if t else F.lit(0)).alias(n) for n, t in zip(named, terms, strict=True)]
    cut = docs.where(F.col(column).isNotNull()).select(key, F.split(F.lower(column), r"[^\p{L}\p{N}_]+").alias("w")).select(key, (F.size(w) - empty).alias("len"), *numbers)
    place = f"{shared_folder(spark)}/bm25-{uuid.uuid4().hex}"
    summed = cut.where("len > 0").groupBy(key).agg(*[F.sum(c).cast("double").alias(c) for c in ("len", *named)])
    summed.write.parquet(place)
    counted = spark.read.schema(summed.schema).parquet(place)
    total = counted.agg(F.avg("len").alias("mean"), F.count("*").alias("n"), *[F.count_if(F.col(n) > 0).alias(f"df{n}") for n in named])
    scored = counted.where(reduce(lambda x, y: x | y, [F.col(n) > 0 for n in named])).crossJoin(F.broadcast(total))

    def weight(n: str) -> Column:
        df, tf = F.col(f"df{n}"), F.col(n)
        idf = F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))).otherwise(0.0)

    return scored.select(key, reduce(lambda x, y: x + y, map(weight, named)).alias("score"))


def fused(rows: DataFrame, key: str, orders: list[list[Column | str]], most: int = 20, damping: float = 60.0) -> DataFrame:
    """(key, fused): the sum of 1 / (damping + rank) over the lists that hold a row among their first so many."""
    lists = []
    for i, order in enumerate(orders):
        first = rows.orderBy(*order).limit(most)
        lists.append(first.select(key, F.row_number().over(Window.orderBy(*order)).alias(f"__{i}")))
    met = reduce(lambda x, y: x.join(y, key, "full_outer"), lists)
    share = [F.coalesce(1 / (damping + F.col(f"__{i}")), F.lit(0.0)) for i in range(len(orders))]
    return met.select(key, reduce(lambda x, y: x + y, share).alias("fused"))
