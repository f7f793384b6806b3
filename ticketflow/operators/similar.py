"""Similar tickets and duplicates by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine

DUPLICATE, NEAREST, MOST_NEAREST = 0.92, 5, 50
#: Vectors multiplied at once with a batch or block.
TILE = 256


def _checked(k: int) -> int:
    if not 1 <= k <= MOST_NEAREST:
        raise ValueError(f"k must be in 1..{MOST_NEAREST}")
    return k


def by_vector(vectors: DataFrame, tickets: DataFrame, vector: list[float], k: int = NEAREST) -> DataFrame:
    """(ticket_id, subject, category, similarity, duplicate) of the k nearest; never a duplicate, as a text has no category.

    vectors (ticket_id, vector, category) may lack a category. The nearest are cut to k before
    the join, so tickets are looked up and not shuffled with all vectors.
    """
    query = F.array(*[F.lit(float(x)) for x in vector])
    near = vectors.select("ticket_id", "category", cosine(F.col("vector"), query).alias("cos")).orderBy(F.desc_nulls_last("cos"), "ticket_id").limit(_checked(k))
    joined = near.join(tickets.select(F.col("id").alias("ticket_id"), "subject"), "ticket_id")
    return joined.select("ticket_id", "subject", "category", F.round("cos", 4).alias("similarity"), F.lit(False).alias("duplicate"))


def by_ticket(vectors: DataFrame, tickets: DataFrame, ticket_id: int, k: int = NEAREST, threshold: float = DUPLICATE) -> DataFrame:
    """The k nearest other tickets; a duplicate has the same category and at least the threshold, before rounding."""
    query = vectors.where(F.col("ticket_id") == ticket_id).select(F.col("vector").alias("q"), F.col("category").alias("qc")).limit(1)
    others = vectors.where(F.col("ticket_id") != ticket_id).crossJoin(F.broadcast(query))
    near = others.select("ticket_id", "category", "qc", cosine(F.col("vector"), F.col("q")).alias("cos")).orderBy(F.desc_nulls_last("cos"), "ticket_id").limit(_checked(k))
    joined = near.join(tickets.select(F.col("id").alias("ticket_id"), "subject"), "ticket_id")
    same = F.coalesce(F.col("category") == F.col("qc"), F.lit(False))
    return joined.select("ticket_id", "subject", "category", F.round("cos", 4).alias("similarity"), (same & (F.col("cos") >= threshold)).alias("duplicate"))


def find(spark: SparkSession, vectors: DataFrame, tickets: DataFrame, ticket_id: int | None = None, vector: list[float] | None = None, k: int = NEAREST) -> DataFrame:
    """By ticket if its id is given, else by vector; nothing asked gives no rows."""
    if ticket_id is not None:
        return by_ticket(vectors, tickets, ticket_id, k)
    return by_vector(vectors, tickets, vector or [0.0], k).where(F.lit(vector is not None))


def _sound(t: pa.Table | pa.RecordBatch, key: str, vector: str, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and unit vectors of the rows that have a direction of this length, and the keys of the others."""
    ids, v = t.column(key), t.column(vector)
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    fits = pc.fill_null(pc.equal(pc.list_value_length(v), length), False)
    x = v.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    ok = np.isfinite(norm) & (norm > 0)
    whole = np.flatnonzero(fits.to_numpy(zero_copy_only=False))[ok]
    ids = np.asarray(ids.to_numpy()) if isinstance(ids, pa.ChunkedArray) else ids.to_numpy(zero_copy_only=False)
    return ids[whole], x[ok] / norm[ok, None], np.delete(ids, whole)


def _first_of_each(q: np.ndarray, ids: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: by cosine, those without one last, then by id."""
    order = np.lexsort((ids, -np.nan_to_num(cos, nan=-2.0), q))
    starts = np.flatnonzero(np.append(True, q[order][1:] != q[order][:-1])) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def _best(asked: pa.Table, k: int):
    """(query_id, ticket_id, cos) of the k best rows of a task for each query."""
    lengths = [n for n in pc.unique(pc.list_value_length(asked.column("q"))).to_pylist() if n]
    blocks = [_sound(asked, "query_id", "q", n)[:2] for n in lengths]
    known = np.concatenate([ids for ids, _ in blocks]) if blocks else np.zeros(0, np.int64)
    dull = np.setdiff1d(asked.column("query_id").to_numpy(), known)

    def near(batch, ids, unit):
        """Candidates of a batch for queries of one length; k + 1 values, as one may be the query itself."""
        rows, x, other = _sound(batch, "ticket_id", "vector", unit.shape[1])
        rows, x = rows[order := np.argsort(rows, kind="stable")], x[order]
        for s in range(0, len(ids), TILE):
            # equal vectors must tie, whatever the order of a sum
            cos = np.round(unit[s : s + TILE] @ x.T, 12)
            if len(rows) > k + 1:
                least = np.partition(cos, len(rows) - k - 1, axis=1)[:, len(rows) - k - 1]
                i, j = np.nonzero(cos >= least[:, None])
            else:
                i, j = np.indices(cos.shape).reshape(2, -1)
            yield ids[s + i], rows[j], cos[i, j]
        few = np.sort(other)[: k + 1]
        yield np.repeat(ids, len(few)), np.tile(few, len(ids)), np.full(len(ids) * len(few), np.nan)

    def run(batches: Iterator[pa.RecordBatch]):
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            few = np.sort(batch.column("ticket_id").to_numpy())[: k + 1]
            parts = [held, (np.repeat(dull, len(few)), np.tile(few, len(dull)), np.full(len(dull) * len(few), np.nan))]
            parts += [c for ids, unit in blocks for c in near(batch, ids, unit)]
            q, ids, cos = (np.concatenate([p[n] for p in parts]) for n in range(3))
            q, ids, cos = (v[q != ids] for v in (q, ids, cos))
            held = tuple(v[_first_of_each(q, ids, cos, k)] for v in (q, ids, cos))
        yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2], mask=np.isnan(held[2]))], ["query_id", "ticket_id", "cos"])

    return run


def nearest_of_queries(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, most_queries: int = 10_000) -> DataFrame:
    """(query_id, ticket_id, similarity, rank) of the k nearest of each query (query_id, q).

    The queries (query_id is distinct) are asked in blocks by a hash, of about half of most_queries each if
    they are more. A block goes to every task, which multiplies it with its batches of vectors and keeps
    its best k of each query before they meet. What has no direction (null, zero, another length, a
    component that is no number) has a null similarity and comes last.
    """
    queries = queries.select(F.col("query_id").cast("long"), "q")
    n = queries.count()
    blocks = 1 if n <= most_queries else -(-2 * n // most_queries)
    near = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("cos"), "ticket_id")
    found = None
    for i in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries
        scored = vectors.select(F.col("ticket_id").cast("long"), "vector").mapInArrow(_best(asked.toArrow(), k), "query_id long, ticket_id long, cos double")
        best = scored.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("query_id", "ticket_id", F.round("cos", 4).alias("similarity"), "rank")
        found = best if found is None else found.union(best)
    return found


def _close(threshold: float):
    """The pairs at the threshold of a group: within it, or between its two sides."""

    def run(keys: tuple, t: pa.Table) -> pa.Table:
        length, i, j = (keys[n].as_py() for n in (1, 2, 3))
        sides = [t] if i == j else [t.filter(pc.equal(t.column("mine"), side)) for side in (i, j)]
        (a, x, _), (b, y, _) = (_sound(side, "ticket_id", "vector", length) for side in (sides[0], sides[-1]))
        out = []
        for s in range(0, len(a), TILE):
            cos = np.round(x[s : s + TILE] @ y.T, 12)
            u, v = np.nonzero(cos >= threshold)
            first, second = a[s + u], b[v]
            keep = first < second if i == j else first != second
            out.append((np.minimum(first, second)[keep], np.maximum(first, second)[keep], cos[u, v][keep]))
        cols = [np.concatenate([o[n] for o in out]) if out else np.zeros(0, kind) for n, kind in enumerate((np.int64, np.int64, np.float64))]
        return pa.table([pa.array(c) for c in cols], names=["a", "b", "cos"])

    return run


def duplicates(vectors: DataFrame, threshold: float = DUPLICATE, block: int = 2048, asked: str | None = None) -> DataFrame:
    """(a, b, similarity): all pairs of one category at the threshold or above, with a < b; with asked only those with an end for which it holds.

    Exact, so the work is the square of a category's size, or asked rows times it; a category is cut into blocks of about so
    many rows and its pairs of blocks are multiplied apart, so that a large one is not one task's. A vector
    without direction, and one without category, has no duplicate. For many vectors use likely_duplicates.
    """
    own = vectors.select("category", F.col("ticket_id").cast("long").alias("ticket_id"), "vector", F.size("vector").alias("length")).where("length > 0")
    if asked:
        pairs = _asked_pairs(own, ["category", "length"], asked, threshold, block)
    else:
        sizes = own.groupBy("category", "length").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        dealt = own.join(sizes, ["category", "length"]).withColumn("mine", F.pmod(F.xxhash64("ticket_id"), F.col("blocks").cast("long")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        groups = dealt.select("category", "length", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "ticket_id", "vector")
        pairs = groups.groupBy("category", "length", "i", "j").applyInArrow(_close(threshold), "a long, b long, cos double")
    return pairs.select("a", "b", F.round("cos", 4).alias("similarity"))


def _met(threshold: float, hashed: bool):
    """The pairs at the threshold between the asked rows of a group and its others; of hashed ones those that meet first in the group's table."""

    def run(keys: tuple, t: pa.Table) -> pa.Table:
        length, table = keys[1].as_py(), keys[2].as_py() if hashed else 0
        asks = pc.equal(t.column("side"), 0)
        sides = [t.filter(asks), t.filter(pc.invert(asks))]
        rows, out = [], []
        for side in sides:
            ids, x, _ = _sound(side, "ticket_id", "vector", length)
            at = np.argsort(side.column("ticket_id").to_numpy(), kind="stable")
            at = at[np.searchsorted(side.column("ticket_id").to_numpy()[at], ids)]
            h = side.column("buckets").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(side), -1)[at, :table] if hashed and len(side) else None
            rows.append((ids, x, side.column("asked").to_numpy()[at], h))
        (a, x, _, g), (b, y, asked, h) = rows
        for s in range(0, len(a), TILE):
            for r in range(0, len(b), 32 * TILE):
                cos = np.round(x[s : s + TILE] @ y[r : r + 32 * TILE].T, 12)
                u, v = np.nonzero(cos >= threshold)
                first, second = a[s + u], b[r + v]
                # a pair of two asked rows is told from its smaller one
                keep = (first != second) & ~(asked[r + v] & (second < first))
                if hashed:
                    keep &= ~(g[s + u] == h[r + v]).any(axis=1)
                out.append((np.minimum(first, second)[keep], np.maximum(first, second)[keep], cos[u, v][keep]))
        cols = [np.concatenate([o[n] for o in out]) if out else np.zeros(0, kind) for n, kind in enumerate((np.int64, np.int64, np.float64))]
        return pa.table([pa.array(c) for c in cols], names=["a", "b", "cos"])

    return run


def _asked_pairs(rows: DataFrame, keys: list[str], asked: str, threshold: float, block: int) -> DataFrame:
    """(a, b, cos): pairs at the threshold within the groups of keys with an end that is asked; blocks of asked rows meet blocks of 16 times as many rows."""
    known = rows.withColumn("asked", F.coalesce(F.expr(asked), F.lit(False)))
    sizes = known.groupBy(*keys).agg(F.ceil(F.count_if("asked") / block).cast("int").alias("few"), F.ceil(F.count("*") / (16 * block)).cast("int").alias("many")).where("few > 0")
    # null keys meet nothing
    dealt = known.join(sizes, keys).withColumn("h", F.xxhash64("ticket_id"))
    mine = lambda n: F.pmod("h", F.col(n).cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where("asked").withColumn("side", F.lit(0)).withColumn("i", mine("few")).withColumn("j", each("many"))
    right = dealt.withColumn("side", F.lit(1)).withColumn("j", mine("many")).withColumn("i", each("few"))
    hashed = "buckets" in rows.columns
    met = left.unionByName(right).groupBy(*keys, "i", "j")
    return met.applyInArrow(_met(threshold, hashed), "a long, b long, cos double")


def likely_duplicates(vectors: DataFrame, threshold: float = DUPLICATE, tables: int = 8, bucket: float = 1.0, block: int = 2048, asked: str | None = None) -> DataFrame:
    """As duplicates, but only pairs that fall in one bucket of one of the tables: work in proportion to buckets, some pairs missed.

    A bucket's rows are multiplied by blocks, and a pair is told in the first table that it meets in. Vectors that are shorter than others have no duplicate.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    longest = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    # what has no direction hashes as zeros, as a plan may hash before it filters
    sound = F.expr(f"coalesce(size(vector) = {max(longest, 1)} and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('Infinity')), false)")
    whole = vectors.withColumn("vector", F.when(sound, F.col("vector").cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), max(longest, 1))))
    unit = Normalizer(inputCol="v", outputCol="features").transform(whole.select(F.col("ticket_id").cast("long").alias("ticket_id"), "category", F.col("vector").alias("given"), array_to_vector("vector").alias("v")))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", numHashTables=tables, bucketLength=bucket, seed=5).fit(unit)
    buckets = F.transform(F.array(*[vector_to_array(F.col("hashes")[i])[0] for i in range(tables)]), lambda x: x.cast("long"))
    hashed = model.transform(unit).select("category", F.size("given").alias("length"), "ticket_id", F.col("given").alias("vector"), buckets.alias("buckets"))
    placed = hashed.select("*", F.posexplode("buckets").alias("table", "bucket"))
    pairs = _asked_pairs(placed, ["category", "length", "table", "bucket"], asked or "true", threshold, block)
    return pairs.select("a", "b", F.round("cos", 4).alias("similarity"))


def missing(tickets: DataFrame, vectors: DataFrame) -> DataFrame:
    """The tickets without a vector."""
    return tickets.join(vectors.select(F.col("ticket_id").alias("id")), "id", "left_anti")
