"""Merging new rows into stored tables: insert or ignore, upsert, referential actions, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.store import Store, Table


def insert_ignore(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """The new rows whose key is not stored; a NULL key never conflicts."""
    return new.join(existing.where(F.col(key).isNotNull()).select(key), key, "left_anti").select(new.columns)


def first_write_wins(new: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """The stored rows, and of the new ones the first of each key that is not stored."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), F.struct(order)).alias("r")).select("r.*")
    return existing.unionByName(insert_ignore(first, existing, key).select(existing.columns))


def last_write_wins(new: DataFrame, existing: DataFrame, key: str, order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: the newest new row, else the stored one; columns in keep stay as stored."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), F.struct(order)).alias("n"))
    old = existing.select(F.col(key).alias("__key"), F.struct(*existing.columns).alias("o"))
    both = last.join(old, F.col(key) == F.col("__key"), "full_outer")
    columns = []
    for c in existing.columns:
        first, second = (("o", "n") if c in keep else ("n", "o"))
        value = F.when(F.col(f"{first}.{key}").isNotNull(), F.col(f"{first}.{c}")).otherwise(F.col(f"{second}.{c}"))
        columns.append(value.alias(c))
    return both.select(*columns)


def cascade_delete(children: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """The children whose parent is still there; a NULL reference stays."""
    alive = children.join(parents.select(F.col(key).alias(column)), column, "left_semi").select(children.columns)
    return children.where(F.col(column).isNull()).unionByName(alive)


def set_null(children: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """The children with references to parents that are gone set to NULL."""
    alive = parents.select(F.col(key).alias("__p"))
    joined = children.join(alive, F.col(column) == F.col("__p"), "left")
    return joined.select(*[F.col("__p").alias(c) if c == column else F.col(c) for c in children.columns])


def placed(rows: DataFrame, order: str, name: str, by: str | None = None) -> DataFrame:
    """rows with their place from 1 on in the given order (within each value of by), numbered by many tasks.

    Rows are dealt into runs of the order at values drawn from it, held in the plan, so a
    row's run is a matter of its value and not of where it is computed. Each run is numbered
    apart, from where those before it end. Nulls come first; equal values in any order.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = rows.select(F.col(order).alias("o")).where("o is not null").orderBy(F.rand(7)).limit(16 * n).collect()
    values = sorted(r["o"] for r in drawn)
    cuts = sorted({values[len(values) * k // n] for k in range(1, n)}) if values else []
    run = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    keys = ["__run"] + ([by] if by else [])
    dealt = rows.withColumn("__run", run).withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first(order))))
    # a row for each run, and value of by
    sizes = rows.select(run.alias("__run"), *([by] if by else [])).groupBy(*keys).agg(F.count("*").alias("__c"))
    earlier = Window.partitionBy(*([by] if by else [])).orderBy("__run")
    before = sizes.select(F.col("__run").alias("__r"), *([F.col(by).alias("__by")] if by else []), (F.sum("__c").over(earlier) - F.col("__c")).alias("__before"))
    same = F.col("__run") == F.col("__r")
    met = dealt.join(before, same & F.col(by).eqNullSafe(F.col("__by"))) if by else dealt.join(F.broadcast(before), same)
    return met.select(*rows.columns, (F.col("__before") + F.col("__n")).alias(name))


def with_ids(new: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """new with dense ids after the largest stored one, in the given order."""
    base = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__base"))
    numbered = placed(new, order, "__place").crossJoin(F.broadcast(base))
    return numbered.select((F.col("__base") + F.col("__place")).alias("id"), *new.columns)


def _table(spark: SparkSession, path: str, schema: StructType, key: str = "ticket_id") -> Store:
    return Store(spark, path, {"rows": Table(schema, key)})


def stored(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, int]:
    """(the newest version of the table at path, its number); an empty table and 0 where there is none."""
    store = _table(spark, path, schema)
    newest = store.manifest()
    return store.rows(newest, "rows"), newest["version"]


def store_analyses(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """Adds analyses; of each ticket the first that was ever stored stays.

    Reads the buckets of the new rows' tickets and adds files to them. A run that is lost
    leaves the version before, and the next one goes on from it.
    """
    store = _table(spark, path, new.schema)
    store.transact(lambda t: t.insert("rows", new, "created_at"))
    return store.read("rows")


def store_embeddings(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """Puts vectors in; of each ticket the newest stays, with the time of the first. Only the buckets of those tickets are rewritten."""
    store = _table(spark, path, new.schema)
    store.transact(lambda t: t.merge("rows", new, lambda old: last_write_wins(new, old, "ticket_id", "created_at", keep=("created_at",))))
    return store.read("rows")
