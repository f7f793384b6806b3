"""Small helpers of the corpus operators: durable cuts of a plan, links to components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import trim


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where a local session names none, as in tests, a folder of this machine is made. On a
    cluster that would lose rows, so it is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(shared_folder, "own", None) or f"file://{tempfile.mkdtemp(prefix='ticketflow-')}"
        shared_folder.own = folder
    return folder


def cut(df: DataFrame, drop: bool = True) -> DataFrame:
    """Writes df to the shared folder and reads it back, which ends its lineage.

    The table outlives lost executors. With drop, what was shuffled to make it is given up at
    once: the collectors of Python and of the JVM are asked to let go of it. Small tables
    leave that to Spark's own cleaner, unless the driver's heap has grown to two thirds of its bound.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ticketflow-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    del df
    if drop or _grown(spark):
        release(spark)
    return spark.read.schema(schema).parquet(path)


def _grown(spark: SparkSession) -> bool:
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    return 3 * runtime.totalMemory() > 2 * runtime.maxMemory()


def release(spark: SparkSession) -> None:
    """Collects, which gives up shuffles and shrinks the driver's heap, and hands freed native memory back."""
    # the cleaner learns of a shuffle when its last reference is collected, some of them one round later
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)
    trim(spark)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id in links (a, b): the smallest id that links reach.

    Alternates large-star and small-star steps, each a grouped minimum joined back,
    so a hub is pre-aggregated and its join can be split. Stops when the links form stars:
    no id has two links to smaller ones, and none that has one is the smaller end of another.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), drop=False)
    for _ in range(rounds):
        ends = edges.selectExpr("u as id", "1 as up", "0 as down").union(edges.selectExpr("v", "0", "1"))
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > least(1, 1 - down)").isEmpty():
            break
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        edges = cut(large.join(low, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), drop=False)
    else:
        raise RuntimeError(f"components still moved after {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").union(edges.select("v", "v").distinct())
