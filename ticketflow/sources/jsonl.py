"""Records as JSON lines: evaluation sets in and out, and what earlier runs have written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import normalise
from ..schemas import EVALUATION


def read_records(spark: SparkSession, path: str, schema: StructType = EVALUATION) -> DataFrame:
    """One row a line that holds a JSON object; blank and broken lines are left out."""
    broken = StructField("__broken", StringType())
    rows = spark.read.schema(StructType([*schema.fields, broken])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__broken").json(path)
    return rows.where("__broken is null").drop("__broken")


def records(rows: DataFrame) -> DataFrame:
    """(value): one JSON object a row, with its NULLs."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_records(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    records(rows).write.mode(mode).text(path)


def seen_bodies(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(body): the normalised bodies of records written before, which a new set must not repeat."""
    return read_records(spark, paths).where("body is not null").select(normalise(F.col("body")).alias("body")).distinct()
