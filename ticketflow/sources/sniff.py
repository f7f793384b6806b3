"""What a file is and how its text is encoded, from its name and its first bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = 65_536
EXTENSIONS = {"csv": "CSV", "txt": "TXT", "tsv": "TXT", "json": "JSON", "xlsx": "XLSX", "docx": "DOCX", "pdf": "PDF", "eml": "EML"}


class UnsupportedType(ValueError):
    """No parser reads this type of file."""


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def file_type(name: Column, head: Column) -> Column:
    """By magic bytes, else by extension; NULL if neither is known."""
    ext = extension(name)
    magic = F.hex(F.substring(head, 1, 4))
    by_name = F.try_element_at(F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair]), ext)
    return F.when(magic == "504B0304", F.when(ext == "docx", "DOCX").otherwise("XLSX")).when(magic == "25504446", "PDF").otherwise(by_name)


def charset(head: Column) -> Column:
    """By byte order mark, else UTF-8 if the head is valid, else ISO-8859-1."""
    sample = F.substring(head, 1, HEAD)
    mark = F.hex(F.substring(head, 1, 3))
    return (
        F.when(mark == "EFBBBF", "UTF-8")
        .when(mark.startswith("FFFE"), "UTF-16LE")
        .when(mark.startswith("FEFF"), "UTF-16BE")
        .when(F.is_valid_utf8(sample.cast("string")), "UTF-8")
        .otherwise("ISO-8859-1")
    )


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, type, charset) of the files under path, reading their heads."""
    files = spark.read.format("binaryFile").load(path)
    head = F.substring("content", 1, HEAD)
    return files.select("path", "length", file_type(F.col("path"), head).alias("type"), charset(head).alias("charset"))


def of_head(spark: SparkSession, path: str) -> tuple[str | None, str]:
    """(type, charset) of one file by its first bytes, which alone are read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        head = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, HEAD)))
    finally:
        stream.close()
    one = spark.createDataFrame([(path, bytearray(head))], "path string, head binary")
    return tuple(one.select(file_type(F.col("path"), F.col("head")), charset(F.col("head"))).first())
