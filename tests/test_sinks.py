import pytest
from pyspark.sql import functions as F

from ticketflow.operators import evaluation, generation, ingest, sinks
from ticketflow.schemas import IMPORTS
from ticketflow.sources import jsonl

WIDE = 400_000


def wide(spark, n=WIDE):
    """More bytes than one partition of a coalesced shuffle holds."""
    return spark.range(n, numPartitions=16).select((F.col("id") * 7919 % n).alias("o"), *[F.repeat(F.sha2(F.concat(F.lit(x), F.col("id").cast("string")), 512), 2).alias(x) for x in "ab"])


def test_ids_are_dense_and_in_order_at_size(spark, tmp_path):
    """Written with adaptive execution as it comes, since that is what once lost rows."""
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    old = spark.createDataFrame([(5,), (9,)], "id long")
    sinks.with_ids(wide(spark), old, "o").write.parquet(str(tmp_path / "t"))
    got = spark.read.parquet(str(tmp_path / "t"))
    assert got.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id"), F.count_if(F.col("id") != F.col("o") + 10)).first() == (WIDE, WIDE, 10, WIDE + 9, 0)


def test_confirm_and_zip_at_size(spark, tmp_path):
    n = 100_000
    rows = wide(spark, n).select((F.col("o") + 2).cast("int").alias("line_no"), F.array(F.lit("ref"), F.lit("subject")).alias("headers"), F.array(F.concat(F.lit("R"), F.col("o").cast("string")), "a").alias("cells"))
    inserted, _ = ingest.confirm(rows, {"externalRef": "ref", "subject": "subject"}, spark.createDataFrame([(3, "R0")], "id long, external_ref string"))
    inserted.write.parquet(str(tmp_path / "t"))
    got = spark.read.parquet(str(tmp_path / "t"))
    assert got.agg(F.count("*"), F.min("id"), F.max("id"), F.count_if(F.concat(F.lit("R"), (F.col("id") - 3).cast("string")) != F.col("external_ref"))).first() == (n - 1, 4, n + 2, 0)
    left, right = wide(spark, n).select("o", "a"), spark.range(10, n, 2).select(F.col("id").alias("o"), F.col("id").alias("p"))
    zipped = generation.positional_zip(left, right, "o").cache()
    assert zipped.count() == n and zipped.where("p <> 2 * o + 10").count() == 0 and zipped.where("p is null").count() == n - (n - 10) // 2
    zipped.unpersist()


def test_places_of_ties_nulls_and_groups(spark):
    df = spark.createDataFrame([("x", 3), ("x", 1), ("y", 1), ("y", None), (None, 2), (None, 1), ("x", 1)], "g string, o int")
    got = sinks.placed(df, "o", "n").collect()
    assert sorted(r.n for r in got) == list(range(1, 8)) and next(r.n for r in got if r.o is None) == 1 and next(r.n for r in got if r.o == 3) == 7
    apart = {(r.g, r.o, r.n) for r in sinks.placed(df, "o", "n", "g").collect()}
    assert apart == {("x", 1, 1), ("x", 1, 2), ("x", 3, 3), ("y", None, 1), ("y", 1, 2), (None, 1, 1), (None, 2, 2)}
    assert sinks.placed(df.limit(0), "o", "n").count() == 0


def test_split_of_one_stratum(spark):
    df = spark.range(1000).select("id", F.lit(None).cast("string").alias("s"))
    got = evaluation.stratified_split(df, "s", F.col("id")).where("split = 'validation'").agg(F.count("*"), F.max("id")).first()
    assert got == (150, 149)


def test_stores(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, "ticket_id long, vector string, created_at int")
    for store, want in ((sinks.store_analyses, {(1, "a", 1), (2, "b", 1), (3, "e", 5)}), (sinks.store_embeddings, {(1, "d", 1), (2, "b", 1), (3, "e", 5)})):
        path = str(tmp_path / store.__name__)
        store(spark, path, make((1, "a", 1), (2, "b", 1)))
        got = store(spark, path, make((1, "c", 3), (1, "d", 4), (3, "e", 5)))
        assert {tuple(r) for r in got.collect()} == want
        assert sinks.stored(spark, path, got.schema)[1] == 2


def test_import_states(spark):
    files = spark.createDataFrame([("x/a.csv", "CSV"), ("x/b.txt", "TXT")], "path string, type string")
    rows = spark.createDataFrame([("x/a.csv", 2), ("x/a.csv", 3)], "path string, line_no int")
    table = ingest.uploaded(rows, files, spark.createDataFrame([], IMPORTS), by=4)
    assert [(r.id, r.filename, r.row_count, r.status, r.uploaded_by) for r in table.orderBy("id").collect()] == [(1, "a.csv", 2, "AWAITING_VALIDATION", 4), (2, "b.txt", 0, "AWAITING_VALIDATION", 4)]
    done = ingest.settled(table, 2, {"subject": " s ", "body": ""})
    assert {r.id: (r.status, r.column_mapping) for r in done.collect()} == {1: ("AWAITING_VALIDATION", None), 2: ("DONE", {"subject": "s"})}
    for i in (2, 9):
        with pytest.raises(ingest.ImportState):
            ingest.settled(done, i, {"subject": "s"})


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([("1", "Hé  LLO", None)], "id string, body string, style string")
    jsonl.write_records(rows, path)
    (tmp_path / "r" / "more.json").write_text('{"id": "2"\n\n{"id": "3", "body": "Ok"}\n')
    assert {(r.id, r.body, r.style) for r in jsonl.read_records(spark, path).collect()} == {("1", "Hé  LLO", None), ("3", "Ok", None)}
    assert {r.body for r in jsonl.seen_bodies(spark, [path]).collect()} == {"hé llo", "ok"}
