import json
import random

import pytest
from pyspark.sql import functions as F

from ticketflow.streaming import bucket, consumer


def put(path, n, rows):
    path.mkdir(exist_ok=True)
    (path / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))


def event(i, ref, subject="s"):
    return {"ticketId": i, "externalRef": ref, "subject": subject, "body": "b", "language": "fr"}


def test_idempotent_consumption(spark, tmp_path):
    src, sink, dead, ckpt = (tmp_path / x for x in ("in", "out", "dead", "ckpt"))
    put(src, 1, [event(1, "TCK-1", "Site en panne"), event(2, "TCK-2"), event(3, None)])
    put(src, 2, [event(4, "TCK-1"), event(5, None), event(2, "TCK-9")])
    run = lambda: consumer.consume(consumer.once(consumer.events(spark, str(src), 1)), consumer.triaged, str(sink), str(dead), str(ckpt)).awaitTermination()
    run()
    got = {r.ticket_id: r.priority for r in spark.read.parquet(str(sink)).collect()}
    assert sorted(got) == [1, 2, 3, 5] and got[1] == "HIGH" and got[2] == "MEDIUM"
    put(src, 3, [event(1, "TCK-7"), event(6, "TCK-6")])
    run()
    assert sorted(r.ticket_id for r in spark.read.parquet(str(sink)).collect()) == [1, 2, 3, 5, 6] and not dead.exists()


def test_failing_batch_is_set_aside(spark, tmp_path):
    src, sink, dead, ckpt = (tmp_path / x for x in ("in", "out", "dead", "ckpt"))
    put(src, 1, [event(1, "A")])
    waits = []

    def broken(df):
        raise RuntimeError("no model")

    consumer.consume(consumer.events(spark, str(src)), broken, str(sink), str(dead), str(ckpt), wait=waits.append).awaitTermination()
    r = spark.read.parquet(str(dead)).first()
    assert (r.attempts, r.error, json.loads(r.message)["ticketId"]) == (3, "no model", 1) and waits == [1.0, 2.0] and not sink.exists()


def test_only_the_failing_message_is_set_aside(spark, tmp_path):
    src, sink, dead, ckpt = (tmp_path / x for x in ("in", "out", "dead", "ckpt"))
    put(src, 1, [event(i, f"R{i}") for i in range(1, 31)])
    waits = []

    def poisoned(df):
        bad = F.when(F.col("ticketId") == 13, F.raise_error(F.lit("poison")).cast("string")).otherwise(F.col("subject"))
        return df.select(F.col("ticketId").alias("ticket_id"), bad.alias("subject"))

    consumer.consume(consumer.events(spark, str(src)), poisoned, str(sink), str(dead), str(ckpt), wait=waits.append).awaitTermination()
    assert sorted(r.ticket_id for r in spark.read.parquet(str(sink)).collect()) == [i for i in range(1, 31) if i != 13]
    r = spark.read.parquet(str(dead)).collect()
    assert [json.loads(x.message)["ticketId"] for x in r] == [13] and "poison" in r[0].error and waits == [1.0, 2.0]


def test_two_new_requests_of_one_ref(spark):
    rows = [(3, "N", "c"), (1, "N", "a"), (2, None, "b"), (4, "OLD", "d"), (5, None, "e")]
    accepted = spark.createDataFrame(rows, "arrived int, externalRef string, subject string").select("arrived", F.struct("externalRef", F.lit(None).cast("string").alias("customerEmail"), "subject", F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("language")).alias("event"))
    got = {r.subject: (r.result, r.id, r.stored_id) for r in consumer.ingested(accepted, spark.createDataFrame([(9, "OLD")], "id long, external_ref string")).collect()}
    assert got == {"a": ("ACCEPTED", 10, None), "b": ("ACCEPTED", 11, None), "c": ("DUPLICATE", None, 10), "d": ("DUPLICATE", None, 9), "e": ("ACCEPTED", 12, None)}


def test_delays():
    assert [consumer.connect_delay(n) for n in range(6)] == [1, 2, 4, 8, 15, 15]


REQUESTS = [("a", 0, 1), ("a", 0, 2), ("a", 0, 3), ("b", 0, 4), ("a", 1800, 5), ("a", 1801, 6)]
ALLOWED = {1: True, 2: True, 3: False, 4: True, 5: True, 6: False}


def test_bucket(spark):
    df = spark.createDataFrame(REQUESTS, "client string, s int, key long").withColumn("at", F.timestamp_seconds("s"))
    got = bucket.admitted(df, "client", "at", "key", capacity=2, refill=2, period=3600)
    assert {r.key: r.allowed for r in got.collect()} == ALLOWED


def test_bucket_of_a_hot_client(spark):
    """Against a plain fold; no row holds all requests of a client, and pauses cut them into pieces."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else None if rng.random() < 0.2 else f"c{rng.randrange(9)}", rng.choice([None, *range(0, 60)]) if i % 50 == 0 else rng.randrange(200_000), i) for i in range(4000)]
    want, state = {}, {}
    for c, t, k in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2])):
        tokens, last = state.get(c, (5.0, None))
        tokens = tokens if t is None or last is None else min(5.0, tokens + (t - last) * (5 / 360))
        want[k] = tokens >= 1
        state[c] = tokens - want[k], t
    df = spark.createDataFrame(rows, "client string, s int, key long").withColumn("at", F.timestamp_seconds("s"))
    got = bucket.admitted(df, "client", "at", "key", capacity=5, refill=5, period=360)
    assert {r.key: r.allowed for r in got.collect()} == want and 0 < sum(want.values()) < len(want)
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_bucket_query_is_by_user(spark):
    from ticketflow.catalogue import QUERIES

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = QUERIES["token_bucket_admission"](spark, "/root/testdata/sf0.001")
    assert got.select("client").distinct().count() == events.select("user_id").distinct().count() and got.count() == events.count()


def test_bucket_stream_equals_batch(spark, tmp_path):
    pytest.importorskip("pandas")
    put(tmp_path / "in", 1, [{"client": c, "s": s, "key": k} for c, s, k in REQUESTS[:3]])
    put(tmp_path / "in", 2, [{"client": c, "s": s, "key": k} for c, s, k in REQUESTS[3:]])
    stream = spark.readStream.schema("client string, s int, key long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("at", F.timestamp_seconds("s"))
    q = bucket.admitted_stream(stream, "client", "at", "key", capacity=2, refill=2, period=3600).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.key: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()} == ALLOWED


def test_webhook(spark):
    import hashlib
    import hmac

    def row(body, key="k1", good=True):
        return (body, key, hmac.new(b"s", body.encode(), hashlib.sha256).hexdigest() if good else "sha256=deadbeef")

    rows = [row('{"externalRef":"WH-1","subject":"x","language":"FR"}'), row('{"subject":" "}'), row("nope"), row('{"subject":"x"}', "bad"), row('{"subject":"x"}', good=False), row('{"externalRef":"OLD","subject":"y"}')]
    judged = consumer.webhook(spark.createDataFrame(rows, "body string, api_key string, signature string"), "k1", b"s")
    assert [r.outcome for r in judged.collect()] == ["ACCEPTED", "INVALID", "INVALID", "UNAUTHORISED", "UNAUTHORISED", "ACCEPTED"]
    old = spark.createDataFrame([(9, "OLD")], "id long, external_ref string")
    got = {r.external_ref: (r.result, r.stored_id, r.language) for r in consumer.ingested(judged.where("outcome = 'ACCEPTED'"), old).collect()}
    assert got == {"WH-1": ("ACCEPTED", None, "fr"), "OLD": ("DUPLICATE", 9, None)}
