"""Consumption of ticket events: idempotent, retried, with what fails set aside."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import rules, security, text
from ..operators.sinks import with_ids
from ..schemas import TICKET_CREATED

ATTEMPTS = 3
#: Parts of a batch that fails, and how often parts are split again.
SPLIT, DEPTH = 8, 16


def retry_delay(attempt: int) -> float:
    """Seconds before the next of several attempts, from 1 on."""
    return float(2 ** (attempt - 1))


def connect_delay(n: int) -> float:
    return float(min(2**n, 15))


def events(spark: SparkSession, path: str, files_a_batch: int = 20) -> DataFrame:
    """A stream of JSON events in files under path; so many files a micro-batch hold back the rest."""
    return spark.readStream.schema(TICKET_CREATED).option("maxFilesPerTrigger", files_a_batch).json(path)


def once(stream: DataFrame, delay: str = "1 day", at: str | None = None) -> DataFrame:
    """The stream without events whose externalRef came before; those without one all pass.

    With a time column the state of a ref is dropped once it is older than delay.
    """
    named, bare = stream.where("externalRef is not null"), stream.where("externalRef is null")
    if at is None:
        return named.dropDuplicates(["externalRef"]).unionByName(bare)
    return named.withWatermark(at, delay).dropDuplicatesWithinWatermark(["externalRef"]).unionByName(bare)


def triaged(events: DataFrame) -> DataFrame:
    """Analyses of events by rules alone, as where no classifier is installed."""
    body = text.ticket_text(F.col("subject"), F.col("body"), "(vide)")
    none = F.lit(None).cast("string")
    routed = rules.route(none, F.lit(None).cast("double"), none, F.lit(None).cast("double"), none, none)
    r = events.select(F.col("ticketId").alias("ticket_id"), "externalRef", body.alias("text"), F.coalesce("language", text.detect_language(body)).alias("language"), routed.alias("r"))
    return r.select("ticket_id", "externalRef", "language", rules.priority(F.col("text"), F.col("r.category"), F.col("r.sentiment")).alias("priority"), "r.category", "r.sentiment", "r.confidence", "r.escalated", "r.model_used")


def consume(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], sink: str, quarantine: str, checkpoint: str, key: str = "ticket_id", attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> StreamingQuery:
    """Runs analyse over each micro-batch and appends what is new to the sink, as long as input is there.

    A batch is tried several times. If it still fails it is split, so that only the messages
    that fail by themselves go to the quarantine, with the number of attempts and the error;
    the others are stored and the stream goes on. The sink holds one row a key: the first
    wins, also when a batch runs again after a crash.
    """

    def add(df: DataFrame) -> None:
        made = analyse(df)
        first = made.groupBy(key).agg(F.min(F.struct(*made.columns)).alias("r")).select("r.*")
        stored = stored_table(df.sparkSession, sink, made.schema)
        first.join(stored.select(key), key, "left_anti").select(made.columns).write.mode("append").parquet(sink)

    def settle(df: DataFrame, tries: int, depth: int = 0) -> None:
        for attempt in range(1, tries + 1):
            try:
                return add(df)
            except Exception as e:  # noqa: BLE001 - any failure is retried, then set aside
                error = str(e)[:500]
                if attempt < tries:
                    wait(retry_delay(attempt))
        message = F.to_json(F.struct("*"))
        if depth < DEPTH and df.select(message).distinct().limit(2).count() > 1:
            part = F.pmod(F.xxhash64(F.lit(depth), message), F.lit(SPLIT))
            for k in range(SPLIT):
                some = df.where(part == k)
                if not some.isEmpty():
                    settle(some, 1, depth + 1)
        else:
            df.select(message.alias("message"), F.lit(attempts).alias("attempts"), F.lit(error).alias("error")).write.mode("append").parquet(quarantine)

    def batch(df: DataFrame, _: int) -> None:
        settle(df, attempts)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at path, or an empty one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def publish(messages: DataFrame, path: str) -> None:
    """Appends one JSON message a line; called once the tickets themselves are stored."""
    messages.select("value").write.mode("append").text(path)


def webhook(requests: DataFrame, key: str, secret: bytes) -> DataFrame:
    """requests (body, api_key, signature, address) with the parsed event and an outcome.

    outcome is UNAUTHORISED, INVALID (no JSON object, or a blank subject) or ACCEPTED.
    """
    fields = "externalRef string, customerEmail string, subject string, body string, language string"
    ok = security.signed(secret, key, F.col("body"), F.col("api_key"), F.col("signature"))
    parsed = requests.withColumn("event", F.from_json("body", fields, {"mode": "PERMISSIVE"}))
    blank = F.coalesce(text.strip(F.col("event.subject")), F.lit("")) == ""
    return parsed.withColumn("outcome", F.when(~ok, "UNAUTHORISED").when(blank, "INVALID").otherwise("ACCEPTED"))


def ingested(accepted: DataFrame, tickets: DataFrame, arrival: str = "arrived") -> DataFrame:
    """Accepted requests as WEBHOOK tickets with ids: ACCEPTED, or DUPLICATE with the id that the ref has.

    A ref counts as known if a ticket has it or an earlier request of the same batch, in
    order of the column arrival, or of the bodies where there is none. id is the new ticket's,
    stored_id the one that a duplicate repeats.
    """
    order = F.col(arrival) if arrival in accepted.columns else F.col("body")
    e = accepted.select(order.alias("arrived"), F.col("event.*"))
    new = e.select("arrived", text.blank_to_null(F.col("externalRef")).alias("external_ref"), F.lit("WEBHOOK").alias("source"), text.blank_to_null(F.col("customerEmail")).alias("customer_email"), text.blank_to_null(F.col("subject")).alias("subject"), text.blank_to_null(F.col("body")).alias("body"), text.known_language(F.col("language")).alias("language"))
    old = tickets.where("external_ref is not null").select(F.col("external_ref").alias("ref"), F.col("id").alias("known"))
    # refs are short lists of requests each; those without one never meet
    turn = F.row_number().over(Window.partitionBy("external_ref").orderBy("arrived"))
    named = new.where("external_ref is not null").join(old, F.col("external_ref") == F.col("ref"), "left").drop("ref").withColumn("turn", turn)
    bare = new.where("external_ref is null").withColumn("known", F.lit(None).cast("long")).withColumn("turn", F.lit(1))
    fresh = with_ids(named.unionByName(bare).where("known is null and turn = 1"), tickets, "arrived").withColumn("result", F.lit("ACCEPTED")).withColumn("stored_id", F.col("known"))
    firsts = fresh.where("external_ref is not null").select(F.col("external_ref").alias("ref"), F.col("id").alias("own"))
    again = named.where("known is not null or turn > 1").join(firsts, F.col("external_ref") == F.col("ref"), "left").withColumn("stored_id", F.coalesce("known", "own")).withColumn("id", F.lit(None).cast("long")).withColumn("result", F.lit("DUPLICATE"))
    columns = ["external_ref", "source", "customer_email", "subject", "body", "language", "id", "stored_id", "result"]
    return fresh.select(columns).unionByName(again.select(columns))
