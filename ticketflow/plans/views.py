"""The driver's tables as tickets, vectors, analyses and gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tickets; views have no reference, the others share their user's."""
    e = table(spark, sf_dir, "events")
    pick = lambda key, *values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col("event_id"), F.lit(key)) + 1).cast("int"))
    source = F.when(F.col("event_type").isin("view", "purchase"), "FILE").when(F.col("event_type") == "click", "WEBHOOK").when(F.col("event_type") == "error", "EMAIL").otherwise("MANUAL")
    return e.select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") != "view", F.concat(F.lit("U"), F.col("user_id").cast("string"))).alias("external_ref"), source.alias("source"),
        F.lit(None).cast("string").alias("customer_email"), F.concat_ws(" ", "event_type", "props").alias("subject"), F.col("props").alias("body"), pick(3, "fr", "en", None).alias("language"),
        pick(5, "NEW", "ANALYZED", "IN_PROGRESS", "RESOLVED", "MERGED").alias("status"), F.col("ts").alias("created_at"),
    )


TICKETS = """
tickets AS (SELECT event_id AS id, CASE WHEN event_type <> 'view' THEN 'U' || user_id END AS external_ref,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'FILE' WHEN event_type = 'click' THEN 'WEBHOOK' WHEN event_type = 'error' THEN 'EMAIL' ELSE 'MANUAL' END AS source,
  NULL::VARCHAR AS customer_email, concat_ws(' ', event_type, props) AS subject, props AS body, (['fr', 'en', NULL])[event_id % 3 + 1] AS language,
  (['NEW', 'ANALYZED', 'IN_PROGRESS', 'RESOLVED', 'MERGED'])[event_id % 5 + 1] AS status, ts AS created_at FROM events)"""


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each ticket but every seventh, an analysis drawn from its id."""
    of = lambda *values, by=1: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.floor(F.col("event_id") / by), F.lit(len(values))) + 1).cast("int"))
    first = F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 1)
    return table(spark, sf_dir, "events").where("event_id % 7 <> 0").select(
        F.col("event_id").alias("ticket_id"), F.when(first < "8", "HIGH").otherwise("LOW").alias("priority"), of("TECHNIQUE", "FACTURATION", "COMPTE", "RECLAMATION", "DEMANDE").alias("category"),
        of("NEG", "NEU", "POS", by=5).alias("sentiment"), (F.pmod(F.col("event_id") * 37, F.lit(100)) / 100).alias("confidence"), F.pmod(F.col("event_id") * 53, F.lit(997)).cast("int").alias("latency_ms"),
        of(True, False, None, False).alias("escalated_to_llm"),
    )


ANALYSES = """
analyses AS (SELECT event_id AS ticket_id, CASE WHEN substr(md5(event_id::VARCHAR), 1, 1) < '8' THEN 'HIGH' ELSE 'LOW' END AS priority, (['TECHNIQUE', 'FACTURATION', 'COMPTE', 'RECLAMATION', 'DEMANDE'])[event_id % 5 + 1] AS category,
  (['NEG', 'NEU', 'POS'])[event_id // 5 % 3 + 1] AS sentiment, event_id * 37 % 100 / 100.0::DOUBLE AS confidence, (event_id * 53 % 997)::INTEGER AS latency_ms, ([true, false, NULL, false])[event_id % 4 + 1] AS escalated_to_llm
  FROM events WHERE event_id % 7 <> 0)"""


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tickets with long texts."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.split("text", "\n", 2)[0].alias("subject"), F.col("text").alias("body"), F.when(F.col("lang").isin("fr", "en"), F.col("lang")).alias("language"), F.col("lang"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    categories = F.array(*map(F.lit, ("TECHNIQUE", "FACTURATION", "COMPTE", "RECLAMATION", "DEMANDE")))
    return e.select(F.col("vec_id").alias("ticket_id"), F.element_at(categories, F.col("label") % 5 + 1).alias("category"), F.col("embedding").alias("vector"), "label")


VECTORS = """
vectors AS (SELECT vec_id AS ticket_id, (['TECHNIQUE', 'FACTURATION', 'COMPTE', 'RECLAMATION', 'DEMANDE'])[label % 5 + 1] AS category, embedding::DOUBLE[] AS vector, label FROM embeddings)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as gold, and a rule on the length as prediction."""
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    long = F.when(F.col("n_chars") > 1500, "good").otherwise("bad")
    return l.join(d, "doc_id").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("gold"), long.alias("pred"), "text", "toxic")


JUDGED = """
judged AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS gold, CASE WHEN n_chars > 1500 THEN 'good' ELSE 'bad' END AS pred, text, toxic
  FROM labels JOIN documents USING (doc_id))"""


def routed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets with labels and confidences of two models, some missing."""
    t = tickets(spark, sf_dir)
    of = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col("id"), F.lit(k)) + 1).cast("int"))
    conf = lambda k: F.pmod(F.col("id") * k, F.lit(100)) / 100
    return t.select("id", "subject", of(("TECHNIQUE", "FACTURATION", "COMPTE", "RECLAMATION", "DEMANDE", None), 6).alias("lc"), conf(37).alias("cc"), of(("NEG", "NEU", "POS"), 3).alias("ls"), conf(53).alias("sc"), of(("COMPTE", None), 2).alias("oc"), of(("POS", "NEU", None, None), 4).alias("os"))


ROUTED = f"""{TICKETS},
routed_in AS (SELECT id, subject, (['TECHNIQUE', 'FACTURATION', 'COMPTE', 'RECLAMATION', 'DEMANDE', NULL])[id % 6 + 1] AS lc, id * 37 % 100 / 100.0::DOUBLE AS cc,
  (['NEG', 'NEU', 'POS'])[id % 3 + 1] AS ls, id * 53 % 100 / 100.0::DOUBLE AS sc, (['COMPTE', NULL])[id % 2 + 1] AS oc, (['POS', 'NEU', NULL, NULL])[id % 4 + 1] AS os FROM tickets),
routed AS (SELECT id, subject, CASE WHEN lc IS NOT NULL AND cc >= 0.8 THEN lc ELSE coalesce(oc, lc, 'DEMANDE') END AS category,
  CASE WHEN sc >= 0.8 THEN ls ELSE coalesce(os, ls, 'NEU') END AS sentiment,
  round(coalesce(least(CASE WHEN lc IS NOT NULL AND cc >= 0.8 THEN cc END, CASE WHEN sc >= 0.8 THEN sc END), 0.5), 3) AS confidence,
  NOT (lc IS NOT NULL AND cc >= 0.8 AND sc >= 0.8) AS escalated,
  CASE WHEN lc IS NOT NULL AND cc >= 0.8 AND sc >= 0.8 THEN 'xlm-r-onnx' WHEN lc IS NOT NULL THEN 'hybrid' ELSE 'llm' END AS model_used FROM routed_in)"""
