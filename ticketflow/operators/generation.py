"""Making and filtering evaluation data, and asking an outside model only where it is needed."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.vectors import hashed_embeddings
from ..schemas import CATEGORIES, PRIORITIES, SENTIMENTS
from . import evaluation, similar, sinks

# Subjects and bodies of sample tickets.
SAMPLES = {
    "fr": (
        ("Probleme de connexion", "Facture incorrecte", "Remboursement demande", "Application qui plante", "Mot de passe oublie", "Livraison en retard"),
        ("Bonjour, je n'arrive pas a acceder a mon compte depuis ce matin.", "Ma derniere facture ne correspond pas a mon abonnement.", "Je souhaite etre rembourse suite a une erreur de commande."),
    ),
    "en": (
        ("Login issue", "Wrong invoice", "Refund request", "App keeps crashing", "Forgot password", "Late delivery"),
        ("Hi, I cannot access my account since this morning.", "My last invoice does not match my subscription.", "I would like a refund following an order mistake."),
    ),
}

#: A model's answer to a list of texts: a JSON text for each, or None.
Answers = Callable[[Sequence[str]], Sequence[str | None]]


def drawn(k: int, *parts: Column) -> Column:
    """A number from 0 to k - 1 from a hash of the parts; the same on every run."""
    digest = F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")


def sample_tickets(spark: SparkSession, n: int = 10_000, seed: int = 42) -> DataFrame:
    """n tickets a minute apart, the first a minute into 2026, each in a drawn language with texts of that language."""
    languages = list(SAMPLES)
    i = F.col("id")
    row = spark.range(n).withColumn("l", drawn(len(languages), F.lit(seed), F.lit("l"), i))
    choose = lambda part: F.element_at(F.element_at(F.array(*[F.array(*map(F.lit, SAMPLES[x][part])) for x in languages]), F.col("l") + 1), drawn(len(SAMPLES[languages[0]][part]), F.lit(seed), F.lit(part), i) + 1)
    at = F.timestamp_seconds(F.lit(1_767_225_600) + (i + 1) * 60)
    return row.select(
        F.format_string("TCK-%06d", i + 1).alias("external_ref"), F.format_string("client%d@example.com", i + 1).alias("customer_email"), choose(0).alias("subject"), choose(1).alias("body"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.element_at(F.array(*map(F.lit, languages)), F.col("l") + 1).alias("language"),
    )


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """rows with place, their key in a reproducible random order."""
    return rows.withColumn("place", F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")))


def parsed_tickets(rows: DataFrame, column: str = "answer") -> DataFrame:
    """rows with subject and body of the JSON object in an answer; rows without both are dropped."""
    found = rows.withColumn("__o", F.from_json(text.first_json_object(F.col(column)), "subject string, body string"))
    made = found.withColumn("subject", text.strip(F.col("__o.subject"))).withColumn("body", text.strip(F.col("__o.body"))).drop("__o")
    return made.where("subject <> '' and body <> ''")


def parsed_labels(rows: DataFrame, column: str = "answer") -> DataFrame:
    """rows with category, priority and sentiment of the JSON object in an answer, NULL where not allowed."""
    found = rows.withColumn("__o", F.from_json(text.first_json_object(F.col(column)), "category string, priority string, sentiment string"))
    for name, allowed in (("category", CATEGORIES), ("priority", PRIORITIES), ("sentiment", SENTIMENTS)):
        found = found.withColumn(name, text.label(F.col(f"__o.{name}"), allowed))
    return found.drop("__o")


def label_id(c: Column, labels: tuple[str, ...]) -> Column:
    """The place of a label, from 0; NULL if it is none of them."""
    return F.nullif(F.array_position(F.array(*map(F.lit, labels)), c), F.lit(0)) - 1


def asked(
    rows: DataFrame, column: str, answers: Callable[[], Answers] | Sequence[Callable[[], Answers]], needed: Column | None = None, batch: int = 16, attempts: int = 2,
    backoff: float = 0.0, pace: float = 0.0, told: Callable[[str, str], str] | None = None,
) -> DataFrame:
    """rows with answer, from an outside model for the rows that need it and NULL for the others.

    answers makes a client, once a task; of several, the next is tried when one fails, each so
    many times, and a batch that all fail stays without answer. Only rows that need it reach
    Python. A task pauses backoff seconds before a second attempt, twice as long before each
    further one, and starts calls at least pace seconds apart; told(text, error) makes the
    text of a further attempt.
    """
    makers = list(answers) if isinstance(answers, (list, tuple)) else [answers]
    needed = F.lit(True) if needed is None else F.coalesce(needed, F.lit(False))

    def ask(clients, texts, last):
        for client in clients:
            said = texts
            for attempt in range(attempts):
                time.sleep(max(0.0, backoff * 2 ** (attempt - 1) if attempt else 0.0, last[0] + pace - time.monotonic()))
                last[0] = time.monotonic()
                try:
                    got = list(client(said))[: len(texts)]
                    return got + [None] * (len(texts) - len(got))
                except Exception as e:  # noqa: BLE001 - whatever a provider raises, the next one is asked
                    said = [told(t, str(e)) for t in texts] if told else texts
        return [None] * len(texts)

    def run(batches: Iterator[pa.RecordBatch]):
        clients, last = [make() for make in makers], [-pace]
        for b in batches:
            texts = b.column(column).to_pylist()
            said = [a for s in range(0, len(texts), batch) for a in ask(clients, texts[s : s + batch], last)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], [*b.schema.names, "answer"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", answer string"
    return rows.where(needed).mapInArrow(run, schema).unionByName(rows.where(~needed).withColumn("answer", F.lit(None).cast("string")))


def built_dataset(candidates: DataFrame, seen: DataFrame, per_cell: int, gate: tuple[str, ...] = ("category", "sentiment"), order: str = "seq") -> DataFrame:
    """The candidates (spec, pred structs and texts) that pass the gate, are unseen, and fit the quota of their cell.

    Duplicates by normalised body keep the first in order; a cell is a category and a language.
    """
    passed = candidates.where(evaluation.agrees("spec", "pred", gate))
    fresh = evaluation.unseen(passed, seen, "body", order=order)
    return evaluation.quota(fresh.withColumn("category", F.col("spec.category")), ["category", "language"], order, per_cell).drop("category")


def backfilled(tickets: DataFrame, vectors: DataFrame, model: str = "hashed", length: int = 64) -> DataFrame:
    """Vectors for the tickets without one, to upsert: unit counts of hashed words as stand-in for a model."""
    body = text.ticket_text(F.col("subject"), F.col("body"), "(vide)")
    words = F.split(F.concat(F.lit("query: "), body), " ")
    new = similar.missing(tickets, vectors).withColumnRenamed("id", "ticket_id")
    return hashed_embeddings(new, "ticket_id", words, length).withColumn("model", F.lit(model))


def upserted_vectors(new: DataFrame, stored: DataFrame) -> DataFrame:
    """One vector a ticket, the newest; created_at stays as first stored."""
    stamped = new.withColumn("created_at", F.current_timestamp())
    return sinks.last_write_wins(stamped, stored, "ticket_id", "created_at", keep=("created_at",))


def topics(rows: DataFrame, column: str = "vector", k: int = 5, seed: int = 3) -> DataFrame:
    """rows with cluster, by k-means over their vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    featured = rows.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(featured).transform(featured).drop("features")


def recall_at(found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """The mean share of relevant (query_id, ticket_id) among the first k found (.., rank)."""
    hits = relevant.join(found.where(F.col("rank") <= k).select("query_id", "ticket_id", F.lit(1).alias("hit")), ["query_id", "ticket_id"], "left")
    return hits.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r")).agg(F.avg("r").alias("recall"))


def positional_zip(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """left with the columns of right at the same place in order; missing ones NULL, surplus ones dropped.

    Places are counted by partition after a range sort, so no task numbers all rows.
    """
    number = lambda df: sinks.placed(df, order, "__place")
    return number(left).join(number(right).drop(order), "__place", "left").drop("__place")

