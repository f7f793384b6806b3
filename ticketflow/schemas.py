"""Tables of the ticket engine: schemas, value domains, and a split into valid and quarantined rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DecimalType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType


def _table(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, not required[0] if required else True) for name, kind, *required in fields])


TEXT, LONG, TIME = StringType(), LongType(), TimestampType()

USERS = _table(("id", LONG, True), ("email", TEXT, True), ("password_hash", TEXT, True), ("full_name", TEXT), ("role", TEXT, True), ("created_at", TIME))
REFRESH_TOKENS = _table(("id", LONG, True), ("user_id", LONG, True), ("token_hash", TEXT, True), ("expires_at", TIME, True), ("revoked", BooleanType()), ("created_at", TIME))
IMPORTS = _table(("id", LONG, True), ("filename", TEXT, True), ("file_type", TEXT, True), ("uploaded_by", LONG), ("row_count", IntegerType()), ("status", TEXT, True), ("column_mapping", MapType(TEXT, TEXT)), ("extraction_meta", TEXT), ("created_at", TIME))
TICKETS = _table(("id", LONG, True), ("external_ref", TEXT), ("import_id", LONG), ("source", TEXT, True), ("customer_email", TEXT), ("subject", TEXT), ("body", TEXT), ("language", TEXT), ("status", TEXT, True), ("sla_due_at", TIME), ("merged_into_id", LONG), ("created_at", TIME))
ANALYSES = _table(("id", LONG, True), ("ticket_id", LONG, True), ("priority", TEXT), ("category", TEXT), ("sentiment", TEXT), ("keywords", ArrayType(TEXT)), ("confidence", DecimalType(4, 3)), ("model_used", TEXT), ("latency_ms", IntegerType()), ("escalated_to_llm", BooleanType()), ("created_at", TIME))
EMBEDDINGS = _table(("ticket_id", LONG, True), ("vector", ArrayType(FloatType()), True), ("model", TEXT), ("created_at", TIME))
TICKET_CREATED = _table(("ticketId", LONG), ("externalRef", TEXT), ("subject", TEXT), ("body", TEXT), ("language", TEXT))
EVALUATION = _table(*[(n, TEXT) for n in ("id", "language", "subject", "body", "text", "category", "priority", "sentiment", "style", "split", "source")])

CATEGORIES = ("TECHNIQUE", "FACTURATION", "COMPTE", "RECLAMATION", "DEMANDE")
PRIORITIES = ("LOW", "MEDIUM", "HIGH")
SENTIMENTS = ("NEG", "NEU", "POS")
STATUSES = ("NEW", "ANALYZED", "IN_PROGRESS", "RESOLVED", "MERGED")
SOURCES = ("FILE", "WEBHOOK", "EMAIL", "MANUAL")
ROLES = ("ADMIN", "MANAGER", "AGENT")
LANGUAGES = ("fr", "en")

#: Allowed values, unique columns and longest texts by table.
DOMAINS = {
    "users": {"role": ROLES},
    "tickets": {"source": SOURCES, "status": STATUSES, "language": LANGUAGES},
    "analyses": {"priority": PRIORITIES, "category": CATEGORIES, "sentiment": SENTIMENTS},
}
UNIQUE = {"users": ("email",), "refresh_tokens": ("token_hash",), "tickets": ("external_ref",), "analyses": ("ticket_id",), "embeddings": ("ticket_id",)}
LENGTHS = {"tickets": {"external_ref": 255, "customer_email": 320}, "users": {"email": 320, "full_name": 255}, "analyses": {"model_used": 32}}
SCHEMAS = {"users": USERS, "refresh_tokens": REFRESH_TOKENS, "imports": IMPORTS, "tickets": TICKETS, "analyses": ANALYSES, "embeddings": EMBEDDINGS}

VECTOR_LENGTH = 768


def violations(df: DataFrame, table: str) -> DataFrame:
    """df with reasons, the names of the constraints that a row breaks.

    NULL satisfies a domain and uniqueness, as in SQL. Of rows that share a unique value all
    but one break it; which one is left open, so deduplicate by an order first where it matters.
    """
    checks = []
    for field in SCHEMAS[table].fields:
        if field.name in df.columns and not field.nullable:
            checks.append((F.col(field.name).isNull(), f"{field.name} missing"))
    for name, values in DOMAINS.get(table, {}).items():
        if name in df.columns:
            checks.append((~F.col(name).isin(*values), f"{name} not allowed"))
    for name, most in LENGTHS.get(table, {}).items():
        if name in df.columns:
            checks.append((F.length(name) > most, f"{name} too long"))
    for name in UNIQUE.get(table, ()):
        if name in df.columns:
            # nulls are all unique: a key of their own each, so that no task gets them together
            key = F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.monotonically_increasing_id().cast("string"))
            seen = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))
            df = df.withColumn(f"__{name}", seen)
            checks.append((F.col(name).isNotNull() & (F.col(f"__{name}") > 1), f"{name} not unique"))
    reasons = F.array_compact(F.array(*[F.when(broken, F.lit(reason)) for broken, reason in checks]))
    return df.withColumn("reasons", reasons).drop(*[c for c in df.columns if c.startswith("__")])


def validate(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all constraints, rows that do not with their reasons)."""
    judged = violations(df, table)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)
