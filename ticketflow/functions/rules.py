"""Triage rules: urgency, priority, and the routing of classifications by confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that make a ticket urgent, and phrases of questions and thanks.
URGENT = (
    "urgent", "urgence", "imm[ée]diat", "asap", "au plus vite", "bloqu[ée]", "impossible", "en panne", r"\bpanne\b", r"\bdown\b", "critique", "critical",
    "hors service", "ne (?:fonctionne|marche|répond) plus", "double pr[ée]l[èe]vement", "d[ée]bit[ée] deux fois", "fraude", "pirat", "hack", "vol[ée]?", "perdu de l'argent",
)
CALM = (
    "merci", "thanks?", "remerci", r"\bquestion\b", "renseignement", "information", "comment (?:faire|puis)", "how (?:do|to|can)", "est-ce que", "disponib",
    "availab", "f[ée]licit",
)

THRESHOLD, FALLBACK_CONFIDENCE, FALLBACK_CATEGORY, FALLBACK_SENTIMENT = 0.80, 0.5, "DEMANDE", "NEU"


def _any(phrases: tuple[str, ...]) -> str:
    return f"(?iuU)({'|'.join(phrases)})"


def is_urgent(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(_any(URGENT))


def is_calm(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(_any(CALM))


def priority(text: Column, category: Column, sentiment: Column) -> Column:
    """The first rule that holds, from urgent words down to MEDIUM."""
    return (
        F.when(is_urgent(text), "HIGH")
        .when((sentiment == "NEG") & category.isin("FACTURATION", "TECHNIQUE"), "HIGH")
        .when(sentiment == "POS", "LOW")
        .when((category == "DEMANDE") & is_calm(text), "LOW")
        .otherwise("MEDIUM")
    )


def route(category: Column, category_confidence: Column, sentiment: Column, sentiment_confidence: Column, other_category: Column, other_sentiment: Column, threshold: float = THRESHOLD) -> Column:
    """The struct (category, sentiment, confidence, escalated, model_used).

    A local label stands if its confidence reaches the threshold; else the other model's is
    taken, else the local one after all, else the fallback.
    """
    present = category.isNotNull()
    sure_c = F.coalesce(category_confidence >= threshold, F.lit(False)) & present
    sure_s = F.coalesce(sentiment_confidence >= threshold, F.lit(False)) & sentiment.isNotNull()
    kept_c, kept_s = F.when(sure_c, category), F.when(sure_s, sentiment)
    escalated = ~(sure_c & sure_s)
    confidence = F.coalesce(F.least(F.when(sure_c, category_confidence), F.when(sure_s, sentiment_confidence)), F.lit(FALLBACK_CONFIDENCE))
    return F.struct(
        F.coalesce(kept_c, other_category, category, F.lit(FALLBACK_CATEGORY)).alias("category"),
        F.coalesce(kept_s, other_sentiment, sentiment, F.lit(FALLBACK_SENTIMENT)).alias("sentiment"),
        F.round(confidence, 3).alias("confidence"),
        escalated.alias("escalated"),
        F.when(~escalated, "xlm-r-onnx").when(present, "hybrid").otherwise("llm").alias("model_used"),
    )
