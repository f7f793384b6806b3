"""Text expressions: trims, normal forms, excerpts, and the language heuristic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that tell French from English.
FRENCH = """le la les un une des du de et est sont je j vous nous il elle pour avec pas ne que qui sur mon ma mes votre vos
notre bonjour merci cordialement suite commande facture compte paiement site problème depuis être avoir fait cette ce au aux
dans par plus très mais car donc quand à""".split()
ENGLISH = """the a an is are was were i you we he she it they for with not that which on my your our hello hi thanks thank
please and to of in order account payment invoice site issue problem since have has this at by but so when cannot can would
could regards""".split()
DIACRITICS = "àâäéèêëïîôöùûüÿçœæ"


def trim_controls(c: Column) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    """NULL where nothing but white space and controls is left, else trimmed."""
    return F.nullif(trim_controls(c), F.lit(""))


def strip_bom(c: Column) -> Column:
    return F.regexp_replace(c, "^\ufeff", "")


def normalise(c: Column) -> Column:
    """Lower case, white space as single spaces, stripped: the key of exact duplicates."""
    return strip(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def excerpt(c: Column, most: int = 160) -> Column:
    """White space as single spaces, cut after so many characters with an ellipsis; NULL stays NULL."""
    flat = F.regexp_replace(strip(c), r"\s+", " ")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def ticket_text(subject: Column, body: Column, fallback: str | None = None) -> Column:
    """Subject, blank line, body, stripped; then whichever of the two there is, then the fallback."""
    both = strip(F.concat(F.coalesce(subject, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit(""))))
    tries = [F.nullif(both, F.lit("")), F.nullif(subject, F.lit("")), F.nullif(body, F.lit(""))]
    return F.coalesce(*tries, *([F.lit(fallback)] if fallback is not None else []))


def known_language(c: Column) -> Column:
    """fr or en in lower case, anything else NULL."""
    return F.when(F.lower(c).isin("fr", "en"), F.lower(c))


def detect_language(c: Column) -> Column:
    """fr or en by function words and accented letters (which count twice, for French)."""
    low = F.lower(c)
    tokens = F.regexp_extract_all(low, F.lit(f"([a-z{DIACRITICS}']+)"), 1)
    among = lambda words: F.size(F.filter(tokens, lambda t: t.isin(*words)))
    accents = F.regexp_count(low, F.lit(f"[{DIACRITICS}]"))
    fr, en = among(FRENCH) + 2 * accents, among(ENGLISH)
    told = F.when(fr == en, F.when((en > 0) & (accents == 0), "en").otherwise("fr")).when(fr > en, "fr").otherwise("en")
    return F.when(c.isNull() | (strip(c) == ""), "fr").otherwise(told)


def first_json_object(c: Column) -> Column:
    """From the first brace on, without code fences; from_json ignores what follows the object."""
    bare = F.regexp_replace(c, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*)", 1), F.lit(""))


def label(c: Column, allowed: tuple[str, ...]) -> Column:
    """The value in upper case if it is one of those allowed, else NULL."""
    up = F.upper(strip(c.cast("string")))
    return F.when(up.isin(*allowed), up)


def instant(c: Column) -> Column:
    """ISO date and time with a zone, or without one as UTC; anything else NULL."""
    t = trim_controls(c)
    iso = r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d:\d\d)?$"
    return F.when(t.rlike(iso), F.try_to_timestamp(t))


def unaccent(c: Column) -> Column:
    """Latin letters without their accents."""
    return F.translate(c, "àâäéèêëïîôöùûüÿçÀÂÄÉÈÊËÏÎÔÖÙÛÜŸÇ", "aaaeeeeiioouuuycAAAEEEEIIOOUUUYC")


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters of the padded lower-case text."""
    padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: padded.substr(i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
