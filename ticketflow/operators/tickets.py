"""Ticket search: validated filters, whitelisted sort, pages, and their envelope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import excerpt
from ..schemas import CATEGORIES, LANGUAGES, PRIORITIES, SENTIMENTS, SOURCES, STATUSES

SORTS = {"createdAt": "created_at", "subject": "subject", "status": "status", "source": "source", "language": "language", "id": "id"}
SIZE, MOST = 20, 100


def enum_value(value: str | None, allowed: tuple[str, ...], field: str) -> str | None:
    """Upper case and trimmed; None if blank; an error if not allowed."""
    v = (value or "").strip().upper()
    if not v:
        return None
    if v not in allowed:
        raise ValueError(f"{field}: {value!r} is not one of {', '.join(allowed)}")
    return v


def language_value(value: str | None) -> str | None:
    """fr or en; anything else is no filter."""
    v = (value or "").strip().lower()
    return v if v in LANGUAGES else None


def contains(q: str, *columns: str, literal: bool = False) -> Column:
    """Whether a column holds q, in any case. % and _ in q are wildcards unless literal."""
    q = q.strip().lower()
    if literal:
        tests = [F.lower(c).contains(q) for c in columns]
    else:
        pattern = "%" + q.replace("\\", "\\\\") + "%"
        tests = [F.lower(c).like(pattern) for c in columns]
    return reduce(lambda a, b: a | b, tests)


def predicate(q: str | None = None, status: str | None = None, source: str | None = None, language: str | None = None) -> list[Column]:
    """The criteria that are given; an empty list lets every row pass."""
    wanted = {"status": enum_value(status, STATUSES, "status"), "source": enum_value(source, SOURCES, "source"), "language": language_value(language)}
    tests = [F.col(c) == v for c, v in wanted.items() if v is not None]
    if q and q.strip():
        tests.append(contains(q, "subject", "body"))
    return tests


def ordering(sort: str | None = None, direction: str | None = None) -> list[Column]:
    """The whitelisted key, NULLs last when ascending and first when descending, then id."""
    c = F.col(SORTS.get(sort or "", "created_at"))
    key = c.asc_nulls_last() if (direction or "").lower() == "asc" else c.desc_nulls_first()
    return [key, F.col("id").asc()]


def page_bounds(page: int = 0, size: int = SIZE) -> tuple[int, int]:
    return max(0, page), SIZE if size <= 0 else min(size, MOST)


def summary(tickets: DataFrame) -> DataFrame:
    return tickets.select("id", "external_ref", "source", "customer_email", "subject", excerpt(F.col("body")).alias("excerpt"), "language", "status", "created_at")


def with_analyses(tickets: DataFrame, analyses: DataFrame) -> DataFrame:
    """tickets with category, priority and sentiment of their analysis, NULL where there is none."""
    found = analyses.select(F.col("ticket_id").alias("id"), "category", "priority", "sentiment")
    return tickets.join(found, "id", "left")


def filtered(tickets: DataFrame, analyses: DataFrame | None = None, category: str | None = None, priority: str | None = None, sentiment: str | None = None, **criteria) -> DataFrame:
    """The tickets that meet the criteria that are given.

    Criteria on the analysis ask for analyses (ticket_id, category, priority, sentiment); both
    sides are filtered before they meet, and tickets without an analysis fail.
    """
    found = reduce(lambda df, test: df.where(test), predicate(**criteria), tickets)
    asked = {"category": (category, CATEGORIES), "priority": (priority, PRIORITIES), "sentiment": (sentiment, SENTIMENTS)}
    wanted = {name: v for name, (value, allowed) in asked.items() if (v := enum_value(value, allowed, name)) is not None}
    if not wanted:
        return found
    if analyses is None:
        raise ValueError(f"{', '.join(wanted)}: analyses are needed")
    fit = reduce(lambda df, c: df.where(F.col(c) == wanted[c]), wanted, analyses)
    return found.join(fit.select(F.col("ticket_id").alias("id")), "id", "left_semi")


def search(tickets: DataFrame, page: int = 0, size: int = SIZE, sort: str | None = None, direction: str | None = None, **criteria) -> DataFrame:
    """A page of summaries. The sort keeps only offset + size rows of each task."""
    page, size = page_bounds(page, size)
    found = filtered(tickets, **criteria).orderBy(*ordering(sort, direction))
    return summary(found.offset(page * size).limit(size))


def envelope(tickets: DataFrame, page: int = 0, size: int = SIZE, **criteria) -> DataFrame:
    """One row: page, size, total_elements, total_pages, last."""
    page, size = page_bounds(page, size)
    total = filtered(tickets, **criteria).agg(F.count("*").alias("total_elements"))
    pages = F.ceil(F.col("total_elements") / size)
    return total.select(F.lit(page).alias("page"), F.lit(size).alias("size"), "total_elements", pages.alias("total_pages"), (F.lit(page + 1) >= pages).alias("last"))
