"""All registered queries of the ticket engine and the SQL that each must equal."""

from __future__ import annotations

from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
