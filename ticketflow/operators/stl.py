"""Seasonal and trend decomposition of daily series by loess, robust against outliers.

A series is decomposed in one task, whose size is its calendar and not its rows: it takes
rows that are aggregated by day. Series are dealt over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spans:
    """Lengths of the windows, in days but for seasonal, which counts periods; passes of the two loops."""

    period: int = 7
    seasonal: int = 7
    trend: int = 15
    low: int = 7
    inner: int = 2
    outer: int = 5


def loess(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Values at the points of local lines through (x, y) with weights w; x ascends strictly.

    Each point sees its span nearest x (of equals the earlier), by tricube weights that reach
    the furthest of them, or further by span / len(x) where there are fewer. Where weights
    leave one x only, or none, the line is the weighted or the plain mean of what it sees.
    """
    n = len(x)
    q = min(span, n)
    sums = (x[: n - q] + x[q:]) if n > q else np.empty(0)
    first = np.searchsorted(sums, 2 * at, side="left")
    seen = first[:, None] + np.arange(q)
    away = np.abs(x[seen] - at[:, None])
    reach = np.maximum(away.max(axis=1) * max(1.0, span / n), 1e-12)
    near = np.clip(1 - (away / reach[:, None]) ** 3, 0, None) ** 3
    near[away <= 0] = 1.0
    weight = near * w[seen]
    total = weight.sum(axis=1)
    weight[total <= 1e-12] = 1.0
    weight /= weight.sum(axis=1)[:, None]
    centre = (weight * x[seen]).sum(axis=1)
    mean = (weight * y[seen]).sum(axis=1)
    off = x[seen] - centre[:, None]
    spread = (weight * off * off).sum(axis=1)
    slope = (weight * off * y[seen]).sum(axis=1) / np.where(spread > 1e-9, spread, np.inf)
    return mean + slope * (at - centre)


def _moving(v: np.ndarray, k: int) -> np.ndarray:
    total = np.cumsum(np.concatenate([[0.0], v]))
    return (total[k:] - total[:-k]) / k


def _season(days: np.ndarray, rest: np.ndarray, w: np.ndarray, length: int, s: Spans) -> np.ndarray:
    """The seasonal part for all days of the calendar, from detrended values of those that were observed."""
    p = s.period
    padded = np.zeros(length + 2 * p)
    for k in range(min(p, length)):
        cycle = np.arange(-1, (length - 1 - k) // p + 2)
        mine = days % p == k
        if mine.any():  # a weekday that was never observed has no season
            padded[(cycle + 1) * p + k] = loess((days[mine] // p).astype(float), rest[mine], w[mine], cycle.astype(float), s.seasonal)
    level = _moving(_moving(_moving(padded, p), p), 3)
    calendar = np.arange(length, dtype=float)
    return padded[p : p + length] - loess(calendar, level, np.ones(length), calendar, s.low)


def decomposed(days: np.ndarray, y: np.ndarray, s: Spans = Spans()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, season, weight) of each observed day; days ascend strictly from 0 and may have gaps.

    weight is what the robust passes left of a value: 0 for one that is far off. trend, season
    and what they leave sum up to the value.
    """
    length = int(days[-1]) + 1
    calendar = np.arange(length, dtype=float)
    trend, season, w = np.zeros(length), np.zeros(length), np.ones(len(days))
    for turn in range(s.outer + 1):
        for _ in range(s.inner):
            season = _season(days, y - trend[days], w, length, s)
            trend = loess(days.astype(float), y - season[days], w, calendar, s.trend)
        if turn < s.outer:
            off = np.abs(y - trend[days] - season[days])
            far = 6 * np.median(off)
            w = np.clip(1 - (off / far) ** 2, 0, None) ** 2 if far > 1e-9 else np.where(off <= 1e-9, 1.0, 0.0)
    return trend[days], season[days], w


def stl(days: DataFrame, group: str, spans: Spans = Spans()) -> DataFrame:
    """(group, day, n, trend, season, rest, weight) of daily volumes (group, day, n), one row a group and day.

    Days without a row are gaps and not zeros. Rows without a day or with a volume that is
    NULL or not finite take no part and are left out; a group that is NULL is one of its own.
    """

    def one(rows):
        rows = rows.sort_values("day", kind="stable").reset_index(drop=True)
        number = rows["__day"].to_numpy(np.int64)
        rows["trend"], rows["season"], rows["weight"] = decomposed(number - number.min() if len(number) else number, rows["n"].to_numpy(float), spans)
        rows["rest"] = rows["n"] - rows["trend"] - rows["season"]
        return rows[[group, "day", "n", "trend", "season", "rest", "weight"]]

    whole = days.select(group, "day", F.col("n").cast("double").alias("n"), F.unix_date(F.col("day").cast("date")).alias("__day"))
    kinds = {f.name: f.dataType.simpleString() for f in whole.schema}
    known = whole.where("__day is not null and n is not null and not isnan(n) and abs(n) < double('infinity')")
    return known.groupBy(group).applyInPandas(one, f"`{group}` {kinds[group]}, day {kinds['day']}, n double, trend double, season double, rest double, weight double")
