"""The decomposition against one written value by value."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest

from ticketflow.operators import reports, stl


def slow_line(points, at, span):
    """points (x, y, weight); the fitted value at one place."""
    n, q = len(points), min(span, len(points))
    seen = sorted(sorted(points, key=lambda p: (abs(p[0] - at), p[0]))[:q])
    reach = max(abs(p[0] - at) for p in seen) * max(1.0, span / n)
    w = [p[2] * (1.0 if p[0] == at else max(0.0, 1 - (abs(p[0] - at) / reach) ** 3) ** 3) for p in seen]
    if sum(w) <= 1e-12:
        w = [1.0] * q
    mean_x = sum(a * p[0] for a, p in zip(w, seen)) / sum(w)
    mean_y = sum(a * p[1] for a, p in zip(w, seen)) / sum(w)
    spread = sum(a * (p[0] - mean_x) ** 2 for a, p in zip(w, seen)) / sum(w)
    if spread <= 1e-9:
        return mean_y
    return mean_y + sum(a * (p[0] - mean_x) * (p[1] - mean_y) for a, p in zip(w, seen)) / sum(w) / spread * (at - mean_x)


def slow_stl(series, s):
    """{day: (trend, season, weight)} of {day: value}."""
    last, p = max(series), s.period
    trend, weight = dict.fromkeys(range(last + 1), 0.0), dict.fromkeys(series, 1.0)
    for turn in range(s.outer + 1):
        for _ in range(s.inner):
            cycles = dict.fromkeys(range(-p, last + p + 1), 0.0)
            for k in range(p):
                points = [(d // p, v - trend[d], weight[d]) for d, v in series.items() if d % p == k]
                for d in cycles:
                    if d % p == k and points:
                        cycles[d] = slow_line(points, d // p, s.seasonal)
            level = [cycles[d] for d in sorted(cycles)]
            for k in (p, p, 3):
                level = [sum(level[i : i + k]) / k for i in range(len(level) - k + 1)]
            flat = [(d, v, 1.0) for d, v in enumerate(level)]
            season = {d: cycles[d] - slow_line(flat, d, s.low) for d in range(last + 1)}
            left = [(d, v - season[d], weight[d]) for d, v in series.items()]
            trend = {d: slow_line(left, d, s.trend) for d in range(last + 1)}
        if turn < s.outer:
            off = {d: abs(v - trend[d] - season[d]) for d, v in series.items()}
            far = 6 * statistics.median(off.values())
            weight = {d: max(0.0, 1 - (o / far) ** 2) ** 2 if far > 1e-9 else float(o <= 1e-9) for d, o in off.items()}
    return {d: (trend[d], season[d], weight[d]) for d in series}


def made(seed, length, gaps=0.2):
    rng = random.Random(seed)
    out = {d: 50 + 0.3 * d + 10 * (d % 7 in (5, 6)) + rng.gauss(0, 2) for d in range(length) if d == 0 or rng.random() > gaps}
    for d in rng.sample(sorted(out), len(out) // 20):
        out[d] += 200
    return out


@pytest.mark.parametrize("seed, length", [(1, 60), (2, 100), (3, 33), (4, 9), (5, 3), (6, 1), (7, 16)])
def test_equals_the_slow_one_on_gaps_and_outliers(seed, length):
    series = made(seed, length)
    got = stl.decomposed(np.array(sorted(series)), np.array([series[d] for d in sorted(series)]))
    want = slow_stl(series, stl.Spans())
    for part in range(3):
        assert got[part] == pytest.approx([want[d][part] for d in sorted(series)], abs=1e-6)


def test_outliers_are_told_and_leave_the_season_alone():
    days = np.arange(140)
    y = 100 + 0.5 * days + 20 * np.isin(days % 7, (0, 1)) + np.sin(days * 12.9898) * 2
    spoilt = y.copy()
    spoilt[[30, 77]] += 500
    trend, season, weight = stl.decomposed(days, spoilt)
    assert weight[30] == weight[77] == 0
    clean = stl.decomposed(days, y)
    assert np.abs(season - clean[1]).max() < 3 and np.abs(trend - clean[0]).max() < 3


def test_groups_days_and_odd_rows(spark):
    day = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
    series = {g: made(ord(g), 40) for g in "ab"}
    rows = [(g, day(d), v) for g, s in series.items() for d, v in s.items()]
    odd = [(None, day(3), 5.0), ("a", None, 1.0), ("b", day(100), None), ("b", day(101), float("nan")), ("b", day(102), float("inf")), ("c", None, 1.0)]
    got = stl.stl(spark.createDataFrame(rows + odd, "g string, day timestamp, n double"), "g").collect()
    assert len(got) == len(rows) + 1
    for g, s in series.items():
        want = slow_stl(s, stl.Spans())
        mine = {(r.day - day(0)).days: r for r in got if r.g == g}
        assert {d: round(r.trend, 6) for d, r in mine.items()} == {d: round(want[d][0], 6) for d in s}
        assert all(abs(r.trend + r.season + r.rest - r.n) < 1e-9 for r in mine.values())
    alone = [r for r in got if r.g is None]
    assert [(round(r.trend, 6), round(r.season, 6), r.weight) for r in alone] == [tuple(round(v, 6) for v in slow_stl({0: 5.0}, stl.Spans())[0])]
    assert stl.stl(spark.createDataFrame([], "g string, day timestamp, n double"), "g").count() == 0


def test_anomalies_by_what_is_left(spark):
    day = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
    rows = [("a", day(d), 100.0 + 20 * (d % 7 == 0) + (d * 7919 % 5) + 300 * (d == 50)) for d in range(90)]
    got = reports.stl_anomaly(spark.createDataFrame(rows, "g string, day timestamp, n double"), "g")
    assert [r.day for r in got.where("abs(z) > 20").collect()] == [day(50)]
