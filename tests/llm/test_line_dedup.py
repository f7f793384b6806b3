import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketflow.llm import line_dedup as ld

SPACE = " \t\n\x0b\x0c\r"


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def brute(rows, shortest=40, least=5):
    held, split = defaultdict(set), [(d, (t or "").split("\n")) for d, t in rows]
    for d, lines in split:
        for x in lines:
            if d is not None and len(x.strip(SPACE)) >= shortest:
                held[lower(x.strip(SPACE))].add(d)
    out = []
    for d, lines in split:
        gone = [d is not None and len(held.get(lower(x.strip(SPACE)), ())) >= least and max(held[lower(x.strip(SPACE))]) != d for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((d, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **k):
    got = ld.remove_repeated_lines(df, **k).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256))
    return sorted(map(tuple, got.collect()), key=str)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def drawn(n=120):
    rng = random.Random(5)
    pool = ["ab", "Ab ", "\tcd", "cd", "é", "", " ", "CD\r", "longer line", "LONGER line\x0b", "x "]
    rows = [(rng.randrange(n), "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for _ in range(n)]
    return rows + [(None, "ab\ncd\n"), (None, None), (7, None), (8, ""), (9, "\n\n")]


@pytest.mark.parametrize("least", [2, 5])
@pytest.mark.parametrize("bounds", [{}, {"most": 0}, {"most_repeated": 0}])
def test_short_lines_on_both_sides_of_the_bounds(spark, least, bounds):
    rows = drawn()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df, shortest=2, least=least, **bounds) == brute(rows, 2, least)


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = brute(pairs(docs))
    assert found(docs) == want and found(docs, most=0, most_repeated=0) == want and sum(r[2] for r in want) > 0


def test_odd_rows(spark, odd_docs, no_docs):
    assert found(odd_docs, least=2) == brute(pairs(odd_docs), 40, 2)
    assert found(no_docs) == []
    dotted = odd_docs.withColumn("a.b", F.lit(1)).withColumn("n_lines", F.lit("x")).withColumn("gone", F.lit(2))
    assert found(dotted) == brute(pairs(odd_docs))


def test_a_line_of_all_documents_and_many_slices(spark, monkeypatch):
    monkeypatch.setattr(ld, "SLICE", 1 << 6)
    monkeypatch.setattr(ld, "FLUSH", 16)
    rows = [(i, f"{'common line ' * 4}\n{i} {'line of its own ' * 3}\n{i % 40} {'shared ' * 8}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for bounds in ({}, {"most": 0}):
        assert found(df, **bounds) == brute(rows)


def test_filters_lose_nothing_and_suspect_little():
    shape = ld.Shape.holding(2_000)
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 2_000, dtype=np.uint64)
    once, again = np.zeros(shape.bits, bool), np.zeros(shape.bits, bool)
    for part in (h[:1_500], h[1_000:]):
        ld.fold(once, again, shape.places(ld.fingerprint(part)), np.zeros(len(part), bool))
    told = again[shape.places(ld.fingerprint(h))].all(axis=1)
    assert told[1_000:1_500].all() and told[:1_000].mean() < 0.02 and told[1_500:].mean() < 0.02


def test_shape_is_bounded_however_many_lines():
    for n in (0, 1, 10**6, 10**9, 10**12):
        s = ld.Shape.holding(n)
        assert s.slices * s.bits >= ld.BITS * n and ld.SLICE <= s.bits <= ld.LARGEST
