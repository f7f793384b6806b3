import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ticketflow.llm import ranked_search as rs


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    """(item, rank, doc, score) by scoring every document with every item."""
    rows = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in asked.items():
        found = []
        for d, c in rows:
            n = sum(c.values())
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // n_terms))) for t, times in q.items() if t in c)
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def found(docs, items, **k):
    return sorted(tuple(r) for r in rs.search(docs, items, **k).select("item_id", "rank", "doc_id", "score").collect())


def pairs(df, key):
    return [tuple(r) for r in df.select(key, "text").collect()]


def drawn(spark, n=150, words=40, seed=3):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % words}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(n)]
    docs += [(n + i, docs[i % 5][1]) for i in range(40)]  # ties
    items = [(i, "?! ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(12)]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("k, block", [(10, rs.BLOCK), (3, 7), (1000, rs.BLOCK)])
def test_random_texts_with_ties(spark, k, block):
    docs, items = drawn(spark)
    assert found(docs, items, k=k, block=block) == brute(pairs(docs, "doc_id"), pairs(items, "item_id"), k)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "W1 w2, w2!", 5), (1, "lorem", 5), (2, None, 5), (3, "", 5), (4, "?! ...", 5), (None, "w1", 5), (5, "ééé " + "é" * 500, 5), (6, "absent", 5)], "item_id long, text string, score int")
    docs = odd_docs.withColumn("a.b", F.lit(1)).withColumn("rank", F.lit("x"))
    got = found(docs, items)
    assert got == brute(pairs(odd_docs, "doc_id"), pairs(items, "item_id")) and {r[0] for r in got} == {1, 5}
    assert found(no_docs, items) == [] and found(docs, items.limit(0)) == []
    assert found(odd_docs.where("text is null or text = ''"), items) == []


def test_terms_of_equal_hash_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(rs.K, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    known = rs.Terms.of(["ab", "cd", "efg", "ef"])
    data = np.frombuffer(b"cd xy efg ab efh", np.uint8)
    starts, ends = np.array([0, 3, 6, 10, 13]), np.array([2, 5, 9, 12, 16])
    assert sorted(zip(*(x.tolist() for x in known.look_up(data, starts, ends)), strict=True)) == [(0, 1), (2, 2), (3, 0)]


def test_documents(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    assert found(docs, items) == brute(pairs(docs, "doc_id"), pairs(items, "item_id"))
