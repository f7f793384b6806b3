import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ticketflow.llm import substring_dedup as words
from ticketflow.llm import suffix_dedup as suffix


def brute_words(rows, window=13):
    first, split = {}, [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t in rows]
    for d, w in sorted((x for x in split if x[0] is not None), key=lambda x: x[0]):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def found_words(df, **k):
    got = words.remove_repeats(df, **k).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256))
    return sorted(map(tuple, got.collect()), key=str)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("period", range(1, 14))
def test_difference_cover(period):
    d = words.difference_cover(period)
    assert {(a - b) % period for a in d for b in d} == set(range(period))


def test_words_on_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert found_words(docs) == brute_words(pairs(docs))


def test_words_with_other_windows(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_words(df, window=5, period=3) == brute_words(rows, 5)


def test_words_of_odd_rows(spark, odd_docs, no_docs):
    assert found_words(odd_docs) == brute_words(pairs(odd_docs))
    out = words.remove_repeats(odd_docs)
    assert out.columns == [*odd_docs.columns, "n_words", "n_removed"] and words.remove_repeats(no_docs).count() == 0
    assert {r.score for r in out.collect()} == {"clash"}


def brute_bytes(rows, length=200):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for d, b in texts if d is not None for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone, end = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            if d is not None and seen[b[i : i + length]] > 1:
                for j in range(max(i, end), i + length):
                    gone[j] = 1
                end = i + length
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def found_bytes(df, **k):
    got = suffix.remove_repeats(df, **k).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    return sorted(map(tuple, got.collect()), key=str)


def test_bytes_on_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert found_bytes(docs) == brute_bytes(pairs(docs))


@pytest.mark.parametrize("crowd", [3, 8192])
def test_bytes_with_short_strings(spark, monkeypatch, crowd):
    """A small alphabet makes many anchors crowded; a small crowd splits them."""
    monkeypatch.setattr(suffix, "CROWD", crowd)
    rng = random.Random(8)
    passage = "".join(rng.choice("ab") for _ in range(90))
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(50))) + passage[rng.randrange(40) : 50 + rng.randrange(40)] + "".join(rng.choice("ab") for _ in range(rng.randrange(50)))) for i in range(80)]
    rows += [(100, "a" * 300), (101, "ab" * 100), (102, "é" * 40), (103, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found_bytes(df, length=30, gram=9) == brute_bytes(rows, 30)


def test_bytes_of_copies_over_partitions(spark):
    """Of an exact copy in each of two batches, only the second batch has the edited copy too."""
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(120)) for _ in range(40)]
    edited = [t[: (k := rng.randrange(45, 75))] + "#" + t[k + 1 :] for t in texts]
    batches = [list(enumerate(texts)), [(100 + i, t) for i, t in enumerate(texts)] + [(200 + i, t) for i, t in enumerate(edited)], [(300 + i, t[10:]) for i, t in enumerate(edited) if i % 3 == 0]]
    for own in (batches[:2], batches):
        df = spark.createDataFrame(spark.sparkContext.parallelize(own, len(own)).flatMap(lambda b: b), "doc_id long, text string")
        assert df.rdd.getNumPartitions() == len(own)
        assert found_bytes(df, length=30, gram=9) == brute_bytes([r for b in own for r in b], 30)


def test_bytes_of_odd_rows(spark, odd_docs, no_docs):
    assert found_bytes(odd_docs) == brute_bytes(pairs(odd_docs))
    assert suffix.remove_repeats(no_docs).count() == 0


def test_interval_tree_gives_all_maximal_repeats():
    """Against every left-diverse class of equal prefixes, found the slow way."""
    rng = random.Random(3)
    for _ in range(300):
        s = [(bytes(rng.choice(b"ab") for _ in range(rng.randrange(7))), rng.choice([-1, 97, 98, 98])) for _ in range(rng.randrange(2, 9))]
        want = set()
        groups = defaultdict(set)
        for i, (b, _) in enumerate(s):
            for k in range(len(b) + 1):
                groups[b[:k]].add(i)
        for prefix, own in groups.items():
            longer = any(groups.get(prefix + bytes([c]), set()) == own for c in b"ab")
            lefts = {s[i][1] for i in own}
            if len(own) > 1 and not longer and (len(lefts) > 1 or -1 in lefts):
                want.add((len(prefix), frozenset(own)))
        got = {(size, frozenset(order[a:b])) for size, a, b, order in suffix.interval_tree(s, 0)}
        assert got == want
