import random

import pytest
from pyspark.sql import functions as F

from ticketflow.llm import decontaminate as D
from ticketflow.llm import mixing, url_rules
from ticketflow.llm.registry import ORACLES

# --- benchmark


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    items = [(1, text(30)), (2, text(90)), (3, text(25)), (4, None), (5, ""), (6, "tiny")]
    return spark.createDataFrame(items, "item_id long, text string"), dict(items), text


def edited(text, n, seed=1):
    rng, t = random.Random(seed), list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[i] = "z"
        elif kind == 1:
            del t[i]
        else:
            t.insert(i, "q")
    return "".join(t)


def test_finds_passages_within_the_budget(spark, bench):
    df, items, text = bench
    rows = [(1, text(50) + " " + items[1] + " " + text(50)), (2, text(200)), (3, text(9) + edited(items[3], 4)), (4, items[2].upper().replace(" ", " - ") + text(20)), (5, edited(items[1], 40)), (6, None), (7, ""), (8, items[1][: len(items[1]) // 3]), (None, items[1]), (1, items[3])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id): r.edits for r in D.matches(docs, df).collect()}
    assert set(got) == {(1, 1), (3, 3), (4, 2), (None, 1), (1, 3)}
    assert got[1, 1] == 0 and 0 < got[3, 3] <= 4 and got[4, 2] == 0
    kept = D.clean(docs, df)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7, 8] and kept.columns == docs.columns
    assert D.matches(docs, df.limit(0)).count() == 0 and D.matches(docs.limit(0), df).count() == 0


def test_blocks_find_the_same(spark, bench, monkeypatch):
    df, items, text = bench
    docs = spark.createDataFrame([(i, text(20) + " " + items[i] + " " + text(20)) for i in (1, 2, 3)], "doc_id long, text string")
    monkeypatch.setattr(D, "BLOCK", 200)
    assert sorted((r.doc_id, r.item_id) for r in D.matches(docs, df).collect()) == [(1, 1), (2, 2), (3, 3)]
    assert D.clean(docs, df).count() == 0


def slow_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_alignment_and_lemma():
    rng = random.Random(2)
    for _ in range(150):
        p = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(40, 120)))
        t = bytes(rng.choice(b"abcd") for _ in range(10)) + edited(p.decode(), rng.randrange(8), rng.random()).encode() + bytes(rng.choice(b"abcd") for _ in range(10))
        assert D.banded_distance(p, t, 10**6) == slow_distance(p, t)
        assert (D.banded_distance(p, t, 3) is None) == (slow_distance(p, t) > 3)


def test_exact_passages_of_documents(spark, small):
    docs, b = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in b.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in r.text}
    got = {(r.doc_id, r.item_id) for r in D.matches(docs, b).collect()}
    assert want and want <= got and len(got - want) <= 2


def near_in(p, t):
    """The fewest edits between p and any part of t."""
    return slow_distance(p, t)


def test_finds_what_edit_distance_finds(spark):
    """Against a scan of all documents by edit distance; items of every length about the bounds."""
    rng = random.Random(12)
    sizes = [*range(10, 24), 33, 34, 50, 51, 90, 150, 200]
    items = [(i, "".join(rng.choice("abcdefghij") for _ in range(m))) for i, m in enumerate(sizes)]
    docs = []
    for i, (_, t) in enumerate(items):
        for e in (0, 1, 2, 3, 12):
            docs.append((100 * i + e, "".join(rng.choice("klmnop") for _ in range(15)) + edited(t, e, e) + "".join(rng.choice("klmnop") for _ in range(9))))
    bench = spark.createDataFrame([*items, (None, "null item of some length"), (50, "tiny"), (51, "a b"), (52, "!"), (53, "part one of it all"), (53, "second part of it")], "item_id long, text string")
    docs += [(9001, "x null item of some length y"), (9002, "a TINY! thing"), (9003, "tinyish"), (9004, "so a b"), (9005, "ab"), (9006, "the second part of it is here"), (9007, "tiny"), (9007, "tiny")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_segments int")
    index = D.Index(items, 10, 0.06, 200)
    want = {(d, i) for d, t in docs for i, p in items if near_in(p.encode(), t.lower().encode()) <= index.edits(len(p))}
    rows = D.matches(df, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got == want | {(9001, None), (9002, 50), (9007, 50), (9004, 51), (9006, 53)} and len(rows) == len(got) + 1
    assert sorted(r.doc_id for r in D.clean(df, bench).collect()) == sorted(d for d, _ in docs if not any(d == x for x, _ in got))


def test_very_long_texts(spark):
    rng = random.Random(5)
    item = "".join(rng.choice("abcdefgh ") for _ in range(150))
    text = "".join(rng.choice("ijklmnop ") for _ in range(400_000))
    df = spark.createDataFrame([(1, text + item + text), (2, text * 4)], "doc_id long, text string")
    assert [r.doc_id for r in D.matches(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [1]


# --- mixing


def test_mixing_equals_its_sql(spark, small):
    duckdb = pytest.importorskip("duckdb")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = mixing.poisson_mix(docs)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = c.sql(ORACLES["op6_poisson_mix"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_mixing_reaches_its_targets(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 10 == 1, None).otherwise("hot").alias("source"), F.lit("x").alias("copy"))
    weights = spark.createDataFrame([("rare", 0.5), ("hot", 0.25), (None, 0.25), ("absent", 9.0)], "source string, weight double")
    n = {r.source: r.n for r in mixing.poisson_mix(docs, weights).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["rare"] - 10_000) < 400 and abs(n["hot"] - 5_000) < 300 and abs(n[None] - 5_000) < 300
    again = {(r.doc_id, r.copy) for r in mixing.poisson_mix(docs.repartition(7), weights).collect()}
    assert again == {(r.doc_id, r.copy) for r in mixing.poisson_mix(docs, weights).collect()}
    none = spark.createDataFrame([("rare", 1.0)], "source string, weight double")
    assert {r.source for r in mixing.poisson_mix(docs, none).select("source").distinct().collect()} == {"rare"}


def test_mixing_of_odd_rows(odd_docs, no_docs):
    assert mixing.poisson_mix(no_docs).count() == 0
    assert set(mixing.poisson_mix(odd_docs, epochs=3.0).columns) == {*odd_docs.columns, "shuffle_key"}
    clash = odd_docs.withColumn("cdf", F.lit("mine")).withColumn("rate", F.lit("r")).withColumnRenamed("rest", "a.b")
    got = mixing.poisson_mix(clash, epochs=5.0)
    assert set(got.columns) == {*clash.columns, "shuffle_key"} and {(r.cdf, r.rate, r["a.b"]) for r in got.collect()} == {("mine", "r", "r")}


# --- urls


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "<html>", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")


def empty_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


URLS = {
    "https://WWW.Example.COM/en/7/x?q=/de/": ("www.example.com", "/en/7/x", "example.com/en/7", "allow"),
    "http://a.com/en/": ("a.com", "/en/", "com/en/", "block"),
    "http://a.com/en": ("a.com", "/en", None, "allow"),
    "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
    "https://x.net/de/1#/en/": ("x.net", "/de/1", "net/de/", "allow"),
    "https://example.net/de/85": ("example.net", "/de/85", "example.net/de/8", "block"),
    "https://example.net/de/9": ("example.net", "/de/9", "net/de/", "allow"),
    "ftp://y.org/es/a": ("y.org", "/es/a", "org/es/", "block"),
    "https://q.org?x=/es/": ("q.org", "", None, "allow"),
    "https://É.com#f": ("É.com", "", None, "allow"),
    "no scheme/com/en/": ("", "", None, "allow"),
    "a://b://c.com/en/": ("b:", "//c.com/en/", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_given_rules(spark):
    urls = list(URLS)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judged(pages_of(spark, urls), empty_labels(spark)).collect()}
    assert [got[i] for i in range(len(urls))] == list(URLS.values())


def test_mined_rules_block(spark):
    urls = [f"http://h{i % 7}.example.info/{'promo' if i % 3 == 0 else 'news'}/{'win' if i % 2 == 0 else 'read'}/{i}" for i in range(240)] + ["http://free-casino.example.info/x"] * 9
    labels = spark.createDataFrame([(i, 1, int(i >= 240 or i % 3 == 0 and i % 2 == 0)) for i in range(249)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.verdict, r.matched) for r in url_rules.judged(pages_of(spark, urls), labels).collect()}
    assert all((got[i][0] == "block") == (i % 6 == 0 or i >= 240) for i in range(249))
    assert got[0][1] == "p:promo p:win" and got[1][1] is None


def slow_rules(items, support, confidence, lift):
    """All rules of one or two tokens, by counting every pair."""
    from itertools import combinations

    n, bad = len(items), sum(b for _, b in items)
    often = {t for s, _ in items for t in s if sum(t in x for x, _ in items) >= url_rules.UBIQUITOUS * n}
    counted = {}
    for tokens, b in items:
        own = sorted(tokens - often)
        for s in [(t,) for t in own] + list(combinations(own, 2)):
            seen = counted.setdefault(s, [0, 0])
            seen[0] += 1
            seen[1] += b
    least = max(support * n, url_rules.LEAST_URLS)
    rules = {s: (hit / all_, hit / n) for s, (all_, hit) in counted.items() if hit >= least and hit / all_ >= confidence and hit / all_ / (bad / n) >= lift}
    return {s: c for s, c in rules.items() if len(s) == 1 or not any((t,) in rules for t in s)}


@pytest.mark.parametrize("bound", [0, 2_000])
def test_rules_equal_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(url_rules, "RULES", bound)
    rng = random.Random(4)
    pool = ["aa", "bb", "cc", "dd", "ee", "ff"]
    urls = [f"http://{rng.choice(pool)}.info/{rng.choice(pool)}/{rng.choice(pool)}" for _ in range(300)] + [f"http://{rng.choice(pool)}.info/{rng.choice(pool)}/qq{k % 2}" for k in range(40)] + ["http://aa.info/bb/cc"] * 2 + [None, ""]
    bad = {i: int(u is not None and ("aa.info" in u and "/bb" in u or "cc.info" in u and "/dd" in u or "/qq" in u and rng.random() < 0.9)) for i, u in enumerate(urls)}
    labels = spark.createDataFrame([(i, 1, b) for i, b in bad.items() if i % 7], "doc_id long, quality int, toxic int")
    pages = pages_of(spark, urls)
    tokens = {r.page_id: set(r.t) for r in pages.select("page_id", url_rules.tokens_of(url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))).alias("t")).collect()}
    want = slow_rules([(tokens[i], b) for i, b in bad.items() if i % 7], 0.002, 0.7, 1.5)
    prepared = pages.select("page_id", url_rules.tokens_of(url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))).alias("tokens"))
    got = {tuple(r.tokens): (r.confidence, r.support) for r in url_rules.mine(url_rules.labelled(prepared, labels)).collect()}
    assert set(got) == set(want) and len(want) > 3 and any(len(s) == 2 for s in want)
    assert all(got[s] == pytest.approx(want[s]) for s in want)
    for r in url_rules.judged(pages, labels, rules=()).collect():
        fits = sorted((-want[s][0], list(s)) for s in want if set(s) <= tokens[r.page_id])
        assert (r.verdict, r.matched) == (("block", " ".join(fits[0][1])) if fits else ("allow", None))


def test_odd_pages(spark):
    rows = [(1, "http://a.com/en/"), (1, "http://a.com/en/"), (None, "http://b.org/es/"), (2, "http://c.net/de/" + "x/y" * 20_000), (3, None)]
    df = spark.createDataFrame([(*r, "t", 1, 2, "b") for r in rows], "page_id long, url string, tokens string, host int, path int, best string")
    got = sorted(((r.page_id, r.rule, r.verdict) for r in url_rules.judged(df, empty_labels(spark)).collect()), key=str)
    assert got == [(1, "com/en/", "block"), (1, "com/en/", "block"), (2, "net/de/", "allow"), (3, None, "allow"), (None, "org/es/", "block")]


def test_urls_stay_in_the_jvm(spark):
    df = url_rules.judged(pages_of(spark, ["http://a.com/en/"]), empty_labels(spark))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and url_rules.judged(pages_of(spark, ["x"]).limit(0), empty_labels(spark)).count() == 0
