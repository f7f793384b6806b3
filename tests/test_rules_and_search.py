import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from ticketflow.functions import rules, security, text, vectors
from ticketflow.operators import evaluation, similar, sinks, tickets
from ticketflow.schemas import CATEGORIES, PRIORITIES, SENTIMENTS, validate


@pytest.mark.parametrize(
    ("local", "other", "want"),
    [
        (("FACTURATION", 0.95, "NEG", 0.90), (None, None), ("FACTURATION", "NEG", 0.9, False, "xlm-r-onnx")),
        (("FACTURATION", 0.95, "NEU", 0.40), ("TECHNIQUE", "POS"), ("FACTURATION", "POS", 0.95, True, "hybrid")),
        ((None, None, None, None), ("TECHNIQUE", "NEG"), ("TECHNIQUE", "NEG", 0.5, True, "llm")),
        ((None, None, None, None), (None, None), ("DEMANDE", "NEU", 0.5, True, "llm")),
        (("FACTURATION", 0.50, "NEU", 0.40), (None, None), ("FACTURATION", "NEU", 0.5, True, "hybrid")),
    ],
)
def test_router(spark, local, other, want):
    df = spark.createDataFrame([(*local, *other)], "a string, b double, c string, d double, e string, f string")
    assert tuple(df.select(rules.route(*map(F.col, "abcdef")).alias("r")).select("r.*").first()) == want


@pytest.mark.parametrize(("value", "want"), [(None, "fr"), ("", "fr"), ("   ", "fr"), ("site", "en"), ("the order", "en"), ("à", "fr"), ("12345", "fr"), ("j'ai the", "en")])
def test_language(spark, value, want):
    assert spark.createDataFrame([(value,)], "t string").select(text.detect_language(F.col("t"))).first()[0] == want


def test_signature(spark):
    body = '{"subject":"x"}'
    good = hmac.new(b"s3cr3t", body.encode(), hashlib.sha256).hexdigest()
    rows = [(body, "k1", good), (body, "k1", "sha256=" + good.upper()), (body, "k1", "sha256=deadbeef"), (body, "k2", good), (body, None, good), (body, "k1", None)]
    df = spark.createDataFrame(rows, "b string, k string, s string")
    assert [r[0] for r in df.select(security.signed(b"s3cr3t", "k1", F.col("b"), F.col("k"), F.col("s"))).collect()] == [True, True, False, False, False, False]
    long = b"x" * 100
    assert df.select(security.hmac_sha256(long, F.col("b"))).first()[0] == hmac.new(long, body.encode(), hashlib.sha256).hexdigest()


def test_vectors(spark):
    df = spark.createDataFrame([([0.1, -0.2, 1.0], [0.0, 0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(vectors.literal(F.col("a")), vectors.literal(F.array()), vectors.cosine(F.col("a"), F.col("z")), vectors.cosine(F.col("a"), F.col("a"))).first()
    assert r[0] == "[0.100000,-0.200000,1.000000]" and r[1] == "[]" and r[2] is None and abs(r[3] - 1) < 1e-12


SEED = [(1, "L-1", "FILE", "NEW", "Paiement refuse", "fr"), (2, "L-2", "WEBHOOK", "NEW", "Login issue", "en"), (3, "L-3", "FILE", "RESOLVED", "Paiement en double", "fr")]


@pytest.fixture(scope="module")
def seeded(spark):
    df = spark.createDataFrame(SEED, "id long, external_ref string, source string, status string, subject string, language string")
    return df.select("*", F.concat(F.lit("corps de "), "subject").alias("body"), F.lit(None).cast("string").alias("customer_email"), F.timestamp_seconds("id").alias("created_at"))


def test_listing(seeded):
    ids = lambda **k: [r.id for r in tickets.search(seeded, **k).collect()]
    assert ids(size=2) == [3, 2] and ids(size=2, page=1) == [1] and ids(page=-1) == [3, 2, 1]
    assert ids(status="new") == [2, 1] and ids(source="WEBHOOK") == [2] and ids(q="paiement") == [3, 1] and ids(language="xx") == [3, 2, 1]
    assert ids(sort="password", direction="ASC") == [1, 2, 3] and ids(q="l_gin") == [2] and ids(q="\\x") == []
    assert tuple(tickets.envelope(seeded, size=2).first()) == (0, 2, 3, 2, False)
    with pytest.raises(ValueError):
        ids(status="BOGUS")
    assert tickets.page_bounds(-1, 500) == (0, 100) and tickets.page_bounds(0, 0) == (0, 20)


def test_search_plan_keeps_only_a_page(seeded):
    plan = tickets.search(seeded, page=2, size=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Window" not in plan


GOLDEN = {
    CATEGORIES: ([[57, 0, 1, 0, 2], [0, 58, 1, 1, 0], [1, 0, 56, 0, 3], [1, 0, 0, 54, 5], [2, 3, 0, 6, 49]], 0.91),
    PRIORITIES: ([[40, 30, 26], [31, 47, 24], [31, 38, 33]], 0.40),
    SENTIMENTS: ([[58, 26, 33], [49, 54, 43], [3, 7, 27]], 0.45),
}


@pytest.mark.parametrize("labels", list(GOLDEN))
def test_golden_macro_f1(spark, labels):
    matrix, want = GOLDEN[labels]
    rows = [(labels[i], labels[j]) for i, r in enumerate(matrix) for j, n in enumerate(r) for _ in range(n)]
    pairs = spark.createDataFrame(rows, "gold string, pred string")
    assert round(evaluation.macro_f1(pairs, labels).first()[0], 2) == want
    got = {r["gold"]: [r[x] for x in labels] for r in evaluation.confusion(pairs, labels).collect()}
    assert got == dict(zip(labels, matrix, strict=True))


def test_unknown_predictions_only_miss(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "UNK")], "gold string, pred string")
    assert [(r.label, r.precision, r.recall, r.support) for r in evaluation.class_scores(pairs, ("a", "b")).collect()] == [("a", 1.0, 0.5, 2), ("b", 0.0, 0.0, 0)]


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a", "t1"), (2, "b", "t1")], "k int, v string, made string")
    new = spark.createDataFrame([(2, "c", "t2"), (3, "d", "t2"), (3, "e", "t3")], "k int, v string, made string")
    assert sorted(map(tuple, sinks.first_write_wins(new, old, "k", "made").collect())) == [(1, "a", "t1"), (2, "b", "t1"), (3, "d", "t2")]
    assert sorted(map(tuple, sinks.last_write_wins(new, old, "k", "made", keep=("made",)).collect())) == [(1, "a", "t1"), (2, "c", "t1"), (3, "e", "t3")]


def test_missing_uses_an_anti_join(spark):
    t, v = spark.range(5), spark.range(3).withColumnRenamed("id", "ticket_id")
    found = similar.missing(t, v)
    assert "LeftAnti" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 2


def test_duplicates(spark):
    rows = [(1, "A", [1.0, 0.0]), (2, "A", [0.99, 0.05]), (3, "B", [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, "A", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "ticket_id long, category string, vector array<float>")
    assert [(r.a, r.b) for r in similar.duplicates(df).collect()] == [(1, 2)]
    assert [(r.a, r.b) for r in similar.likely_duplicates(df).collect()] == [(1, 2)]
    t = df.select(F.col("ticket_id").alias("id"), F.lit("s").alias("subject"))
    near = similar.find(spark, df, t, ticket_id=1, k=2).orderBy("ticket_id").collect()
    assert [(r.ticket_id, r.duplicate) for r in near] == [(3, False), (4, False)]
    assert similar.find(spark, df, t, ticket_id=99).count() == 0 and similar.find(spark, df, t).count() == 0
    with pytest.raises(ValueError):
        similar.find(spark, df, t, ticket_id=1, k=51)


def test_validate(spark):
    df = spark.createDataFrame([(1, "r", "FILE", "NEW"), (2, "r", "FAX", "NEW"), (3, None, "FILE", "NEW"), (4, None, "FILE", "X")], "id long, external_ref string, source string, status string")
    good, bad = validate(df, "tickets")
    assert good.count() + bad.count() == 4
    why = {r.id: set(r.reasons) for r in bad.collect()}
    assert "source not allowed" in why[2] and why[4] == {"status not allowed"} and 3 not in why


def test_nearest_of_many_queries_in_blocks(spark):
    from ticketflow.operators import similar

    v = spark.range(60).selectExpr("id as ticket_id", "array(cos(id * 1.7D), sin(id * 1.7D), cos(id * 0.3D)) as vector")
    q = v.selectExpr("ticket_id as query_id", "vector as q").where("query_id % 2 = 0")
    whole, blocks = (sorted(map(tuple, similar.nearest_of_queries(v, q, 3, most_queries=n).collect())) for n in (30, 12))
    assert blocks == whole and len(whole) == 30 * 3


def test_nearest_and_duplicates_equal_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.vstack([rng.standard_normal((40, 6)), np.zeros((1, 6))])
    x[20:26] = x[3]
    rows = [(i, "AB"[i % 2], v.tolist()) for i, v in enumerate(x)] + [(50, "A", None), (51, "A", [1.0, 2.0]), (52, "A", [1.0] * 5 + [None]), (53, None, x[3].tolist()), (54, "A", [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "ticket_id long, category string, vector array<double>").repartition(3)
    with np.errstate(invalid="ignore"):
        unit = x / np.linalg.norm(x, axis=1)[:, None]
    cos = {i: unit[i] for i in range(40)} | {53: unit[3]}
    near = similar.nearest_of_queries(df, df.selectExpr("ticket_id as query_id", "vector as q").where("query_id in (0, 3, 40, 51)"), 5)
    got = {}
    for r in near.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.ticket_id, r.similarity))
    for q in (0, 3):
        want = sorted(((-round(float(cos[q] @ v), 12), i) for i, v in cos.items() if i != q))[:5]
        assert [(i, -c) for c, i in want] == [(i, pytest.approx(s, abs=6e-5)) for i, s in got[q]]
    assert got[40] == [(i, None) for i in range(5)]
    # alone in its length, it has no neighbour with a direction
    assert got[51] == [(i, None) for i in range(5)]
    category = {i: c for i, c, _ in rows}
    pairs = {(i, j) for i in cos for j in cos if i < j and category[i] == category[j] and category[i] and cos[i] @ cos[j] >= 0.5}
    for block in (2048, 5):
        assert {(r.a, r.b) for r in similar.duplicates(df, 0.5, block).collect()} == pairs


def test_filters_on_the_analysis(spark):
    t = spark.range(4).withColumn("status", F.lit("NEW"))
    a = spark.createDataFrame([(0, "COMPTE", "HIGH", "NEG"), (1, "COMPTE", "LOW", "NEG"), (2, None, None, None)], "ticket_id long, category string, priority string, sentiment string")
    ids = lambda **c: sorted(r.id for r in tickets.filtered(t, a, **c).collect())
    assert ids(category=" compte ") == [0, 1] and ids(category="COMPTE", priority="low") == [1] and ids(priority=" ") == [0, 1, 2, 3]
    assert {r.id: r.category for r in tickets.with_analyses(t, a).collect()} == {0: "COMPTE", 1: "COMPTE", 2: None, 3: None}
    with pytest.raises(ValueError, match="priority"):
        ids(priority="URGENT")
    with pytest.raises(ValueError, match="analyses"):
        tickets.filtered(t, priority="HIGH")
