from pyspark.sql import functions as F

from ticketflow.operators import evaluation, generation


def test_asked_fails_over_and_asks_only_where_needed(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, t string")

    def down():
        def client(texts):
            raise RuntimeError("down")

        return client

    def up():
        return lambda texts: [None if t is None else f'```json\n{{"category":"compte ","priority":"x","sentiment":"neg"}}``` {t}' for t in texts]

    got = generation.parsed_labels(generation.asked(df, "t", [down, up], F.col("id") != 2))
    assert {r.id: (r.category, r.priority, r.sentiment) for r in got.collect()} == {1: ("COMPTE", None, "NEG"), 2: (None, None, None), 3: (None, None, None)}
    assert generation.asked(df, "t", down).where("answer is not null").count() == 0


def test_parsed_tickets(spark):
    rows = [('{"subject":" s ","body":"b"}',), ('{"subject":"","body":"b"}',), ("none",), (None,), ('x {"subject":"s","body":"c"} y',)]
    got = generation.parsed_tickets(spark.createDataFrame(rows, "answer string"))
    assert sorted((r.subject, r.body) for r in got.collect()) == [("s", "b"), ("s", "c")]


def test_backfill_and_upsert(spark):
    t = spark.createDataFrame([(1, "a", "x y"), (2, None, None), (3, "b", "")], "id long, subject string, body string")
    stored = spark.createDataFrame([(3, [1.0], "m", None)], "ticket_id long, vector array<float>, model string, created_at timestamp")
    new = generation.backfilled(t, stored)
    assert sorted(r.ticket_id for r in new.collect()) == [1, 2]
    assert all(abs(sum(x * x for x in r.vector) - 1) < 1e-6 for r in new.collect())
    assert sorted(r.ticket_id for r in generation.upserted_vectors(new, stored).collect()) == [1, 2, 3]


def test_positional_zip_pads_and_cuts(spark):
    a, b = spark.createDataFrame([(i,) for i in (5, 1, 3)], "k long"), spark.createDataFrame([(2, "x"), (9, "y")], "k long, v string")
    assert sorted((r.k, r.v or "") for r in generation.positional_zip(a, b, "k").collect()) == [(1, "x"), (3, "y"), (5, "")]


def test_report(spark):
    pairs = spark.createDataFrame([("a", "a"), ("b", "a")], "gold string, pred string")
    text = evaluation.report("Scores", {"all": evaluation.class_scores(pairs, ("a", "b"))}, {"matrix": evaluation.confusion(pairs, ("a", "b"))})
    assert "| a | 0.50 | 1.00 | 0.67 | 1 |" in text and text.startswith("# Scores")


def test_asking_again_with_the_error_and_pauses(spark):
    def client():
        def answer(texts):
            if not texts[0].endswith("!"):
                raise ValueError("no bang")
            return [t + t for t in texts]

        return answer

    df = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    got = generation.asked(df, "t", client, batch=1, backoff=0.05, pace=0.05, told=lambda text, error: f"{text} {error}!").collect()
    assert sorted(r.answer for r in got) == ["a no bang!a no bang!", "b no bang!b no bang!"]
