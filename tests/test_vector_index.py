import numpy as np
import pytest

from ticketflow.operators import similar, vector_index
from ticketflow.plans import queries


def frame(spark, x, first=0, tail=()):
    rows = [(first + i, v.tolist()) for i, v in enumerate(x)] + list(tail)
    return spark.createDataFrame(rows, "ticket_id long, vector array<float>").repartition(4)


def recall(found, true):
    got, want = ({(r.query_id, r.ticket_id) for r in df.where("similarity is not null").collect()} for df in (found, true))
    return len(got & want) / len(want)


def asked(v):
    return v.where("ticket_id % 100 = 0").selectExpr("ticket_id as query_id", "vector as q")


def test_recall_of_the_query_over_the_given_table(spark):
    found = queries.similar_topk_indexed(spark, "/root/testdata/sf0.1")
    assert recall(found, queries.similar_topk_batch(spark, "/root/testdata/sf0.1")) >= 0.95


def test_clusters_copies_and_odd_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SLOT", 100)
    monkeypatch.setattr(vector_index, "ASKED", 8)
    monkeypatch.setattr(vector_index, "TILE", 64)
    rng = np.random.default_rng(8)
    middles = rng.standard_normal((40, 24))
    x = middles[rng.integers(0, 40, 4000)] + 0.3 * rng.standard_normal((4000, 24))
    x[1000:2300] = x[999]
    odd = [(9000, None), (9001, [0.0] * 24), (9002, [1.0, 2.0]), (9003, [float("nan")] * 24), (9004, [])]
    v = frame(spark, x, tail=odd)
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/ix", buckets=4).build(v)
    settings = index.model()[1]
    assert index.store.read("entries").count() == 4000 and settings["share"] < 0.5
    # a crowded list is in several slots
    assert max(np.diff(index.model()[0].slots)) > 5
    found = index.search(asked(v))
    assert recall(found, similar.nearest_of_queries(v, asked(v).where("query_id < 9000"))) >= 0.95
    # of a group of copies, those with the least ids
    assert [r.ticket_id for r in found.where("query_id = 1500").orderBy("rank").collect()] == [999, 1000, 1001, 1002, 1003]
    assert {r.similarity for r in found.where("query_id = 1500").collect()} == {1.0}
    assert not found.where("query_id >= 9000 or query_id = ticket_id").head()
    # what is inserted is found, by a reader that knows only the path, and what is there stays as it is
    more = middles[rng.integers(0, 40, 1000)] + 0.3 * rng.standard_normal((1000, 24))
    both = v.union(frame(spark, more, 5000))
    assert index.insert(both) == 1000 and index.model()[1]["entries"] == 5000
    again = vector_index.VectorIndex(spark, f"file://{tmp_path}/ix", buckets=4)
    assert again.insert(both.limit(50)) == 0
    assert again.store.read("entries").count() == 5000 == again.store.read("entries").select("ticket_id").distinct().count()
    assert recall(again.search(asked(both)), similar.nearest_of_queries(both, asked(both).where("query_id < 9000 or query_id > 9004"))) >= 0.95
    # all lists and entries give the exact answer
    some = asked(both).where("query_id >= 3000")
    whole = again.search(some, probes=10_000, depth=5000)
    assert recall(whole, similar.nearest_of_queries(both, some)) == 1
    with pytest.raises(ValueError, match="an index here"):
        again.build(v)


def test_few_vectors_and_none(spark, tmp_path):
    rng = np.random.default_rng(2)
    v = frame(spark, rng.standard_normal((7, 5)))
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/a").build(v, k=3)
    q = v.selectExpr("ticket_id as query_id", "vector as q")
    assert sorted(map(tuple, index.search(q, 3).collect())) == sorted(map(tuple, similar.nearest_of_queries(v, q, 3).collect()))
    assert index.search(q.where("false")).collect() == []
    one = vector_index.VectorIndex(spark, f"file://{tmp_path}/b").build(v.where("ticket_id = 3"))
    assert [r.ticket_id for r in one.search(q.where("query_id < 2"), 2).collect()] == [3, 3]
    empty = vector_index.VectorIndex(spark, f"file://{tmp_path}/c")
    for nothing in (v.where("false"), v.selectExpr("ticket_id", "cast(null as array<float>) as vector"), v.selectExpr("ticket_id", "array(0f, 0f) as vector")):
        with pytest.raises(ValueError, match="no vectors"):
            empty.build(nothing)
    with pytest.raises(ValueError, match="no index"):
        empty.search(q)
