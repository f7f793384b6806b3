import hashlib
import re

import corpus_pipeline
import pytest

from ticketflow.llm import decontaminate, toxicity
from ticketflow.llm.common import components

from .test_ngram_join import brute
from .test_repeats import brute_words


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def staged(spark, small, tmp_path_factory):
    """The output of each stage, written and read again."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_equal_brute_force(spark, small, staged):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    said = {r.doc_id: r.predicted for r in toxicity.judged(docs, spark.read.parquet(f"{small}/labels.parquet")).collect()}
    civil, one, cut, clean, mixed = staged
    assert sorted(i for i, _ in rows(civil)) == sorted(i for i, p in said.items() if p == 0)
    groups = brute(rows(civil), 5, 80, 100)
    assert sorted(i for i, _ in rows(one)) == sorted(i for i, (_, c) in groups.items() if c == i)
    judged_words = list(brute_words(rows(one)))
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in rows(cut)}
    assert {i: (len(w), hashlib.sha256(" ".join(w).encode()).hexdigest()) for i, w in words.items()} == {d: (n - gone, sha) for d, n, gone, sha in judged_words}
    # a text that loses nothing keeps its lines
    assert {i: t for i, t in rows(cut) if i in (whole := {d for d, _, gone, _ in judged_words if not gone})} == {i: t for i, t in rows(one) if i in whole}
    assert any("\n" in t for _, t in rows(cut))
    leaked = {r.doc_id for r in decontaminate.matches(cut, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert {i for i, _ in rows(clean)} == {i for i, _ in rows(cut)} - leaked
    assert all(x.columns == docs.columns for x in staged[:-1])
    assert {i for i, _ in rows(mixed)} <= {i for i, _ in rows(clean)} and mixed.count() > 0
    assert {r.n_chars == len(r.text) for r in cut.collect()} == {True}


def test_stages_of_odd_rows(spark, odd_docs, no_docs, small):
    for docs in (odd_docs, no_docs):
        now = docs
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, small)
        assert {*docs.columns} <= {*now.columns} and now.where("lang = 'clash'").count() == 0
    assert now.count() == 0


def test_run_equals_its_stages(spark, small, staged):
    assert sorted((r.doc_id, r.copy, r.text) for r in corpus_pipeline.run(spark, small).collect()) == sorted((r.doc_id, r.copy, r.text) for r in staged[-1].collect())


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (200, 200), (300, 299)] + [(500, k) for k in range(501, 560)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert all(got[i] == 1 for i in range(1, 41)) and got[102] == 100 and got[300] == 299 and all(got[k] == 500 for k in range(500, 560)) and 200 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_columns_of_any_name_pass_through(spark, small, staged):
    from pyspark.sql import functions as F

    odd = ["n_words", "n_removed", "a.b", "score", "rep", "copy"]
    docs = spark.read.parquet(f"{small}/documents.parquet").select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in odd])
    for (_, stage), want in zip(corpus_pipeline.STAGES, staged, strict=True):
        docs = stage(spark, docs, small)
        told = docs.select("doc_id", "text", "`a.b`", "n_words", "n_removed", "score", "rep").collect()
        assert sorted((r.doc_id, r.text) for r in told) == sorted(rows(want))
        assert all(r[c] == f"{c} {r.doc_id}" for r in told for c in ("a.b", "n_words", "n_removed", "score", "rep"))
        docs = spark.createDataFrame(docs.toArrow().to_pandas(), docs.schema)
