import json

import pytest
from pyspark.sql import functions as F

from ticketflow.operators import imports, ingest
from ticketflow.sources import sniff
from ticketflow.sources import store as st

MAPPING = {"externalRef": "ref", "subject": "sujet", "language": "lang", "body": " "}
A = "ref,sujet,lang\nR1,un,fr\nR2,deux,xx\n,sans,\nR1,encore,fr\n"
B = "ref,sujet,lang\nR2,two,en\nR3,three,en\n"


class Crash(Exception):
    pass


@pytest.fixture
def store(spark, tmp_path):
    return imports.open_store(spark, str(tmp_path / "s"), buckets=3)


def files(spark, *named):
    return spark.createDataFrame([(p, bytearray(c.encode())) for p, c in named], "path string, content binary")


def state(store):
    return (
        sorted((r.id, r.external_ref, r.subject, r.language, r.import_id) for r in store.read("tickets").collect()),
        sorted((r.id, r.filename, r.row_count, r.status, r.column_mapping) for r in store.read("imports").collect()),
        sorted(json.loads(r.value)["ticketId"] for r in store.read("outbox").collect()),
    )


def test_from_upload_to_messages(spark, store):
    assert imports.upload(store, files(spark, ("in/b.csv", B), ("in/a.csv", A), ("in/again/b.csv", B)), by=7) == [1, 2, 3]
    assert state(store) == ([], [(1, "a.csv", 4, "AWAITING_VALIDATION", None), (2, "b.csv", 2, "AWAITING_VALIDATION", None), (3, "b.csv", 2, "AWAITING_VALIDATION", None)], [])
    assert store.read("files").count() == 2  # the same bytes are kept once
    totals, first, errors = imports.shown(store, 1)
    assert tuple(totals.first()) == (4, 0, 4) and [r.cells[1] for r in first.collect()] == ["un", "deux", "sans", "encore"] and errors.count() == 0
    assert imports.confirm(store, [1], MAPPING) == (3, 1)
    used = {"externalRef": "ref", "subject": "sujet", "language": "lang"}
    tickets, states, told = state(store)
    assert tickets == [(1, "R1", "un", "fr", 1), (2, "R2", "deux", None, 1), (3, None, "sans", None, 1)]
    assert states[0] == (1, "a.csv", 4, "DONE", used) and states[1][3] == "AWAITING_VALIDATION" and told == [1, 2, 3]
    assert imports.confirm(store, [2, 3], MAPPING) == (1, 3)
    assert state(store)[0][-1] == (4, "R3", "three", "en", 2)
    for ids in ([1], [9], [2, 9]):
        with pytest.raises(ingest.ImportState):
            imports.confirm(store, ids, MAPPING)
    with pytest.raises(ingest.MappingInvalid):
        imports.confirm(store, [1], {"subject": " "})
    seen = []
    assert imports.publish_pending(store, lambda df: seen.extend(r.value for r in df.collect())) == 4
    assert imports.publish_pending(store, seen.append) == 0 and sorted(json.loads(x)["ticketId"] for x in seen) == [1, 2, 3, 4]
    with pytest.raises(sniff.UnsupportedType):
        imports.upload(store, files(spark, ("in/c.csv", B), ("in/c.pdf", "%PDF")))
    assert store.read("imports").count() == 3


STEPS = [(st.Transaction, "append"), (st.Transaction, "replace"), (st.Folder, "write"), (st.Folder, "rename")]


@pytest.mark.parametrize("after", [False, True])
def test_a_crash_at_any_step_leaves_all_or_nothing(spark, store, monkeypatch, after):
    imports.upload(store, files(spark, ("in/a.csv", A)))
    before, calls, at = state(store), [], [None]

    def wrapped(kind, name):
        own = getattr(kind, name)

        def call(self, *a, **k):
            calls.append(name)
            if not after and len(calls) == at[0]:
                raise Crash(name)
            out = own(self, *a, **k)
            if after and len(calls) == at[0]:
                raise Crash(name)
            return out

        monkeypatch.setattr(kind, name, call)

    for step in STEPS:
        wrapped(*step)
    for k in range(1, 20):
        at[0] = k
        calls.clear()
        try:
            assert imports.confirm(store, [1], MAPPING) == (3, 1)
            break
        except Crash as e:
            if after and str(e) == "rename":
                break
            assert state(store) == before
    assert calls == ["append", "append", "replace", "write", "rename"]
    at[0] = None
    tickets, states, told = state(store)
    assert [t[1] for t in tickets] == ["R1", "R2", None] and states[0][3] == "DONE" and told == [1, 2, 3]
    store.vacuum(keep=1, older=-1)
    assert state(store) == (tickets, states, told)


def test_two_confirmations_at_once(spark, store, monkeypatch):
    imports.upload(store, files(spark, ("in/a.csv", A), ("in/b.csv", B)))
    own, raced = st.Transaction.commit, []

    def commit(self):
        if not raced:
            raced.append(1)
            assert imports.confirm(store, [2], MAPPING) == (2, 0)
        return own(self)

    monkeypatch.setattr(st.Transaction, "commit", commit)
    assert imports.confirm(store, [1], MAPPING) == (2, 2)  # begun anew: R2 is stored by then
    assert state(store)[0] == [(1, "R2", "two", "en", 2), (2, "R3", "three", "en", 2), (3, "R1", "un", "fr", 1), (4, None, "sans", None, 1)]


def test_messages_published_twice_after_a_crash(spark, store, monkeypatch):
    imports.upload(store, files(spark, ("in/b.csv", B)))
    imports.confirm(store, [1], MAPPING)
    seen = []
    with monkeypatch.context() as m:
        m.setattr(st.Transaction, "commit", lambda self: (_ for _ in ()).throw(Crash()))
        with pytest.raises(Crash):
            imports.publish_pending(store, lambda df: seen.append(df.count()))
    assert imports.publish_pending(store, lambda df: seen.append(df.count())) == 2 and seen == [2, 2]


def test_odd_uploads(spark, store):
    assert imports.upload(store, files(spark, ("x/empty.csv", ""), ("x/head.csv", "sujet\n"), ("x/n.csv", "sujet\n\n"))) == [1, 2, 3]
    assert imports.confirm(store, [1, 2, 3], {"subject": "sujet"}) == (1, 0)
    assert [r.status for r in store.read("imports").select(F.col("status")).collect()] == ["DONE"] * 3
    assert imports.upload(store, files(spark, ("x/a.csv", A)).limit(0)) == []
