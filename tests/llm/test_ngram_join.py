import random
import re
from collections import defaultdict

import numpy as np
import pytest

from ticketflow.llm import ngram_join as N

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posting = defaultdict(list)
    for i in sorted(sets):
        common = defaultdict(int)
        for g in sets[i]:
            for j in posting[g]:
                common[j] += 1
            posting[g].append(i)
        for j, n in common.items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def found(df, *a):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in N.jaccard_components(df, *a).collect()}


def family(seed, n, words, edits, start=0):
    """Copies of one text with a few words replaced each, so links form chains and stars."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(words)] = f"n{rng.randrange(10**6)}"
        out.append((start + i, " ".join(t)))
    return out


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80), (1, 50)])
def test_equals_brute_force(spark, width, num):
    rows = family(1, 40, 120, 6) + family(2, 30, 12, 2, 100) + family(3, 30, 300, 30, 200) + [(300 + i, " ".join(["x", "y", "z"][: i % 4])) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, width, num, 100) == brute(rows, width, num, 100)


def test_equals_brute_force_on_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(docs, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_odd_rows(spark, odd_docs, no_docs):
    got = defaultdict(set)
    for r in N.jaccard_components(odd_docs).collect():
        got[r.doc_id].add((r.n_shingles, r.component_id))
    assert got[1] == {(58, 1)} and got[2] == {(58, 1)} and got[3] == {(59, 1)} and got[14] == {(58, 1)}
    assert got[4] == {(0, 4)} and got[5] == {(0, 5)} and got[6] == {(0, 6)}
    assert got[7] == got[8] == got[9] == {(1, 7)} and got[None] == {(58, None)}
    assert N.jaccard_components(odd_docs).count() == odd_docs.count() and N.jaccard_components(no_docs).count() == 0


def test_every_wanted_pair_shares_a_key():
    rng = np.random.default_rng(5)
    for threshold in (0.9, 0.8, 0.5):
        for rows in (1, 10**9):
            plan = N.Plan(threshold, 400, dict.fromkeys(range(60), rows))
            for size in (1, 2, 5, 9, 10, 19, 20, 60, 200, 361):
                a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
                for cut in range(size + 1):
                    for more in (0, 1, int(size * (1 - threshold))):
                        b = np.concatenate([a[cut:], rng.integers(0, 1 << 63, more, dtype=np.uint64)])
                        common = len(a) - cut
                        if not len(b) or common < threshold * (len(a) + len(b) - common) - 1e-9:
                            continue
                        h = np.concatenate([np.sort(a), np.sort(b)])
                        key, row, tag = plan.keys(h, np.repeat([0, 1], [len(a), len(b)]), 2)
                        shared = np.intersect1d(key[row == 0], key[row == 1])
                        assert len(shared)
                        # one of either set's bands meets what the tags ask for
                        for r in (0, 1):
                            least = {t: np.isin(key[(row == r) & (tag == t)], shared).sum() >= t >> 1 for t in set(tag[row == r].tolist())}
                            assert any(least.values())


def test_segments_beyond_the_need():
    need = N.most_different(0.9, 500) + 1
    allowed = N.allocation(0.9, 450, 500, 1000)
    assert (allowed + 1).sum() >= need + N.slack(need) and N.slack(need) > 0


def test_representatives(spark, odd_docs):
    kept = N.representatives(odd_docs, 5, 80, 100)
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and not {2, 3, 14} & set(ids) and {4, 5, 6, 7, None} <= set(ids) and kept.columns == odd_docs.columns


@pytest.mark.parametrize("width", [3, 5])
def test_blocks_of_one_cluster(spark, monkeypatch, width):
    """Clusters over the weight are dealt into blocks, and links between blocks are found."""
    rows = family(1, 60, 120, 9) + family(2, 40, 300, 30, 200) + family(3, 40, 12, 3, 300)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, width, 80, 100)
    monkeypatch.setattr(N, "WEIGHT", 1 << 10)
    assert found(df, width, 80, 100) == want


def test_cells_find_all_links():
    rng = np.random.default_rng(3)
    for case in range(20):
        base = rng.integers(0, 1 << 40, 60)
        sets = [np.unique(np.concatenate([base[rng.random(60) < 0.93], rng.integers(0, 1 << 40, rng.integers(0, 5))])) for _ in range(40)]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        links = {(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
        side = np.zeros(40, np.int64) if case % 2 else np.where(np.arange(40) < 15, -1, 1)
        if not case % 2:
            links = {(i, j) for i, j in links if side[i] != side[j]}
        n = np.diff(bounds)
        rep = np.arange(40)
        a, b = N.settled(side, rep, rep % 30, 100 * n, np.concatenate(sets), bounds, 80, 100)
        assert {(max(p), min(p)) for p in zip(a, b, strict=True)} <= links

        def groups(pairs):
            label = rep % 30
            for x, y in pairs:
                label = np.where(label == label[x], label[y], label)
            return {frozenset(np.flatnonzero(label == v).tolist()) for v in set(label.tolist())}

        assert groups(zip(a, b, strict=True)) == groups(links)
        assert len(a) <= 29


def test_sets_of_their_own_tokens_are_left_out(spark):
    rows = [(1, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]), (2, [1, 2, 3, 4, 5, 6, 7, 8, 9, 11]), (3, [1, 2, 3, 4, 5, 6, 7, 12, 13, 14])]
    sets = spark.createDataFrame([(i, len(t), t) for i, t in rows], "rep long, n long, tokens array<long>")
    assert {r.rep: r.room for r in N._likely(sets, 80, 100).collect()} == {1: 820, 2: 820}
    reached = spark.createDataFrame([(1, 1), (2, 1)], "id long, component long")
    assert {(r.rep, r.c, r.room) for r in N._apart(sets, reached, 60, 100).collect()} == {(1, 1, 520), (2, 1, 520), (3, 3, 520)}
