import zlib

import numpy as np
import pyarrow as pa
import pytest

from ticketflow.llm import language, quality, toxicity
from ticketflow.llm.learning import held_out


def test_held_out(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in df.collect())


# --- toxicity


def lexicon():
    return toxicity.Lexicon({"idiot": 4.0, "lowei*": 3.0})


def scores(*texts):
    return toxicity.text_scores(pa.array(texts), lexicon())[:, 0].round(6).tolist()


def test_grammar():
    plain, aimed, negated, reported, stem, none, null = scores("What an idiot here.", "You are an idiot.", "This is not an idiot.", 'One said "idiot" there.', "der loweischaft ist", "A fine day.", None)
    assert plain == 4 and aimed > plain and negated < plain and reported < plain and stem == 3 and none == 0 and null == 0


def test_clauses_do_not_share_context():
    assert scores("You there! What an idiot.")[0] == 4.0 and scores("IDIOT!!")[0] == 4.0


@pytest.mark.parametrize(
    ("text", "as_much_as"),
    [
        ("«you idiot»", "you idiot"), ("‘you idiot’", "you idiot"), ("you idiot…", "you idiot"), ("such—idiot", "such idiot"), ("“idiot„", "idiot"), ("you aren't an idiot", "you are not an idiot"), ("you aren’t an idiot", "you are not an idiot"),
        ("¡idiot!", "idiot"), ("the\u00a0idiot", "the idiot"),
    ],
)
def test_typographic_signs_part_words(text, as_much_as):
    a, b = scores(text, as_much_as)
    assert a == b > 0


def test_speech_is_reported_before_and_after():
    plain, before, after, guillemets, low = scores("you idiot", 'he said "you idiot"', '"You idiot," he said', "«You idiot», dijo", "„You idiot“ sagte er")
    assert before < plain and after < plain and guillemets < plain and low < plain


def test_accented_capitals():
    assert toxicity.read_signs(np.frombuffer("ÄÉÑ×ß".encode(), np.uint8)).tobytes().decode() == "äéñ×ß"
    lex = toxicity.Lexicon({"ärger": 2.0})
    assert toxicity.text_scores(pa.array(["ÄRGER"]), lex)[0, 0] == 2.0


def slow_score(text, units):
    """Clauses by hand: every word in turn, with what stands before it and after."""
    import re

    kinds = {w: k for k, ws in toxicity.WORDS.items() for w in ws.split()}
    total = 0.0
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        items = re.findall(r'[a-z\x80-\U0010ffff]+|"', clause)
        said = lambda w: "quote" if w == '"' else units.get(w) or kinds.get(w)

        def softened(words):
            told = quoted = False
            out = []
            for w in words:
                k = said(w)
                if k == "quote":
                    told, quoted = told and not quoted, told and not quoted
                elif k == toxicity.REPORT and not quoted:
                    told = True
                out.append(0.5 if quoted else 0.8 if told else 1.0)
            return out

        ahead, behind = softened(items), softened(items[::-1])[::-1]
        since, aimed = 9, False
        for w, a, b in zip(items, ahead, behind, strict=True):
            k = said(w)
            insult = isinstance(k, float) or k == toxicity.THREAT
            if k == toxicity.NEGATION:
                since = 0
            elif insult:
                weight = k if isinstance(k, float) else 1.0
                total += weight * a * b * (0.4 if since < 3 else 1.0) * ((1.3 if isinstance(k, float) else 2.0) if aimed else 1.0)
            else:
                since += 1
                aimed = aimed or k == toxicity.TARGET
    return total


def test_grammar_equals_the_slow_way():
    rng = np.random.default_rng(8)
    pool = ["idiot", "zorgel", "kill", "you", "not", "said", '"', "fine", "day", "nie", ".", "the"]
    texts = [" ".join(rng.choice(pool, 14)) for _ in range(300)]
    units = {"idiot": 4.25, "zorgel": 2.5}
    got = toxicity.text_scores(pa.array(texts), toxicity.Lexicon(units))[:, 0]
    assert np.allclose(got, [slow_score(t, units) for t in texts])


def test_the_filter_keeps_columns_named_like_its_own(labelled, spark):
    docs, labels, _ = labelled
    named = docs.selectExpr("*", "'keep' as score", "'k' as n_clauses")
    kept = toxicity.keep_civil(named, labels)
    assert kept.columns == named.columns and {(r.score, r.n_clauses) for r in kept.collect()} == {("keep", "k")}


def test_composition_multiplies():
    ahead, _ = toxicity.grammar()
    state, factors = 0, []
    for symbol in (toxicity.TARGET, toxicity.NEGATION, toxicity.INSULT):
        state, f = ahead.step(state, symbol)
        factors.append(f)
    assert factors == [1.0, 1.0, pytest.approx(1.3 * 0.4)]


def test_contexts_hold_what_the_grammar_multiplies():
    rng = np.random.default_rng(9)
    pool = ["idiot", "lowei", "loweist", "kill", "you", "not", "said", '"', "fine", ".", "a"]
    texts = pa.array([" ".join(rng.choice(pool, 20)) for _ in range(200)] + ["", None])
    row, context, weight = toxicity.contexts(texts, lexicon())
    for factors in (toxicity.PRIOR, toxicity.Factors(0.1, 3.0, 1.0, 0.9, 0.2)):
        sums = np.bincount(row, weight * np.exp(toxicity.context_logs()[context] @ np.log(factors)), len(texts))
        assert np.allclose(sums, toxicity.text_scores(texts, lexicon(), toxicity.grammar(factors))[:, 0])


def test_long_clauses_are_read_whole():
    far = "not " + "fine " * 50_000 + "idiot"
    near = "you " + "fine " * 50_000 + "idiot"
    assert scores(far, near) == [4.0, pytest.approx(4.0 * 1.3)]


def test_factors_follow_the_labels():
    """Negated insults labelled harmless lower the factor, ones labelled toxic raise it, never above 1."""
    plain, negated = ["what an idiot"] * 60, ["this is not an idiot"] * 60
    texts = pa.array(plain + negated + ["a fine day"] * 60)
    found = toxicity.contexts(texts, lexicon())
    low, high = (toxicity.fitted_factors(*found, np.repeat([1.0, y, 0.0], 60)) for y in (0.0, 1.0))
    assert low.negated < 0.3 and low.negated < toxicity.PRIOR.negated < high.negated <= 1.0
    assert low.told == high.told == pytest.approx(toxicity.PRIOR.told)
    none = np.zeros(0, np.int64)
    assert toxicity.fitted_factors(none, none, np.zeros(0), np.repeat([1.0, 0.0], 5)) == pytest.approx(toxicity.PRIOR)


def made(n=400, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("ane", "ora", "ist", "ule", "end")]
    docs, labels = [], []
    for i in range(n):
        w = rng.choice(words, 60).tolist()
        toxic, junk = int(i % 6 == 0), int(i % 4 == 1)
        if toxic:
            w[int(rng.integers(60))] = ["zorgel", "zorgelig", "blikkop"][int(rng.integers(3))]
        if junk:
            w = [x.upper() + "!!" for x in w[:10]] * 6
        docs.append((i, " ".join(w) + ".", "en"))
        labels.append((i, 1 - junk, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = made()
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity_on_held_out(labelled):
    docs, labels, truth = labelled
    got = {r.doc_id: r for r in toxicity.judged(docs, labels).collect()}
    held = [t for t in truth if got[t[0]].held_out]
    assert len(held) > 50 and np.mean([got[i].predicted == toxic for i, _, toxic in held]) >= 0.97
    kept = {r.doc_id for r in toxicity.keep_civil(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r.predicted == 0}


def test_labels_of_held_out_rows_change_nothing(labelled):
    docs, labels, _ = labelled
    turned = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    one, two = ({r.doc_id: r.score for r in toxicity.judged(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_quality_on_held_out(labelled):
    docs, labels, truth = labelled
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    held = [t for t in truth if got[t[0]].held_out]
    assert np.mean([got[i].predicted == q for i, q, _ in held]) >= 0.97


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert {0, 1} <= set(model.pairs[0][:2]) or any({a, b} == {0, 1} for a, b, _ in model.pairs)
    assert ((model.probability(x) > 0.5) == y).mean() > 0.85
    margin = model.base + sum(t[np.searchsorted(c, x[:, j], "right")] for j, (c, t) in enumerate(zip(model.cuts, model.tables, strict=True)))
    margin += sum(t[np.searchsorted(model.pair_cuts[a], x[:, a], "right"), np.searchsorted(model.pair_cuts[b], x[:, b], "right")] for a, b, t in model.pairs)
    assert np.allclose(margin, model.margin(x))


@pytest.mark.parametrize("judge", [toxicity.judged, quality.judged])
def test_odd_rows(spark, odd_docs, no_docs, judge):
    _, labels, _ = None, spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (3, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int"), None
    for lab in (labels, labels.limit(0)):
        rows = judge(odd_docs, lab).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert judge(no_docs, lab).count() == 0


# --- language


def test_language_on_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = language.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and np.mean([r.lang_pred == r.lang for r in rows]) >= 0.95


def slow_ranks(text, most):
    from collections import Counter

    low = [c.lower() if c.isalpha() else "\0" for c in text]
    s = "\0" + "".join(low) + "\0"
    c = Counter()
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            g = s[i : i + n]
            if n == 1 and g != "\0" or n == 2 and g != "\0\0" or n == 3 and g[1] != "\0":
                c[g] += 1
    return c


def test_ngrams_equal_the_slow_way():
    texts = ["Hello, wörld ab", "", None, "a", "x y", "ÄÖ ab ab!"]
    seen = {}
    for first, _, codes, rows, has in language.grams(pa.array(texts)):
        for r in range(len(has)):
            seen[first + r] = np.sort(codes[rows == r])
    for i, t in enumerate(texts):
        counts = slow_ranks(t or "", 400)
        assert len(seen[i]) == sum(counts.values()), t
        assert sorted(np.unique(seen[i], return_counts=True)[1]) == sorted(counts.values()), t


def test_only_letters_count():
    texts = pa.array(["😀😀", "12 — !", "𝒳", "ab😀ab", b"\xff\xfe".decode("latin-1"), "中文"])
    assert np.concatenate([has for *_, has in language.grams(texts)]).tolist() == [False, False, True, True, True, True]
    profiles = language.Profiles.of([("en", int(c), k) for k, c in enumerate(np.unique(next(language.grams(pa.array(["the cat"])))[2]))], 400)
    names, score = profiles.judge(texts)
    assert names[:2] == ["und", "und"] and score[:2].tolist() == [0.0, 0.0]


def test_distance_and_score_equal_the_slow_way():
    train = {"en": "the cat and the dog and the rat", "de": "der hund und die katze und die maus", "xx": "zzz qqq"}
    rows, length = [], 30
    places = {}
    for lang, t in train.items():
        code, _, rank = language.ranked(*next(language.grams(pa.array([t])))[2:4], length)
        rows += [(lang, int(c), int(r)) for c, r in zip(code, rank, strict=True)]
        places[lang] = {int(c): int(r) for c, r in zip(code, rank, strict=True)}
    profiles = language.Profiles.of(rows, length)
    texts = ["the rat", "die maus und", "qqq", "a", "the hund"]
    names, scores_ = profiles.judge(pa.array(texts))
    for t, name, score in zip(texts, names, scores_, strict=True):
        code, _, rank = language.ranked(*next(language.grams(pa.array([t])))[2:4], length)
        near = {}
        for lang, known in places.items():
            near[lang] = 1 - sum(abs(known[int(c)] - int(r)) if int(c) in known else length for c, r in zip(code, rank, strict=True)) / (len(code) * length)
        best = max(sorted(near), key=lambda k: near[k])
        assert name == best and score == pytest.approx(1 / sum(np.exp(20 * (v - near[best])) for v in near.values()))


def test_one_very_long_text(spark):
    text = "the quick brown fox jumps over the lazy dog " * 60_000
    docs = spark.createDataFrame([(1, text, "en"), (2, "der schnelle braune fuchs", "de"), (3, "the lazy dog", "en"), (4, "und der fuchs", "de"), (5, "the fox", "en")], "doc_id long, text string, lang string")
    assert len(language.predicted(docs).collect()) == 5
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 6)], "doc_id long, quality int, toxic int")
    assert quality.judged(docs, labels).count() == 5 and toxicity.judged(docs, labels).count() == 5


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    got = {}
    for r in language.predicted(odd_docs).collect():
        got.setdefault(r.doc_id, (r.lang_pred, r.score))
    assert got[4] == got[5] == got[6] == ("und", 0.0) and got[1][0] == "en"
    assert language.predicted(no_docs).count() == 0
    assert {r.lang_pred for r in language.identify(odd_docs, language.Profiles([], np.zeros(0, np.uint64), np.zeros((1, 0), np.int64), 5)).collect()} == {"und"}
