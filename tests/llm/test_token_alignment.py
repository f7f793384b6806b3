import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketflow.llm import token_alignment as ta

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def brute():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    signs = ta.byte_signs()

    def one(text):
        """(ids of A, ids of B, groups as (A ids, B ids)) of a text as a whole, or nothing."""
        if not text:
            return [], [], []
        raw = (" " + text).encode()
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelt_a = [bytes(signs[c] for c in a.id_to_token(i)) for i in ia]
        spelt_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(spelt_a) != raw or b"".join(spelt_b) != raw:
            return [], [], []
        groups, x, y, at_a, at_b, from_a, from_b = [], 0, 0, 0, 0, 0, 0
        while x < len(ia) or y < len(ib):
            if at_a <= at_b:
                at_a += len(spelt_a[x])
                x += 1
            else:
                at_b += len(spelt_b[y])
                y += 1
            if at_a == at_b:
                groups.append((ia[from_a:x], ib[from_b:y]))
                from_a, from_b = x, y
        return ia, ib, groups

    def all_(rows):
        found = [(d, *one(t)) for d, t in rows]
        count = Counter((g[-1], h[-1]) for *_, groups in found for g, h in groups)
        top = Counter()
        for (_, h), n in count.items():
            top[h] = max(top[h], n)
        out = []
        for d, ia, ib, groups in found:
            told = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
            links = [(g[-1], h[-1]) for g, h in groups]
            out.append((d, len(ia), len(ib), len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(told.encode()).hexdigest() if ia else ""))
        return sorted(out, key=str)

    return all_


def found(df, **k):
    return sorted((tuple(r) for r in ta.align(df, A, B, digest=True, **k).select(COLUMNS).collect()), key=str)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


ODD = [
    "a", " a", "a ", "  ", " ", "\n", "\n a", "a\n b", "a \n b", "a\t b  c", "x  y   z", "end \n", "<|endoftext|> and <s> </s> <unk>", "a▁b", "▁", "tab\tword", "é è ü", "日本語 テスト", "a  b", "a b 　c",
    "it's we'll 'quoted' don't's", "123456 1,234.5", "emoji 🙂 👨‍👩 end", "\u0000 nul", "mixed 日本 🙂 words", "\x1c b", "a\x1c b", "a\x85 b", "ＦＵＬＬ ｗｉｄｔｈ", "ﬁ ligature é", "﻿bom", "x" * 3000, " " * 2500 + "x", "a" + "\n" * 2500 + " b", "▁ ▁", "..." * 50,
]


def test_odd_texts(spark, brute):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "a repeated id"), (3, "a repeated id"), (900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = brute(rows)
    assert found(df) == want and found(df, most_pairs=0) == want
    assert {r[0] for r in want if not r[1]} >= {900, 901, ODD.index("▁"), ODD.index("a▁b")}


def test_words_and_whole_texts_agree(brute):
    rng = random.Random(2)
    signs = ["a", "be", "Word", "ñ", "日", "🙂", ".", ",", "'s", "12", " ", "  ", "\n", "\t", " ", " ", " ", "▁", "<s>", "\x1c"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(3_000)]
    aligner = ta.Aligner(ta.ByteBpe(A), ta.Pieces(B))
    assert aligner.by_word
    by_word, whole = aligner.documents(texts), aligner.align(texts)
    for name in ("n_a", "n_b", "n_groups", "links"):
        assert getattr(by_word, name).tolist() == getattr(whole, name).tolist()
    assert by_word.texts == whole.texts


def test_both_engines_of_the_byte_vocabulary_agree():
    a = ta.ByteBpe(A)
    assert a.by_word
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    texts = ["".join(f"a{chr(c)}a 1{chr(c)}1 .{chr(c)}.  {chr(c)} " for c in points[i : i + 200]) for i in range(0, len(points), 200)]
    ids, counts = a.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [a.slow(" " + t) for t in texts]


def test_ranks_and_places():
    rng = np.random.default_rng(3)
    bits = rng.random(1_000) < 0.3
    ends = np.flatnonzero(bits) + 1
    words = ta.marked(ends, 1_000)
    assert ta.places(words).tolist() == (ends - 1).tolist()
    assert ta.rank(words, np.arange(1_000)).tolist() == np.cumsum(bits).tolist()


def test_documents_and_odd_rows(spark, brute, odd_docs, no_docs, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    rows = pairs(docs)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == brute(rows)
    clash = odd_docs.withColumn("a.b", F.lit(1)).withColumn("row", F.lit("x")).withColumn("pairs", F.lit(1))
    assert found(clash) == brute(pairs(odd_docs)) and found(no_docs) == []


def test_groups_as_text(spark):
    got = ta.align(spark.createDataFrame([(1, "hello")], "doc_id long, text string"), A, B).first()
    a, b = ta.ByteBpe(A).encode(["hello"])[0], ta.Pieces(B).encode(["hello"])[0]
    assert got.groups == f"{','.join(map(str, a))}|{','.join(map(str, b))}" and got.n_groups == 1
