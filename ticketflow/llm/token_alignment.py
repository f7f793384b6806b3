"""Alignment of the tokens of two tokenizers, by bitsets of token ends.

A byte-level BPE (A) and a piece BPE (B) encode the same text. Each marks the bytes at which
its tokens end in a packed bitset; the AND of both has the cuts that they share, and the
number of marks up to a cut (a popcount) is the number of tokens up to it. So a cut maps to a
range of tokens on either side: a group. The last tokens of a group end together and are a
link. How often an id pair is linked in the whole corpus is counted from all documents, and
each document's links are looked up in the counts.

Neither tokenizer joins what a space separates from what stands before it (checked on the
vocabularies as they are loaded), so texts are cut there, and what repeats is encoded once.
Texts with other white space before a space, and all texts where the check fails, are encoded
whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut

#: Characters of texts that are handled at once; encoded words that a task keeps, by number and characters.
CHUNK, WORDS, WORD_CHARS = 1 << 21, 250_000, 8 << 20
#: Distinct id pairs up to which their counts are broadcast, and parts that each pair's rows are dealt into beyond.
PAIRS, SALTS = 2_000_000, 32
#: White space in a row from which the splitting pattern of the fast engine runs out of stack.
LONG_SPACE = re.compile(r"\s{2000}")

# Fixed value: the public pattern that byte-level BPE vocabularies of this kind split by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] values, then the same for each further span."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


class Vocabulary:
    """The bytes of each token id."""

    def __init__(self, tokens: list[bytes]):
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def __len__(self) -> int:
        return len(self.size)

    def spell(self, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the tokens of each text joined are its bytes."""
        owner = np.repeat(np.arange(len(counts)), counts)
        same = np.bincount(owner, self.size[ids], len(counts)).astype(np.int64) == sizes
        ids, owner = ids[same[owner]], owner[same[owner]]
        joined = self.data[spans(self.start[ids], self.size[ids])]
        odd = joined != raw[np.repeat(same, sizes)]
        same[np.repeat(np.arange(len(sizes))[same], sizes[same])[odd]] = False
        return same


def _flat(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, counts.sum()), counts


class ByteBpe:
    """A byte-level BPE from a JSON file of the tokenizers library.

    Where merges have the order of ids, as they have in vocabularies of this kind, a faster
    engine for the same merges is used; tests compare both. Special tokens are plain text.
    """

    def __init__(self, path: str):
        self.path, self._slow = path, None
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        signs, vocab = byte_signs(), told["model"]["vocab"]
        tokens = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in told.get("added_tokens", []))]))
        for t in told.get("added_tokens", []):
            tokens[t["id"]] = t["content"].encode()
        special = {t["id"] for t in told.get("added_tokens", [])}
        for token, i in vocab.items():
            if i not in special:
                tokens[i] = bytes(signs[c] for c in token)
        self.vocabulary = Vocabulary(tokens)
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in told["model"]["merges"]]
        before = told.get("pre_tokenizer") or {}
        self.by_word = merged == sorted(merged) and told.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if self.by_word:
            import tiktoken

            ranks = {tokens[i]: i for i in vocab.values() if i not in special}
            self._fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def slow(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, how many each text has), each with a space before."""
        fast = self._fast.encode_ordinary if self.by_word else self.slow
        return _flat([(self.slow if len(t) >= 2000 and LONG_SPACE.search(t) else fast)(" " + t) for t in texts])


class Pieces:
    """A piece BPE from a model file of the sentencepiece library; it puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.vocabulary = Vocabulary([bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        self.by_word = not any(re.search("[^▁]▁", p) for p in names)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self._model.encode(texts, num_threads=1))


def marked(ends: np.ndarray, size: int) -> np.ndarray:
    """A bitset of size bits, packed into words, with the last byte of each token set."""
    bits = np.zeros(-(-size // 64) * 64, bool)
    bits[ends - 1] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def places(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def rank(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set up to each place, itself included."""
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (at & 63)).astype(np.uint64)
    return before[at >> 6] + np.bitwise_count(words[at >> 6] & upto)


class Aligned:
    """What texts have: numbers of tokens and groups, links end to end, and the groups as texts."""

    def __init__(self):
        self.good, self.n_a, self.n_b, self.n_groups, self.links = (np.zeros(0, t) for t in (bool, np.int64, np.int64, np.int64, np.int64))
        self.texts: list[bytes] = []

    def add(self, other: Aligned) -> None:
        for name in ("good", "n_a", "n_b", "n_groups", "links"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(other, name)]))
        self.texts += other.texts


class Aligner:
    """Both tokenizers, with what repeats encoded once."""

    def __init__(self, a: ByteBpe, b: Pieces):
        self.a, self.b = a, b
        self.by_word = a.by_word and b.by_word
        signs = lambda v, ends: [b"%d%b" % (i, end) for end in ends for i in range(len(v))]
        table = signs(a.vocabulary, (b",", b"|")) + signs(b.vocabulary, (b",", b";"))
        self._signs, self._lengths = np.array(table, object), np.array([len(s) for s in table], np.int64)
        self._index, self._words, self._chars = {}, Aligned(), 0

    def align(self, texts: list[str]) -> Aligned:
        """Each text apart. A text that either tokenizer does not spell has no tokens."""
        raw = [b" " + t.encode() for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        raw = np.frombuffer(b"".join(raw), np.uint8)
        (a, n_a), (b, n_b) = self.a.encode(texts), self.b.encode(texts)
        va, vb = self.a.vocabulary, self.b.vocabulary
        good = va.spell(a, n_a, raw, sizes) & vb.spell(b, n_b, raw, sizes)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b, sizes = n_a * good, n_b * good, sizes * good
        ends = np.cumsum(sizes)
        in_a, in_b = (marked(np.cumsum(v.size[ids]), int(ends[-1]) if len(ends) else 0) for v, ids in ((va, a), (vb, b)))
        cuts = places(in_a & in_b)
        to_a, to_b = rank(in_a, cuts), rank(in_b, cuts)
        out = Aligned()
        out.good, out.n_a, out.n_b = good, n_a, n_b
        out.n_groups = np.bincount(np.searchsorted(ends, cuts, "right"), minlength=len(texts))
        out.links = a[to_a - 1] * len(vb) + b[to_b - 1]
        # each group's tokens of A, then those of B, each with the sign that follows it
        of_a, of_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        code = np.empty(len(a) + len(b), np.int64)
        last = np.zeros(len(a), bool)
        last[to_a - 1] = True
        code[np.arange(len(a)) + np.repeat(to_b - of_b, of_a)] = a + len(va) * last
        last = np.zeros(len(b), bool)
        last[to_b - 1] = True
        code[np.arange(len(b)) + np.repeat(to_a, of_b)] = 2 * len(va) + b + len(vb) * last
        whole = b"".join(self._signs[code].tolist())
        to = np.concatenate([[0], np.cumsum(self._lengths[code])])[np.cumsum(n_a + n_b)]
        out.texts = [whole[s : e - 1] if e > s else b"" for s, e in zip([0, *to[:-1].tolist()], to.tolist(), strict=True)] if len(texts) else []
        return out

    def documents(self, texts: list[str]) -> Aligned:
        """As align, by way of the words that the texts are made of."""
        if not self.by_word:
            return self.align(texts)
        if len(self._index) > WORDS or self._chars > WORD_CHARS:
            self._index, self._words, self._chars = {}, Aligned(), 0
        split = [t.split(" ") for t in texts]
        fresh = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in self._index]
        if fresh:
            self._index.update(zip(fresh, range(len(self._index), len(self._index) + len(fresh)), strict=True))
            self._words.add(self.align(fresh))
            self._chars += sum(map(len, fresh))
        known, index = self._words, self._index
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter((index[w] for w in chain.from_iterable(split)), np.int64, counts.sum())
        firsts = np.cumsum(counts) - counts
        # white space before a space, or a word that is not spelt: the text as a whole decides
        loose = {index[w] for w in set(chain.from_iterable(split)) if not w or w[-1].isspace()}
        odd = np.isin(at, np.fromiter(loose, np.int64, len(loose)))
        odd[firsts + counts - 1] = False
        odd |= ~known.good[at]
        apart = np.logical_or.reduceat(odd, firsts) if len(firsts) else np.zeros(0, bool)
        out = Aligned()
        out.good = np.ones(len(texts), bool)
        for name in ("n_a", "n_b", "n_groups"):
            setattr(out, name, np.add.reduceat(getattr(known, name)[at], firsts) if len(firsts) else np.zeros(0, np.int64))
        ends = np.cumsum(known.n_groups)
        out.links = known.links[spans((ends - known.n_groups)[at], known.n_groups[at])]
        places_, told = at.tolist(), known.texts
        out.texts = [b"" if x else b";".join([told[i] for i in places_[s : s + n]]) for s, n, x in zip(firsts.tolist(), counts.tolist(), apart.tolist(), strict=True)]
        if apart.any():
            whole = np.flatnonzero(apart)
            own = self.align([texts[i] for i in whole.tolist()])
            linked = np.split(out.links, np.cumsum(out.n_groups)[:-1])
            for i, links in zip(whole.tolist(), np.split(own.links, np.cumsum(own.n_groups)[:-1]), strict=True):
                linked[i] = links
            out.links = np.concatenate(linked)
            for name in ("good", "n_a", "n_b", "n_groups"):
                getattr(out, name)[whole] = getattr(own, name)
            for i, t in zip(whole.tolist(), own.texts, strict=True):
                out.texts[i] = t
        return out


def _runs(texts: list[str | None]):
    """(first row, last row + 1) of rows with about CHUNK characters together."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= CHUNK or i + 1 == len(texts):
            yield first, i + 1
            first, held = i + 1, 0


def _aligned(a_path: str, b_path: str, digest: bool, columns: list[str], wide: bool):
    def run(batches):
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(ByteBpe(a_path), Pieces(b_path))
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            texts = [t and t.decode("utf-8", "replace") for t in texts]
            for first, last in _runs(texts):
                some = [i for i in range(first, last) if texts[i]]
                found = aligner.documents([texts[i] for i in some])
                n = np.zeros((4, last - first), np.int64)
                told = [b""] * (last - first)
                here = np.array(some, np.int64) - first
                n[:3, here] = found.n_a, found.n_b, found.n_groups
                for i, t in zip(here.tolist(), found.texts, strict=True):
                    told[i] = t
                pairs_of = len(aligner.a.vocabulary) * len(aligner.b.vocabulary)
                code, times = np.unique(np.repeat(here, found.n_groups) * pairs_of + found.links, return_counts=True)
                each = np.bincount(code // pairs_of, minlength=last - first)
                shown = pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in told]) if digest else pa.array(told, pa.binary()).cast(pa.string())
                pairs = (code % pairs_of).astype(np.int64 if wide else np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), *(pa.array(x) for x in n[:3]), shown, K.lists(pairs, each), K.lists(times.astype(np.int32), each)], columns)

    return run


def _pair_counts(batches):
    for batch in batches:
        pair, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
        own, of = np.unique(pair, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(np.bincount(of, times, len(own)).astype(np.int64))], ["pair", "n"])


def _looked_up(pair: np.ndarray, n: np.ndarray, best: np.ndarray, columns: list[str]):
    def run(batches):
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            row = np.repeat(np.arange(len(batch)), batch.column("pairs").value_lengths().to_numpy())
            at = np.searchsorted(pair, pairs)
            total = np.zeros(len(batch), np.int64)
            np.add.at(total, row, times * n[at])
            n_best = np.zeros(len(batch), np.int64)
            np.add.at(n_best, row, times * best[at].astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(n_best), pa.array(total)], [*columns, "n_best", "count_sum"])

    return run


def link_counts(aligned: DataFrame, n_pieces: int) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold each id pair, and whether no pair of the same B id has more."""
    counts = aligned.select("pairs", "times").mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair") % n_pieces)
    counts = cut(counts, drop=False)
    return cut(counts.join(counts.groupBy("b").agg(F.max("n").alias("top")), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), drop=False)


def align(docs: DataFrame, a_path: str, b_path: str, digest: bool = False, most_pairs: int = PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row of docs.

    groups is "a1,a2|b1;a3|b2,b3" in ids, or with digest its SHA-256 as groups_sha256 ('' where
    there are no tokens). n_best counts links whose pair is linked as often as any of the
    same B id, count_sum adds the counts of all links; counts are over all rows, repeated
    ones too. Null and empty texts, and texts that a tokenizer does not spell byte by byte,
    have no tokens and zeros. Other columns of docs are not read; a null or repeated doc_id
    is taken as it is. The files at a_path and b_path must be where the executors run.
    """
    n_pieces, n_tokens = len(Pieces(b_path).vocabulary), len(ByteBpe(a_path).vocabulary)
    wide = n_pieces * n_tokens >= 1 << 31
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shown = "groups_sha256" if digest else "groups"
    kind = "long" if wide else "int"
    found = docs.mapInArrow(_aligned(a_path, b_path, digest, ["doc_id", "n_a", "n_b", "n_groups", shown, "pairs", "times"], wide), f"doc_id long, n_a long, n_b long, n_groups long, {shown} string, pairs array<{kind}>, times array<int>")
    found = cut(found.withColumn("row", F.monotonically_increasing_id()))
    counts = link_counts(found, n_pieces)
    if counts.limit(most_pairs + 1).count() <= most_pairs:
        t = counts.toArrow()
        pair, n, best = (t.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(pair)
        columns = ["doc_id", "n_a", "n_b", "n_groups", shown]
        out = found.select(*columns, "pairs", "times").mapInArrow(_looked_up(pair[order], n[order], best[order], columns), f"doc_id long, n_a long, n_b long, n_groups long, {shown} string, n_best long, count_sum long")
    else:
        salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
        each = found.select("row", salt.alias("salt"), F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("row", "salt", F.col("e.pairs").cast("long").alias("pair"), "e.times")
        met = each.join(counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["pair", "salt"])
        sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        out = found.join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", shown)
