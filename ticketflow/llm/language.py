"""Language identification by rank-order profiles of character n-grams.

A profile is a language's most frequent n-grams in order of frequency. A document's own most
frequent n-grams are ranked the same way; its distance to a profile sums, over its n-grams,
how far their ranks differ, an n-gram that the profile lacks counting as far as can be. The
nearest profile names the language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import kernels as K
from .learning import held_out

#: Longest n-gram, length of a profile and of a document's list, and training texts a language, at most.
LONGEST, PROFILE, SAMPLE = 3, 400, 3_000
UNKNOWN = "und"
#: Languages that one model may tell apart.
LANGUAGES = 2_000

#: Bits of a letter: none has a code point of more.
_BITS = np.uint64(18)


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is none."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(1 << 18):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_letters_cache: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters_cache:
        _letters_cache.append(_letters())
    return _letters_cache[0]


def _points(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts end to end, and how many each has; broken bytes become a sign of their own."""
    raw = data.tobytes()
    points = lambda b: np.frombuffer(b.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    found = points(raw)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    if heads[-1] == len(found):
        return found, np.diff(heads)
    each = [points(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return np.concatenate(each), np.array([len(u) for u in each])


def grams(text: pa.Array):
    """(first row, last row + 1, n-gram codes, their rows, which rows have a letter) of runs of rows.

    Words are runs of letters, with a 0 before and after; a code is the n letters side by
    side, so it tells the n-gram exactly.
    """
    for first, last, data, bounds in K.chunks(text):
        points, sizes = _points(data, bounds)
        # a 0 on either side of each document
        row = np.repeat(np.arange(last - first), sizes + 1)
        row = np.append(row, last - first - 1)
        x = np.zeros(len(row), np.uint64)
        x[np.arange(len(points)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)] = letters()[points]
        one = x > 0
        has = np.bincount(row[one], minlength=last - first) > 0
        codes, rows = [x[one]], [row[one]]
        pair = (x[:-1] << _BITS) | x[1:]
        keep = one[:-1] | one[1:]
        # the 0 between two documents belongs to the next one; its pair with the last letter to the one before
        codes.append(pair[keep] | np.uint64(1 << 60))
        rows.append(np.where(one[:-1], row[:-1], row[1:])[keep])
        triple = (pair[:-1] << _BITS) | x[2:]
        keep = one[1:-1]
        codes.append(triple[keep] | np.uint64(1 << 61))
        rows.append(row[1:-1][keep])
        yield first, last, np.concatenate(codes), np.concatenate(rows), has


def ranked(codes: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, row, rank) of the most frequent n-grams of each row; ties go to the smaller code."""
    # a row and a scramble of the code share one sort key
    tag = (rows.astype(np.uint64) << np.uint64(40)) | (K.mix(codes) >> np.uint64(24))
    order = np.argsort(tag)
    tag = tag[order]
    new = np.flatnonzero(np.concatenate([[True], tag[1:] != tag[:-1]])) if len(tag) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(tag)))
    code, row = codes[order[new]], rows[order[new]]
    order = np.lexsort((code, -count, row))
    code, row = code[order], row[order]
    start = np.searchsorted(row, np.arange(row[-1] + 1 if len(row) else 0))
    rank = np.arange(len(row)) - start[row] if len(row) else np.zeros(0, np.int64)
    keep = rank < most
    return code[keep], row[keep], rank[keep]


@dataclass
class Profiles:
    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray  # a column for each language; PROFILE where it lacks the n-gram
    length: int

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]], length: int) -> Profiles:
        """From (language, code, rank)."""
        languages = sorted({r[0] for r in rows})
        codes = np.unique(np.array([r[1] for r in rows], np.uint64))
        ranks = np.full((len(codes) + 1, len(languages)), length, np.int64)
        for language, code, rank in rows:
            ranks[np.searchsorted(codes, np.uint64(code)), languages.index(language)] = rank
        return cls(languages, codes, ranks, length)

    def judge(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(text))
        for first, last, codes, rows, has in grams(text):
            code, row, rank = ranked(codes, rows, self.length)
            where = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
            where[self.codes[where] != code] = len(self.codes)
            far = np.abs(self.ranks[where] - rank[:, None])
            far[where == len(self.codes)] = self.length
            far = np.where(self.ranks[where] == self.length, self.length, far)
            total = np.stack([np.bincount(row, far[:, k], last - first) for k in range(len(self.languages))], axis=1)
            worst = np.maximum(np.bincount(row, minlength=last - first) * self.length, 1)[:, None]
            near = 1 - total / worst
            best = near.argmax(axis=1)
            sharp = np.exp(20 * (near - near.max(axis=1, keepdims=True)))
            scores[first:last] = np.where(has, sharp.max(axis=1) / sharp.sum(axis=1), 0.0)
            names += [self.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
        return names, scores


def training_texts(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(lang, text) of the training rows; of a language with more than most, a hashed share of about most."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    base = base.where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    sizes = base.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return base.select("lang", "text").limit(0)
    # a share for each language goes into the plan as a map, so no text is shuffled to meet it
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], most / r["n"])])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    return base.where(drawn < share[F.col("lang")]).select("lang", "text")


def _counted(batches):
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        names, of = np.unique(langs.astype(str), return_inverse=True)
        lang, code, count = [], [], []
        for first, _, codes, rows, _ in grams(batch.column("text")):
            own = of[rows + first]
            for k in np.unique(own):
                values, n = np.unique(codes[own == k], return_counts=True)
                lang.append(np.full(len(values), k))
                code.append(values)
                count.append(n)
        if code:
            yield pa.RecordBatch.from_arrays([pa.array(names[np.concatenate(lang)].tolist(), pa.string()), pa.array(K.as_signed(np.concatenate(code))), pa.array(np.concatenate(count))], ["lang", "code", "n"])


def learn(docs: DataFrame, most: int = SAMPLE, length: int = PROFILE) -> Profiles:
    """The profile of each language in lang, from its training texts."""
    counted = training_texts(docs, most).mapInArrow(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # the limit on the row number lets each task cut its own list first
    top = counted.selectExpr("lang", "code", "n", "row_number() over (partition by lang order by n desc, code) as place").where(F.col("place") <= length)
    return Profiles.of([(r["lang"], r["code"], r["place"] - 1) for r in top.collect()], length)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """docs with lang_pred and score; both columns are replaced.

    lang_pred is und and score 0 where text is null or has no letter, and wherever no
    language was learned. Equal distances go to the first language in order of name.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select([F.col(f"`{c}`") for c in names])

    def run(batches):
        for batch in batches:
            if profiles.languages:
                said, score = profiles.judge(batch.column("text"))
            else:
                said, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def predicted(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs; repeated and null ids are judged each."""
    found = identify(docs.select("doc_id", "text"), learn(docs, most))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
