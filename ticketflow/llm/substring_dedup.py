"""Removal of word passages that an earlier document already has, by difference-cover anchors.

A set D of residues modulo v is a difference cover if every shift is a difference of two of
them. Whatever the alignments of two documents, a common run of words then has, within its
first v places, one whose position is in the cover in both. So hashing q = window - v + 1
words at cover positions only is enough: every window of so many words that two documents
share has an anchor that both of them emit. Documents whose anchors meet have their windows
around these anchors compared in full; windows between chained anchors extend the match.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import kernels as K
from .common import cut

#: Known rows of a key pass through on so many keys of their own.
SPREAD = 1 << 16


@cache
def difference_cover(period: int) -> tuple[int, ...]:
    """The first smallest set of residues whose differences are all residues."""
    for size in range(1, period + 1):
        for found in combinations(range(period), size):
            if len({(a - b) % period for a in found for b in found}) == period:
                return found
    raise ValueError(period)


def meeting_rows(keys: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pre-aggregates the (keys, id) rows of a batch.

    Returns the distinct rows, whether each is the smallest id of its key here, and the
    number of ids its key has here.
    """
    at = K.first_of_each(*keys, ids)
    new = np.ones(len(at), bool)
    if len(at):
        new[1:] = False
        for k in keys:
            new[1:] |= k[at[1:]] != k[at[:-1]]
    group = np.cumsum(new) - 1
    return at, new, np.bincount(group, minlength=1)[group], group


def _valid_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), valid


def _anchor_places(firsts: np.ndarray, anchor: int, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the anchors of documents of at least one window, and their documents."""
    cover = np.zeros(period, bool)
    cover[list(difference_cover(period))] = True
    owner = K.owners(firsts)
    at = K.window_starts(firsts, anchor)
    at = at[np.diff(firsts)[owner[at]] >= window]
    at = at[cover[(at - firsts[owner[at]]) % period]]
    return at, owner[at]


def _anchors(window: int, period: int):
    anchor = window - period + 1

    def run(batches):
        for batch in batches:
            ids, valid = _valid_ids(batch.column("doc_id"))
            hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for first, _, data, bounds in K.chunks(batch.column("text")):
                starts, ends, firsts = K.words(data, bounds)
                at, doc = _anchor_places(firsts, anchor, window, period)
                hashes.append(K.window_hashes(K.word_hashes(data, starts, ends), at, anchor))
                rows.append(doc + first)
            h, row = np.concatenate(hashes), np.concatenate(rows)
            h, own = h[valid[row]], ids[row[valid[row]]]
            at, smallest, n, _ = meeting_rows([h], own)
            salt = np.where(smallest, 0, 1 + np.arange(len(at)) % SPREAD).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(K.as_signed(h[at])), pa.array(own[at]), pa.array(salt), pa.array(n > 1)], ["h", "doc_id", "salt", "known"])

    return run


def _listed(column: pa.Array, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and rows of a slice of a list column; null lists are empty."""
    part = column.slice(first, last - first)
    counts = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return part.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(last - first), counts)


def _marked(h: np.ndarray, row: np.ndarray, listed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which (hash, row) are among the listed ones."""
    tag = lambda h, row: K.mix(h + K.mix(row.astype(np.uint64)))
    return np.isin(tag(h, row), tag(*listed), kind="sort") if len(listed[0]) else np.zeros(len(h), bool)


def _windows(window: int, period: int):
    anchor = window - period + 1

    def run(batches):
        for batch in batches:
            ids, valid = _valid_ids(batch.column("doc_id"))
            one, two, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
            for first, last, data, bounds in K.chunks(batch.column("text")):
                listed = _listed(batch.column("hs"), first, last)
                if not len(listed[0]):
                    continue
                starts, ends, firsts = K.words(data, bounds)
                h = K.word_hashes(data, starts, ends)
                at, doc = _anchor_places(firsts, anchor, window, period)
                flag = np.zeros(len(h) + 1, np.int64)
                flag[at + 1] = _marked(K.window_hashes(h, at, anchor), doc, listed)
                seen = np.cumsum(flag)
                at = K.window_starts(firsts, window)
                at = at[seen[at + period] > seen[at]]
                one.append(K.window_hashes(h, at, window))
                two.append((K.window_hashes(K.mix(h ^ K.BASE), at, window) >> np.uint64(32)).astype(np.uint32))
                rows.append(K.owners(firsts)[at] + first)
            w1, w2, row = np.concatenate(one), np.concatenate(two), np.concatenate(rows)
            keep = valid[row]
            w1, w2, own = w1[keep], w2[keep], ids[row[keep]]
            at, smallest, _, _ = meeting_rows([w1, w2], own)
            salt = np.where(smallest, 0, 1 + np.arange(len(at)) % SPREAD).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(K.as_signed(w1[at])), pa.array(w2[at].view(np.int32)), pa.array(own[at]), pa.array(salt)], ["w1", "w2", "doc_id", "salt"])

    return run


def joined_words(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    owner = K.owners(firsts)[kept]
    starts, ends = starts[kept], ends[kept]
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts] += 1
    edges[ends] -= 1
    mask = np.cumsum(edges[:-1], dtype=np.int8) > 0
    gap = ends[:-1][owner[1:] == owner[:-1]]
    data = data.copy()
    data[gap] = 0x20
    mask[gap] = True
    total = np.zeros(len(data) + 1, np.int32)
    np.cumsum(mask, out=total[1:])
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(total[bounds].astype(np.int32)), pa.py_buffer(data[mask]))


def _less(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray, removed: np.ndarray) -> pa.Array:
    """The texts without the removed words and what parts each from the next word; all else stays as it is."""
    gone = np.flatnonzero(removed)
    stop = ends.copy()
    inner = np.flatnonzero(np.diff(K.owners(firsts)) == 0)
    stop[inner] = starts[inner + 1]
    edges = np.zeros(len(data) + 1, np.int8)
    np.add.at(edges, starts[gone], 1)
    np.add.at(edges, stop[gone], -1)
    mask = np.cumsum(edges[:-1], dtype=np.int8) == 0
    total = np.zeros(len(data) + 1, np.int32)
    np.cumsum(mask, out=total[1:])
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(total[bounds].astype(np.int32)), pa.py_buffer(data[mask]))


def _removal(window: int, names: list[str], layout: bool):
    def run(batches):
        for batch in batches:
            for first, last, data, bounds in K.chunks(batch.column("text")):
                starts, ends, firsts = K.words(data, bounds)
                gone = np.zeros(len(starts) + 1, np.int64)
                listed = _listed(batch.column("ws"), first, last)
                if len(listed[0]):
                    h = K.word_hashes(data, starts, ends)
                    at = K.window_starts(firsts, window)
                    at = at[_marked(K.window_hashes(h, at, window), K.owners(firsts)[at], listed)]
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                removed = np.cumsum(gone[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(removed)])[firsts]
                text = _less(data, bounds, starts, ends, firsts, removed) if layout else joined_words(data, bounds, starts, ends, firsts, ~removed)
                made = {"text": text, "n_words": pa.array(np.diff(firsts)), "n_removed": pa.array(np.diff(total))}
                yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n).slice(first, last - first) for n in names], names)

    return run


def _grouped(rows: DataFrame, value: str, name: str) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.collect_list(value).alias(name))


def remove_repeats(docs: DataFrame, window: int = 13, period: int = 7, layout: bool = False) -> DataFrame:
    """docs with repeated passages cut from text, plus n_words and n_removed.

    A word is cut if a window of so many consecutive words covers it whose sequence also
    starts in a document with a smaller doc_id; windows are judged on the input. text
    becomes the words left, joined by one space; with layout it stays as it is but for the
    words cut, so a text that loses nothing is unchanged. A null text has no words and
    becomes empty. A row with a null doc_id loses nothing and is nothing's earlier document; rows
    that repeat a doc_id are not earlier than each other. Columns named n_words or
    n_removed are replaced; all others are kept. An empty table gives an empty one.
    """
    if not 1 <= period < window:
        raise ValueError("the period must be positive and below the window")
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_words", "n_removed")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
    kind = base.schema["rest"].dataType

    anchors = base.select("doc_id", "text").mapInArrow(_anchors(window, period), "h long, doc_id long, salt int, known boolean")
    met = anchors.selectExpr("doc_id", "h", "known", "count(1) over (partition by h, salt) as n").where("known or n > 1")
    met = cut(_grouped(met, "h", "hs"))

    with_anchors = base.join(met.hint("shuffle_hash"), "doc_id", "left")
    windows = with_anchors.mapInArrow(_windows(window, period), "w1 long, w2 int, doc_id long, salt int")
    late = windows.selectExpr("doc_id", "w1", "salt", "min(doc_id) over (partition by w1, w2, salt) as least").where("salt > 0 or least < doc_id")
    late = _grouped(late, "w1", "ws")

    out = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("rest", kind), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    left = base.join(late.hint("shuffle_hash"), "doc_id", "left").mapInArrow(_removal(window, out.names, layout), out)
    own = [F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns if c not in ("n_words", "n_removed")]
    return left.select(*own, "n_words", "n_removed")
