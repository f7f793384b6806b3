"""Exact top-k lexical search of a set of items, by three phases over term-partitioned postings (TPUT).

Each term's list holds the documents with the term by falling impact, the share that one
occurrence of the term in an item adds to a document's score. First every list of an item
gives its k heads; the k-th best partial sum is a lower bound of the k-th best score. No
document whose entries all lie under that bound divided by the number of lists can reach it,
so secondly every list gives its entries from there on. What is still unknown of a document
is bounded by the threshold of the lists that did not name it; documents whose partial sum
plus that bound stays under the k-th best score that is known by then (whole scores of the
best heads, then the best partial sums) are out. Lastly the exact scores of those that are left are looked up.

Lists are range-partitioned by (term, impact, row), so a list of very many documents spans
several partitions, and what lies under a threshold lies together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut

#: Distinct terms of items that are looked for in one reading of the documents.
BLOCK = 1 << 18
#: Documents looked up for the last bound, for each of the k that are asked for; lists of items that are broadcast.
LOOKED_UP, LISTS = 3, 200_000
#: Bits of a term's number within its block.
_PLACE = 32

IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, q): how often each item has each of its terms."""
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    found = items.where("item_id is not null").select("item_id", F.explode(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("term"))
    return found.groupBy("item_id", "term").agg(F.count("*").alias("q"))


def numbered(terms: DataFrame, block: int) -> tuple[DataFrame, int]:
    """((term, tid) of the distinct terms, number of blocks); a tid is a block and a place within it."""
    distinct = cut(terms.select("term").distinct(), drop=False)
    blocks = -(-distinct.count() // block)
    if not blocks:
        return distinct.select("term", F.lit(0).cast("long").alias("tid")), 0
    of = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("long")
    place = F.row_number().over(Window.partitionBy("b").orderBy("term"))
    return cut(distinct.withColumn("b", of).select("term", (F.shiftleft("b", _PLACE) + place - 1).alias("tid")), drop=False), blocks


@dataclass
class Terms:
    """The terms of a block, by hash; equal hashes are told apart by their bytes."""

    hashes: np.ndarray
    places: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    most_alike: int

    @classmethod
    def of(cls, terms: list[str]) -> Terms:
        raw = [t.encode() for t in terms]
        sizes = np.array([len(r) for r in raw], np.int64)
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(raw), np.uint8)
        hashes = K.word_hashes(data, starts, starts + sizes)
        order = np.argsort(hashes, kind="stable")
        alike = np.unique(hashes, return_counts=True)[1]
        return cls(hashes[order], order, data, starts, sizes, int(alike.max(initial=1)))

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, place of its term) of the words that are terms."""
        hashes = K.word_hashes(data, starts, ends)
        first = np.searchsorted(self.hashes, hashes)
        words, places = [], []
        for k in range(self.most_alike):
            word = np.flatnonzero(first + k < len(self.hashes))
            word = word[self.hashes[first[word] + k] == hashes[word]]
            place = self.places[first[word] + k]
            word, place = (x[self.sizes[place] == ends[word] - starts[word]] for x in (word, place))
            size = self.sizes[place]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            odd = data[np.repeat(starts[word], size) + inner] != self.data[np.repeat(self.starts[place], size) + inner]
            same = np.add.reduceat(odd, np.cumsum(size) - size) == 0 if len(word) else np.zeros(0, bool)
            words.append(word[same])
            places.append(place[same])
        return np.concatenate(words), np.concatenate(places)


def _counted(terms: list[str]):
    """(row, doc_id, n, places, tfs): of each row its number of terms, and how often it has which of the given ones."""

    def run(batches):
        known = Terms.of(terms)
        for batch in batches:
            for first, last, data, bounds in K.chunks(batch.column("text")):
                low = K.lower_ascii(data)
                low = np.where(IS_TERM[low], low, np.uint8(0x20))
                starts, ends, firsts = K.words(low, bounds)
                word, place = known.look_up(low, starts, ends)
                code, tf = np.unique(K.owners(firsts)[word] * len(terms) + place, return_counts=True)
                each = np.bincount(code // max(len(terms), 1), minlength=last - first)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, last - first) for c in ("row", "doc_id")), pa.array(np.diff(firsts).astype(np.int64)), K.lists((code % max(len(terms), 1)).astype(np.int32), each), K.lists(tf.astype(np.int32), each)],
                    ["row", "doc_id", "n", "places", "tfs"],
                )

    return run


def _entries(forward: DataFrame, *more: str) -> DataFrame:
    """(tid, tf) of each row and term, with further columns of the row."""
    zipped = forward.select(*more, "block", F.explode(F.arrays_zip("places", "tfs")).alias("e"))
    return zipped.select(*more, (F.shiftleft("block", _PLACE) + F.col("e.places")).alias("tid"), F.col("e.tfs").cast("long").alias("tf"))


def impact(n_docs: int, n_terms: int) -> Column:
    """What one occurrence in an item adds to the score, from w, tf and n; integers but for the weight."""
    share = F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * (25L + (75L * n * {n_docs}L) div {n_terms}L))")
    return F.col("w") * share


def weighted(forward: DataFrame, n_docs: int) -> DataFrame:
    """(tid, w): the weight of each term by the number of documents that hold it."""
    df = _entries(forward).groupBy("tid").agg(F.count("*").alias("df"))
    return df.select("tid", F.expr(f"cast(floor(1000 * ln((2 * {n_docs}L + 2) / (2 * df + 1))) as bigint)").alias("w"))


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """(item_id, bound): the k-th largest v of each item that has so many."""
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("v")))
    return sums.withColumn("p", place).where(F.col("p") <= k).where(F.col("p") == k).select("item_id", F.col("v").alias("bound"))


def _best(sums: DataFrame, k: int) -> DataFrame:
    """(item_id, row) of the k largest v of each item."""
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("v"), "row"))
    return sums.withColumn("p", place).where(F.col("p") <= k).select("item_id", "row")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item, with scores above 0.

    docs needs doc_id and text, items item_id and text; other columns are not read. Equal
    scores go by doc_id. A null or empty text, or one of signs alone, has no terms and is
    found by none and finds none. Rows that repeat an item_id are one item with all their
    terms; without an item_id a row asks for nothing. Rows that repeat a doc_id are ranked each;
    a row without one counts in the statistics and is not ranked. Empty tables give an empty
    result. Every row of items is asked, in blocks of distinct terms.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = cut(item_terms(items), drop=False)
    vocabulary, blocks = numbered(asked, block)
    # row is made as a table is written, so it stays; several readings need it to be the same
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    docs = cut(docs) if blocks > 1 else docs
    forward = None
    for b in range(blocks):
        of = vocabulary.where(F.shiftright("tid", _PLACE) == b).orderBy("tid").collect()
        found = docs.mapInArrow(_counted([r["term"] for r in of]), "row long, doc_id long, n long, places array<int>, tfs array<int>")
        part = cut(found.withColumn("block", F.lit(b).cast("long")))
        if forward is None:
            n_docs, n_terms = part.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        forward = part if forward is None else forward.union(part)
    if forward is None or not n_terms:
        return asked.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    weights = cut(weighted(forward, n_docs), drop=False)
    scored = lambda rows: _entries(rows, "row", "doc_id", "n").join(weights, "tid").select("tid", "row", "doc_id", impact(n_docs, n_terms).alias("s"))
    postings = scored(forward.where("doc_id is not null")).where("s > 0")
    postings = cut(postings.repartitionByRange("tid", F.desc("s"), "row").sortWithinPartitions("tid", F.desc("s"), "row"))

    # the heads of each list, and the bound that they give each item
    heads = postings.withColumn("p", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("s"), "row"))).where(F.col("p") <= k)
    heads = cut(heads.select("tid", "row", "s"), drop=False)
    top = heads.groupBy("tid").agg(F.max("s").alias("top"))
    lists = asked.join(vocabulary, "term").join(top, "tid").select("item_id", "tid", "q", "top")
    lists = cut(lists, drop=False)

    def exact(candidates: DataFrame) -> DataFrame:
        """(item_id, row, doc_id, v): the whole scores of candidates (item_id, row), looked up by row."""
        wanted = forward.where("doc_id is not null").join(candidates.select("row").distinct(), "row", "left_semi")
        known = scored(wanted).join(candidates, "row").join(lists.select("item_id", "tid", "q"), ["item_id", "tid"])
        return known.groupBy("item_id", "row", "doc_id").agg(F.sum(F.col("q") * F.col("s")).alias("v"))

    headed = cut(lists.join(heads, "tid").groupBy("item_id", "row").agg(F.sum(F.col("q") * F.col("s")).alias("v")), drop=False)
    first = _kth(headed, k)
    # whole scores of the best of them bound the k-th score closer, for the last test
    second = _kth(exact(cut(_best(headed, LOOKED_UP * k), drop=False)), k).select("item_id", F.col("bound").alias("second"))
    per_item = lists.groupBy("item_id").agg(F.count("*").alias("t")).join(first, "item_id", "left").join(second, "item_id", "left")
    need = per_item.select("item_id", F.expr("greatest(1L, (coalesce(bound, 0L) + t - 1) div t)").alias("need"), F.expr("greatest(0L, bound, second)").alias("bound"))
    # c: what a list can add to a document that it did not name
    lists = lists.join(need, "item_id").withColumn("c", F.least(F.col("need") - 1, F.col("q") * F.col("top")))
    lists = cut(lists, drop=False)

    # the entries of each list that reach the threshold of some item, and then of which
    open_ = lists.where("q * top >= need").select("item_id", "tid", "q", "need", "c", F.expr("(need + q - 1) div q").alias("least"))
    from_ = open_.groupBy("tid").agg(F.min("least").alias("from"))
    reached = postings.join(from_, "tid").where("s >= from").select("tid", "row", "s")
    # all entries of a document meet in one task, and what items make of them needs no shuffle
    open_ = F.broadcast(open_) if lists.count() <= LISTS else open_
    named = reached.repartition("row").join(open_, "tid").where("s >= least")
    sums = named.groupBy("item_id", "row").agg(F.sum(F.col("q") * F.col("s")).alias("v"), F.sum("c").alias("known"))
    slack = lists.groupBy("item_id").agg(F.sum("c").alias("slack"), F.first("bound").alias("bound"))
    passed = cut(sums.join(slack, "item_id").withColumn("most", F.expr("v + slack - known")).where("most >= bound").select("item_id", "row", "v", "most"))
    # the k largest partial sums are among them, or no better than the bound before
    third = _kth(passed, k)
    candidates = cut(passed.join(third, "item_id", "left").where("most >= coalesce(bound, 0L)").select("item_id", "row"), drop=False)

    found = exact(candidates).withColumnRenamed("v", "score").where("score > 0")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: The same in DuckDB, all documents with each item.
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PATTERN}') AS ts FROM documents),
stat AS (SELECT count(*) FILTER (len(ts) > 0)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d),
tf AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(ts)::BIGINT AS n, unnest(ts) AS t FROM d) GROUP BY doc_id, n, t),
weight AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t), stat),
q AS (SELECT item_id, t, count(*)::BIGINT AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PATTERN}')) AS t FROM benchmark) GROUP BY item_id, t),
score AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN tf USING (t) JOIN weight USING (t), stat GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
