"""An inverted file of vectors with product-quantised residuals: nearest tickets without reading all vectors.

Vectors are scaled to length 1 and dealt to lists by their nearest centroid. What is left of a
vector behind its centroid is cut into parts of a few dimensions, each told by the nearest of
256 words, so an entry has one byte a part. A query visits the lists of its nearest centroids,
ranks their entries by the words alone, and only the best of those are looked up and compared
exactly. How many lists and how many entries that takes is measured on a sample, for the recall
that is asked for.

Centroids and words are learned from a bounded sample (SAMPLE rows a list, WORD_SAMPLE rows in all)
of four fifths of the vectors; every vector is indexed. The recall is measured on the last fifth, as
what is inserted later was not learned from either. The entries are a stored table with a commit log, so an insert adds
files and readers see whole versions. A list of many entries is split into slots of about
SLOT rows, so no list is one task's; a slot that many queries visit is read by several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

from ..functions.vectors import cosine
from ..sources.store import Store, Table
from .similar import NEAREST, _checked, _sound, nearest_of_queries

#: Lists at most; the model that goes to every task has so many centroids, and 256 words a part.
MOST_LISTS = 4096
SAMPLE, WORD_SAMPLE, WORDS, WIDTH = 64, 65_536, 256, 4
#: Entries a slot, queries a task, entries scored at once, queries scored at once.
SLOT, ASKED, TILE, QUERIES = 50_000, 4096, 16_384, 256
#: Vectors asked to measure the recall, and the most entries a query looks up.
CALIBRATED, DEEPEST = 256, 2000
#: Rows from which some are held out. Sampled pieces that a word stands for at least.
FEW, A_WORD = 200, 39
ENTRIES = StructType().add("slot", "long").add("ticket_id", "long").add("codes", "binary").add("vector", ArrayType(FloatType()))
MODEL = StructType().add("kind", "string").add("id", "integer").add("numbers", ArrayType(DoubleType()))


@dataclass(frozen=True)
class Model:
    """Centroids (lists, length), words (parts, 256, width) and the first slot of each list, with one number more."""

    centroids: np.ndarray
    words: np.ndarray
    slots: np.ndarray

    @property
    def length(self) -> int:
        return self.centroids.shape[1]

    def towards(self, x: np.ndarray) -> np.ndarray:
        """How near each vector is to each centroid; more is nearer."""
        return x @ self.centroids.T - (self.centroids**2).sum(1) / 2

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Vectors cut into parts, the last filled up with zeros."""
        n, width = self.words.shape[0], self.words.shape[2]
        return np.pad(x, ((0, 0), (0, n * width - x.shape[1]))).reshape(len(x), n, width)

    def encoded(self, residuals: np.ndarray) -> np.ndarray:
        out = np.empty((len(residuals), len(self.words)), np.uint8)
        for p, (x, words) in enumerate(zip(self.parts(residuals).transpose(1, 0, 2), self.words, strict=True)):
            out[:, p] = (x @ words.T - (words**2).sum(1) / 2).argmax(1)
        return out

    def decoded(self, codes: np.ndarray, of: int) -> np.ndarray:
        """What the words of entries of a list say their vectors are."""
        told = self.words[np.arange(len(self.words)), codes].reshape(len(codes), -1)[:, : self.length]
        return (told + self.centroids[of]).astype(np.float32)

    def list_of(self, slot: int) -> int:
        return int(np.searchsorted(self.slots, slot, "right") - 1)


def held_out() -> Column:
    """Whether a row is of the fifth that nothing is learned from."""
    return F.pmod(F.xxhash64("ticket_id", F.lit(13)), F.lit(5)) == 0


def _floats(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.astype(np.float32).ravel()))


def _learned_words(rounds: int = 8):
    """The words of a part: k-means over its pieces of a bounded sample."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        x = np.stack(t.sort_by("draw").column("piece").to_numpy(zero_copy_only=False))
        own = min(WORDS, max(1, len(x) // A_WORD))
        words = np.resize(x[np.linspace(0, len(x) - 1, own).astype(int)], (WORDS, x.shape[1])).astype(np.float64)
        for _ in range(rounds):
            near = np.concatenate([(x[s : s + TILE] @ words.T - (words**2).sum(1) / 2).argmax(1) for s in range(0, len(x), TILE)])
            n = np.bincount(near, minlength=WORDS)
            sums = np.stack([np.bincount(near, x[:, d], WORDS) for d in range(x.shape[1])], 1)
            words[n > 0] = sums[n > 0] / n[n > 0, None]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "numbers": pa.array([words.ravel().tolist()])})

    return run


def _pieces(model: Model):
    """What is left of sampled vectors behind their centroids, part by part."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, x, _ = _sound(batch, "ticket_id", "vector", model.length)
            left = model.parts(x - model.centroids[model.towards(x).argmax(1)])
            n = left.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(n, dtype=np.int32), len(ids))), pa.array(np.repeat(ids, n)), _floats(left.reshape(-1, left.shape[2]))], ["part", "draw", "piece"])

    return run


def _entries(model: Model):
    """Vectors as entries of a slot of their list; those without a direction of this length have none."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, x, _ = _sound(batch, "ticket_id", "vector", model.length)
            near = model.towards(x).argmax(1)
            first, many = model.slots[near], np.diff(model.slots)[near]
            # ids in sequence must not fall into one slot
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            slot = first + (mixed % many.astype(np.uint64)).astype(np.int64)
            codes = pa.array([c.tobytes() for c in model.encoded(x - model.centroids[near])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(ids, pa.int64()), codes, _floats(x)], ["slot", "ticket_id", "codes", "vector"])

    return run


def _visits(model: Model, probes: int):
    """Queries in each slot that they visit."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, x, _ = _sound(batch, "query_id", "q", model.length)
            for s in range(0, len(ids), QUERIES):
                near = np.argsort(-model.towards(x[s : s + QUERIES]), axis=1, kind="stable")[:, :probes]
                for at, lists in enumerate(near):
                    slots = np.concatenate([np.arange(model.slots[n], model.slots[n + 1]) for n in lists])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[s + at], len(slots))), pa.array(slots), _floats(np.repeat(x[s + at : s + at + 1], len(slots), 0))], ["query_id", "slot", "unit"])

    return run


def _ranked(model: Model, depth: int):
    """The best entries of a slot for each of its visitors, by words alone; of equal ones those with the least ids."""

    def run(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(asked) and len(held):
            held = held.sort_by("ticket_id")
            ids, asks = held.column("ticket_id").to_numpy(), asked.column("query_id").to_numpy()
            unit = asked.column("unit").combine_chunks().flatten().to_numpy().reshape(len(asks), -1)
            codes = np.frombuffer(b"".join(held.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            of = model.list_of(key[0].as_py())
            for e in range(0, len(ids), TILE):
                told, own = model.decoded(codes[e : e + TILE], of), ids[e : e + TILE]
                back = TILE - 1 - np.arange(len(own))
                for s in range(0, len(asks), QUERIES):
                    score = np.round((unit[s : s + QUERIES] @ told.T).astype(np.float64) * 1e6).astype(np.int64)
                    score[asks[s : s + QUERIES, None] == own] = -(1 << 40)
                    most = min(depth, len(own))
                    best = np.argpartition(-(score * TILE + back), most - 1, axis=1)[:, :most]
                    got = np.take_along_axis(score, best, 1).ravel()
                    keep = got > -(1 << 40)
                    out.append((np.repeat(asks[s : s + QUERIES], most)[keep], own[best.ravel()][keep], got[keep]))
        cols = [np.concatenate([o[n] for o in out]) for n in range(3)]
        return pa.table([pa.array(np.full(len(cols[0]), key[0].as_py(), np.int64)), *map(pa.array, cols)], names=["slot", "query_id", "ticket_id", "told"])

    return run


class VectorIndex:
    """The index at a path. build() makes it; insert() and search() need nothing but the path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        self.store = Store(spark, path, {"entries": Table(ENTRIES, "slot", buckets), "model": Table(MODEL, "kind", 1)})
        self._known: tuple[list, Model, list[float]] | None = None

    # --- what is learned ---

    def model(self, manifest: dict | None = None) -> tuple[Model, dict[str, float]]:
        """The model and the settings of a version; their size is bounded by MOST_LISTS and the vectors' length."""
        manifest = manifest or self.store.manifest()
        files = manifest["files"].get("model", {}).get("0", [])
        if not files:
            raise ValueError("no index here; build() makes one")
        if self._known is None or self._known[0] != files:
            rows = self.store.rows(manifest, "model").orderBy("kind", "id").collect()
            of = lambda kind: [r.numbers for r in rows if r.kind == kind]
            words, centroids = np.array(of("words")), np.array(of("centroid"))
            last = (of("settings") or [[len(centroids), DEEPEST, 1, 1, NEAREST, 0]])[-1]
            self._known = files, Model(centroids, words.reshape(len(words), WORDS, -1), np.array(of("slots")[0], np.int64)), last
        return self._known[1], dict(zip(("probes", "depth", "share", "recall", "k", "entries"), self._known[2], strict=True))

    def build(self, vectors: DataFrame, recall: float = 0.97, k: int = NEAREST, lists: int | None = None) -> VectorIndex:
        """Indexes all rows (ticket_id, vector), ids being distinct, and measures how far to look for a recall of the k nearest.

        The length of the vectors is that of most of a sample; vectors of another length, without a
        direction, or null are not in the index.
        """
        if self.store.newest():
            raise ValueError("there is an index here")
        rows = vectors.select(F.col("ticket_id").cast("long"), F.col("vector").cast("array<float>").alias("vector"))
        n = rows.count()
        lists = lists or min(MOST_LISTS, max(1, math.isqrt(n)))
        # few rows are all learned from
        learned = rows.where(~held_out()) if n >= FEW else rows
        drawn = self._drawn(learned, max(SAMPLE * lists, WORD_SAMPLE), n)
        lengths = drawn.groupBy(F.size("vector").alias("length")).count().where("length > 0").orderBy(F.desc("count"), "length").first()
        if lengths is None:
            raise ValueError("no vectors")
        model = self._with_words(self._clustered(drawn, lists, lengths["length"]), drawn)
        sizes = {r["slot"]: r["count"] for r in rows.mapInArrow(_entries(model), ENTRIES).groupBy("slot").count().collect()}
        slots = np.cumsum([0, *(max(1, -(-sizes.get(i, 0) // SLOT)) for i in range(len(model.centroids)))])
        model = Model(model.centroids, model.words, slots)
        told = [("centroid", i, c.tolist()) for i, c in enumerate(model.centroids)] + [("words", i, w.ravel().tolist()) for i, w in enumerate(model.words)] + [("slots", 0, [float(s) for s in slots])]
        t = self.store.begin()
        t.append("model", self.spark.createDataFrame(told, MODEL))
        t.append("entries", rows.mapInArrow(_entries(model), ENTRIES))
        t.number("entries", sum(sizes.values()))
        t.commit()
        self.calibrate(recall, k)
        return self

    @staticmethod
    def _drawn(rows: DataFrame, most: int, n: int) -> DataFrame:
        """About so many rows, the same ones each time."""
        return rows if n <= most else rows.where(F.pmod(F.xxhash64("ticket_id", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * most / n))

    def _clustered(self, drawn: DataFrame, lists: int, length: int) -> Model:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.stat import Summarizer

        blank = Model(np.zeros((1, length)), np.zeros((1, WORDS, length)), np.array([0, 1]))
        unit = drawn.mapInArrow(_entries(blank), ENTRIES).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
        if unit.head() is None:
            raise ValueError("no vectors")
        if lists > 1:
            centres = np.array(KMeans(k=lists, seed=11, maxIter=10, initSteps=1).fit(unit).clusterCenters())
        else:
            centres = unit.select(Summarizer.mean(F.col("features"))).head()[0].toArray()[None]
        return Model(centres, np.zeros((-(-length // WIDTH), WORDS, WIDTH)), np.arange(len(centres) + 1))

    def _with_words(self, model: Model, drawn: DataFrame) -> Model:
        few = drawn.where(F.pmod(F.xxhash64("ticket_id", F.lit(12)), F.lit(1000)) < 1000 * min(1.0, WORD_SAMPLE / max(1, SAMPLE * len(model.centroids))))
        found = few.mapInArrow(_pieces(model), "part int, draw long, piece array<float>").groupBy("part").applyInArrow(_learned_words(), "part int, numbers array<double>")
        words = np.array([r.numbers for r in found.orderBy("part").collect()]).reshape(model.words.shape)
        return Model(model.centroids, words, model.slots)

    def calibrate(self, recall: float | None = None, k: int | None = None) -> dict[str, float]:
        """Measures how many lists and entries queries need for a recall of their k nearest, and keeps that.

        A bounded sample of queries is compared with all entries; half of what may be missed is left to the
        lists, half to the depth, which gets a quarter more, as entries grow by a tenth before this is done anew.
        """
        manifest = self.store.manifest()
        model, now = self.model(manifest)
        recall, k, n = recall or now["recall"], k or int(now["k"]), manifest["counters"]["entries"]
        rows = self.store.rows(manifest, "entries").select("ticket_id", "slot", "vector")
        some = n >= FEW
        asked = self._drawn(rows.where(held_out()) if some else rows, CALIBRATED, n // 5 if some else n).select(F.col("ticket_id").alias("query_id"), F.col("vector").alias("q"))
        true = nearest_of_queries(rows, asked, k).select("query_id", "ticket_id")
        true = true.where(held_out()) if some else true
        place = true.join(rows.select("ticket_id", "slot"), "ticket_id").toArrow()
        ids, x, _ = _sound(asked.toArrow(), "query_id", "q", model.length)
        settings = [float(len(model.centroids)), float(DEEPEST), 1.0, recall, float(k), float(n)]
        if len(place):
            order = np.argsort(-model.towards(x), axis=1, kind="stable")
            rank = np.argsort(order, axis=1)
            at = {q: i for i, q in enumerate(ids.tolist())}
            ranks = np.sort([rank[at[q], model.list_of(s)] for q, s in zip(place.column("query_id").to_pylist(), place.column("slot").to_pylist(), strict=True)])
            probes = int(ranks[math.ceil((1 + recall) / 2 * len(ranks)) - 1]) + 1
            sizes = np.zeros(len(model.centroids))
            for row in rows.groupBy("slot").count().collect():
                sizes[model.list_of(row["slot"])] += row["count"]
            deep = np.sort(self._candidates(asked, probes, DEEPEST, manifest).join(true, ["query_id", "ticket_id"]).select("rank").toArrow().column("rank").to_numpy())
            need = math.ceil(recall * len(ranks))
            depth = min(DEEPEST, int(deep[need - 1] * 5 // 4) + 1) if len(deep) >= need else DEEPEST
            settings[:3] = [float(probes), float(max(depth, 2 * k)), float(np.mean(sizes[order[:, :probes]].sum(1)) / sizes.sum())]

        def work(t):
            t.append("model", self.spark.createDataFrame([("settings", t.number("settings", 1), settings)], MODEL))

        self.store.transact(work)
        return self.model()[1]

    # --- use ---

    def insert(self, vectors: DataFrame) -> int:
        """Adds rows (ticket_id, vector), ids being distinct, that the index does not hold; how many that were.

        Once the index has grown by a tenth since it was measured, it is measured anew.
        """
        model = self.model()[0]

        def work(t) -> int:
            new = vectors.select(F.col("ticket_id").cast("long"), F.col("vector").cast("array<float>").alias("vector"))
            fresh = new.join(t.read("entries").select("ticket_id"), "ticket_id", "left_anti")
            t.append("entries", fresh.mapInArrow(_entries(model), ENTRIES))
            files = [f"{self.store.folder.path}/{f}" for held in t.added.get("entries", {}).values() for f in held]
            n = self.spark.read.schema(ENTRIES).parquet(*files).count() if files else 0
            if n:
                t.number("entries", n)
            return n

        n = self.store.transact(work)
        if self.store.manifest()["counters"]["entries"] > 1.1 * self.model()[1]["entries"]:
            self.calibrate()
        return n

    def _candidates(self, queries: DataFrame, probes: int, depth: int, manifest: dict) -> DataFrame:
        model = self.model(manifest)[0]
        visits = queries.select(F.col("query_id").cast("long"), F.col("q").cast("array<float>").alias("q")).mapInArrow(_visits(model, probes), "query_id long, slot long, unit array<float>")
        sizes = visits.groupBy("slot").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
        asked = visits.join(sizes, "slot").select("slot", F.pmod(F.xxhash64("query_id"), F.col("parts").cast("long")).cast("int").alias("part"), "query_id", "unit")
        held = self.store.rows(manifest, "entries").select("slot", "ticket_id", "codes").join(sizes, "slot")
        held = held.select("slot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "ticket_id", "codes")
        found = asked.groupBy("slot", "part").cogroup(held.groupBy("slot", "part")).applyInArrow(_ranked(model, depth), "slot long, query_id long, ticket_id long, told long")
        best = Window.partitionBy("query_id").orderBy(F.desc("told"), "ticket_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= depth)

    def search(self, queries: DataFrame, k: int = NEAREST, probes: int | None = None, depth: int | None = None) -> DataFrame:
        """(query_id, ticket_id, similarity, rank) of about the k nearest others of each query (query_id, q), ids being distinct.

        The recall is measured for the k of calibrate(); ask with more probes and depth for more. Codes of the
        visited slots are shuffled, and queries once a slot that they visit; vectors are read for entries that
        the codes rank well. Queries without a direction of the index's length find nothing.
        """
        manifest = self.store.manifest()
        settings = self.model(manifest)[1]
        found = self._candidates(queries, probes or int(settings["probes"]), max(_checked(k), depth or int(settings["depth"])), manifest)
        vectors = self.store.rows(manifest, "entries").select("slot", "ticket_id", "vector")
        asked = queries.select(F.col("query_id").cast("long"), F.col("q").cast("array<float>").alias("q"))
        near = found.select("query_id", "slot", "ticket_id").join(vectors, ["slot", "ticket_id"]).join(asked, "query_id")
        near = near.select("query_id", "ticket_id", F.round(cosine(F.col("vector"), F.col("q")), 12).alias("cos"))
        best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("cos"), "ticket_id")
        return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "ticket_id", F.round("cos", 4).alias("similarity"), "rank")
