"""Near-duplicate embeddings by collision counting over one-dimensional projections.

Vectors are projected on many random directions. Two vectors at the threshold differ little
in most projections, so around each query a window of fixed width is laid on every
projection and the windows that hold the other vector are counted; pairs whose count is one
that all but a few wanted pairs reach are verified by their exact cosine. To keep this from
comparing everything, it runs within cells: orthants of a few further projections, in as many
independent tables as the wanted recall asks for; how often the cuts, at the medians, part a
wanted pair is measured on a sample. A pair is counted in the first table whose cell it shares. Crowded cells are compared block by block in separate tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, comb, erf, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

#: Projections counted within a cell; half width of a window in deviations of a wanted pair's difference.
DIRECTIONS, WIDTH = 64, 1.6
#: Rows of a cell that one block holds (ranks are 16 bits wide), and rows that a cell should hold on average.
BLOCK, CELL = 1024, 48
#: Wanted pairs that the choice of cells, and the count, may each miss.
MISSED_BY_CELLS, MISSED_BY_COUNT = 0.01, 0.002
#: Vectors whose medians place the cells' cuts, at most; made pairs and cuts on which the cuts' agreement is measured.
SAMPLE, PAIRS, CUTS = 4096, 512, 1024
#: Comparisons that one more copy of a vector is worth, where its cells weigh as components do; values of a batch of cells at once.
COPY, AT_ONCE = 400, 1 << 22
#: Ranks compared with windows at once.
TILE = 1 << 18


def count_needed(directions: int, hit: float, missed: float) -> int:
    """The largest count that a wanted pair falls short of with at most the given probability."""
    below, needed = 0.0, 0
    for k in range(directions + 1):
        below += comb(directions, k) * hit**k * (1 - hit) ** (directions - k)
        if below > missed:
            break
        needed = k + 1
    return needed


def made_pairs(sample: np.ndarray, threshold: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the sample and, of each, a unit vector at the threshold that lies as far from the sample's mean.

    A partner is turned about the mean, towards a difference of two vectors of the sample. Where
    no turn reaches the threshold all that is near is wanted, and a right angle stands for it.
    """
    at = lambda: sample[rng.integers(0, len(sample), PAIRS)]
    dot = lambda a, b: np.einsum("ij,ij->i", a, b)[:, None]
    x, mean = at(), sample.mean(axis=0)
    u = x - mean
    size = np.sqrt(dot(u, u))
    u = np.divide(u, size, out=np.zeros_like(u), where=size > 0)
    z = at() - at() + 1e-9 * rng.standard_normal(x.shape)
    z -= dot(z, u) * u
    length = np.sqrt(dot(z, z))
    z = np.divide(z, length, out=np.zeros_like(z), where=length > 0)

    def turned(angle):
        y = mean + size * (np.cos(angle) * u + np.sin(angle) * z)
        return y / np.maximum(np.sqrt(dot(y, y)), 1e-300)

    low, high = np.zeros_like(size), np.full_like(size, np.pi)
    never = dot(x, turned(high)) > threshold
    for _ in range(40):
        middle = (low + high) / 2
        near = dot(x, turned(middle)) > threshold
        low, high = np.where(near, middle, low), np.where(near, high, middle)
    return x, turned(np.where(never, np.pi / 2, low))


def agreement(sample: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
    """For each of some pairs at the threshold, the share of cuts at the sample's medians with both on one side."""
    x, y = made_pairs(sample, threshold, rng)
    cuts = rng.standard_normal((sample.shape[1], CUTS))
    medians = np.median(sample @ cuts, axis=0)
    return ((x @ cuts > medians) == (y @ cuts > medians)).mean(axis=1)


def cells_for(agree: np.ndarray, dim: int, rows: int) -> tuple[int, int]:
    """(bits, tables) of least work by which the pairs share a cell of some table, but for MISSED_BY_CELLS of them.

    No bits is one cell of everything, so that there is always an answer.
    """
    work = lambda bits, tables: tables * (COPY * max(1.0, rows / 2**bits / BLOCK) * (1 + tables / dim) + rows / 2**bits / 2)
    best = 0, 1
    for bits in range(1, 1 + max(0, min(24, round(log2(max(1, rows / CELL)))))):
        apart = 1 - agree**bits
        short, enough = 0, 1
        while (apart**enough).mean() > MISSED_BY_CELLS and work(bits, enough) < work(*best):
            short, enough = enough, 2 * enough
        while enough - short > 1:
            middle = (short + enough) // 2
            short, enough = (middle, enough) if (apart**middle).mean() > MISSED_BY_CELLS else (short, middle)
        if (apart**enough).mean() <= MISSED_BY_CELLS and work(bits, enough) < work(*best):
            best = bits, enough
    return best


@dataclass
class Geometry:
    """The directions, cells and windows for vectors of one dimension."""

    counting: np.ndarray
    cutting: np.ndarray
    medians: np.ndarray
    tables: int
    bits: int
    width: float
    needed: int
    threshold: float

    @classmethod
    def of(cls, dim: int, rows: int, threshold: float, sample: np.ndarray, seed: int = 11) -> Geometry:
        rng = np.random.default_rng(seed + dim)
        bits, tables = cells_for(agreement(sample, threshold, np.random.default_rng(seed)), dim, rows) if len(sample) else (0, 1)
        deviation = sqrt(max(2 - 2 * threshold, 1e-12))
        counting, cutting = rng.standard_normal((dim, DIRECTIONS)), rng.standard_normal((dim, tables * bits))
        medians = np.median(sample @ cutting, axis=0) if len(sample) and bits else np.zeros(tables * bits)
        return cls(counting, cutting, medians, tables, bits, WIDTH * deviation, count_needed(DIRECTIONS, erf(WIDTH / sqrt(2)), MISSED_BY_COUNT), threshold)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """The cell of each vector in each table."""
        if not self.bits:
            return np.zeros((len(unit), self.tables), np.int64)
        cells, values = np.empty((len(unit), self.tables), np.int64), 1 << np.arange(self.bits, dtype=np.int64)
        step = max(1, AT_ONCE // len(self.medians))
        for s in range(0, len(unit), step):
            side = unit[s : s + step] @ self.cutting > self.medians
            cells[s : s + step] = side.reshape(-1, self.tables, self.bits) @ values
        return cells

    def links(self, x: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (from left, from right) of rows of x at the threshold; rows are compared once."""
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        unit = x / norm[:, None]
        p = (unit @ self.counting).T
        # lines lie one after another, further apart than any window reaches, so that one search serves all
        apart = np.arange(DIRECTIONS)[:, None] * (np.ptp(p) + 2 * self.width + 1)
        order = np.argsort(p[:, right], axis=1, kind="stable")
        ordered = (np.take_along_axis(p[:, right], order, axis=1) + apart).ravel()
        ranks = np.empty(order.shape, np.uint16)
        np.put_along_axis(ranks, order, np.arange(len(right), dtype=np.uint16)[None, :], axis=1)
        # the window around each query is a run of ranks of the sorted projection
        centres, base = p[:, left] + apart, np.arange(DIRECTIONS)[:, None] * len(right)
        low = np.searchsorted(ordered, centres - self.width, "left") - base
        span = (np.searchsorted(ordered, centres + self.width, "right") - base - low).astype(np.uint16)[:, :, None]
        low = low.astype(np.uint16)[:, :, None]
        found = ([], [])
        triangle = left is right
        step = max(1, TILE // (DIRECTIONS * max(1, len(right))))
        for s in range(0, len(left), step):
            a = left[s : s + step]
            # a rank below the window wraps round to one far above it
            counts = (ranks[:, None, :] - low[:, s : s + step] < span[:, s : s + step]).sum(axis=0, dtype=np.uint8)
            close = counts >= self.needed
            if triangle:
                close &= np.arange(s, s + len(a))[:, None] < np.arange(len(right))[None, :]
            i, j = np.nonzero(close)
            for k in range(0, len(i), 1 << 14):
                u, v = a[i[k : k + (1 << 14)]], right[j[k : k + (1 << 14)]]
                cosine = np.einsum("ij,ij->i", x[u], x[v]) / (norm[u] * norm[v])
                ok = cosine >= self.threshold
                found[0].append(u[ok])
                found[1].append(v[ok])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return join(found[0]), join(found[1])


def _doubles(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _celled(geometry: Geometry, dim: int):
    def run(batches):
        for batch in batches:
            if len(batch):
                x = _doubles(batch.column("embedding"), dim)
                cells = geometry.cells(x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None])
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * geometry.tables), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), batch.column("embedding"), cells], ["rep", "n", "embedding", "cells"])

    return run


def _compared(geometry: Geometry, dim: int):
    """From rows sorted by (t, cell, i, j): (a, b, n). b null: n vectors link with a; else a and b are connected."""

    def linked(t: pa.Table, table: int):
        rep, n, side = (t.column(c).to_numpy() for c in ("rep", "n", "side"))
        x = _doubles(t.column("embedding").combine_chunks(), dim)
        cells = t.column("cells").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        if (side == 0).all():
            left = right = np.arange(len(rep))
        else:
            left, right = np.flatnonzero(side < 0), np.flatnonzero(side > 0)
        u, v = geometry.links(x, left, right)
        if not len(u):
            return
        # counted where the pair first shares a cell
        first = (cells[u, :table] != cells[v, :table]).all(axis=1)
        add = np.bincount(u[first], n[v[first]], len(rep)) + np.bincount(v[first], n[u[first]], len(rep))
        some = np.flatnonzero(add)
        label = np.arange(len(rep))
        while True:
            low = label.copy()
            np.minimum.at(low, u, label[v])
            np.minimum.at(low, v, label[u])
            low = low[low]
            if (low == label).all():
                break
            label = low
        tied = np.flatnonzero(label != np.arange(len(rep)))
        yield np.concatenate([rep[some], rep[tied]]), np.concatenate([np.zeros(len(some), np.int64), rep[label[tied]]]), np.concatenate([add[some].astype(np.int64), np.zeros(len(tied), np.int64)]), np.arange(len(some) + len(tied)) >= len(some)

    def emit(groups):
        found = [f for t, table in groups for f in linked(t, table)]
        if found:
            a, b, n, tied = (np.concatenate([f[k] for f in found]) for k in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=~tied), pa.array(n)], ["a", "b", "n"])

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            keys = [t.column(c).to_numpy() for c in ("t", "cell", "i", "j")]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if len(t) > 1 else np.zeros(0, np.int64)
            starts = np.append(0, new)
            yield from emit((t.slice(s, e - s), int(keys[0][s])) for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
            held = t.slice(int(starts[-1]))
        if held is not None and len(held):
            yield from emit([(held, int(held.column("t")[0].as_py()))])

    return run


def _of_dimension(classes: DataFrame, dim: int, rows: int, threshold: float) -> DataFrame:
    """(a, b, n) of the classes of one dimension; see _compared."""
    classes = classes.where(F.size("embedding") == dim)
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toArrow().column("embedding").combine_chunks()
    sample = _doubles(sample, dim)
    sample /= np.sqrt(np.einsum("ij,ij->i", sample, sample))[:, None]
    geometry = Geometry.of(dim, rows, threshold, sample)
    celled = cut(classes.select("rep", "n", "embedding").mapInArrow(_celled(geometry, dim), "rep long, n long, embedding array<double>, cells array<long>"))
    spots = celled.select("rep", "n", "embedding", "cells", F.posexplode("cells").alias("t", "cell"))
    crowd = cut(celled.select(F.posexplode("cells").alias("t", "cell")).groupBy("t", "cell").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK))
    blocks = F.coalesce(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("int")
    dealt = spots.join(crowd, ["t", "cell"], "left").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), -1).otherwise(1)
    dealt = dealt.select("t", "cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), side.alias("side"), "rep", "n", "embedding", "cells")
    keys = ["t", "cell", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compared(geometry, dim), "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding).

    Vectors of the same dimension link when their cosine, in double precision, is at least
    the threshold. n_links counts the other rows linked directly, component_id is the
    smallest vec_id that links reach, kept whether it is the row's own. A vector that is
    null, empty, zero, or has null or non-finite components links with nothing; so does a row
    with a null vec_id, which is kept and has a null component. Rows that repeat a vec_id
    count as vectors of their own. Equal vectors are one class throughout. Other columns are
    ignored, and an empty table gives an empty result.
    """
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    usable = whole.where("vec_id is not null and embedding is not null").where(F.size("embedding") > 0).where(sound)
    # lengths that squares cannot hold are brought into range by a power of two, which changes no angle
    size = F.array_max(F.transform("embedding", F.abs))
    by = F.when(size > 1e100, 2.0**-700).when(size < 1e-100, 2.0**700)
    usable = usable.withColumn("by", by).withColumn("embedding", F.when(F.col("by").isNull(), F.col("embedding")).otherwise(F.transform("embedding", lambda x: x * F.col("by"))))
    usable = usable.withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < float("inf"))).select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    same = ["h1", "h2"]
    classes = cut(usable.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min("embedding").alias("embedding")))
    member = usable.select("vec_id", *same).join(classes.select("rep", "n", *same), same).select("vec_id", "rep", "n")
    dims = classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("rows")).orderBy("d").collect()
    met = None
    for r in dims:
        part = _of_dimension(classes, r["d"], r["rows"], threshold)
        met = part if met is None else met.union(part)
    if met is None:
        return whole.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    met = cut(met)
    degree = met.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    reached = components(met.where("b is not null").select("a", "b").distinct()).withColumnRenamed("id", "rep")
    found = cut(member.join(degree, "rep", "left").join(reached, "rep", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("l"), F.coalesce("component", "rep").alias("c")))
    found = found.groupBy("vec_id").agg(F.max("l").alias("l"), F.min("c").alias("c"))
    out = whole.select("vec_id").join(found, "vec_id", "left").select("vec_id", F.coalesce("l", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
