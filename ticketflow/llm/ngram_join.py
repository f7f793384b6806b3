"""Exact Jaccard self-join of documents on word shingles, by a partition of the token universe.

Sizes are dealt into bands. Within a band two sets at or above the threshold differ in at
most H tokens. Tokens are hashed into segments; an allocation gives each segment the number
of differing tokens it still finds (0: equal subsets meet, 1: subsets meet through their
one-deletion neighbourhoods), so that the allowances plus one sum to more than H. By the
pigeonhole principle every wanted pair then shares a key. There are more segments than the
principle asks for, so a wanted pair shares many keys, and a set that shares fewer with all
others together is out. The allocation of a band is the cheapest one under a cost model of
keys written and pairs that meet by chance.

Documents with equal sets are one class from the start. Of the sets that are left, those with
too many tokens that no other set has cannot link either. The rest first meet at the most
central class of each key, each class at one centre, so a key of many near copies yields as
many pairs as members. Then only tokens and keys that several components have count; what
still lies apart is dealt into cells of bounded weight and verified there on whole sets, and
only links that join components come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import components, cut

#: Shingles of a block of classes, two of which are compared in one cell.
WEIGHT = 1 << 20
#: How likely one token of a set is to be matched by chance in an unrelated set; and the cost
#: of verifying a pair in units of one written key. Both only steer the allocation.
CHANCE, PAIR_COST = 0.005, 20.0


def shingles(text: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, distinct sorted shingle hashes, first hash of each row).

    A-Z count as a-z. A document of fewer words has its whole sequence as one shingle.
    """
    for first, last, data, bounds in K.chunks(text):
        data = K.lower_ascii(data)
        starts, ends, firsts = K.words(data, bounds)
        hashes = K.word_hashes(data, starts, ends)
        sums = K.prefix_sums(hashes)
        at = K.window_starts(firsts, width)
        count = np.diff(firsts)
        short = np.flatnonzero((count > 0) & (count < width))
        h = np.concatenate([K.span_hash(sums, at, at + width), K.span_hash(sums, firsts[short], firsts[short + 1])])
        doc = np.concatenate([K.owners(firsts)[at], short])
        keep = K.first_of_each(doc, h)
        yield first, last, h[keep], np.searchsorted(doc[keep], np.arange(last - first + 1))


def bands(threshold: float, size: int) -> list[tuple[int, int]]:
    """(smallest, largest) size of each band up to size; partners lie in the same or the next."""
    out, low = [], 1
    while low <= size:
        high = max(low, floor(low / threshold + 1e-9))
        out.append((low, high))
        low = high + 1
    return out


def most_different(threshold: float, high: int) -> int:
    """The largest symmetric difference of two sets at the threshold, the smaller of size at most high."""
    larger = floor(high / threshold + 1e-9)
    return floor((1 - threshold) / (1 + threshold) * (high + larger) + 1e-9)


def slack(need: int) -> int:
    """Segments beyond what the pigeonhole asks for: so many more must a wanted pair share."""
    return need // 4


def allocation(threshold: float, low: int, high: int, rows: float) -> np.ndarray:
    """The allowance of each segment of a band; its sum plus its length is over most_different by slack and one."""
    need = most_different(threshold, high) + 1
    need += slack(need)
    best = None
    for ones in range(need // 2 + 1):
        parts = ones + (need - 2 * ones)
        tokens = low / parts
        keys = parts + ones * tokens
        met = rows * ((parts - ones) * CHANCE**tokens + ones * (1 + tokens) * CHANCE ** max(0.0, tokens - 1))
        cost = keys + PAIR_COST * met
        if best is None or cost < best[0]:
            best = cost, ones, parts
    _, ones, parts = best
    return np.array([1] * ones + [0] * (parts - ones))


class Plan:
    """The bands and their allocations up to the largest set."""

    def __init__(self, threshold: float, largest: int, rows_by_band: dict[int, int] | None = None):
        self.threshold = threshold
        self.edges = bands(threshold, max(1, largest))
        rows = rows_by_band or {}
        allowed = [allocation(threshold, low, high, rows.get(i, 1)) for i, (low, high) in enumerate(self.edges)]
        self.lows = np.array([low for low, _ in self.edges])
        self.highs = np.array([high for _, high in self.edges])
        self.parts = np.array([len(a) for a in allowed])
        self.allowed, self.offset = np.concatenate(allowed), np.cumsum([0, *self.parts])
        self.plain = np.array([not x.any() for x in allowed])
        #: how many differing tokens the found segments of a wanted pair stand for, at least
        self.gap = np.array([int((x + 1).sum()) - most_different(threshold, high) for x, (_, high) in zip(allowed, self.edges, strict=True)])

    def band(self, size):
        return np.searchsorted(self.lows, size, "right") - 1

    def keys(self, h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All keys, their rows and tags: those of a set's own band, and of the band below, where smaller partners are.

        A tag is 2 * least + below: a set with a partner in that band has least keys or more
        that others have too. Sets of a plain band share gap segments with a partner, so one
        with fewer empty segments than that leaves the empty ones out and still shares the rest.
        """
        sizes = np.bincount(row, minlength=n)
        own = self.band(np.maximum(sizes, 1))
        keys, rows, tags = [], [], []
        for below in (0, 1):
            band = own - below
            some = (sizes > 0) & (band >= 0)
            if below:
                some &= sizes * self.threshold <= self.highs[band] + 1e-9
            band = np.maximum(band, 0)
            parts = np.where(some, self.parts[band], 0)
            base = np.concatenate([[0], np.cumsum(parts)])
            element = some[row]
            hh, rr = h[element], row[element]
            segment = ((K.mix(hh) >> np.uint64(33)) % parts[rr].astype(np.uint64)).astype(np.int64)
            value = K.mix(hh + (2 * band[rr] + 1).astype(np.uint64))
            totals = np.zeros(base[-1], np.uint64)
            np.add.at(totals, base[rr] + segment, value)
            of = np.repeat(np.arange(n), parts)
            filled = np.bincount(base[rr] + segment, minlength=base[-1])[: base[-1]] > 0
            empty = np.bincount(of[~filled], minlength=n)
            gap, plain = self.gap[band], self.plain[band]
            loud = ~plain | (empty >= gap)
            least = np.where(plain, np.maximum(gap - empty, 1), (gap + 1) // 2)
            tag = K.mix((band[of].astype(np.uint64) << np.uint64(32)) + (np.arange(base[-1]) - base[of]).astype(np.uint64))
            told = filled | loud[of]
            keys.append(K.mix(totals + tag)[told])
            rows.append(of[told])
            one = self.allowed[self.offset[band[rr]] + segment] == 1
            if one.any():
                where = base[rr[one]] + segment[one]
                keys.append(K.mix(totals[where] - value[one] + tag[where]))
                rows.append(rr[one])
            tags += [2 * least[r] + below for r in rows[len(tags) :]]
        return np.concatenate(keys), np.concatenate(rows), np.concatenate(tags)


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _keys(width: int, plan: Plan):
    def run(batches):
        for batch in batches:
            ids, valid = _ids(batch.column("doc_id"))
            for first, last, h, firsts in shingles(batch.column("text"), width):
                key, row, tag = plan.keys(h, K.owners(firsts), last - first)
                keep = valid[first:last][row]
                yield pa.RecordBatch.from_arrays([pa.array(K.as_signed(key[keep])), pa.array(ids[first:last][row[keep]]), pa.array(tag[keep].astype(np.int32))], ["key", "doc_id", "tag"])

    return run


def _sizes(width: int):
    def run(batches):
        for batch in batches:
            for first, last, h, firsts in shingles(batch.column("text"), width):
                n = last - first
                sums = np.zeros(len(h) + 1, np.uint64)
                other = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(K.mix(h), out=sums[1:])
                np.cumsum(K.mix(h ^ K.BASE), out=other[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), pa.array(np.diff(firsts).astype(np.int64)), pa.array(K.as_signed(sums[firsts[1:]] - sums[firsts[:-1]])), pa.array(K.as_signed(other[firsts[1:]] - other[firsts[:-1]]))],
                    ["doc_id", "n_shingles", "h1", "h2"],
                )

    return run


def _sets(width: int):
    """(rep, n, tokens): the set of each row."""

    def run(batches):
        for batch in batches:
            for first, last, h, firsts in shingles(batch.column("text"), width):
                n = np.diff(firsts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(n.astype(np.int64)), K.lists(K.as_signed(h), n)], ["rep", "n", "tokens"])

    return run


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end, and where each row's begin."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _verified(numerator: int, denominator: int):
    """The pairs (a, b) of rows (a, b, x, y) whose sets x and y are similar enough."""

    def run(batches):
        for batch in batches:
            (x, at), (y, to) = _flat(batch.column("x")), _flat(batch.column("y"))
            linked = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                p, q = x[at[i] : at[i + 1]], y[to[i] : to[i + 1]]
                common = len(np.intersect1d(p, q, assume_unique=True))
                linked[i] = common > 0 and denominator * common >= numerator * (len(p) + len(q) - common)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    return run


def _check(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The linked ones of pairs (a, b) of classes, of which a class has few.

    A set can share only the tokens that are not its own alone, so pairs with too few of
    those, known from room (see _room), are not looked at.
    """
    x, y = (sets.select(F.col("rep").alias(id_), F.col("n").alias(n), F.col("room").alias(r), F.col("tokens").alias(t)) for id_, n, r, t in (("a", "xn", "xr", "x"), ("b", "yn", "yr", "y")))
    met = pairs.join(x, "a").join(y, "b").where(f"xr >= {numerator} * yn and yr >= {numerator} * xn")
    return cut(met.select("a", "b", "x", "y").mapInArrow(_verified(numerator, denominator), "a long, b long"), drop=False)


def _room(r: str, numerator: int, denominator: int):
    """What a set of n tokens, r of them to be found elsewhere, has room for.

    The intersection of two sets is at most the lesser r and their union at least what each
    has alone plus the greater r; so they can only be similar enough if the room of either is
    numerator times the other's size or more.
    """
    return F.expr(f"{denominator} * {r} - {numerator} * (n - {r})")


def _likely(sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """sets (rep, n, tokens) less those that hold too many tokens of their own to link, with their room."""
    token = sets.select("rep", F.explode("tokens").alias("t")).groupBy("t").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"))
    alone = token.where("rep = last").groupBy("rep").agg(F.count("*").alias("u"))
    known = sets.join(alone, "rep", "left").withColumn("r", F.col("n") - F.coalesce("u", F.lit(0)))
    return known.where(f"{denominator} * r >= {numerator} * n").select("rep", "n", "tokens", _room("r", numerator, denominator).alias("room"))


def _apart(sets: DataFrame, reached: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(rep, n, c, room): the sets that may link with another component, counting only tokens that several components have."""
    known = sets.join(reached, sets.rep == reached.id, "left").select("rep", "n", F.coalesce("component", "rep").alias("c"), "tokens")
    token = known.select("rep", "n", "c", F.explode("tokens").alias("t"))
    across = token.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("t")
    r = token.join(across, "t", "left_semi").groupBy("rep", "n", "c").agg(F.count("*").alias("r")).where(f"{denominator} * r >= {numerator} * n")
    return r.select("rep", "n", "c", _room("r", numerator, denominator).alias("room"))


def _dealt(met: DataFrame, apart: DataFrame) -> DataFrame:
    """(i, j, side, rep, c, n, room): the cells in which sets of different components meet.

    Sets with common keys form a cluster. Small clusters share a cell; a large one is dealt
    into blocks, of its largest component and of the rest, and two blocks meet in a cell
    unless both are of the largest component.
    """
    near = met.join(apart.select("rep", "c"), "rep")
    spread = near.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("rep").alias("first")).where("lo <> hi").select("key", "first")
    links = near.join(spread, "key").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    cluster = components(links).select(F.col("id").alias("rep"), F.col("component").alias("cluster"))
    placed = cut(apart.join(cluster, "rep"), drop=False)
    heavy = placed.groupBy("cluster", "c").agg(F.sum("n").alias("w"))
    main = heavy.groupBy("cluster").agg(F.max_by("c", F.struct("w", "c")).alias("main"), F.sum("w").alias("all"), F.max("w").alias("most"))
    bins = F.ceil(placed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("w")).first()["w"] / F.lit(WEIGHT)) + 1
    rest = F.when(F.col("all") > WEIGHT, F.ceil((F.col("all") - F.col("most")) / WEIGHT)).otherwise(1)
    mains = F.when(F.col("all") > WEIGHT, F.ceil(F.col("most") / WEIGHT)).otherwise(0)
    known = placed.join(main.select("cluster", "main", "all", rest.alias("rest"), mains.alias("mains")), "cluster")
    inner = (F.col("c") == F.col("main")) & (F.col("mains") > 0)
    mine = F.when(inner, F.col("rest") + F.pmod(F.xxhash64("rep"), F.greatest("mains", F.lit(1)))).otherwise(F.pmod(F.xxhash64("rep"), F.col("rest")))
    known = known.withColumn("inner", inner).withColumn("mine", mine)
    known = known.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("inner"), F.col("rest") - 1).otherwise(F.col("rest") + F.col("mains") - 1))))
    home = F.when(F.col("mains") == 0, F.pmod(F.xxhash64("cluster"), bins)).otherwise(F.xxhash64("cluster", F.least("mine", "other")))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), -1).otherwise(1)
    return known.select(home.alias("i"), F.greatest("mine", "other").alias("j"), side.alias("side"), "rep", "c", "n", "room")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] values, then the same for each further range."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def settled(side, rep, c, room, tokens, bounds, numerator: int, denominator: int) -> tuple[list[int], list[int]]:
    """Links that join all components which the sets of one cell link with each other.

    A set looks for partners of other components by its rarest tokens, as many as it cannot
    do without, and is compared with all that have one of them; components that a link has
    joined are one from then on, so no more than one link a component comes out.
    """
    n = np.diff(bounds)
    _, token, held = np.unique(tokens, return_inverse=True, return_counts=True)
    post, first = np.repeat(np.arange(len(n)), n)[np.argsort(token, kind="stable")], np.concatenate([[0], np.cumsum(held)])
    _, label = np.unique(c, return_inverse=True)
    if (side != 0).any():
        probes = np.flatnonzero(side < 0)
        rank = side.astype(np.int64)
    else:
        # the largest component is found by all others
        most = np.bincount(label, weights=n).argmax()
        probes = np.flatnonzero(label != most)
        rank = np.full(len(n), len(n))
        rank[probes] = np.arange(len(probes))
    marked, out = np.zeros(len(held), bool), ([], [])
    for x in probes.tolist():
        own = token[bounds[x] : bounds[x + 1]]
        rare = own[np.argsort(held[own], kind="stable")[: n[x] - -(-numerator * n[x] // denominator) + 1]]
        rare = rare[held[rare] > 1]
        found = np.unique(post[_ranges(first[rare], held[rare])])
        found = found[(label[found] != label[x]) & (rank[found] > rank[x]) & (room[found] >= numerator * n[x]) & (room[x] >= numerator * n[found])]
        marked[own] = True
        ends = np.cumsum(n[found])
        for lot in np.split(found, np.searchsorted(ends, np.arange(WEIGHT, ends[-1], WEIGHT)) if len(ends) else []):
            lot = lot[label[lot] != label[x]]
            if not len(lot):
                continue
            common = np.add.reduceat(marked[token[_ranges(bounds[lot], n[lot])]].astype(np.int64), np.cumsum(n[lot]) - n[lot])
            linked = lot[denominator * common >= numerator * (n[x] + n[lot] - common)]
            others, at = np.unique(label[linked], return_index=True)
            out[0].extend([int(rep[x])] * len(at))
            out[1].extend(rep[linked[at]].tolist())
            if len(others):
                label[np.isin(label, others)] = label[x]
        marked[own] = False
    return out


def _settled(numerator: int, denominator: int):
    """The links of cells, whose rows come sorted by (i, j)."""

    def run(batches):
        for done in K.groups(batches, ["i", "j"]):
            a, b = [], []
            for t in done:
                tokens, bounds = _flat(t.column("tokens"))
                found = settled(*(t.column(x).to_numpy() for x in ("side", "rep", "c", "room")), tokens, bounds, numerator, denominator)
                a += found[0]
                b += found[1]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _centred(met: DataFrame) -> DataFrame:
    """(a, b) with a < b: each class b or a at the most central other class of its keys.

    Central is who shares many keys; ties go to the smaller id. One pair a class at most.
    """
    share = met.groupBy("rep").agg(F.count("*").alias("shared"))
    ranked = met.join(share, "rep").select("key", "rep", F.struct("shared", (-F.col("rep")).alias("m")).alias("c"))
    top = ranked.groupBy("key").agg(F.max("c").alias("top"))
    best = ranked.join(top, "key").where("top.m <> c.m").groupBy("rep").agg(F.max("top").alias("top"))
    pairs = best.select("rep", (-F.col("top.m")).alias("p"))
    return pairs.select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).distinct()


def _crowded(met: DataFrame) -> DataFrame:
    """The rows of met whose key several classes have."""
    return met.join(met.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("key"), "key", "left_semi")


def jaccard_components(docs: DataFrame, width: int = 3, numerator: int = 90, denominator: int = 100) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) per row of docs.

    docs needs doc_id and text; other columns are ignored. Two documents link when
    denominator * |A and B| >= numerator * |A or B| over their sets of distinct word
    shingles; component_id is the smallest doc_id that links reach. A null or empty text
    has no shingles and links with nothing. Rows that repeat a doc_id are taken as one
    document with the union of links; a null doc_id gets a null component. An empty table
    gives an empty result.
    """
    threshold = numerator / denominator
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = cut(docs.mapInArrow(_sizes(width), "doc_id long, n_shingles long, h1 long, h2 long"))
    some = sizes.where("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "h1", "h2"]
    classes = cut(some.groupBy(*same).agg(F.min("doc_id").alias("rep")))
    member = cut(some.select("doc_id", *same).join(classes.select("rep", *same), same).select("doc_id", "rep").distinct())
    # a count for each band: bands grow with the logarithm of the largest size
    sized = classes.groupBy(F.floor(F.log("n_shingles") * 64).alias("l")).agg(F.count("*").alias("n"), F.min("n_shingles").alias("s"), F.max("n_shingles").alias("most")).collect()
    largest = max([r["most"] for r in sized], default=1)
    lows, per_band = np.array([low for low, _ in bands(threshold, largest)]), {}
    for r in sized:
        band = int(np.searchsorted(lows, r["s"], "right")) - 1
        per_band[band] = per_band.get(band, 0) + r["n"]
    plan = Plan(threshold, largest, per_band)

    keys = docs.mapInArrow(_keys(width, plan), "key long, doc_id long, tag int")
    met = keys.selectExpr("key", "doc_id", "tag", "count(1) over (partition by key) as g").where("g > 1").select("key", "doc_id", "tag")
    met = cut(met.join(member, "doc_id").select("key", "rep", "tag").distinct())
    met = cut(_crowded(met), drop=False)
    enough = met.groupBy("rep", "tag").agg(F.count("*").alias("shared")).where("shared >= shiftright(tag, 1)").select("rep").distinct()
    texts = docs.join(enough.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = cut(texts.mapInArrow(_sets(width), "rep long, n long, tokens array<long>"))
    sets = cut(_likely(sets, numerator, denominator))
    met = cut(_crowded(met.select("key", "rep").distinct().join(sets.select("rep"), "rep", "left_semi")), drop=False)

    links = _check(_centred(met), sets, numerator, denominator)
    # those that their centre did not take meet once more among themselves
    alone = met.join(links.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep", "left_anti")
    links = links.union(_check(_centred(cut(alone, drop=False)), sets, numerator, denominator))
    reached = cut(components(links), drop=False)
    # what still lies apart is compared in cells
    apart = cut(_apart(sets, reached, numerator, denominator), drop=False)
    cells = _dealt(met, apart).join(sets.select("rep", "tokens"), "rep").select("i", "j", "side", "rep", "c", "room", "tokens")
    more = cut(cells.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(_settled(numerator, denominator), "a long, b long"))
    if not more.isEmpty():
        x, y = reached.select(F.struct("id", "component").alias("x")), reached.select(F.struct("id", "component").alias("y"))
        between = more.join(x, F.col("a") == F.col("x.id"), "left").join(y, F.col("b") == F.col("y.id"), "left")
        between = components(between.select(F.coalesce("x.component", "a").alias("a"), F.coalesce("y.component", "b").alias("b")))
        reached = cut(_merged(reached, between), drop=False)
    of = member.join(reached, member.rep == reached.id, "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    of = of.groupBy("doc_id").agg(F.min("component").alias("component"))
    out = sizes.select("doc_id", "n_shingles").join(of, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _merged(reached: DataFrame, between: DataFrame) -> DataFrame:
    """reached, with components that between (id, component) joins taken together."""
    b = cut(between).select(F.col("id").alias("old"), F.col("component").alias("new"))
    moved = reached.join(b, reached.component == b.old, "left").select("id", F.coalesce("new", "component").alias("component"))
    fresh = b.join(reached, b.old == reached.id, "left_anti").select(F.col("old").alias("id"), F.col("new").alias("component"))
    return moved.union(fresh)


def representatives(docs: DataFrame, width: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """docs without the documents that are not the smallest doc_id of their component."""
    found = jaccard_components(docs, width, numerator, denominator)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
