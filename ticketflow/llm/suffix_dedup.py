"""Removal of long byte strings that occur more than once, by interval trees of suffix arrays.

Suffixes of a corpus cannot meet in one array, so they are dealt by content first. Every
window of the wanted length is assigned to the least hash among its short grams (its anchor);
equal windows have equal anchors, so only suffixes of the same anchor can share so long a
prefix. The windows of an anchor form a tile. Tiles with the same bytes are repeats as they
stand, and one of them stands for all. Tiles that differ but share an anchor have their
suffixes sorted into an enhanced suffix array, whose stack scan yields the tree of common
prefixes; nodes whose occurrences have different bytes to the left are the maximal repeats,
with all their occurrences. Crowded anchors are split; what a part cannot know alone is
settled by the windows' hashes across parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import kernels as K
from .common import cut
from .substring_dedup import SPREAD, _valid_ids

#: Tiles of one anchor that are sorted together: some 3 MB of text and 60 MB of working arrays.
CROWD = 8192


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of each run of so many values, in a few passes."""
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, x[-1])]).reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return best(back[:n], ahead[width - 1 : width - 1 + n])


def tiles(data: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """(anchor hash, tile hash, row, first window's start, number of windows) of all tiles."""
    empty = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, width = len(data) - gram + 1, length - gram + 1
    if n < width:
        return empty
    sums = K.prefix_sums(K.BYTE_VALUE[data])
    _, down = K.powers(n)
    g = (sums[gram:] - sums[:-gram]) * down
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(32)
    low = _sliding(g, width, np.minimum)
    ok = np.ones(len(low), bool)
    for b in bounds[1:-1].tolist():
        ok[max(0, b - length + 1) : b] = False
    if not ok.any():
        return empty
    # a gram is an anchor if it equals the least of some window that holds it
    held = np.concatenate([np.zeros(width - 1, np.uint64), np.where(ok, low, np.uint64(0)), np.zeros(width - 1, np.uint64)])
    anchors = np.flatnonzero(_sliding(held, width, np.maximum) == g)
    start = ok.copy()
    start[1:] &= ~ok[:-1] | (low[1:] != low[:-1])
    after = anchors[anchors + 1 < len(ok)] + 1
    start[after] |= ok[after]
    first = np.flatnonzero(start)
    end = np.flatnonzero(ok & ~np.concatenate([ok[1:], [False]]))
    stop = np.minimum(np.append(first[1:], len(ok)), end[np.searchsorted(end, first)] + 1)
    at = np.searchsorted(anchors, first)
    wrong = g[anchors[at]] != low[first]
    while wrong.any():
        at[wrong] += 1
        wrong[wrong] = g[anchors[at[wrong]]] != low[first[wrong]]
    anchor = anchors[at]
    same = np.ones(len(first), bool)
    same[1:] = (anchor[1:] != anchor[:-1]) | (stop[:-1] != first[1:])
    head = np.flatnonzero(same)
    lo, hi = first[head], stop[np.append(head[1:], len(first)) - 1]
    anchor = anchor[head]
    whole = K.span_hash(sums, lo, hi - 1 + length) + K.mix((anchor - lo).astype(np.uint64))
    return g[anchor], whole, np.searchsorted(bounds, lo, "right") - 1, lo, hi - lo


def _tiled(length: int, gram: int):
    def run(batches):
        for batch in batches:
            ids, valid = _valid_ids(batch.column("doc_id"))
            parts = [[np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
            for first, _, data, bounds in K.chunks(batch.column("text")):
                g, c, row, lo, n = tiles(data, bounds, length, gram)
                for part, x in zip(parts, (g, c, row + first, lo - bounds[row], n), strict=True):
                    part.append(x)
            g, c, row, lo, n = map(np.concatenate, parts)
            keep = valid[row]
            g, c, row, lo, n = g[keep], c[keep], row[keep], lo[keep], n[keep]
            # what this batch already knows need not meet again: known rows pass on keys of their own
            order = np.lexsort((c, g))
            g, c, row, lo, n = g[order], c[order], row[order], lo[order], n[order]
            new_g = np.ones(len(g), bool)
            new_g[1:] = g[1:] != g[:-1]
            new_c = new_g.copy()
            new_c[1:] |= c[1:] != c[:-1]
            of_g, of_c = np.cumsum(new_g) - 1, np.cumsum(new_c) - 1
            c_known = np.bincount(of_c, minlength=1)[of_c] > 1
            g_known = np.bincount(of_g[new_c], minlength=1)[of_g] > 1
            spread = 1 + np.arange(len(g)) % SPREAD
            yield pa.RecordBatch.from_arrays(
                [pa.array(K.as_signed(g)), pa.array(K.as_signed(c)), pa.array(ids[row]), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.where(new_c, 0, spread).astype(np.int32)), pa.array(np.where(new_g, 0, spread).astype(np.int32)), pa.array(c_known), pa.array(g_known)],
                ["g", "c", "doc_id", "lo", "n", "c_salt", "g_salt", "c_known", "g_known"],
            )

    return run


def _contexts(length: int):
    """The bytes of the listed tiles of each document."""

    def run(batches):
        for batch in batches:
            lists, texts = batch.column("tiles"), batch.column("text")
            ids = batch.column("doc_id")
            g, salt, split, doc, lo, n, ctx = [], [], [], [], [], [], []
            for row in range(len(batch)):
                if not lists[row].is_valid:
                    continue
                text = texts[row].as_py().encode()
                for t in lists[row].as_py():
                    g.append(t["g"])
                    salt.append(t["salt"])
                    split.append(t["split"])
                    doc.append(ids[row].as_py())
                    lo.append(t["lo"])
                    n.append(t["n"])
                    ctx.append(text[t["lo"] : t["lo"] + t["n"] - 1 + length])
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(salt, pa.int32()), pa.array(split, pa.bool_()), pa.array(doc, pa.int64()), pa.array(lo, pa.int32()), pa.array(n, pa.int32()), pa.array(ctx, pa.binary())], ["g", "salt", "split", "doc_id", "lo", "n", "ctx"])

    return run


def interval_tree(suffixes: list[tuple[bytes, int]], length: int) -> list[tuple[int, int, int, list[int]]]:
    """The left-diverse nodes of the tree of common prefixes: (prefix length, first, last + 1, order).

    suffixes are (bytes after a common prefix of the given length, byte to the left or -1 at
    an edge). order is the suffix array, shared by all nodes; a node's occurrences are
    order[first:last + 1].
    """
    order = sorted(range(len(suffixes)), key=lambda i: suffixes[i][0])
    lcp = [0]
    for a, b in zip(order, order[1:], strict=False):
        x, y = suffixes[a][0], suffixes[b][0]
        k, most = 0, min(len(x), len(y))
        if x[:most] == y[:most]:
            k = most
        else:
            while x[k] == y[k]:
                k += 1
        lcp.append(k)
    lcp.append(-1)
    lefts = [suffixes[i][1] for i in order]
    # where the byte to the left last differed from the one before, so diversity of a run is one look-up
    change = [0] * len(order)
    for i in range(1, len(order)):
        change[i] = i if lefts[i] != lefts[i - 1] or lefts[i] < 0 else change[i - 1]
    out, stack = [], []
    for i in range(1, len(lcp)):
        start = i - 1
        while stack and stack[-1][0] > lcp[i]:
            depth, start = stack.pop()
            if i - start > 1 and (change[i - 1] > start or lefts[start] < 0):
                out.append((length + depth, start, i, order))
        if not stack or stack[-1][0] < lcp[i]:
            stack.append((lcp[i], start))
    return out


def _repeats(length: int):
    """Spans of repeats among the tiles of each (g, salt); for split anchors also one row a window.

    Rows: (kind, w, w2, doc_id, start, size), w and w2 being two hashes of a window. kind 0 is a span of a maximal repeat, 1 a window of a
    split anchor that this part saw once, 2 one of the windows that it saw more often.
    """

    def found(t: pa.Table):
        data = t.column("ctx").combine_chunks()
        if isinstance(data, pa.ChunkedArray):
            data = pa.concat_arrays(data.chunks)
        doc, lo, n = (t.column(x).to_numpy() for x in ("doc_id", "lo", "n"))
        split = t.column("split").to_numpy(zero_copy_only=False)
        for first, last, raw, bounds in K.chunks(data, 1 << 40):
            yield from _batch(raw, bounds, doc[first:last], lo[first:last].astype(np.int64), n[first:last].astype(np.int64), split[first:last], length)

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            g, salt = t.column("g").to_numpy(), t.column("salt").to_numpy()
            new = np.flatnonzero((g[1:] != g[:-1]) | (salt[1:] != salt[:-1])) + 1
            last = int(new[-1]) if len(new) else 0
            # whole groups, a bounded number of bytes at a time
            if last:
                for s, e in _runs(np.append(0, new), last):
                    yield from found(t.slice(s, e - s))
            held = t.slice(last)
        if held is not None and len(held):
            yield from found(held)

    return run


def _runs(starts: np.ndarray, end: int, rows: int = 8192):
    """Runs of whole groups of about so many rows."""
    s = 0
    while s < end:
        e = int(starts[min(np.searchsorted(starts, s + rows), len(starts) - 1)])
        e = e if e > s else end
        yield s, min(e, end)
        s = e


def _batch(raw, bounds, doc, lo, n, split, length):
    sums = K.prefix_sums(K.BYTE_VALUE[raw])
    tile = np.repeat(np.arange(len(n)), n)
    index = np.arange(len(tile)) - np.repeat(np.cumsum(n) - n, n)
    at = bounds[tile] + index
    h = K.span_hash(sums, at, at + length)
    left = np.where(index > 0, raw[np.maximum(at - 1, 0)].astype(np.int64), -1)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    of = np.cumsum(new) - 1
    count = np.bincount(of, minlength=1)
    start = np.flatnonzero(new)
    lefts = left[order]
    low, high = np.minimum.reduceat(lefts, start) if len(start) else lefts, np.maximum.reduceat(lefts, start) if len(start) else lefts
    diverse = (count[: len(start)] > 1) & ((low != high) | (low < 0))
    spans = ([], [], [])
    memory = raw.tobytes()
    for k in np.flatnonzero(diverse).tolist():
        own = order[start[k] : start[k] + count[k]].tolist()
        suffixes = [(memory[at[i] + length : bounds[tile[i] + 1]], int(left[i])) for i in own]
        longest = [0] * len(own)
        for size, a, b, sorted_ in interval_tree(suffixes, length):
            for i in sorted_[a:b]:
                longest[i] = max(longest[i], size)
        for i, size in zip(own, longest, strict=True):
            if size:
                spans[0].append(doc[tile[i]])
                spans[1].append(lo[tile[i]] + index[i])
                spans[2].append(size)
    names = ["kind", "w", "w2", "doc_id", "start", "size"]
    m = len(spans[0])
    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m, np.int64)), pa.array(spans[0], pa.int64()), pa.array(spans[1], pa.int64()), pa.array(spans[2], pa.int64())], names)
    if split.any():
        one = order[start][split[tile[order[start]]]]
        kind = np.where(count[of[start]] > 1, 2, 1)[split[tile[order[start]]]].astype(np.int32)
        other = K.prefix_sums(K.mix(K.BYTE_VALUE)[raw])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(K.as_signed(h[one])), pa.array(K.as_signed(K.span_hash(other, at[one], at[one] + length))), pa.array(doc[tile[one]]), pa.array(lo[tile[one]] + index[one]), pa.array(np.full(len(one), length))], names)


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = 50) -> DataFrame:
    """(doc_id, start, size): spans of bytes whose union is every byte that a repeated string of length covers."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "g long, c long, doc_id long, lo int, n int, c_salt int, g_salt int, c_known boolean, g_known boolean"
    found = base.mapInArrow(_tiled(length, gram), kind)
    within = "over (partition by g, c, c_salt"
    classed = found.selectExpr("*", f"c_known or count(1) {within}) > 1 as full", f"c_salt = 0 and row_number() {within} order by doc_id, lo) = 1 as rep", f"max(g_known) {within}) as c_met")
    # one row stands for a class, so it carries what any batch knows of the class
    classed = cut(classed.select("g", "doc_id", "lo", "n", "g_salt", "c_met", "full", "rep").where("full or rep"))
    whole = classed.where("full").select("doc_id", F.col("lo").cast("long").alias("start"), (F.col("n") - 1 + length).cast("long").alias("size"))

    shared = classed.where("rep").selectExpr("g", "doc_id", "lo", "n", "c_met or count(1) over (partition by g, g_salt) > 1 as met").where("met")
    shared = cut(shared.select("g", "doc_id", "lo", "n"))
    crowded = shared.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > CROWD)
    parts = F.coalesce(F.ceil(F.col("m") / CROWD), F.lit(1)).cast("long")
    dealt = shared.join(crowded, "g", "left").select("doc_id", F.struct("g", F.pmod(F.xxhash64("doc_id", "lo"), parts).cast("int").alias("salt"), F.col("m").isNotNull().alias("split"), "lo", "n").alias("t"))
    listed = dealt.groupBy("doc_id").agg(F.collect_list("t").alias("tiles"))
    contexts = base.where("doc_id is not null").join(listed.hint("shuffle_hash"), "doc_id").mapInArrow(_contexts(length), "g long, salt int, split boolean, doc_id long, lo int, n int, ctx binary")
    met = contexts.repartition("g", "salt").sortWithinPartitions("g", "salt").mapInArrow(_repeats(length), "kind int, w long, w2 long, doc_id long, start long, size long")
    met = cut(met)
    apart = met.where("kind > 0").selectExpr("kind", "doc_id", "start", "size", "count(1) over (partition by w, w2) as n").where("kind = 1 and n > 1")
    # a window seen often in one part and never again needs nothing more; one seen in two parts marks both
    return whole.union(met.where("kind = 0").select("doc_id", "start", "size")).union(apart.select("doc_id", "start", "size"))


def _without(names: list[str]):
    def run(batches):
        for batch in batches:
            for first, last, data, bounds in K.chunks(batch.column("text")):
                edges = np.zeros(len(data) + 1, np.int32)
                spans = batch.column("spans").slice(first, last - first)
                counts = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = spans.flatten()
                start = flat.field("start").to_numpy(zero_copy_only=False) + np.repeat(bounds[:-1], counts)
                np.add.at(edges, start, 1)
                np.add.at(edges, start + flat.field("size").to_numpy(zero_copy_only=False), -1)
                gone = np.cumsum(edges[:-1]) > 0
                heads = gone.copy()
                heads[1:] &= ~gone[:-1]
                inner = bounds[:-1][bounds[:-1] < len(data)]
                heads[inner] = gone[inner]
                total = np.concatenate([[0], np.cumsum(gone)])[bounds]
                runs = np.concatenate([[0], np.cumsum(heads)])[bounds]
                kept = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer((bounds - total).astype(np.int32)), pa.py_buffer(data[~gone])])
                made = {"kept": kept, "n_bytes": pa.array(np.diff(bounds)), "n_removed": pa.array(np.diff(total)), "n_spans": pa.array(np.diff(runs))}
                yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n).slice(first, last - first) for n in names], names)

    return run


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 50) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans) of every row of docs.

    kept is the UTF-8 text less every byte that a string of length bytes covers which also
    starts elsewhere, in the same or another document; it is binary, as a cut may fall within
    a letter. A null text is empty. doc_id names a document: rows that repeat one are taken to
    repeat its text, and so repeat each other. A row with a null doc_id is compared with
    nothing and keeps all. An empty table gives an empty result.
    """
    if not 8 <= gram < length:
        raise ValueError("the gram must be shorter than the length")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = repeated_spans(base, length, gram).groupBy("doc_id").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    out = StructType([StructField("doc_id", LongType()), StructField("kept", BinaryType()), StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType())])
    return base.join(spans.hint("shuffle_hash"), "doc_id", "left").mapInArrow(_without(out.names), out)
