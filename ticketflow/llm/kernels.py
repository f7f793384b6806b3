"""Vectorised text kernels shared by the corpus operators.

Every kernel works on a run of whole documents laid end to end as bytes, so the
cost per document is a few numpy passes and no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A fixed random value for each byte, so that short strings spread over 64 bits.
BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]))
        for key, base in (("up", BASE), ("down", BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Scrambled polynomial hash of each span, from the sums of prefix_sums."""
    _, down = powers(len(sums))
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def chunks(text: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows; null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_binary())
    if text.null_count:
        text = text.fill_null(b"")
    n = len(text)
    if not n:
        return
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each document, and each document's first word in them."""
    inside = ~IS_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    edge = bounds[(bounds > 0) & (bounds < len(data))]
    before[edge] = False
    after[edge - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(BYTE_VALUE[data]), starts, ends)


def owners(firsts: np.ndarray) -> np.ndarray:
    """The document of each item, from each document's first item."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def window_starts(firsts: np.ndarray, width: int) -> np.ndarray:
    """Items at which a window of so many items of one document starts."""
    total = firsts[-1]
    ends = np.repeat(firsts[1:], np.diff(firsts))
    at = np.arange(total)
    return at[at + width <= ends]


def window_hashes(items: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return span_hash(prefix_sums(items), at, at + width)


def first_of_each(*keys: np.ndarray) -> np.ndarray:
    """Rows of the first occurrence of each key, in the order of keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order[new]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def as_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list column from the values of consecutive rows."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.Table]]:
    """The runs of rows with equal integer keys of sorted batches; as many at once as a batch completes."""
    held: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        g = [t.column(k).to_numpy() for k in keys]
        new = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in g], axis=0)])).tolist()
        yield [t.slice(s, e - s) for s, e in zip(new[:-1], new[1:], strict=True)]
        held = t.slice(new[-1])
    if held is not None:
        yield [held]
