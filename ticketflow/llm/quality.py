"""Quality by a generalised additive model with pairwise interactions.

Each feature is cut into bins and has a lookup table of contributions, learned by boosting
in turn over the features with trees of up to four leaves; then the pairs of features with
the most left to explain get tables of their own, learned by trees of one cut on either
feature. A text's score is the logistic function of the sum of its bins' entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import kernels as K
from .learning import held_out, labelled_sample

#: Labelled rows learned from, at most; bins of a feature; bins of a feature within a pair; pairs.
SAMPLE, BINS, PAIR_BINS, PAIRS = 20_000, 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 60, 0.15, 4.0

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "marks", "shouts", "other_signs",
    "spaces", "non_ascii", "words_a_line", "distinct_words", "same_as_before", "same_lines", "letter_words",
)

_KIND = np.zeros(256, np.int8)  # 0 letter in lower case
_KIND[range(65, 91)] = 1
_KIND[range(48, 58)] = 2
_KIND[[ord(c) for c in ".,;:'\"-()"]] = 3
_KIND[[ord(c) for c in "!?"]] = 4
_KIND[[c for c in range(33, 127) if chr(c) in "#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_KIND[range(33)] = 6
_KIND[range(128, 256)] = 7


def _per_row(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(float)


def _distinct(rows: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
    return _per_row(rows[new], n)


def features(text: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; those of an empty or null one are all 0."""
    out = np.zeros((len(text), len(FEATURES)))
    for first, last, data, bounds in K.chunks(text):
        n = last - first
        size = np.diff(bounds).astype(float)
        per = np.maximum(size, 1)
        kinds = np.zeros((8, n))
        kind = _KIND[data]
        for k in range(1, 8):
            total = np.zeros(len(data) + 1, np.int64)
            np.cumsum(kind == k, out=total[1:])
            kinds[k] = total[bounds[1:]] - total[bounds[:-1]]
        starts, ends, firsts = K.words(data, bounds)
        sums = K.prefix_sums(K.BYTE_VALUE[data])
        h = K.span_hash(sums, starts, ends)
        row = K.owners(firsts)
        words = np.diff(firsts).astype(float)
        per_word = np.maximum(words, 1)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        breaks = np.union1d(np.flatnonzero(data == 10) + 1, bounds)
        breaks = breaks[breaks < len(data)]
        line_row = np.searchsorted(bounds, breaks, "right") - 1
        line = K.span_hash(sums, breaks, np.append(breaks[1:], len(data)))
        lines = _per_row(line_row, n)
        plain = np.zeros(len(data) + 1, np.int64)
        np.cumsum((kind == 0) | (kind == 1) | (kind == 7), out=plain[1:])
        tidy = plain[ends] - plain[starts] >= ends - starts - 1
        columns = [
            np.log1p(size), np.log1p(words), (size - kinds[6]) / per_word, kinds[1] / per, kinds[2] / per, kinds[3] / per, kinds[4] / per, kinds[5] / per,
            kinds[6] / per, kinds[7] / per, np.log1p(words / np.maximum(lines, 1)), _distinct(row, h, n) / per_word, _per_row(row[again], n) / per_word,
            1 - _distinct(line_row, line, n) / np.maximum(lines, 1), _per_row(row[tidy], n) / per_word,
        ]
        columns = np.stack(columns, axis=1)
        columns[size == 0] = 0
        out[first:last] = columns
    return out


@dataclass
class Additive:
    """Cut points of each feature, a table for each, and tables for pairs over coarser cuts."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], "right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_cuts[a], x[:, a], "right"), np.searchsorted(self.pair_cuts[b], x[:, b], "right")]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best cut of a run of bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of a tree of up to four leaves over ordered bins."""
    leaves = [(0, len(g))]
    for _ in range(2):
        leaves = [part for a, b in leaves for gain, at in [_best_cut(g[a:b], h[a:b])] for part in ([(a, a + at), (a + at, b)] if gain > 1e-6 else [(a, b)])]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and values of the best tree of one cut on either of two features."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best = 0.0, np.zeros_like(g)
    rows, cols = g.shape
    for i in range(rows - 1):
        for j in range(cols - 1):
            parts = [(slice(0, i + 1), slice(0, j + 1), cg[i, j], ch[i, j])]
            parts.append((slice(0, i + 1), slice(j + 1, cols), cg[i, -1] - cg[i, j], ch[i, -1] - ch[i, j]))
            parts.append((slice(i + 1, rows), slice(0, j + 1), cg[-1, j] - cg[i, j], ch[-1, j] - ch[i, j]))
            parts.append((slice(i + 1, rows), slice(j + 1, cols), cg[-1, -1] - cg[i, -1] - cg[-1, j] + cg[i, j], ch[-1, -1] - ch[i, -1] - ch[-1, j] + ch[i, j]))
            gain = sum(_gain(p[2], p[3]) for p in parts) - _gain(cg[-1, -1], ch[-1, -1])
            if gain > best[0] + 1e-9:
                values = np.zeros_like(g)
                for a, b, pg, ph in parts:
                    values[a, b] = pg / (ph + RIDGE)
                best = gain, values
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, n_pairs: int = PAIRS) -> Additive:
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Additive(float(np.log(share / (1 - share))), [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1])
    cuts = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    model = Additive(float(np.log(y.mean() / (1 - y.mean()))), cuts, [np.zeros(len(c) + 1) for c in cuts])
    margin = np.full(len(y), model.base)

    def left():
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, b in enumerate(bins):
            r, w = left()
            n = len(cuts[j]) + 1
            step = RATE * _tree(np.bincount(b, r, n), np.bincount(b, w, n))
            model.tables[j] += step
            margin += step[b]
    model.pair_cuts = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.pair_cuts)]
    shape = lambda a, b: (len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1)

    def histogram(a, b, v):
        rows, cols = shape(a, b)
        return np.bincount(coarse[a] * cols + coarse[b], v, rows * cols).reshape(rows, cols)

    r, w = left()
    ranked = sorted(((_quadrants(histogram(a, b, r), histogram(a, b, w))[0], a, b) for a, b in combinations(range(x.shape[1]), 2)), reverse=True)
    chosen = [(a, b, np.zeros(shape(a, b))) for gain, a, b in ranked[:n_pairs] if gain > 0]
    for _ in range(pair_rounds if chosen else 0):
        for a, b, table in chosen:
            r, w = left()
            step = RATE * _quadrants(histogram(a, b, r), histogram(a, b, w))[1]
            table += step
            margin += step[coarse[a], coarse[b]]
    model.pairs = chosen
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Additive:
    """Learns from at most so many labelled training rows, whose features alone reach the driver."""

    def run(batches):
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = labelled_sample(docs, labels, "quality", most).select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, x array<double>").toArrow()
    rows = rows.sort_by("doc_id")
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, np.array(rows.column("y").to_pylist(), float))


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """docs with score, the probability of quality 1; the column is replaced."""
    names = [c for c in docs.columns if c != "score"]
    docs = docs.select([F.col(f"`{c}`") for c in names])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.probability(features(batch.column("text"))))], [*names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def judged(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Null and empty texts have the features of an empty text; repeated and null ids are
    scored each. Without labels of both kinds all texts get one score.
    """
    found = score(docs.select("doc_id", "text"), train(docs, labels, most))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
