"""Toxicity by a weighted finite-state grammar over the clauses of a text.

Words are read as symbols (insult, threat, target, negation, report, quote mark, other) and
clauses by a composition of small transducers. Each transducer passes the symbols on and
multiplies the weight of an insult or threat: a target in the clause raises it, a negation
shortly before lowers it, reported speech lowers it. A clause scores what its insults and
threats weigh on the best path; a text is judged by its clauses' scores.

Which words insult is learned: words and word stems that labelled toxic texts have and other
labelled texts lack, weighted by log odds. By how much a context raises or lowers a weight is
learned too: the factors of the transducers start from PRIOR and move as far as labels ask.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from . import kernels as K
from .learning import held_out, labelled_sample
from .ngram_join import shingles

#: Labelled rows learned from, at most; it bounds the lexicon too, as a unit needs a share of them.
SAMPLE = 20_000
#: A unit must be seen in so many toxic texts, and in this share of them.
SUPPORT, SHARE = 4, 0.01
STEMS = (4, 5, 6, 7)
#: A unit is learned if it is so many times likelier in toxic texts.
ODDS = 12.0

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)

# Function words of the grammar in English, German, French and Spanish.
WORDS = {
    THREAT: "kill hurt destroy beat punch burn stab shoot töten umbringen schlagen verletzen tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours he him she her they them their everyone people du dich dir dein ihr euch sie er tu toi vous votre ils elles il elle tú usted ustedes vosotros ellos ellas él ella",
    NEGATION: "not no never neither nor hardly cannot nicht kein keine keinen nie niemals ne pas non jamais aucun ni nunca jamás ningún tampoco",
    REPORT: "said says say told wrote quoted claimed called reported sagte sagt schrieb nannte behauptete dit disait écrit appelé dijo dice escribió llamó",
}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?;:\n"]] = True
_QUOTE = np.zeros(256, bool)
_QUOTE[ord('"')] = True
# Last bytes of the signs of two and three bytes that are no letters, and what they are read as.
_TWO = {0xA0: " ", 0xA1: ".", 0xA7: " ", 0xAB: '"', 0xB0: " ", 0xB4: "'", 0xB7: " ", 0xBB: '"', 0xBF: "."}
_THREE = {**dict.fromkeys(range(0x80, 0x98), " "), 0xAF: " ", 0x98: "'", 0x99: "'", 0x9A: '"', 0x9C: '"', 0x9D: '"', 0x9E: '"', 0x9F: '"', 0xA2: " ", 0xA6: ".", 0xB9: '"', 0xBA: '"'}


def read_signs(data: np.ndarray) -> np.ndarray:
    """The bytes in lower case (ASCII and accented Latin letters), with typographic signs as plain ones in each of their bytes."""
    data = K.lower_ascii(data)
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out = np.where(capital, data + 0x20, data).astype(np.uint8)
    for head, table in (([0xC2], _TWO), ([0xE2, 0x80], _THREE)):
        n = len(head)
        if len(data) <= n:
            continue
        at = np.flatnonzero(np.all([data[i : len(data) - n + i] == b for i, b in enumerate(head)], axis=0))
        sign = np.zeros(256, np.uint8)
        sign[list(table)] = [ord(c) for c in table.values()]
        found = sign[data[at + n]]
        for i in range(n + 1):
            out[at[found > 0] + i] = found[found > 0]
    # a sign of several bytes is one mark
    again = np.flatnonzero((out[1:] == ord('"')) & (data[1:] >= 0x80) & (data[1:] < 0xC0)) + 1
    out[again] = 0x20
    return out


def contracted(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words are the t of a contracted not, as in aren't, by either apostrophe."""
    at = lambda k: data[np.maximum(starts - k, 0)]
    mark, n = ord("'"), ord("n")
    alone = (ends - starts == 1) & (data[starts] == ord("t")) & (starts > 1) if len(starts) else np.zeros(0, bool)
    return alone & (at(1) == mark) & ((at(2) == n) | (at(2) == mark) & (at(3) == mark) & (at(4) == n))


@dataclass(frozen=True)
class Transducer:
    """States from 0; moves[state, symbol] is the next state and the factor of that step."""

    n_states: int
    moves: dict[tuple[int, int], tuple[int, float]]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The next state and the factor by state and symbol."""
        steps = [[self.step(s, symbol) for symbol in range(7)] for s in range(self.n_states)]
        return np.array([[s for s, _ in row] for row in steps]), np.array([[f for _, f in row] for row in steps])

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.moves.get((state, symbol), (state, 1.0))

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols; a step's factors multiply."""
        moves = {}
        for a, b, symbol in product(range(self.n_states), range(other.n_states), range(7)):
            (x, f), (y, g) = self.step(a, symbol), other.step(b, symbol)
            moves[a * other.n_states + b, symbol] = x * other.n_states + y, f * g
        return Transducer(self.n_states * other.n_states, moves)


class Factors(NamedTuple):
    """What a context multiplies a weight by: below 1 it softens, above 1 it sharpens."""

    negated: float
    aimed_insult: float
    aimed_threat: float
    told: float
    quoted: float


#: Factors before any label is seen, and how far, as the deviation of their logarithms, labels may well lie from them.
PRIOR, SPREAD = Factors(0.4, 1.3, 2.0, 0.8, 0.5), 0.5
#: Words that a negation reaches.
REACH = 3


def _negation(f: Factors) -> Transducer:
    moves = {(s, NEGATION): (REACH, 1.0) for s in range(REACH + 1)}
    for s in range(1, REACH + 1):
        for symbol in (OTHER, TARGET, REPORT, QUOTE):
            moves[s, symbol] = s - 1, 1.0
        for symbol in (INSULT, THREAT):
            moves[s, symbol] = s, f.negated
    return Transducer(REACH + 1, moves)


def _target(f: Factors) -> Transducer:
    return Transducer(2, {(0, TARGET): (1, 1.0), (1, INSULT): (1, f.aimed_insult), (1, THREAT): (1, f.aimed_threat)})


def _report(f: Factors) -> Transducer:
    quoted = {(1, QUOTE): (2, 1.0), (2, QUOTE): (0, 1.0)}
    softened = {(s, symbol): (s, g) for s, g in ((1, f.told), (2, f.quoted)) for symbol in (INSULT, THREAT)}
    return Transducer(3, {(0, REPORT): (1, 1.0), (1, REPORT): (1, 1.0)} | quoted | softened)


def grammar(f: Factors = PRIOR) -> tuple[Transducer, Transducer]:
    """The transducer that reads a clause ahead, and that which reads it from its end, for speech whose report follows it."""
    return _negation(f).compose(_target(f)).compose(_report(f)), _report(f)


#: Passes all weights on as they are.
NEUTRAL = Transducer(1, {}), Transducer(1, {})


def _states(moves: np.ndarray, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step: int) -> np.ndarray:
    """The state in which each symbol is read. All clauses, the longest first, are read at once, from starts on by step."""
    out = np.zeros(len(symbols), np.int64)
    state = np.zeros(len(starts), np.int64)
    for t in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -t, "left"))
        at = starts[:n] + step * t
        out[at] = state[:n]
        state[:n] = moves[state[:n], symbols[at]]
    return out


@dataclass
class Lexicon:
    """Weights of insulting words and stems, by hash, with the fixed words of the grammar."""

    units: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        own = [(word, kind) for kind, text in WORDS.items() for word in text.split()]
        self.fixed = self._table([w for w, _ in own], [k for _, k in own], [1.0] * len(own))
        words = {u: w for u, w in self.units.items() if not u.endswith("*")}
        self.words = self._table(list(words), [INSULT] * len(words), list(words.values()))
        stems = {u[:-1]: w for u, w in self.units.items() if u.endswith("*")}
        self.stems = {n: self._table(x := [s for s in stems if len(s.encode()) == n], [INSULT] * len(x), [stems[s] for s in x]) for n in STEMS}

    @staticmethod
    def _table(words, kinds, weights):
        data = [w.encode() for w in words]
        ends = np.cumsum([0, *map(len, data)]).astype(np.int64)
        h = K.word_hashes(K.lower_ascii(np.frombuffer(b"".join(data), np.uint8)), ends[:-1], ends[1:])
        order = np.argsort(h)
        return h[order], np.array(kinds, np.int8)[order], np.array(weights, float)[order]

    def read(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol and the weight of each word."""
        sums = K.prefix_sums(K.BYTE_VALUE[data])
        kind, weight = np.zeros(len(starts), np.int8), np.zeros(len(starts))

        def put(h, at, table):
            known, kinds, weights = table
            if len(known):
                i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[i] == h
                kind[at[hit]], weight[at[hit]] = kinds[i[hit]], weights[i[hit]]

        every = np.arange(len(starts))
        whole = K.span_hash(sums, starts, ends)
        put(whole, every, self.fixed)
        for n in STEMS:
            at = np.flatnonzero(ends - starts > n)
            put(K.span_hash(sums, starts[at], starts[at] + n), at, self.stems[n])
        put(whole, every, self.words)
        return kind, weight


def letter_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as runs of letters, by mapping every other byte to a space."""
    return K.words(np.where(_LETTER[data], data, 0x20), bounds)


class Hits(NamedTuple):
    """The insults and threats of some texts: text, clause, which of the two, weight, and the states they are read in."""

    row: np.ndarray
    clause: np.ndarray
    symbol: np.ndarray
    weight: np.ndarray
    ahead: np.ndarray
    back: np.ndarray


def hits(text: pa.Array, lexicon: Lexicon, rules: tuple[Transducer, Transducer]) -> Iterator[Hits]:
    moves, behind = (r.tables()[0] for r in rules)
    for first, _, data, bounds in K.chunks(text):
        data = read_signs(data)
        starts, ends, firsts = letter_words(data, bounds)
        kind, weight = lexicon.read(data, starts, ends)
        kind[contracted(data, starts, ends)] = NEGATION
        hot = (kind == INSULT) | (kind == THREAT)
        if not hot.any():
            continue
        stops = np.union1d(np.flatnonzero(_STOP[data]), bounds)
        quotes = np.flatnonzero(_QUOTE[data])
        clauses = np.unique(np.searchsorted(stops, starts[hot], "right"))
        # the words and quote marks of the clauses with a hit, in order
        at = np.concatenate([starts, quotes])
        symbol = np.concatenate([kind, np.full(len(quotes), QUOTE, kind.dtype)]).astype(np.int64)
        weight = np.concatenate([weight, np.zeros(len(quotes))])
        clause = np.searchsorted(stops, at, "right")
        kept = np.flatnonzero(np.isin(clause, clauses))
        kept = kept[np.argsort(at[kept], kind="stable")]
        # other words only end a negation's reach: more of them in a row change no state
        said = symbol[kept] != OTHER
        near = said.copy()
        for k in range(1, REACH + 1):
            near[k:] |= said[:-k]
        kept = kept[near]
        at, symbol, weight, clause = at[kept], symbol[kept], weight[kept], clause[kept]
        _, low, lengths = np.unique(clause, return_index=True, return_counts=True)
        order = np.argsort(-lengths, kind="stable")
        low, lengths = low[order], lengths[order]
        ahead = _states(moves, symbol, low, lengths, 1)
        back = _states(behind, symbol, low + lengths - 1, lengths, -1)
        hit = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
        word = np.searchsorted(starts, at[hit])
        row = first + np.searchsorted(firsts, word, "right") - 1
        yield Hits(row, np.searchsorted(clauses, clause[hit]), symbol[hit], weight[hit], ahead[hit], back[hit])


def text_scores(text: pa.Array, lexicon: Lexicon, rules: tuple[Transducer, Transducer] | None = None) -> np.ndarray:
    """Per text: the sum of its clauses' scores, the largest, and the number of clauses that score."""
    rules = rules or grammar()
    ahead, back = (r.tables()[1] for r in rules)
    out = np.zeros((len(text), 3))
    for h in hits(text, lexicon, rules):
        score = np.bincount(h.clause, h.weight * ahead[h.ahead, h.symbol] * back[h.back, h.symbol])
        row = np.zeros(len(score), np.int64)
        row[h.clause] = h.row
        np.add.at(out[:, 0], row, score)
        np.maximum.at(out[:, 1], row, score)
        np.add.at(out[:, 2], row, score > 0)
    return out


def contexts(text: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, context, weight): the weights of each text's hits, summed by the states and the symbol they are read with."""
    rules = grammar()
    n = rules[0].n_states * rules[1].n_states * 2
    found = [np.bincount(h.row * n + (h.ahead * rules[1].n_states + h.back) * 2 + (h.symbol == THREAT), h.weight) for h in hits(text, lexicon, rules)]
    total = np.zeros(len(text) * n)
    for f in found:
        total[: len(f)] += f
    at = np.flatnonzero(total)
    return at // n, at % n, total[at]


def context_logs() -> np.ndarray:
    """By context and factor: the power of the factor that the context multiplies a weight by."""
    columns = []
    for k in range(len(PRIOR)):
        ahead, back = (np.log(r.tables()[1][:, [INSULT, THREAT]]) for r in grammar(Factors(*[np.e if i == k else 1.0 for i in range(len(PRIOR))])))
        columns.append((ahead[:, None, :] + back[None, :, :]).ravel())
    return np.stack(columns, axis=1)


def fitted_factors(row: np.ndarray, context: np.ndarray, weight: np.ndarray, y: np.ndarray, steps: int = 60) -> Factors:
    """The likeliest factors, given labels y of texts and their contexts.

    A text's logit is linear in log(1 + its score). Logarithms of factors have a normal prior
    about those of PRIOR and keep their sign: what softens never sharpens.
    """
    logs, prior = context_logs()[context], np.log(PRIOR)
    centre = np.concatenate([[0.0, 0.0], prior])
    pull = np.concatenate([[1e-2, 1e-2], np.full(len(prior), SPREAD**-2)])

    def at(v):
        raised = weight * np.exp(logs @ v[2:])
        score = np.bincount(row, raised, len(y))
        slopes = np.stack([np.bincount(row, raised * logs[:, k], len(y)) for k in range(len(prior))], axis=1)
        z = np.clip(v[0] + v[1] * np.log1p(score), -30, 30)
        loss = np.logaddexp(0, z).sum() - z @ y + (pull * (v - centre) ** 2).sum() / 2
        return loss, z, np.hstack([np.ones((len(y), 1)), np.log1p(score)[:, None], v[1] * slopes / (1 + score)[:, None]])

    v, size = centre.copy(), 1.0
    loss, z, x = at(v)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        new = v + size * np.linalg.solve(h, x.T @ (y - p) - pull * (v - centre))
        new[2:] = np.where(prior < 0, np.minimum(new[2:], 0.0), np.maximum(new[2:], 0.0))
        tried = at(new)
        if tried[0] > loss:
            size /= 2
            continue
        done = loss - tried[0] < 1e-9
        v, (loss, z, x), size = new, tried, min(1.0, 2 * size)
        if done:
            break
    return Factors(*np.exp(v[2:]).tolist())


def _units(batches):
    """Counts, over the texts of a batch, of the words and stems that a text has."""
    for batch in batches:
        counts = (Counter(), Counter())
        for y, text in zip(batch.column("y").to_pylist(), batch.column("text"), strict=True):
            data = read_signs(np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8))
            starts, ends, _ = letter_words(data, np.array([0, len(data)]))
            raw = data.tobytes()
            own = {raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)}
            own |= {w[:n] + b"*" for w in own for n in STEMS if len(w) > n}
            counts[y].update(own)
        units = list(counts[0] | counts[1])
        names = [u.decode("utf-8", "replace") for u in units]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][u] for u in units], pa.int64()), pa.array([counts[0][u] for u in units], pa.int64())], ["unit", "pos", "neg"])


def _least_shingle(batches):
    for batch in batches:
        least = np.zeros(len(batch), np.uint64)
        for first, last, h, firsts in shingles(batch.column("text"), 5):
            some = np.flatnonzero(np.diff(firsts) > 0)
            least[first + some] = h[firsts[some]]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(K.as_signed(least))], ["doc_id", "text", "y", "family"])


@dataclass
class Model:
    lexicon: Lexicon
    scale: np.ndarray
    weights: np.ndarray
    factors: Factors = PRIOR

    def features(self, text: pa.Array) -> np.ndarray:
        return text_scores(text, self.lexicon, grammar(self.factors))

    def probability(self, features: np.ndarray) -> np.ndarray:
        x = np.log1p(features) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights (first the constant) of a ridge logistic fit, by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Learns lexicon, factors and calibration from at most so many labelled training rows.

    Near copies (texts whose smallest shingle hash agrees) count once, so that a passage that
    was copied often is not taken for an insult.
    """
    sample = labelled_sample(docs, labels, "toxic", most).select("doc_id", "text", "y")
    sample = sample.mapInArrow(_least_shingle, "doc_id long, text string, y int, family long")
    sample = sample.groupBy("family").agg(F.min(F.struct("doc_id", "y", "text")).alias("r")).select("r.doc_id", "r.text", "r.y")
    sample = sample.cache()
    try:
        n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
        pos, neg = n.get(1, 0), n.get(0, 0)
        units = sample.mapInArrow(_units, "unit string, pos long, neg long").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        odds = (F.col("pos") + 0.5) / (pos + 1) / ((F.col("neg") + 0.5) / (neg + 1))
        units = units.where(~F.col("unit").contains("\ufffd")).where(F.col("pos") >= max(SUPPORT, SHARE * pos)).withColumn("w", F.log(odds)).where(F.col("w") >= float(np.log(ODDS)))
        found = units.orderBy(F.desc("pos"), F.desc("w"), "unit").collect()
        lexicon = Lexicon({r["unit"]: r["w"] for r in found})

        def read(batches):
            for batch in batches:
                row, context, weight = contexts(batch.column("text"), lexicon)
                ends = np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (context, weight)]
                yield pa.RecordBatch.from_arrays([batch.column("y"), *lists], ["y", "context", "weight"])

        seen = sample.mapInArrow(read, "y int, context array<long>, weight array<double>").toArrow().combine_chunks()
        y = seen.column("y").to_numpy().astype(float)
        factors = PRIOR
        if pos and neg:
            lists = [seen.column(c).combine_chunks() for c in ("context", "weight")]
            row = np.repeat(np.arange(len(y)), lists[0].value_lengths().to_numpy())
            factors = fitted_factors(row, *(v.flatten().to_numpy() for v in lists), y)
        rules = grammar(factors)

        def features(batches):
            for batch in batches:
                f = text_scores(batch.column("text"), lexicon, rules)
                yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array(np.ascontiguousarray(f[:, i])) for i in range(3))], ["y", "a", "b", "c"])

        rows = np.array([tuple(r) for r in sample.mapInArrow(features, "y int, a double, b double, c double").collect()], float).reshape(-1, 4)
    finally:
        sample.unpersist()
    x = np.log1p(rows[:, 1:])
    scale = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(3)
    if not pos or not neg:
        return Model(lexicon, scale, np.array([2.0 if pos else -2.0, 0, 0, 0]), factors)
    return Model(lexicon, scale, logistic(x / scale, rows[:, 0]), factors)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score in [0, 1] and n_clauses, the clauses that carry it; both columns are replaced."""
    names = [c for c in docs.columns if c not in ("score", "n_clauses")]
    docs = docs.select([F.col(f"`{c}`") for c in names])

    def run(batches):
        for batch in batches:
            f = model.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.probability(f)), pa.array(f[:, 2].astype(np.int64))], [*names, "score", "n_clauses"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("n_clauses", LongType())]))


def judged(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_clauses) of every row of docs.

    Null and empty texts have no clause and get the score of such texts; rows that repeat a
    doc_id are scored each; a null doc_id is scored and not held out. Without any usable
    label the lexicon is empty and all texts get one score.
    """
    model = train(docs, labels, most)
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")


def keep_civil(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, as they are; nothing of docs is shuffled."""
    model = train(docs, labels, most)

    def run(batches):
        for batch in batches:
            f = model.features(batch.column("text"))
            yield batch.filter(pa.array(model.probability(f) < threshold))

    return docs.mapInArrow(run, docs.schema)
