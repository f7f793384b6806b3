"""Evaluation of classifiers: metrics, frequencies, gates, quotas, splits, term weights, reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.text import normalise
from .sinks import placed


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("accuracy"))


def class_scores(pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(label, precision, recall, f1, support) for each label in order, one pass over pairs (gold, pred).

    A label that never occurs scores 0; predictions outside the labels only miss.
    """
    counts = []
    for x in labels:
        counts += [F.count_if((F.col("gold") == x) & (F.col("pred") == x)).alias(f"tp_{x}"), F.count_if(F.col("gold") == x).alias(f"gold_{x}"), F.count_if(F.col("pred") == x).alias(f"pred_{x}")]
    rows = pairs.agg(*counts).select(F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(x).alias("label"), F.col(f"tp_{x}").alias("tp"), F.col(f"gold_{x}").alias("support"), F.col(f"pred_{x}").alias("said")) for i, x in enumerate(labels)])).alias("r")).select("r.*")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = rows.withColumn("precision", share(F.col("tp"), F.col("said"))).withColumn("recall", share(F.col("tp"), F.col("support")))
    return out.withColumn("f1", share(2 * F.col("tp"), F.col("support") + F.col("said"))).select("label", "precision", "recall", "f1", "support")


def macro_f1(pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    return class_scores(pairs, labels).agg(F.avg("f1").alias("macro_f1"))


def confusion(pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """A row for each gold label seen, a column for each predicted one; others are dropped."""
    return pairs.where(F.col("gold").isin(*labels)).groupBy("gold").agg(*[F.count_if(F.col("pred") == x).alias(x) for x in labels])


def majority(rows: DataFrame, column: str, order: str) -> DataFrame:
    """The most frequent value; of equals the one first seen."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(1).select(column, "n")


def frequencies(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of every value of every column, one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("p")).select("p.*").groupBy("field", "value").agg(F.count("*").alias("n"))


def class_weights(rows: DataFrame, column: str, classes: int) -> DataFrame:
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select(column, (F.col("total") / (F.lit(classes) * F.col("n"))).alias("weight"))


def error_examples(pairs: DataFrame, order: str, most: int = 6, width: int = 90) -> DataFrame:
    """The first disagreements in order, line ends as spaces, cut to a width."""
    shown = F.substring(F.regexp_replace("text", "\n", " "), 1, width)
    return pairs.where(F.col("gold") != F.col("pred")).orderBy(order).limit(most).select(order, "gold", "pred", shown.alias("example"))


def agrees(spec: str, pred: str, gate: tuple[str, ...] = ("category", "sentiment")) -> Column:
    """Whether a prediction equals its target on all fields of the gate; a NULL does not."""
    out = F.lit(True)
    for g in gate:
        out = out & F.coalesce(F.col(f"{spec}.{g}") == F.col(f"{pred}.{g}"), F.lit(False))
    return out


def gate_rates(rows: DataFrame, kept: Column, priority_agrees: Column) -> DataFrame:
    r = rows.agg(F.count("*").alias("generated"), F.count_if(kept).alias("kept"), F.count_if(kept & priority_agrees).alias("agreed"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return r.select("generated", "kept", share("kept", "generated").alias("kept_rate"), share("agreed", "kept").alias("priority_rate"))


def quota(rows: DataFrame, cell: list[str], order: str, most: int) -> DataFrame:
    """The first so many rows of each cell in order."""
    n = F.row_number().over(Window.partitionBy(*cell).orderBy(order))
    return rows.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def stratified_split(rows: DataFrame, stratum: str, key: Column, share: float = 0.15) -> DataFrame:
    """rows with split: the first share of each stratum in order of key, one at least, validates."""
    sizes = rows.groupBy(F.col(stratum).alias("__s")).agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("__most"))
    ranked = placed(rows.withColumn("__key", key), "__key", "__place", stratum)
    met = ranked.join(sizes, F.col(stratum).eqNullSafe(F.col("__s")))
    return met.withColumn("split", F.when(F.col("__place") <= F.col("__most"), "validation").otherwise("train")).select(*rows.columns, "split")


def unseen(rows: DataFrame, seen: DataFrame, column: str, within: bool = True, order: str | None = None) -> DataFrame:
    """Rows whose normalised text is not seen, and (within) not that of an earlier row."""
    keyed = rows.withColumn("__key", normalise(F.col(column)))
    fresh = keyed.join(seen.select(normalise(F.col(column)).alias("__key")).distinct(), "__key", "left_anti")
    if within:
        fresh = fresh.groupBy("__key").agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    return fresh.select(rows.columns)


def spec_grid(spark: SparkSession, n: int, priorities: tuple[str, ...], sentiments: tuple[str, ...], split: str = "train") -> DataFrame:
    """n specifications that cycle through all combinations, with running ids."""
    cells = [(p, s) for p in priorities for s in sentiments]
    of = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in cells]), (F.col("id") % len(cells) + 1).cast("int"))
    return spark.range(n).select(F.format_string(f"syn-{split}-%05d", "id").alias("spec_id"), of(0).alias("priority"), of(1).alias("sentiment"))


def _words(column: str) -> Column:
    """The words of a text of two letters or more, lower-case, joined by spaces."""
    return F.array_join(F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 1), " ")


def _counted(docs: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(keys, key, term, tf: the numbers of each key's terms; words, first, second: the terms as words).

    A term is a place among the block's terms in order, which does not depend on the order of its texts.
    A term of one word has no second.
    """
    encoded = docs.column("key").combine_chunks().dictionary_encode(null_encoding="encode")
    texts = docs.column("words").combine_chunks()
    split = pc.split_pattern(pc.if_else(pc.equal(texts, ""), pa.scalar(None, texts.type), texts), " ")
    row, flat = pc.list_parent_indices(split).to_numpy(), split.flatten().dictionary_encode()
    order = pc.array_sort_indices(flat.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    word, n = place[flat.indices.to_numpy()], len(order)
    near = row[1:] == row[:-1]
    key = encoded.indices.to_numpy().astype(np.int64)[row]
    codes, place = np.unique(np.concatenate([word, (word[:-1][near] + 1) * n + word[1:][near]]), return_inverse=True)
    pair, tf = np.unique(np.concatenate([key, key[:-1][near]]) * max(len(codes), 1) + place, return_counts=True)
    single = codes < n
    first, second = np.where(single, codes, codes // max(n, 1) - 1), np.where(single, -1, codes % max(n, 1))
    return encoded.dictionary, pair // max(len(codes), 1), pair % max(len(codes), 1), tf, flat.dictionary.take(pa.array(order)), first, second


def _spelt(words: pa.Array, first: np.ndarray, second: np.ndarray) -> pa.Array:
    pair = pa.array(second, mask=second < 0)
    return pc.coalesce(pc.binary_join_element_wise(words.take(pa.array(first)), words.take(pair), " "), words.take(pa.array(first)))


def _asked_terms(docs: pa.Table) -> pa.Table:
    """(block, place, term, c): each term of a block of texts, and how many of those that are learned from have it."""
    keys, key, term, _, words, first, second = _counted(docs)
    learned = pc.is_in(keys, docs.filter(docs.column("learned")).column("key").combine_chunks()).to_numpy(zero_copy_only=False)
    c = np.bincount(term, learned[key], len(first)).astype(np.int32)
    return pa.table([pa.array(np.repeat(np.int32(docs.column("block")[0].as_py()), len(c))), pa.array(np.arange(len(c), dtype=np.int32)), _spelt(words, first, second), pa.array(c)], names=["block", "place", "term", "c"])


def _weigh(most: int | None):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        keys, key, term, tf, words, first, second = _counted(docs)
        idf = np.full(len(first), np.nan)
        idf[known.column("place").to_numpy()] = known.column("idf").to_numpy()
        held = ~np.isnan(idf[term])
        key, term, tf = key[held], term[held], tf[held]
        w = (1 + np.log(tf)) * idf[term]
        w /= np.sqrt(np.bincount(key, w * w, len(keys)))[key]
        if most:
            order = np.lexsort((-w, key))
            sizes = np.bincount(key, minlength=len(keys))
            last = np.cumsum(sizes) - sizes + np.minimum(sizes, most) - 1
            # what may round to the weight of the last comes too
            held = w >= np.where(sizes > 0, w[order][np.maximum(last, 0)], 0)[key] - 1e-8 if len(w) else np.zeros(0, bool)
            key, term, w = key[held], term[held], w[held]
        return pa.table([keys.take(pa.array(key)), _spelt(words, first[term], second[term]), pa.array(w)], names=["key", "term", "weight"])

    return run


def tfidf(rows: DataFrame, key: str, column: str, min_df: int = 2, learned: Column | None = None, most: int | None = None, block: int = 8 << 20) -> DataFrame:
    """(key, term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1) of word one- and two-grams in min_df texts or more, of unit length.

    n and df count the rows that are learned, all unless told. With most, only each text's so many
    heaviest terms, and what rounds to the weight of the last of them.

    Texts are dealt by key into blocks of about so many letters, whose terms are counted and weighed where the texts
    are. A block asks for the df of each of its terms once and is told of those in min_df texts, so what is shuffled
    is the texts and the terms of blocks, not those of texts.
    """
    known = rows.withColumn("__learned", F.lit(True) if learned is None else F.coalesce(learned, F.lit(False)))
    n, letters = known.agg(F.count_if("__learned"), F.sum(F.length(column))).first()
    # small inputs are cut smaller, so that all tasks have a part
    blocks = max(-(-(letters or 1) // block), min(-(-8 * (letters or 1) // block), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = known.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), F.col(key).alias("key"), F.col("__learned").alias("learned"), _words(column).alias("words")).repartition(blocks, "block")
    asked = dealt.groupBy("block").applyInArrow(_asked_terms, "block int, place int, term string, c int").repartition(blocks, "term")
    told = asked.withColumn("df", F.sum("c").over(Window.partitionBy("term"))).where(F.col("df") >= min_df).select("block", "place", (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
    kind = dealt.schema["key"].dataType
    weighed = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_weigh(most), StructType([StructField("key", kind), StructField("term", StringType()), StructField("weight", DoubleType())]))
    return weighed.select(F.col("key").alias(key), "term", "weight")


def keyphrases(rows: DataFrame, key: str, column: str, most: int = 5) -> DataFrame:
    """(key, rank, term): the heaviest terms of each text, in place of a model's ranking."""
    best = Window.partitionBy(key).orderBy(F.desc(F.round("weight", 9)), "term")
    return tfidf(rows, key, column, most=most).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select(key, "rank", "term")


def report(title: str, scores: dict[str, DataFrame], matrix: dict[str, DataFrame]) -> str:
    """A Markdown report of tables with a row for each label."""
    out = [f"# {title}", ""]
    for kind in (scores, matrix):
        for name, df in kind.items():
            rows = df.collect()
            out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
            out += ["| " + " | ".join(f"{v:.2f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows] + [""]
    return "\n".join(out)
