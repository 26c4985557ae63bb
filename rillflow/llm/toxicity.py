"""Toxicity by a counterfactual-regularised linear classifier.

Features are the words (letters and digits, A-Z lower-cased) that go with either
label, and all identity terms. The training loss is the log loss, a ridge, and
the mean squared change of the score (before the logistic function) when an
identity term of a labelled text is swapped for another of its group; so a
mention of a group by itself moves a score little.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.storage import written
from rillflow.llm.wordhash import PUNCTUATION, U64, WordHasher, Words, chunks, string_buffers

#: Identity terms by group; terms of a group are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african"),
    ("gay", "straight", "lesbian", "transgender", "bisexual"),
    ("old", "young", "disabled", "deaf", "blind"),
    ("immigrants", "natives", "refugees", "foreigners"),
)


#: At most about so many labelled rows are learnt from.
MAX_ROWS = 20000


def word_hashes(words: list[str]) -> np.ndarray:
    """The hash of each word; used for lists of terms."""
    data, offsets = string_buffers(pa.array(words, pa.string()))
    return WordHasher(29, lower=True).words(data, offsets[:-1], offsets[1:])


def present(column: pa.Array, wanted: np.ndarray | None = None):
    """Yield (first row, rows, row of each, hash or index in the sorted `wanted`): the distinct words of each text."""
    hasher = WordHasher(29, lower=True)
    data, offsets = string_buffers(column)
    for a, b in chunks(offsets):
        words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], PUNCTUATION)
        value, doc = hasher.words(words.data, words.starts, words.ends), words.doc_of_word()
        if wanted is not None:
            at = np.minimum(np.searchsorted(wanted, value), max(0, len(wanted) - 1))
            hit = np.flatnonzero(wanted[at] == value) if len(wanted) else at[:0]
            key = np.unique(doc[hit] * max(1, len(wanted)) + at[hit])
            yield a, b - a, key // max(1, len(wanted)), key % max(1, len(wanted))
        else:
            order = np.lexsort((value, doc))
            doc, value = doc[order], value[order]
            new = np.append(True, (np.diff(doc) != 0) | (value[1:] != value[:-1]))[: len(doc)]
            yield a, b - a, doc[new], value[new]


class Model:
    """Weights of sorted word hashes and a bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for a, n, row, index in present(column, self.features):
            out[a : a + n] += np.bincount(row, self.weights[index], n)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def swaps(row: np.ndarray, index: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) features of each swap of one identity term in a text for a term of its group that the text lacks."""
    group_of = {int(t): g for g in groups for t in g}
    has = set(zip(row.tolist(), index.tolist()))
    pairs = [(t, int(u)) for r, t in sorted(has) if t in group_of for u in group_of[t] if (r, int(u)) not in has]
    return (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), ())))


def fit(row: np.ndarray, index: np.ndarray, label: np.ndarray, n_features: int, groups: list[np.ndarray], ridge: float = 1e-5, swap_penalty: float = 1.0, steps: int = 800) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam; texts are (row, index) pairs of present features."""
    n = len(label)
    weights, bias = np.zeros(n_features), float(np.log((label.sum() + 1) / (n - label.sum() + 1)))
    old, new = swaps(row, index, groups)
    first, second = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        score = bias + np.bincount(row, weights[index], n)
        error = (1 / (1 + np.exp(-np.clip(score, -500, 500))) - label) / n
        slope = np.bincount(index, error[row], n_features) + ridge * weights
        if len(old):
            change = 2 * swap_penalty * (weights[old] - weights[new]) / len(old)
            slope += np.bincount(old, change, n_features) - np.bincount(new, change, n_features)
        slope = np.append(slope, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    return weights, bias


def train(texts: DataFrame, max_rows: int = MAX_ROWS, max_features: int = 4000, least_docs: int = 3, identity_terms=IDENTITY_TERMS, **options) -> Model:
    """A model from `texts` (doc_id, text, label 0 or 1).

    At most about `max_rows` rows are used, those with the smallest hashes of
    doc_id; further data change nothing but which they are. Of the words in at
    least `least_docs` of them, the `max_features` that lean most clearly
    towards a label are features. Without rows every score is 0; with one label
    only it is that label's smoothed share.
    """
    texts = bounded(texts, max_rows)
    n, positive = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n:
        return Model(np.zeros(0, U64), np.zeros(0), -500.0)

    def words(batches):
        for batch in batches:
            for a, _, row, value in present(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), batch.column(1).take(pa.array(row + a))], names=["word", "label"])

    counts = texts.select("text", F.col("label").cast("int").alias("label")).mapInArrow(words, "word long, label int").groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").cast("double").alias("k")).where(F.col("n") >= least_docs)
    share = positive / n
    # How far the word's count of label 1 is from the expected one, in standard deviations.
    lean = F.abs(F.col("k") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share) + 1e-9) + 1.0)
    best = counts.select("word", lean.alias("lean")).where("lean >= 3").orderBy(F.desc("lean"), "word").limit(max_features).collect()
    terms = [word_hashes(list(group)) for group in identity_terms]
    features = np.unique(np.concatenate([np.array([r["word"] for r in best], np.int64).view(U64), *terms]))

    def indices(batches):
        for batch in batches:
            for a, rows, row, index in present(batch.column(0), features):
                first = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, rows), pa.ListArray.from_arrays(pa.array(first), pa.array(index.astype(np.int32)))], names=["label", "features"])

    # max_rows texts of some tens of features.
    got = texts.select("text", F.col("label").cast("int").alias("label"), "doc_id").orderBy("doc_id").drop("doc_id").mapInArrow(indices, "label int, features array<int>").toArrow()
    lists = got.column("features").combine_chunks()
    label = np.asarray(got.column("label").combine_chunks()).astype(float)
    index = np.asarray(lists.flatten()).astype(np.int64)
    row = np.repeat(np.arange(len(label)), np.diff(np.asarray(lists.offsets)))
    groups = [np.searchsorted(features, t) for t in terms]
    return Model(features, *fit(row, index, label, len(features), groups, **options))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, score) of all rows, whole texts; a null text scores as an empty one, further columns are left out."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.scores(batch.column(1)))], names=["doc_id", "text", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text string, score double")


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """`docs`, all columns, without the documents that score `limit` or more.

    Each row is judged by its whole text alone: repeated rows go or stay together, a null text
    is empty, and an id may be null.
    """

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column("text")) < limit))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id) -> F.Column:
    """Rows that are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents; the model learns from labelled rows that aren't held out.

    Takes doc_id and text of `docs`, doc_id and toxic of `labels`; further
    columns are ignored and no input of a score. A null text is empty; empty
    texts score by the bias. A null doc_id is not held out. Rows with a null
    label are not learnt from. Repeated rows give repeated results; an empty
    table gives none.
    """
    model = train(training_rows(docs, labels), **options)
    scored = score_documents(docs, model).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, label) of the labelled documents that aren't held out, as a table that is written once.

    Of more than `max_rows` labels, about so many are taken, those with the
    smallest hashes of doc_id. So the labels are small enough for every executor,
    and the documents are read once and not shuffled. A doc_id with both labels
    is toxic; rows with a null id or label are left out; a null text is empty.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    known = written(known.where(~held_out(F.col("doc_id"))), "labels", narrow=True)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return written(texts.join(F.broadcast(bounded(known, max_rows)), "doc_id"), "training-rows", narrow=True)


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """`rows`, or about `most` of them: those with the smallest hashes of doc_id."""
    total = rows.count()
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**32)) < int(most / total * 2**32)) if total > most else rows
