"""Toxicity by a chain of linear classifiers.

Categories are predicted in a fixed order. The model of a category sees the
words of a text and the probabilities of the earlier categories; in training
those are out-of-fold predictions, so a later model learns from
probabilities as unsure as it will meet. Scoring is narrow: one pass over
whole texts with a bounded table of word weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import read
from tesserae.llm.tokens import texts_of

#: At most so many labelled rows train the chain, those with the smallest hashes; it is fitted in this many folds.
SAMPLE, FOLDS = 8_000, 3
#: A word, or a beginning of words, enters the vocabulary if so many texts of the sample hold it and its chi-squared with a category reaches TELLING; at most so many do.
LEAST_TEXTS, TELLING, VOCABULARY = 4, 15.0, 4096
#: Bytes of the beginnings, which stand for the words that are built on them.
BEGINNINGS = (4, 5, 6)
#: Strength of the penalty on weights, and steps of the fit.
PENALTY, STEPS = 0.3, 150

#: Bytes of the longest text that trains.
LONGEST = 1 << 16

#: Log odds of a category that no label tells of: nothing is in it.
UNKNOWN = -30.0

#: Lower case for A to Z; white space for other ASCII characters than letters and digits.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def features_of(text: bytes | None) -> list[set[bytes]]:
    """Distinct words of a text in lower case, and for each length of BEGINNINGS the beginnings of the longer ones."""
    words = set((text or b"").translate(PLAIN).split())
    return [words, *({w[:n] for w in words if len(w) > n} for n in BEGINNINGS)]


def sigmoid(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Chain:
    """Linear models of categories; weights[k][w] holds the weights of feature w of kind k (words, then beginnings)."""

    def __init__(self, names: list[str]):
        self.names = names
        self.weights: list[dict[bytes, np.ndarray]] = [{} for _ in range(1 + len(BEGINNINGS))]
        self.bias = np.full(len(names), UNKNOWN)
        self.earlier = np.zeros((len(names), len(names)))  # [later, earlier], on probabilities

    def scores(self, texts, n: int) -> np.ndarray:
        """Probability of each category for each of n texts; of a text without words, 0."""
        out, zero = np.zeros((n, len(self.names))), np.zeros(len(self.names))
        for k, text in enumerate(texts):
            features = features_of(text)
            if not features[0]:
                out[k] = -np.inf
                continue
            for weights, found in zip(self.weights, features):
                out[k] += sum((weights[w] for w in sorted(weights.keys() & found)), zero)
        return self.chained(out)

    def chained(self, sums: np.ndarray) -> np.ndarray:
        """Probabilities from the sums of word weights, category by category."""
        p = np.zeros(sums.shape)
        for c in range(len(self.names)):
            p[:, c] = sigmoid(sums[:, c] + self.bias[c] + p @ self.earlier[c])
        return p


class Sparse:
    """Binary matrix of texts by words, as positions."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int]):
        self.rows, self.columns, self.shape = rows, columns, shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.columns], self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, r[self.rows], self.shape[1])


def fit_linear(x: Sparse, extra: np.ndarray, y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Penalized logistic regression on the rows of use: weights of words, of extra columns, and bias.

    Accelerated gradient steps, each coordinate scaled by a bound of its
    curvature.
    """
    n_words, y, use = x.shape[1], y.astype(float), use.astype(float)
    length = 1 + np.bincount(x.rows, minlength=x.shape[0]) + np.abs(extra).sum(axis=1)
    bound_w = PENALTY + x.back(0.25 * use * length)
    bound_e = PENALTY + (0.25 * use * length) @ np.abs(extra) if extra.shape[1] else np.zeros(0)
    bound_b = (0.25 * use * length).sum() + 1e-9
    w, e, b = np.zeros(n_words), np.zeros(extra.shape[1]), 0.0
    vw, ve, vb, t = w, e, b, 1.0
    for _ in range(STEPS):
        z = x.dot(vw) + extra @ ve + vb
        r = use * (sigmoid(z) - y)
        nw, ne, nb = vw - (x.back(r) + PENALTY * vw) / bound_w, ve - (r @ extra + PENALTY * ve) / bound_e if len(ve) else ve, vb - r.sum() / bound_b
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, ve, vb = nw + (t - 1) / s * (nw - w), ne + (t - 1) / s * (ne - e), nb + (t - 1) / s * (nb - b)
        w, e, b, t = nw, ne, nb, s
    return w, e, b


def fit_chain(texts: list[bytes], labels: np.ndarray, names: list[str], folds: int = FOLDS) -> Chain:
    """Fits the chain; labels[text, category] is 0, 1 or nan (unknown, not learned from)."""
    chain = Chain(names)
    codes: dict[tuple, int] = {}
    columns = [[codes.setdefault((kind, w), len(codes)) for kind, found in enumerate(features_of(t)) for w in found] for t in texts]
    rows = np.repeat(np.arange(len(texts)), [len(c) for c in columns])
    columns = np.array([c for row in columns for c in row], np.int64)
    known, positive = np.isfinite(labels), np.nan_to_num(labels)
    # chi-squared of each feature with each category
    chi = np.zeros(len(codes))
    for c in range(len(names)):
        holds = np.bincount(columns, known[rows, c], len(codes))
        hits = np.bincount(columns, positive[rows, c], len(codes))
        rate, n = positive[:, c].sum() / max(1, known[:, c].sum()), known[:, c].sum()
        spread = holds * rate * (1 - rate) * (1 - holds / max(1, n))
        chi = np.maximum(chi, np.where((holds >= LEAST_TEXTS) & (spread > 0), (hits - holds * rate) ** 2 / np.maximum(spread, 1e-9), 0))
    features = list(codes)
    order = sorted(np.flatnonzero(chi >= TELLING).tolist(), key=lambda k: (-chi[k], features[k]))
    vocabulary = sorted(features[k] for k in order[:VOCABULARY])
    place = np.full(len(codes), -1)
    place[[codes[f] for f in vocabulary]] = np.arange(len(vocabulary))
    columns = place[columns]
    rows, columns = rows[columns >= 0], columns[columns >= 0]
    x = Sparse(rows, columns, (len(texts), len(vocabulary)))
    fold = np.arange(len(texts)) % folds
    p = np.zeros((len(texts), 0))
    weights = np.zeros((len(vocabulary), len(names)))
    for c in range(len(names)):
        y, use = positive[:, c], known[:, c]
        weights[:, c], e, chain.bias[c] = fit_linear(x, p, y, use)
        chain.earlier[c, : len(e)] = e
        if not use.any():
            chain.bias[c] = UNKNOWN
        held = np.zeros(len(texts))
        if c + 1 < len(names):
            for f in range(folds):
                w, e, b = fit_linear(x, p, y, use & (fold != f))
                held[fold == f] = sigmoid(x.dot(w) + p @ e + b)[fold == f]
        p = np.hstack([p, held[:, None]])
    for k, (kind, w) in enumerate(vocabulary):
        chain.weights[kind][w] = weights[k]
    return chain


def train(docs: DataFrame, labels: DataFrame, names: list[str], sample: int = SAMPLE, longest: int = LONGEST) -> Chain:
    """Fits the chain on a bounded sample of labelled documents.

    labels: doc_id and a column of 0, 1 or null for each name; a document
    with several rows counts as positive if any says so. The sample: of the
    labelled ids the `sample` with the smallest hashes, and their texts of
    `longest` bytes at most, so one task can fit it. A category without
    labels in the sample has probability 0 for every text, so a chain that
    ends in it rejects nothing.
    """
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(*(F.max(n).cast("double").alias(n) for n in names))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= longest).join(chosen, "doc_id").select("doc_id", "text", *names)

    def fit(batches):
        import pickle

        batches = [b for b in batches if b.num_rows]
        if batches:
            table = pa.Table.from_batches(batches).sort_by([("doc_id", "ascending"), ("text", "ascending")])
            y = np.array([table[n].to_pylist() for n in names], float).T.reshape(-1, len(names))
            chain = fit_chain(list(texts_of(table["text"])), y, names)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(chain)], pa.binary())], names=["chain"])

    import pickle

    row = rows.repartition(1).mapInArrow(fit, "chain binary").first()
    return pickle.loads(row[0]) if row else Chain(names)


def toxicity(docs: DataFrame, chain: Chain, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores whole texts.

    Returns one row for each input row: id_col, p_<name> for each category in
    the order of the chain, and rejected (the last category's probability
    reaches threshold). A null text counts as empty; a text without words
    has probability 0 of all categories. Rows with null or
    repeated ids are scored like any other; other columns are not read.
    """
    rows = docs.select(F.col(id_col), F.col(text_col))
    names = [f"p_{n}" for n in chain.names]

    def score(batches):
        for batch in batches:
            p = np.round(chain.scores(texts_of(batch.column(1)), batch.num_rows), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(len(names))), pa.array(p[:, -1] >= threshold)], names=[id_col, *names, "rejected"])

    return rows.mapInArrow(score, f"`{id_col}` {rows.dtypes[0][1]}, {', '.join(f'`{n}` double' for n in names)}, rejected boolean")


def without_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text isn't rejected; texts without words, null ones too, stay."""

    @F.arrow_udf("double")
    def last(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.round(chain.scores(texts_of(texts), len(texts))[:, -1], 6))

    return docs.filter(last(text_col) < threshold)


def train_on_labels(spark, docs: DataFrame, sf_dir: str) -> Chain:
    """The chain of the two categories that `labels` knows: low quality, then toxic."""
    labels = read(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return train(docs, labels, ["low_quality", "toxic"])


def op5_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity(docs, train_on_labels(spark, docs, sf_dir)).withColumnRenamed("rejected", "toxic")
