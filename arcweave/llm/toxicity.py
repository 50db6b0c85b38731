"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each has a logistic model on hashed features of a text (its distinct
words and their first four and five letters) and on the log-odds of the categories before it. A later model is trained
on out-of-fold log-odds of the earlier ones, so it meets them as it will on unseen texts. The categories at hand are
the labels' low quality, then toxicity; any list of 0/1 label columns will do.

The chain is fitted in one task on at most SAMPLE labelled documents (by hash of doc_id) with at most SAMPLE_FEATURES
features in all (a document that would exceed them is passed over); both are parameters. Everything else - scoring every document - is a map over all rows with the model broadcast, whose size
is fixed by BITS.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm.store import by_place, gives_back, held_schema, named, table

SAMPLE = 6_000
SAMPLE_FEATURES = 8_000_000
BITS = 18
FOLDS = 3
#: Features whose shrunk log-odds ratio is smaller carry no evidence and are left out of a model.
LEAST_RATIO = 0.1
MEMO_WORDS = 250_000
CATEGORIES = ("low_quality", "toxic")
_NORMAL = bytes(c if 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


class _WordFeatures(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        letters = word.decode("utf-8", "replace")
        names = (word, b"4" + letters[:4].encode(), b"5" + letters[:5].encode())
        value = self[word] = np.array([zlib.crc32(x) >> (32 - BITS) for x in names], np.int32).tobytes()
        return value


def features(text: bytes | None, memo: dict) -> np.ndarray:
    words = set(text.translate(_NORMAL).split()) if text else ()
    if not words:
        return np.empty(0, np.int32)
    return np.unique(np.frombuffer(b"".join(map(memo.__getitem__, words)), np.int32))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class _Rows:
    """Feature lists as one array with row pointers."""

    def __init__(self, lists: Sequence[np.ndarray], only: np.ndarray | None = None):
        if only is not None:
            lists = [x[only[x]] for x in lists]
        self.lists = lists
        self.at = np.concatenate(lists) if len(lists) else np.empty(0, np.int32)
        self.length = np.array([len(x) for x in lists], np.int64)
        self.row = np.repeat(np.arange(len(lists)), self.length)
        self.n = len(lists)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n)

    def transposed_dot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, g[self.row], 1 << BITS)


class LinearModel:
    """Logistic regression on features scaled by their shrunk log-odds ratio; `chain` are the earlier log-odds."""

    def __init__(self, rows: _Rows, chain: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50):
        share = min(max(y.mean(), 1 / (len(y) + 1)), 1 - 1 / (len(y) + 1)) if len(y) else 0.5
        ones, every = rows.transposed_dot(y), rows.transposed_dot(np.ones(rows.n))
        ratio = np.log((ones + 5 * share) / (every - ones + 5 * (1 - share))) - np.log(share / (1 - share))
        scale = np.where((every > 1) & (np.abs(ratio) >= LEAST_RATIO), ratio, 0)
        rows = _Rows(rows.lists, scale != 0)
        dense = np.c_[np.ones(rows.n), 0.5 * chain]
        forward = lambda w, d: rows.dot(scale * w) + dense @ d
        backward = lambda g: (scale * rows.transposed_dot(g), dense.T @ g)
        w, d = scale / max(np.abs(scale).max(), 1e-9), np.ones(dense.shape[1])
        for _ in range(6):  # the largest eigenvalue bounds the step
            w, d = backward(forward(w, d))
            size = np.sqrt((w**2).sum() + (d**2).sum())
            w, d = w / max(size, 1e-12), d / max(size, 1e-12)
        step = 1 / (0.3 * size / rows.n + ridge) if rows.n else 0
        w, d = np.zeros(1 << BITS), np.zeros(dense.shape[1])
        d[0] = np.log(share / (1 - share))
        vw, vd = w, d
        for k in range(steps):
            p = 1 / (1 + np.exp(-np.clip(forward(vw, vd), -30, 30)))
            gw, gd = backward((p - y) / max(rows.n, 1))
            nw, nd = vw - step * (gw + ridge * vw), vd - step * gd
            vw, vd = nw + k / (k + 3) * (nw - w), nd + k / (k + 3) * (nd - d)
            w, d = nw, nd
        self.weights, self.bias, self.chain = (scale * w).astype(np.float32), float(d[0]), 0.5 * d[1:]

    def odds(self, rows: _Rows, chain: np.ndarray) -> np.ndarray:
        return rows.dot(self.weights.astype(np.float64)) + self.bias + chain @ self.chain


class ClassifierChain:
    def __init__(self, lists: Sequence[np.ndarray], labels: np.ndarray, categories: Sequence[str]):
        """labels: rows by categories, 0 or 1."""
        self.categories, self.models, self.thresholds = list(categories), [], []
        n = len(lists)
        fold = np.arange(n) % FOLDS
        chain = np.empty((n, 0))
        every = _Rows(lists)
        for c in range(len(categories)):
            y, out = labels[:, c].astype(float), np.zeros(n)
            for f in range(FOLDS):
                train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                if len(train) and len(test):
                    model = LinearModel(_Rows([lists[i] for i in train]), chain[train], y[train])
                    out[test] = model.odds(_Rows([lists[i] for i in test]), chain[test])
            self.models.append(LinearModel(every, chain, y))
            self.thresholds.append(best_threshold(out, y))
            chain = np.c_[chain, np.clip(out, -9, 9)]

    def odds(self, lists: Sequence[np.ndarray]) -> np.ndarray:
        rows, chain = _Rows(lists), np.empty((len(lists), 0))
        for model in self.models:
            chain = np.c_[chain, np.clip(model.odds(rows, chain), -9, 9)]
        return chain


def best_threshold(odds: np.ndarray, y: np.ndarray) -> float:
    """The log-odds between out-of-fold classes with the best F1; infinite without positive labels, 0 without negative ones."""
    if not 0 < y.sum() < len(y):
        return 0.0 if y.sum() else float("inf")
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(f1))
    below = odds[order[best + 1]] if best + 1 < len(y) else odds[order[best]] - 1
    return float((odds[order[best]] + below) / 2)


@gives_back
def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = _WordFeatures()
    for batch in batches:
        found = [features(t, memo).tobytes() for t in batch.column("text").to_pylist()]
        held = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in held], pa.array(found, pa.binary())], [*held, "features"])


def _fit(categories: Sequence[str], sample_features: int):
    @gives_back
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, labels, total = [], [], 0
        for batch in batches:
            for y, x in zip(batch.column("labels").to_pylist(), batch.column("features").to_pylist(), strict=True):
                if total + len(x) // 4 <= sample_features:
                    lists.append(np.frombuffer(x, np.int32)), labels.append(y)
                    total += len(x) // 4
        model = ClassifierChain(lists, np.array(labels, float).reshape(-1, len(categories)), categories)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return fit


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, sample: int = SAMPLE, sample_features: int = SAMPLE_FEATURES) -> ClassifierChain:
    """Fit on labelled documents. labels: doc_id and a 0/1 column per category; rows with a null are left out.

    Of several label rows for a document the largest values count; of several documents with an id, the one whose
    features are the smallest as bytes, so that runs agree. A chain fitted on no documents, or on none of a category, never flags it.
    """
    known = labels.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories]).dropna()
    order = F.xxhash64("doc_id")
    chosen = known.orderBy(order, "doc_id").limit(sample)  # at most `sample` rows of numbers: safe to broadcast
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.withColumn("labels", F.array(*[named(c).cast("int") for c in categories])).select("labels", "text", order.alias("o"), "doc_id")
    # only hashed features, bounded by BITS, meet in the one task
    found = rows.mapInArrow(_feature_batches, f"labels array<int>, o bigint, doc_id {dict(rows.dtypes)['doc_id']}, features binary")
    found = found.groupBy("doc_id", "o", "labels").agg(F.min("features").alias("features"))
    found = found.repartition(1).sortWithinPartitions("o", "doc_id").select("labels", "features")
    fitted = found.mapInArrow(_fit(categories, sample_features), "model binary").first()
    return pickle.loads(fitted[0]) if fitted else ClassifierChain([], np.empty((0, len(categories))), categories)


def _score(shared, n_held: int):
    """Held columns and the text last, to held columns, probabilities and the verdict."""

    @gives_back
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = shared.value, _WordFeatures()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            odds = model.odds([features(t, memo) for t in texts])
            p = 1 / (1 + np.exp(-odds))
            columns = [*batch.columns[:n_held], *[pa.array(p[:, c]) for c in range(p.shape[1])], pa.array(odds[:, -1] >= model.thresholds[-1])]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])  # Spark reads by place

    return score


def toxicity(docs: DataFrame, model: ClassifierChain, keep_text: bool = True) -> DataFrame:
    """`docs` (without text unless keep_text) with p_<category> per category of the chain, and toxic: the last one's verdict.

    Null and empty texts have no features and get the models' base rates. Columns of `docs` with the names of these are
    replaced, all others stay.
    """
    new = [*[f"p_{c}" for c in model.categories], "toxic"]
    held = [c for c in docs.columns if c not in new and (keep_text or c != "text")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = held_schema(docs, held, ", ".join([f"`{c}` double" for c in new[:-1]] + ["toxic boolean"]))
    return docs.select(*by_place(held), F.col("text").alias("text")).mapInArrow(_score(shared, len(held)), schema)


def labelled(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_chain(docs, labelled(table(spark, sf_dir, "labels")))
    return toxicity(docs, model, keep_text=False).select("doc_id", *[f"p_{c}" for c in CATEGORIES], "toxic")
