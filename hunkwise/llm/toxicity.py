"""Toxicity by non-negative positive-unlabelled learning, in numpy.

A linear classifier over the presence of words and word beginnings is trained from confirmed toxic texts (P) against
unlabelled text (U), minimising pi*E_P[l(f)] + max(0, E_U[l(-f)] - pi*E_P[l(-f)]): U holds a share pi of toxic texts, so
their part of the negative risk is taken out again, and where that part turns negative (overfitting) the step is
reversed. pi is the share of label 1 among all labels that may be learned from.

Training reads a bounded sample: ``MAX_POSITIVE`` confirmed and ``MAX_UNLABELLED`` unlabelled texts, picked by a hash of
the id (of rows with one id one is read), and of their features the ``MAX_FEATURES`` that tell P from U best. Larger bounds
would find rarer words of P; what is learned does not depend on the order or the placing of rows. Labels are counted over
all rows. Features are taken in the executors. Scoring reads every whole text, in batches; a text's features are a set, so a long text with
a few toxic words is not diluted, and only the features picked in training weigh anything.

Defined results: a null or empty text has the score of a text without features; labels with a null or other value than
0/1 are ignored, of repeated labels the largest counts; without any positive label all scores are 0. Repeated rows are
scored alike, further columns don't matter, an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, fresh_name, written

MAX_POSITIVE = 3000
MAX_UNLABELLED = 5000
MAX_FEATURES = 4096
FOLDS = 5
HELD_OUT = 0
_SPACE = 1 << 20
#: A feature weighs something if it is likelier in P than in U by this likelihood ratio test (fewer texts pass a lower
#: one), and if by Bayes' rule at least this share of the texts that have it is toxic. Both, and the weight decay, were
#: picked by cross-validation over the folds that may be learned from.
_SURE, _SHARE = 10.0, 0.85
_STARTS = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")


def fold(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % FOLDS


def word_features(word: str) -> set[int]:
    """Hashed features of one word: itself and its beginnings."""
    return {zlib.crc32(x.encode()) % _SPACE for x in (f"={word}", *(f"{word[:n]}{n}" for n in _STARTS if len(word) > n))}


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


class Model:
    """Weights of the picked features, and the bias."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = dict(zip(ids.tolist(), weights.tolist(), strict=True)), bias
        self.seen: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        found: set[int] = set()
        for w in words(text):
            got = self.seen.get(w)
            if got is None:
                if len(self.seen) > 500_000:
                    self.seen.clear()
                got = self.seen[w] = tuple(word_features(w) & self.weights.keys())
            if got:
                found.update(got)
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[i] for i in sorted(found)), -30, 30))))


def _features(texts: list[str | None]) -> list[np.ndarray]:
    cache: dict[str, set[int]] = {}
    out = []
    for t in texts:
        all_of: set[int] = set()
        for w in words(t):
            if w not in cache:
                cache[w] = word_features(w)
            all_of |= cache[w]
        out.append(np.fromiter(all_of, np.int32, len(all_of)))
    return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _ratio_test(k: np.ndarray, n: int, j: np.ndarray, m: int) -> np.ndarray:
    """Log likelihood ratio of each feature having one frequency in P and another in U."""

    def part(x: np.ndarray, of: int, share: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(of * share, 1e-12)), 0.0)

    share = (k + j) / (n + m)
    return 2 * (part(k, n, share) + part(n - k, n, 1 - share) + part(j, m, share) + part(m - j, m, 1 - share))


def choose(ids: np.ndarray, k: np.ndarray, n: int, j: np.ndarray, m: int, prior: float) -> np.ndarray:
    """The features, ascending, that k of n texts of P and j of m of U have and that tell the two apart."""
    gain = _ratio_test(k, n, j, m)
    share = prior * k * m / np.maximum(j * n, 1e-9)
    gain = np.where((gain < _SURE * min(1.0, n / 200) ** 0.3) | (k < 2) | (share < _SHARE), 0, gain)
    best = np.lexsort((ids, -gain))[:MAX_FEATURES]
    return np.sort(ids[best][gain[best] > 0])


def learn(ids: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """The non-negative estimator's linear model over ``ids``; each text is an array of features."""

    def rows(feats: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        kept = [f[np.isin(f, ids)] for f in feats]
        return np.repeat(np.arange(len(kept)), [len(k) for k in kept]), np.searchsorted(ids, np.concatenate([np.zeros(0, np.int32), *kept]))

    (pr, pc), (ur, uc) = rows(positive), rows(unlabelled)
    w, bias = np.zeros(len(ids)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(len(ids)), np.zeros(len(ids)), 0.0, 0.0
    for t in range(1, rounds + 1):
        fp = bias + np.bincount(pr, w[pc], len(positive))
        fu = bias + np.bincount(ur, w[uc], len(unlabelled))
        up, down, free = -_logistic(-fp) * prior / len(positive), _logistic(fp) * prior / len(positive), _logistic(fu) / len(unlabelled)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gp, gu = (up - down, free) if negative >= 0 else (down, -free)
        grad = np.bincount(pc, gp[pr], len(ids)) + np.bincount(uc, gu[ur], len(ids)) + decay * w
        gb = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return Model(ids, w, float(bias))


def nothing() -> Model:
    """The model where nothing can be learned: no text is toxic."""
    return Model(np.array([], np.int64), np.array([]), -30.0)


def fit(positive: list[str | None], unlabelled: list[str | None], prior: float) -> Model:
    """Learns from texts at hand."""
    if not positive or not unlabelled:
        return nothing()
    sets = [_features(positive), _features(unlabelled)]
    k, j = (np.bincount(np.concatenate([np.zeros(0, np.int32), *s]), minlength=_SPACE) for s in sets)
    return learn(choose(np.arange(_SPACE), k, len(positive), j, len(unlabelled), prior), *sets, prior)


def _drawn(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, p, u, feats``: the features of the texts drawn for P and for U, one row for each id."""
    order = F.xxhash64("doc_id")
    toxic = known.where("toxic = 1").orderBy(order, "doc_id").limit(MAX_POSITIVE).select("doc_id", F.lit(1).alias("p"), F.lit(0).alias("u"))
    pool = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT)).distinct()
    drawn = toxic.unionByName(pool.orderBy(order, "doc_id").limit(MAX_UNLABELLED).select("doc_id", F.lit(0).alias("p"), F.lit(1).alias("u")))
    drawn = drawn.groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u"))  # MAX_POSITIVE + MAX_UNLABELLED ids at most
    texts = docs.join(F.broadcast(drawn), "doc_id").select("doc_id", "p", "u", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                made = pa.array([np.sort(f) for f in _features(part.column(3).to_pylist())], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], made], names=["doc_id", "p", "u", "feats"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, p int, u int, feats array<int>").groupBy("doc_id", "p", "u").agg(F.min("feats").alias("feats"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from the labels outside fold ``HELD_OUT`` only. To the driver come counts of features and, of the drawn
    texts, the ids of the chosen features; no text does."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic or toxic == n:
        return nothing()
    prior = toxic / n
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    drawn = written(_drawn(texts, known), "toxicity-drawn")
    positive, unlabelled = drawn.agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("u"), F.lit(0))).first()
    if not positive or not unlabelled:
        return nothing()
    counts = drawn.select("p", "u", F.explode("feats").alias("f")).groupBy("f").agg(F.sum("p").alias("k"), F.sum("u").alias("j")).where("k > 1").toArrow()
    columns = {c: counts.column(c).to_numpy() for c in ("f", "k", "j")}
    ids = choose(columns["f"].astype(np.int64), columns["k"], positive, columns["j"], unlabelled, prior)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.asarray(f, np.int32) for f in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[np.isin(f, ids)] for f in lists], pa.list_(pa.int32()))], names=["p", "u", "feats"])

    few = drawn.orderBy("doc_id").select("p", "u", "feats").mapInArrow(picked, "p int, u int, feats array<int>").toArrow().to_pydict()
    free(drawn)
    sides = [[np.asarray(f, np.int32) for f, x in zip(few["feats"], few[side], strict=True) if x] for side in ("p", "u")]
    return learn(ids, *sides, prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` as its last column, the text's probability of being toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((list(model.weights), list(model.weights.values()), model.bias))
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, weights, bias = shared.value
        own = Model(np.array(ids, np.int64), np.array(weights), bias)
        for b in batches:
            made = pa.array([own.score(t.as_py()) for t in b.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, score_col])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.mapInArrow(run, f"{out}, `{score_col}` double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    model = train(docs, labels, id_col, text_col)
    scored = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows scored 0.5 or more; the columns of ``docs``, whatever their names."""
    model = train(docs, labels, id_col, text_col)
    own = fresh_name(docs, "score")
    return score(docs, model, text_col, own).where(F.col(f"`{own}`") < 0.5).drop(own)
