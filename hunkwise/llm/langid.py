"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A text's subwords are the 2, 3 and 4 byte runs of its lower-cased letters that don't cross a word, a word's edges
included. Each is hashed to one of ``BUCKETS`` embeddings of ``DIM`` numbers; their average goes through a linear softmax.
Embeddings and softmax are trained together by stochastic gradient descent in numpy. A temperature is fitted on rows set
aside from training, and the rejection threshold is the lowest score from which on the accepted of those rows are right
in ``PRECISION`` of cases (accepted is a column of its own; the prediction is given either way).

Training reads a bounded sample of labelled rows, ``PER_LANG`` of each language at most, those with the smallest hashes of
id and text (about twice as many are drawn by the hash, then ordered, so no language is sorted whole). Prediction reads every whole text, in batches; as averaging and softmax input are linear, embeddings are multiplied
with the softmax weights beforehand, so a subword costs one short row of a table.

Defined results: a null text, and one without any letter, is ``und`` with score 0 and not accepted; rows with a null
language are not learned from; without any labelled row everything is ``und``. Repeated rows are predicted alike, further
columns don't matter, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small

BUCKETS = 1 << 16
DIM = 16
SIZES = (2, 3, 4)
PER_LANG = 600
PRECISION = 0.995
FOLDS = 4
HELD_OUT = 2
_EPOCHS = 6
_BATCH = 32
_STEPS = 900
#: Characters after which a long text's piece is ended at the next gap.
_PIECE = 1 << 16
_LETTER = re.compile(r"[^\W\d_]")
_GAP = re.compile(r"[\x00-\x40\x5b-\x60\x7b-\x7f]")
#: ASCII letters stay, other ASCII becomes a space; bytes of longer characters stay.
_MAP = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def fold(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % FOLDS


def subwords(text: str) -> np.ndarray:
    """Buckets of all subwords of a text."""
    u = _MAP[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)].astype(np.uint32)
    gap = u == 32
    found = []
    for n in SIZES:
        m = len(u) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        inside = np.zeros(m, bool)
        for k in range(n):
            h *= np.uint32(0x01000193)
            h ^= u[k : k + m] * np.uint32(0x9E3779B1)
            if 0 < k < n - 1:
                inside |= gap[k : k + m]
        if n == 2:
            inside = gap[:m] & gap[1 : m + 1]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        found.append((h & np.uint32(BUCKETS - 1))[~inside])
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def pieces(text: str) -> Iterator[str]:
    """A text's lower-cased pieces, cut where a word ends, so that their subwords are those of the whole text."""
    low, at = text.lower(), 0
    while at < len(low):
        gap = _GAP.search(low, at + _PIECE)
        end = gap.start() if gap else len(low)
        yield low[at:end]
        at = end


class Model:
    """Per-bucket logits (embedding times softmax weights), bias, temperature and rejection threshold."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float) -> None:
        self.langs, self.table, self.bias, self.temperature, self.threshold = langs, table, bias, temperature, threshold

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, False
        total, n = np.zeros(len(self.langs)), 0
        for piece in pieces(text):
            ids = subwords(piece)
            total += self.table[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
        z = (total / max(n, 1) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] >= self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Trains on four fifths of the texts and random pieces of them, calibrates on the rest and pieces of it."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((0, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    bags: list[list[tuple[np.ndarray, np.ndarray, int]]] = [[], []]
    for i, (t, lang) in enumerate(zip(texts, langs, strict=True)):
        width = int(rng.integers(20, 200))
        start = int(rng.integers(0, max(1, len(t) - width)))
        for piece in (t, t[start : start + width]):
            if _LETTER.search(piece) and len(ids := subwords(piece)):
                bags[i % 5 == 4].append((*np.unique(ids, return_counts=True), names.index(lang)))
    aside = bags[1] or bags[0]
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    bag = bags[0] or bags[1]
    epochs = max(_EPOCHS, -(-_STEPS * _BATCH // len(bag)))
    steps, total = 0, epochs * (len(bag) // _BATCH + 1)
    for _ in range(epochs):
        order = rng.permutation(len(bag))
        for at in range(0, len(order), _BATCH):
            rate = 20.0 * (1 - steps / total) + 0.05
            steps += 1
            part = [bag[i] for i in order[at : at + _BATCH]]
            ids = np.concatenate([p[0] for p in part])
            weight = np.concatenate([p[1] / p[1].sum() for p in part]).astype(np.float32)
            begins = np.cumsum([0, *(len(p[0]) for p in part[:-1])])
            mean = np.add.reduceat(emb[ids] * weight[:, None], begins)
            err = _softmax(mean @ soft + bias)
            err[np.arange(len(part)), [p[2] for p in part]] -= 1
            err /= len(part)
            back = err @ soft.T
            soft -= rate * 0.2 * (mean.T @ err)
            bias -= 0.02 * err.sum(axis=0)
            for (own, count, _), step in zip(part, back, strict=True):
                emb[own] -= (rate / count.sum()) * count[:, None].astype(np.float32) * step
    logits = np.array([(emb[p[0]] * (p[1] / p[1].sum())[:, None]).sum(axis=0) @ soft + bias for p in aside])
    truth = np.array([p[2] for p in aside])
    grid = np.geomspace(0.05, 5, 60)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    probs = _softmax(logits / temperature)
    best, right = probs.max(axis=1), probs.argmax(axis=1) == truth
    down = np.argsort(-best, kind="stable")
    ok = np.flatnonzero(np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= PRECISION)
    threshold = float(best[down][ok[-1]]) if len(ok) else 1.0
    return Model(names, (emb @ soft).astype(np.float32), bias.astype(np.float64), temperature, threshold)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from labelled rows outside fold ``HELD_OUT``."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    rates = known.groupBy("lang").count().select("lang", (F.lit(2.0 * PER_LANG) / F.col("count")).alias("rate"))
    drawn = known.withColumn("draw", draw).join(broadcast_if_small(rates), "lang").where(F.col("draw") < F.col("rate")).select("doc_id", "text", "lang", "draw").distinct()
    place = F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id", "text"))
    sample = drawn.withColumn("place", place).where(F.col("place") <= PER_LANG).orderBy("lang", "place").select("text", "lang").toArrow()
    return fit(sample.column("text").to_pylist(), sample.column("lang").to_pylist())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.bias, model.temperature, model.threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            made = [own.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()), pa.array([m[2] for m in made], pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, accepted``."""
    model = train(docs, id_col, text_col, lang_col)
    made = predict(docs, model, id_col, text_col)
    return made.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score", "accepted")
