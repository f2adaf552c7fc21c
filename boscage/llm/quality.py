"""Quality classifier (operator 7): hashed word n-gram logistic regression, trained with FTRL-proximal updates.

Features are hashed n-grams of a text's tokens (runs of letters, of digits, of other signs): single tokens, pairs, and
triples of the tokens' normal forms (case form, sign run, or "same word again").  A feature weighs its share of the
text's tokens, so a score is one sparse dot product over the whole text whatever its length.

Training reads at most `bound` labelled rows (SAMPLE) of texts of LONGEST bytes at most, chosen by a hash of the id; the
bounds hold before anything reaches the driver.  Scoring reads every text whole.
Edge cases: null and empty texts have no features and get the score of the intercept; null or other labels are not
learnt from; rows with a null id count as remainder 0; with labels of one class or none the score is that share (0.5
without labels); repeated rows score alike; empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boscage.llm._bytes import BYTE, LOWER, U, mix, span_hash
from boscage.llm._common import release, text_slices, utf8

#: Labelled rows to learn from, at most, and bytes of a text that is learnt from, at most (documented bounds).
SAMPLE, LONGEST = 8_000, 1 << 17
BITS = 18
SCALE = 32.0
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def features(buf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row) of every n-gram of a flat UTF-8 buffer, and the number of tokens of each row."""
    n = len(rows) - 1
    kind = _KIND[buf]
    first = np.ones(len(buf), bool)
    first[1:] = kind[1:] != kind[:-1]
    cut = rows[(rows > 0) & (rows < len(buf))]
    first[cut] = True
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(buf))
    real = kind[begin] > 0 if len(begin) else np.zeros(0, bool)
    begin, end = begin[real], end[real]
    row = np.searchsorted(rows, begin, "right") - 1
    tokens = np.bincount(row, minlength=n)
    if not len(begin):
        return np.zeros(0, np.int64), row, tokens
    word = span_hash(BYTE[buf], begin, end)
    low = span_hash(BYTE[LOWER[buf]], begin, end)
    upper = np.concatenate([[0], np.cumsum((buf >= 65) & (buf <= 90))])
    lower = np.concatenate([[0], np.cumsum((buf >= 97) & (buf <= 122))])
    ups, lows = upper[end] - upper[begin], lower[end] - lower[begin]
    letters = kind[begin] == 1
    form = np.where(ups == 0, 1, np.where((ups == 1) & (upper[begin + 1] > upper[begin]) & (lows > 0), 2, np.where(lows == 0, 3, 4))).astype(U)
    at = np.flatnonzero(letters)
    again = np.zeros(len(begin), bool)
    again[at[1:]] = (low[at[1:]] == low[at[:-1]]) & (row[at[1:]] == row[at[:-1]])
    shape = np.where(letters, form + np.where(again, U(8), U(0)), np.where(kind[begin] == 2, U(16), word))
    out, of = [mix(word + U(1))], [row]
    both = row[1:] == row[:-1]
    out.append(mix(word[:-1] * U(3) + mix(word[1:]))[both])
    of.append(row[1:][both])
    same = (row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, bool)
    if len(row) > 2:
        out.append(mix((mix(shape[:-2]) * U(5) + shape[1:-1]) * U(7) + mix(shape[2:] + U(9)))[same])
        of.append(row[2:][same])
    return (np.concatenate(out) >> U(64 - BITS)).astype(np.int64), np.concatenate(of), tokens


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, buf: np.ndarray, rows: np.ndarray) -> np.ndarray:
        bucket, row, tokens = features(buf, rows)
        dot = np.bincount(row, weights=self.weights[bucket], minlength=len(rows) - 1) * SCALE / np.maximum(tokens, 1)
        return 1 / (1 + np.exp(-np.clip(dot + self.bias, -30, 30)))


def fit(texts: pa.Array, labels: np.ndarray, epochs: int = 3, alpha: float = 0.15, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> Model:
    """Follow-the-regularised-leader (proximal) over the texts in a fixed shuffled order."""
    share = float(labels.mean()) if len(labels) else 0.5
    weights = np.zeros(1 << BITS)
    if not len(labels) or share in (0.0, 1.0):
        return Model(weights, 0.0 if not len(labels) else (1 if share else -1) * 8.0)
    examples = []
    for i in range(len(labels)):
        buf, rows = utf8(texts[i : i + 1])
        bucket, _, tokens = features(buf, rows)
        index, count = np.unique(bucket, return_counts=True)
        examples.append((index.astype(np.int32), np.minimum(count, 65535).astype(np.uint16), SCALE / max(1, int(tokens[0]))))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb, nb = 0.0, 0.0
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(labels)).tolist():
            index, count, scale = examples[i]
            value = count * scale
            root = np.sqrt(n[index])
            w = np.where(np.abs(z[index]) <= l1, 0.0, -(z[index] - np.sign(z[index]) * l1) / ((beta + root) / alpha + l2))
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w @ value + bias, -30, 30)))
            g = (p - labels[i]) * value
            z[index] += g - (np.sqrt(n[index] + g * g) - root) / alpha * w
            n[index] += g * g
            gb = p - labels[i]
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / alpha * bias
            nb += gb * gb
    weights = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(weights.astype(np.float32), float(-zb / ((beta + np.sqrt(nb)) / alpha)))


def train(docs: DataFrame, labels: DataFrame, allowed: Column, bound: int = SAMPLE) -> Model:
    """Learn from at most `bound` labelled rows whose doc_id fulfils `allowed`, both classes alike as far as they go."""
    marks = labels.select("doc_id", F.col("quality").alias("y")).where("y in (0, 1) and doc_id is not null").where(allowed)
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit(pa.array([], pa.string()), np.zeros(0))
    # Bernoulli by id: in expectation under the bound by four standard deviations, and the limit makes it hold
    share = {y: min(1.0, (bound / 2 - 4 * (bound / 2) ** 0.5) / n) for y, n in counts.items()}
    picked = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < F.when(F.col("y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)) * 1_000_000).limit(bound)
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= LONGEST).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y").limit(bound).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    model = fit(rows["text"].combine_chunks(), np.asarray(rows["y"], np.float64))
    y = np.array(rows["y"])
    del rows
    release()
    if 0 < y.sum() < len(y):  # classes were drawn at different rates: back to their true odds
        model.bias += float(np.log(counts.get(1, 1) / counts.get(0, 1)) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every text."""

    def run(batches):
        for b in text_slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(*utf8(b.column(1))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score `least` or more."""
    at = docs.columns.index("text")

    def run(batches):
        for b in text_slices(batches):
            yield b.filter(pa.array(model.score(*utf8(b.column(at))) >= least))

    return docs.mapInArrow(run, docs.schema)
