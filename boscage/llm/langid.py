"""Language identification (operator 6): averaged hashed subword embeddings under a linear softmax.

A text's words (runs of letters, lowered, with a boundary on each side) give all their 2-, 3- and 4-letter subwords;
each has a hashed embedding, a text is their mean, and a linear softmax reads it.  Embeddings and softmax are trained
together by stochastic gradient descent in numpy on a bounded sample (SAMPLE rows a language at most, of texts of LONGEST
bytes at most, chosen by a hash of the id and the text); a fifth of the sample is kept apart to fit the softmax's temperature and the confidence below which a text
is rejected.  As the model is linear, scoring adds up one small row of logits a subword over the whole text.

Edge cases: null, empty and letterless texts are `und` with score 0 and rejected; texts of any length are read whole;
null languages are not learnt; rows with a null id count as remainder 0; without labelled rows everything is `und`;
repeated rows score alike; empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boscage.llm._bytes import U, mix
from boscage.llm._common import release, text_slices

#: Rows of a language to learn from, at most, and bytes of a text that is learnt from, at most (documented bounds).
SAMPLE, LONGEST = 600, 1 << 17
BITS = 16
DIMENSIONS = 16
_letter = np.full(0x110000, 2, np.uint8)


def _letters(points: np.ndarray) -> np.ndarray:
    out = _letter[points]
    if (out == 2).any():
        for p in np.unique(points[out == 2]).tolist():
            _letter[p] = unicodedata.category(chr(p))[0] == "L"
        out = _letter[points]
    return out.astype(bool)


def subwords(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every subword of the texts."""
    parts = [(t or "").lower() + " " for t in texts]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    inside = _letters(points)
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # of other signs only the first after a word
    points, row, inside = np.where(inside, points, 0)[keep].astype(U), row[keep], inside[keep]
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # each word stands between boundaries: the last word's end is the next one's start, texts start with one of their own
    head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    points, row, inside = np.insert(points, head, U(0)), np.insert(row, head, row[head]), np.insert(inside, head, False)
    value = (points + U(1)) * U(0x9E3779B97F4A7C15)
    buckets, rows, h, ok = [], [], value, np.ones(len(points), bool)
    for n in (2, 3, 4):
        m = len(points) - n + 1
        if m <= 0:
            break
        h = h[:m] * U(0x100000001B3) + value[n - 1 :]
        ok = (row[:m] == row[n - 1 :]) if n == 2 else ok[:m] & inside[n - 2 : n - 2 + m] & (row[:m] == row[n - 1 :])
        buckets.append((mix(h[ok] + U(n)) >> U(64 - BITS)).astype(np.int64))
        rows.append(row[:m][ok])
    return np.concatenate(buckets), np.concatenate(rows)


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray
    least: float = 0.0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, calibrated probability, accepted) of each text."""
        n, k = len(texts), len(self.langs)
        bucket, row = subwords(texts)
        count = np.bincount(row, minlength=n)
        if not k:
            return ["und"] * n, np.zeros(n), np.zeros(n, bool)
        each = self.logits[bucket]
        z = np.stack([np.bincount(row, weights=each[:, j], minlength=n) for j in range(k)], 1) / np.maximum(count, 1)[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        score = np.where(count > 0, p[np.arange(n), best], 0.0)
        return [self.langs[b] if c else "und" for b, c in zip(best.tolist(), count.tolist(), strict=True)], score, (count > 0) & (score >= self.least)


def _bag(bucket: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a few texts and their dense (text, bucket) shares."""
    index, at = np.unique(bucket, return_inverse=True)
    x = np.bincount(row * max(1, len(index)) + at, minlength=n * max(1, len(index))).reshape(n, -1).astype(np.float32)
    return index, x / np.maximum(x.sum(1, keepdims=True), 1)


def fit(texts: list[str], langs: list[str], epochs: int = 5, rate: float = 4.0, batch: int = 16) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(11)
    # short passages beside the whole texts, so that confidence holds for either
    short = []
    for t in texts:
        w = t.split()
        at = int(rng.integers(0, max(1, len(w) - 12)))
        short.append(" ".join(w[at : at + 12]))
    texts, y = texts + short, np.concatenate([y, y])
    apart = rng.permutation(len(texts) // 2) < len(texts) // 2 // 5
    apart = np.concatenate([apart, apart])
    table = (rng.normal(0, 0.1, (1 << BITS, DIMENSIONS))).astype(np.float32)
    top = np.zeros((DIMENSIONS, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    learn = np.flatnonzero(~apart)
    steps = 0
    total = epochs * max(1, len(learn) // batch)
    for _ in range(epochs):
        for i in range(0, len(learn), batch):
            if i == 0:
                rng.shuffle(learn)
            pick = learn[i : i + batch]
            index, x = _bag(*subwords([texts[j] for j in pick]), len(pick))
            own = table[index]
            mean = x @ own
            z = mean @ top + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p /= len(pick)
            now = rate * max(0.05, 1 - steps / total)
            steps += 1
            table[index] -= now * 20 * (x.T @ (p @ top.T))
            top -= now * (mean.T @ p)
            bias -= now * 0.1 * p.sum(0)
    model = Model(names, (table @ top + bias).astype(np.float32))
    held = np.flatnonzero(apart)
    if len(held):
        z = []
        for i in range(0, len(held), 64):
            pick = held[i : i + 64]
            index, x = _bag(*subwords([texts[j] for j in pick]), len(pick))
            z.append(x @ model.logits[index])
        z, truth = np.concatenate(z), y[held]

        def probabilities(t: float) -> np.ndarray:
            q = np.exp((z - z.max(1, keepdims=True)) * t)
            return q / q.sum(1, keepdims=True)

        loss = {t: -np.log(probabilities(t)[np.arange(len(held)), truth] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
        best = min(loss, key=loss.get)
        model.logits *= np.float32(best)
        sure = probabilities(best).max(1)
        # between pure chance and the confidence that all but one in a thousand of the texts kept apart reach
        model.least = float((np.quantile(sure, 0.001) + 1 / len(names)) / 2) if len(names) > 1 else 0.0
    return model


def train(docs: DataFrame, allowed: Column, bound: int = SAMPLE) -> Model:
    """Learn from at most `bound` rows a language among those with text and lang that fulfil `allowed`."""
    own = docs.select("doc_id", "text", "lang").where("lang is not null").where(F.octet_length("text") <= LONGEST).where(allowed)
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [])
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (bound - 4 * bound**0.5) / n))])
    rows = own.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(6)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).limit(bound * len(counts)).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    model = fit(rows["text"].to_pylist(), rows["lang"].to_pylist())
    del rows
    release()
    return model


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every text."""

    def run(batches):
        for b in text_slices(batches):
            lang, score, kept = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(kept)], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose language the model accepts."""
    at = docs.columns.index("text")

    def run(batches):
        for b in text_slices(batches):
            yield b.filter(pa.array(model.predict(b.column(at).to_pylist())[2]))

    return docs.mapInArrow(run, docs.schema)
