"""Quality classifier: a factorisation machine over hashed words, structure and
metadata.

A text's features are its words (hashed, each occurrence weighs one over the
number of words), statistics of its structure, and its size. The score is
``bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``; the pairwise part is half of
``(sum v_i x_i)^2 - sum (v_i x_i)^2`` in each factor, so a text is scored in time
linear in its words, from sums of rows of one small table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import IS_SPACE, LOWER, Slice, slices, windows_in_rows, word_hashes, WORDS, mix

#: Documented bound of the fitting sample, in rows.
SAMPLE_ROWS = 8_000
WORD_DIMS = 1 << 12
FACTORS = 4
EPOCHS = 12
BATCH = 64
THRESHOLD = 0.7

STATS = 16


def statistics(p: Slice, s: np.ndarray, e: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> np.ndarray:
    """rows x STATS, each about 0 to 1: shares of kinds of bytes, repetition of
    words and lines, word and line lengths, and size."""
    d = p.data
    size = np.maximum(np.diff(p.off), 1)
    n = np.maximum(np.diff(bounds), 1)
    upper = (d >= 65) & (d <= 90)
    letter = upper | ((d >= 97) & (d <= 122)) | (d >= 128)
    digit = (d >= 48) & (d <= 57)
    sign = ~letter & ~digit & ~IS_SPACE[d]
    row = np.repeat(np.arange(p.rows), np.diff(bounds))
    tagged = words ^ mix(row.astype(np.uint64) + np.uint64(1))
    _, first, count = np.unique(tagged, return_index=True, return_counts=True)
    distinct = np.bincount(row[first], minlength=p.rows)
    most = np.zeros(p.rows)
    np.maximum.at(most, row[first], count)
    run = WORDS.running(words)
    at, at_row = windows_in_rows(bounds, 4)
    grams = WORDS.windows(run, 4)[at] ^ mix(at_row.astype(np.uint64) + np.uint64(1))
    kept = np.bincount(at_row[np.unique(grams, return_index=True)[1]], minlength=p.rows)
    lines = p.per_row(d == 10) + 1
    cols = [p.per_row(upper) / size, p.per_row(digit) / size, p.per_row(sign) / size, p.per_row(d == ord("!")) / size * 4,
            p.per_row(d == ord("|")) / size * 4, p.per_row(np.isin(d, np.frombuffer(b"#*$%&<>{}[]=_/\\@", np.uint8))) / size * 4,
            p.per_row((d == ord(".")) | (d == ord(","))) / n, p.per_row(d >= 128) / size, distinct / n, most / n,
            1 - kept / np.maximum(np.bincount(at_row, minlength=p.rows), 1), np.minimum(size / n, 30) / 15 - .4,
            np.minimum(n / lines, 200) / 100, np.log1p(np.diff(bounds)) / 10, np.log1p(lines) / 8, (np.diff(bounds) < 20) * 1.0]
    out = np.stack(cols, 1)
    out[np.diff(bounds) == 0, :-1] = 0
    return out


@dataclass
class FactorisationMachine:
    """bias; a row of weight and factors for each word dimension and statistic."""

    bias: float
    words: np.ndarray  # WORD_DIMS x (1 + FACTORS)
    stats: np.ndarray  # STATS x (1 + FACTORS)
    mean: np.ndarray
    scale: np.ndarray

    def raw(self, grams: np.ndarray, rows: np.ndarray, x: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores, and the sums of v_i x_i by factor."""
        n = len(stats)
        linear = self.bias + np.bincount(rows, self.words[grams, 0] * x, n) + stats @ self.stats[:, 0]
        sums = np.stack([np.bincount(rows, self.words[grams, f] * x, n) for f in range(1, self.words.shape[1])], 1) + stats @ self.stats[:, 1:]
        squares = np.bincount(rows, (self.words[:, 1:] ** 2).sum(1)[grams] * x * x, n) + (stats ** 2) @ (self.stats[:, 1:] ** 2).sum(1)
        return linear + 0.5 * ((sums ** 2).sum(1) - squares), sums

    def score(self, p: Slice) -> np.ndarray:
        grams, rows, x, stats = inputs(p)
        z, _ = self.raw(grams, rows, x, (stats - self.mean) / self.scale)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def inputs(p: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word dimensions with their rows and values, and the statistics."""
    s, e, bounds = p.words()
    low = word_hashes(LOWER[p.data], s, e)
    n = np.diff(bounds)
    rows = np.repeat(np.arange(p.rows), n)
    return (low % np.uint64(WORD_DIMS)).astype(np.int64), rows, 4.0 / n[rows], statistics(p, s, e, bounds, low)


def train(grams: np.ndarray, starts: np.ndarray, stats: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> FactorisationMachine:
    """Adagrad on log loss over small batches, both labels weighing the same;
    ``starts`` bounds the rows in ``grams``."""
    draw = np.random.default_rng(0)
    mean, scale = stats.mean(0), stats.std(0) + 1e-3
    stats = np.clip((stats - mean) / scale, -5, 5)
    m = FactorisationMachine(0.0, np.c_[np.zeros(WORD_DIMS), draw.normal(0, .05, (WORD_DIMS, FACTORS))],
                             np.c_[np.zeros(STATS), draw.normal(0, .05, (STATS, FACTORS))], mean, scale)
    seen = [np.full_like(m.words, 1e-2), np.full_like(m.stats, 1e-2), 1e-2]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    for epoch in range(epochs):
        order = draw.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            b = order[lo:lo + BATCH]
            n = starts[b + 1] - starts[b]
            rows = np.repeat(np.arange(len(b)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[b][rows]
            g, x, t = grams[at], 4.0 / n[rows], stats[b]
            z, sums = m.raw(g, rows, x, t)
            err = weight[b] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[b]) / len(b)
            seen[2] += err.sum() ** 2
            m.bias -= 0.1 * err.sum() / np.sqrt(seen[2])
            grad = np.empty_like(m.words)
            grad[:, 0] = np.bincount(g, err[rows] * x, WORD_DIMS)
            for f in range(FACTORS):
                grad[:, 1 + f] = np.bincount(g, err[rows] * x * (sums[rows, f] - m.words[g, 1 + f] * x), WORD_DIMS)
            own = np.c_[t.T @ err, (t[:, :, None] * (sums[:, None, :] - t[:, :, None] * m.stats[None, :, 1:]) * err[:, None, None]).sum(0)]
            for value, d, total in ((m.words, grad, seen[0]), (m.stats, own, seen[1])):
                d += 1e-5 * value
                total += d * d
                value -= 0.1 * d / np.sqrt(total)
    return m


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id",
        sample_rows: int = SAMPLE_ROWS) -> FactorisationMachine:
    """Fits in one task on at most about ``sample_rows`` labelled rows, drawn by
    the hash of their ids; raises ValueError if there are none. Only the fitted
    tables come back."""
    d = docs.filter(F.col(label_col).isNotNull())
    n = d.count()
    if not n:
        raise ValueError("no labelled row to learn from")
    if n > sample_rows:
        d = d.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) < int(sample_rows / n * (1 << 30)))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in slices(batch.column(1)):
                grams, rows, _, stats = inputs(p)
                cut = np.searchsorted(rows, np.arange(p.rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(p.first, p.rows), batch.column(2).slice(p.first, p.rows),
                     pa.array([grams[a:b].astype("<u2").tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                     pa.array([r.astype("<f8").tobytes() for r in stats], pa.binary())], ["doc_id", "label", "grams", "stats"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        if t.num_rows:
            t = t.sort_by([("doc_id", "ascending"), ("grams", "ascending")])
            grams = [np.frombuffer(x, "<u2").astype(np.int64) for x in t.column("grams").to_pylist()]
            m = train(np.concatenate(grams), np.concatenate([[0], np.cumsum([len(g) for g in grams])]),
                      np.stack([np.frombuffer(x, "<f8") for x in t.column("stats").to_pylist()]),
                      (t.column("label").to_numpy() > 0).astype(float))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(m)], pa.binary())], ["model"])

    rows = d.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label"))
    fitted = rows.mapInArrow(featurise, "doc_id long, label int, grams binary, stats binary").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(fitted[0]["model"])


def score(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and predicted (score at the threshold
    or above) for each row, from its whole text; null and empty texts are scored by
    bias and statistics. Other columns are not read; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred kB, however large the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for p in slices(batch.column(1)):
                z = m.score(p)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.first, p.rows), pa.array(z), pa.array((z >= threshold).astype(np.int32))],
                                                 ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int")
