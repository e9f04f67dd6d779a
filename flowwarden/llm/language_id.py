"""Language identification by error-correcting output codes.

Each language gets a codeword; each bit of the code is a binary classifier over
hashed byte n-grams that tells the languages with a one from those with a zero.
The classifiers are log-odds of n-gram frequencies, fitted from one table of
counts per language and n-gram. A text's bit margins are decoded to the codeword
with the least loss, each bit weighted by how well it did on the fitting rows,
and a text whose two nearest codewords are about as near is flagged.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOWER, SYMBOL, Slice, mix, slices

#: Documented bound of the fitting sample, in rows.
SAMPLE_ROWS = 20_000
DIMS = 1 << 14
ORDERS = (2, 3)
MAX_BITS = 15
#: N-grams without evidence that every text is taken to have besides its own.
PRIOR_GRAMS = 10
#: Share of the loss by which the second codeword must be farther.
AMBIGUOUS = 0.1

#: ASCII letters and every byte of a longer character carry language; the rest is
#: a gap.
_KEEP = np.zeros(256, bool)
_KEEP[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def codewords(n: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """n x bits matrix of +1 and -1. All two-way splits of the languages while
    these are few, else bits of a seeded draw, with rows that differ."""
    if n == 1:
        return np.ones((1, 1), int)
    if 2 ** (n - 1) - 1 <= max_bits:
        rows = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(rows).T
    draw = np.random.default_rng(n)
    best, far = None, -1
    bits = max(max_bits, 2 * int(np.ceil(np.log2(n))) + 1)
    for _ in range(50):
        c = draw.choice((1, -1), (n, bits))
        near = min((int((c[i] != c[j]).sum()) for i in range(n) for j in range(i)), default=0) if n <= 200 else len({tuple(r) for r in c.tolist()})
        if near > far and np.all(np.abs(c.sum(0)) < n):
            best, far = c, near
    return best


def features(p: Slice, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a slice's rows and the row of each. Runs of other bytes
    count as one gap byte; n-grams don't cross rows."""
    low = LOWER[p.data]
    keep = _KEEP[low]
    here = keep.copy()
    here[1:] |= keep[:-1]  # letters, and the first byte of each gap
    at = np.flatnonzero(here)
    x = SYMBOL[np.where(keep[at], low[at], 0x20)]
    row = np.searchsorted(p.off, at, "right") - 1
    hashed, rows = [], []
    for n in ORDERS:
        if len(x) < n:
            continue
        h = x[:len(x) - n + 1].copy()
        for i in range(1, n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[i:len(x) - n + 1 + i]
        same = row[:len(row) - n + 1] == row[n - 1:]
        hashed.append((mix(h[same]) % np.uint64(dims)).astype(np.int32))
        rows.append(row[:len(row) - n + 1][same])
    if not hashed:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(hashed), np.concatenate(rows)


@dataclass
class LanguageModel:
    """Learned languages, their codewords, and weights and bias of each bit."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray  # dims x bits
    trust: np.ndarray  # of each bit

    def margins(self, p: Slice) -> np.ndarray:
        """Mean log-odds of each row's n-grams, by bit, drawn to zero in short texts."""
        grams, rows = features(p, len(self.weights))
        out = np.zeros((p.rows, self.weights.shape[1]))
        n = np.bincount(rows, minlength=p.rows) + PRIOR_GRAMS
        for b in range(out.shape[1]):
            out[:, b] = np.bincount(rows, self.weights[grams, b], p.rows) / n
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, score and ambiguity of each row."""
        loss = (np.log1p(np.exp(-4 * margins[:, None, :] * self.codes[None])) * self.trust).sum(2) / self.trust.sum()
        near = np.sort(loss, 1)
        like = np.exp(-8 * (loss - near[:, :1]))
        ambiguous = near[:, 1] - near[:, 0] < AMBIGUOUS * near[:, 1] if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return loss.argmin(1), like.max(1) / like.sum(1), ambiguous


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        sample_rows: int = SAMPLE_ROWS, dims: int = DIMS) -> LanguageModel:
    """Fits on at most about ``sample_rows`` rows with a language and a text,
    drawn by the hash of their ids; raises ValueError if there are none."""
    d = docs.filter(F.col(lang_col).isNotNull() & has_letter(F.col(text_col)))
    n = d.count()
    if not n:
        raise ValueError("no row with a language and a letter to learn from")
    if n > sample_rows:
        d = d.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) < int(sample_rows / n * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for p in slices(batch.column(1)):
                grams, rows = features(p, dims)
                own = np.array(langs[p.first:p.first + p.rows], object)[rows]
                for lang in set(own):
                    c = np.bincount(grams[own == lang], minlength=dims)
                    sums[lang] = sums.get(lang, 0) + c
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))],
                                             ["lang", "gram", "n"])

    counts = (d.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, gram int, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(counts["lang"].unique())
    table = np.zeros((len(languages), dims))
    table[np.searchsorted(languages, counts["lang"]), counts["gram"]] = counts["n"]
    share = (table + 0.5) / (table + 0.5).sum(1, keepdims=True)  # each language counts the same
    codes = codewords(len(languages))
    odds = np.stack([np.log(share[codes[:, b] > 0].mean(0)) - (np.log(share[codes[:, b] < 0].mean(0)) if (codes[:, b] < 0).any() else 0)
                     for b in range(codes.shape[1])], 1)
    # a bit is trusted as far as it tells the mean texts of its two sides apart
    mean = share @ odds
    trust = np.maximum((mean * codes).min(0), 1e-3)
    return LanguageModel(languages, codes, odds.astype(np.float32), trust / trust.max())


SCORED = "lang_pred string, score double, ambiguous boolean"


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for each row.

    The whole text is read. Without a letter, or a text, the language is ``und``
    with score 0 and is ambiguous. Equal texts get equal results, whatever their
    other columns, which are not read; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bits x dims floats, however large the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for p in slices(batch.column(1)):
                best, score, ambiguous = m.decode(m.margins(p))
                known = batch.column(2).slice(p.first, p.rows).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(p.first, p.rows), pa.array(np.where(known, np.array(m.languages, object)[best], "und"), pa.string()),
                     pa.array(np.where(known, score, 0.0)), pa.array(ambiguous | ~known)], ["doc_id", "lang_pred", "score", "ambiguous"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), has_letter(text).alias("known")).mapInArrow(run, f"doc_id long, {SCORED}")
