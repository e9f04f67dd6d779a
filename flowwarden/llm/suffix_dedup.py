"""Suffix dedup of repeated byte strings by a depth-limited radix sort.

Suffixes need an order only through ``DEPTH`` bytes: equal groups at that depth
are exactly the repeated strings, so nothing is compared beyond it and no whole
suffix array is built. Passes deal suffixes out to buckets by a digit, sort each
bucket, and finish groups of one; the most significant digit goes first:

1. The first digit is the suffix's anchor, the block of half the depth with the
   least hash among the blocks in its first ``DEPTH`` bytes. Equal suffixes have
   equal anchors, and neighbours mostly share theirs, so one digit serves 13
   suffixes on average; the plain prefix as first digit would be dealt for each.
2. The second digit is the stretch of neighbours that share the anchor, as one
   string. A group whose stretches are all equal is sorted as a whole.
3. Suffixes of the other groups (where repeats end) are sorted one by one through
   all ``DEPTH`` bytes.

In a group of equal suffixes the smallest document comes first. Digits are dealt
as hashes: 32 bits and the bucket's in the first pass, which only prunes, 64 bits
beside a bucket of independent bits in the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .firstseen import CHUNK_BYTES, GROUPED, Keys, chunked, in_order, in_steps, packed, top_bits, with_rest
from .text import BYTES, SYMBOL, Poly, column_bytes, covered, windows_in_rows

DEPTH = 50
OTHER = Poly(0xE7037ED1A0B428DB)


def least(h: np.ndarray, k: int) -> np.ndarray:
    """Least of every ``k`` consecutive values, by doubling spans."""
    span = 1
    while 2 * span <= k and len(h):
        h = np.minimum(h[:len(h) - span], h[span:])
        span *= 2
    return np.minimum(h[:max(0, len(h) - (k - span))], h[k - span:]) if span < k else h


class _Windows:
    """All windows of a chunk's documents, and the runs of them that share an
    anchor."""

    def __init__(self, t: pa.Table, depth: int, buckets: int):
        block, self.depth, self.buckets = depth // 2, depth, buckets
        self.table, self.ids = in_order(t)
        self.data, self.off = column_bytes(self.table.column("text"))
        self.symbols = SYMBOL[self.data]
        self.running = BYTES.running(self.symbols)
        self.starts, self.rows = windows_in_rows(self.off, depth)
        anchor = least(BYTES.windows(self.running, block), depth - block + 1)[self.starts]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (self.rows[1:] != self.rows[:-1])
        self.run_starts = np.flatnonzero(new)
        self.run_ends = np.append(self.run_starts[1:], len(anchor)) - 1
        self.bucket, self.anchor = top_bits(anchor[self.run_starts], buckets)
        self.anchors = Keys(self.bucket, self.anchor)

    def shared(self, answers: pa.Table) -> np.ndarray:
        """Runs whose anchor another document has."""
        k, run_rows = self.anchors, self.rows[self.run_starts]
        two = run_rows[k.first] != np.maximum.reduceat(run_rows[k.order], k.starts) if len(k.starts) else np.zeros(0, bool)
        return np.flatnonzero((two | k.answered(answers, 1))[k.of])

    def stretches(self, runs: np.ndarray) -> Keys:
        """The runs as whole strings, grouped by anchor."""
        lo = self.starts[self.run_starts[runs]]
        hi = self.starts[self.run_ends[runs]] + self.depth
        return Keys(self.bucket[runs], BYTES.ranges(self.running, lo, hi), self.anchor[runs])

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and rows of the windows of some runs."""
        at = np.zeros(len(self.run_starts), bool)
        at[runs] = True
        at = np.repeat(at, self.run_ends - self.run_starts + 1)
        return self.starts[at], self.rows[at]

    def keys(self, starts: np.ndarray) -> Keys:
        other, key = (p.ranges(r, starts, starts + self.depth) for p, r in ((OTHER, OTHER.running(self.symbols)), (BYTES, self.running)))
        return Keys(top_bits(other, self.buckets)[0], key)

    def before(self, k: Keys, rows: np.ndarray) -> np.ndarray:
        """Whether a smaller document of this chunk has each key."""
        return self.ids[rows[k.first]][k.of] < self.ids[rows]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
                 chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (start and end of the
    maximal removed runs), kept (the remaining bytes), text (the remaining whole
    characters: one that loses a byte goes), rest (the other columns, as a struct).

    A byte goes if a string of ``depth`` bytes covers it that also starts in a
    document of a smaller id. Strings never cross documents; rows that share an id
    don't remove each other's bytes; null ids are the smallest; a null text is
    empty; an empty table gives no rows."""
    chunks, buckets = chunked(docs, id_col, text_col, chunk_bytes)

    def prune(t: pa.Table, answers: pa.Table) -> Keys:
        return _Windows(t, depth, buckets).anchors

    def extend(t: pa.Table, answers: pa.Table) -> Keys:
        w = _Windows(t, depth, buckets)
        return w.stretches(w.shared(answers))

    def settled(w: _Windows, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Runs that repeat a smaller document as a whole, and the undecided."""
        runs = w.shared(answers)
        k = w.stretches(runs)
        mixed = k.answered(answers, 2, "mixed")[k.of]
        again = k.answered(answers, 2)[k.of] | w.before(k, w.rows[w.run_starts[runs]])
        return runs[again & ~mixed], runs[mixed]

    def probe(t: pa.Table, answers: pa.Table) -> Keys:
        w = _Windows(t, depth, buckets)
        return w.keys(w.windows(settled(w, answers)[1])[0])

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        w = _Windows(t, depth, buckets)
        whole, open_runs = settled(w, answers)
        starts, rows = w.windows(open_runs)
        k = w.keys(starts)
        again = k.answered(answers, 3)[k.of] | w.before(k, rows)
        starts = np.concatenate([w.windows(whole)[0], starts[again]])
        gone = covered(starts, depth, len(w.data))
        begin, stop = gone.copy(), gone.copy()
        begin[1:] &= ~gone[:-1]
        stop[:-1] &= ~gone[1:]
        inner = w.off[(w.off > 0) & (w.off < len(gone))]
        begin[inner] = gone[inner]
        stop[inner - 1] = gone[inner - 1]
        lo, hi = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        span_off = np.searchsorted(lo, w.off)
        row = np.searchsorted(w.off, lo, "right") - 1
        span = pa.StructArray.from_arrays([pa.array(lo - w.off[row]), pa.array(hi - w.off[row])], ["start", "end"])
        # a character starts at each byte that doesn't continue one
        char = np.flatnonzero((w.data & 0xC0) != 0x80)
        cut = np.repeat(np.logical_or.reduceat(gone, char), np.diff(np.append(char, len(gone)))) if len(char) else gone
        return pa.table({"doc_id": w.table.column("doc_id"), "n_bytes": pa.array(np.diff(w.off)),
                         "spans": pa.ListArray.from_arrays(pa.array(span_off, pa.int32()), span),
                         "kept": packed(w.data[~gone], np.concatenate([[0], np.cumsum(~gone)])[w.off], pa.binary()),
                         "text": packed(w.data[~cut], np.concatenate([[0], np.cumsum(~cut)])[w.off], pa.string()),
                         "rest": w.table.column("rest")})

    return in_steps(chunks, [(prune, "<u4", "other"), (extend, GROUPED, "earlier"), (probe, "<u8", "earlier")], finish,
                    with_rest(chunks, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary, text string"))
