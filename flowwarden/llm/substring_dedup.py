"""Substring dedup of repeated word windows by fixed-block anchors.

Each text is cut into non-overlapping reference blocks of ``WINDOW // 2`` words.
A window of ``WINDOW`` words holds a whole reference block wherever it starts, so
two equal windows meet where the block in one equals a rolling window of the
other:

1. The reference blocks are indexed, and every rolling window of a block's length
   probes the index, in one exchange of 31-bit keys beside the bucket's bits; one
   more bit tells reference blocks. A text learns which of its rolling blocks
   equal a reference block elsewhere, and which of its reference blocks were hit.
2. Hits are extended: the windows that hold a hit are compared whole (64-bit keys
   beside a bucket of independent bits), and those that an earlier place holds
   join to maximal exact repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .firstseen import CHUNK_BYTES, Keys, chunked, in_order, in_steps, packed, top_bits, with_rest
from .text import WORDS, Poly, Slice, column_bytes, covered, windows_in_rows, word_hashes

WINDOW = 20
OTHER = Poly(0xA24BAED4963EE407)


class _Words:
    """The words of a chunk's documents and their rolling windows."""

    def __init__(self, t: pa.Table, window: int):
        self.rows, _ = in_order(t)
        data, off = column_bytes(self.rows.column("text"))
        self.text = Slice(data, off, 0)
        self.s, self.e, self.bounds = self.text.words()
        self.words = word_hashes(data, self.s, self.e)
        self.running = WORDS.running(self.words)
        self.starts, _ = windows_in_rows(self.bounds, window)
        self.block = window // 2
        self.blocks, row = windows_in_rows(self.bounds, self.block)
        self.reference = (self.blocks - self.bounds[row]) % self.block == 0


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the words
    that are left, joined by one space), rest (the other columns, as a struct).

    A word goes if a window of ``window`` words covers it whose words also start
    earlier: in a smaller id, or earlier in the same text. A null text has no
    words; texts shorter than a window stay whole; null ids are the smallest;
    rows that share an id are in the order of their texts; an empty table gives
    no rows."""
    chunks, buckets = chunked(docs, id_col, text_col, chunk_bytes)

    def anchors(x: _Words) -> Keys:
        bucket, key = top_bits(WORDS.windows(x.running, x.block)[x.blocks], buckets, 31)
        k = Keys(bucket, key)
        is_reference = np.maximum.reduceat(x.reference[k.order], k.starts) if len(k.starts) else np.zeros(0, bool)
        k.entry = k.entry << np.uint32(1) | is_reference.astype(np.uint32)
        return k

    def candidates(x: _Words, answers: pa.Table) -> np.ndarray:
        """Starts of the windows that hold a hit."""
        k = anchors(x)
        again = np.diff(np.append(k.starts, len(k.of))) > 1
        hit = ((again & (k.entry & 1).astype(bool)) | k.answered(answers, 1))[k.of]
        run = np.zeros(len(x.words) + 2, np.int64)  # hits before a word
        run[x.blocks[hit] + 1] = 1
        run = np.cumsum(run)
        return x.starts[run[x.starts + window - x.block + 1] > run[x.starts]]

    def window_keys(x: _Words, starts: np.ndarray) -> Keys:
        bucket, _ = top_bits(OTHER.windows(OTHER.running(x.words), window)[starts], buckets)
        return Keys(bucket, WORDS.windows(x.running, window)[starts])

    def index_and_probe(t: pa.Table, answers: pa.Table) -> Keys:
        return anchors(_Words(t, window))

    def extend(t: pa.Table, answers: pa.Table) -> Keys:
        x = _Words(t, window)
        return window_keys(x, candidates(x, answers))

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        x = _Words(t, window)
        starts = candidates(x, answers)
        k = window_keys(x, starts)
        again = k.answered(answers, 2)[k.of]
        again |= k.first[k.of] != np.arange(len(starts))
        gone = covered(starts[again], window, len(x.s))
        run = np.concatenate([[0], np.cumsum(gone)])
        data, off = x.text.data.copy(), x.text.off
        kept = np.flatnonzero(~gone)
        row = np.searchsorted(x.bounds, kept, "right") - 1
        between = np.zeros(len(kept), bool)
        between[:-1] = row[1:] == row[:-1]
        edge = np.zeros(len(data) + 1, np.int64)
        edge[x.s[kept]] += 1
        edge[x.e[kept]] -= 1
        use = np.cumsum(edge[:-1]) > 0
        use[x.e[kept[between]]] = True
        data[x.e[kept[between]]] = 0x20
        out_off = np.concatenate([[0], np.cumsum(use)])[off]
        return pa.table({"doc_id": x.rows.column("doc_id"), "n_words": pa.array(np.diff(x.bounds)),
                         "n_removed": pa.array(run[x.bounds[1:]] - run[x.bounds[:-1]]),
                         "kept": packed(data[use], out_off, pa.string()), "rest": x.rows.column("rest")})

    return in_steps(chunks, [(index_and_probe, "<u4", "probed"), (extend, "<u8", "earlier")], finish,
                    with_rest(chunks, "doc_id long, n_words long, n_removed long, kept string"))
