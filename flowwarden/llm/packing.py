"""Best-two-fit packing of documents into sequences of at most ``size`` tokens.

Tokens are counted where the text is read; only piece lengths and checksums
travel. Pieces are spread by a hash into cells of about ``CELL_PIECES``, and a
cell packs its pieces on a histogram of lengths, so its memory has a bound and a
cell leaves one half-filled sequence at most.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import trimmed

SIZE = 1024
END_ID = 2
CELL_PIECES = 40_000
#: Spans between spaces whose ids a task keeps (about 250 bytes each).
KEPT_SPANS = 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Spans(dict):
    """Ids, as little-endian bytes, of a span after a space; cleared when full."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, span: str) -> bytes:
        if len(self) >= KEPT_SPANS:
            self.clear()
        ids = self[span] = np.array(self.encode(self.lead + span), "<u4").tobytes()
        return ids


class TokenIds:
    """The ids that the tokenizer file at ``path`` gives a text, as bytes.

    A byte-level BPE of the GPT-2 kind never joins what a single space parts, so
    the ids of a text are those of its spans, and spans repeat. Texts with two
    spaces in a row, where white space itself is grouped, and texts with a
    special token's string go through the tokenizer whole. Spans are encoded by
    the same merges in ``tiktoken``, which is faster on short strings; tests hold
    both to the same ids."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        specials = {t["content"] for t in spec.get("added_tokens", [])}
        shown = _shown_bytes()
        ranks = {bytes(shown[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in specials}
        merges = tiktoken.Encoding("spans", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.specials = tuple(specials)
        self.first, self.later = _Spans(merges.encode_ordinary, ""), _Spans(merges.encode_ordinary, " ")

    def __call__(self, text: str) -> bytes:
        if "  " in text or any(s in text for s in self.specials):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *tail = text.split(" ")
        if not tail:
            return self.first[head] if head else b""
        if not tail[-1]:  # a last space has no span of its own
            tail.pop()
            return self.first[head] * bool(head) + b"".join(map(self.later.__getitem__, tail)) + self.later[""]
        return self.first[head] * bool(head) + b"".join(map(self.later.__getitem__, tail))

    def forget(self) -> None:
        """Drop what was kept: the worker may run other tasks next."""
        self.first.clear()
        self.later.clear()


def _shown_bytes() -> dict[str, int]:
    """The byte that each character of the vocabulary file stands for: printable
    Latin-1 stands for itself, the other bytes for the characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one, or full ones after a first
    that may be shorter."""
    first = n - (math.ceil(n / size) - 1) * size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document (schema ``PIECES``); ``path`` names a
    tokenizer file that every executor has."""
    path = path or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(path)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    out.append((doc_id, k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])
        encode.forget()
        trimmed()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def best_two_fit(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length (1 to ``size``).

    A sequence is filled greedily: the longest unpacked piece, then again the
    longest that fits. If a gap is left, the sequence's smallest piece goes back
    when two unpacked pieces fill the gap that it leaves more tightly than it
    did; an exact fit ends the search."""
    order = np.argsort(lengths, kind="stable")
    ends = np.searchsorted(lengths[order], np.arange(size + 2))
    left = np.diff(ends).tolist()  # unpacked pieces by length
    have = 0  # bit n: a piece of length n is unpacked
    for n, c in enumerate(left):
        have |= bool(c) << n
    below = [(1 << (n + 1)) - 1 for n in range(size + 1)]

    def take(n: int) -> None:
        nonlocal have
        left[n] -= 1
        if not left[n]:
            have ^= 1 << n

    def two_for(gap: int, more_than: int) -> tuple[int, int] | None:
        found, best = None, more_than
        a = (have & below[gap - 1]).bit_length() - 1
        while a > 0 and 2 * a > best:
            b = (have & below[min(a, gap - a)]).bit_length() - 1
            if b == a and left[a] < 2:
                b = (have & below[a - 1]).bit_length() - 1
            if b > 0 and a + b > best:
                found, best = (a, b), a + b
                if best == gap:
                    break
            a = (have & below[a - 1]).bit_length() - 1
        return found

    bins = []
    while have:
        one, gap = [], size
        while gap and (n := (have & below[gap]).bit_length() - 1) > 0:
            one.append(n)
            take(n)
            gap -= n
        if gap and len(one) > 1 and have:
            small = one[-1]
            if two := two_for(gap + small, small):
                for n in two:
                    take(n)
                one[-1:] = two
                if not left[small]:
                    have |= 1 << small
                left[small] += 1
        bins.append(one)
    flat = np.fromiter((n for one in bins for n in one), np.int64, len(lengths))
    sizes = np.fromiter(map(len, bins), np.int64, len(bins))
    number = np.repeat(np.arange(len(bins)), sizes)
    run = np.cumsum(flat) - flat
    offset = run - np.repeat(run[np.cumsum(sizes) - sizes], sizes) if len(flat) else run
    slot = np.argsort(flat, kind="stable")
    seq, at = np.empty(len(flat), np.int64), np.empty(len(flat), np.int64)
    seq[order], at[order] = number[slot], offset[slot]
    return seq, at


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
         size: int = SIZE, end_id: int = END_ID, cell_pieces: int = CELL_PIECES) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset.

    A null or empty text is one piece with the end id alone; repeated rows are
    packed each for itself; an empty table gives no rows. Other columns are not
    read, so their names don't matter."""
    cells = max(1, math.ceil(docs.count() / cell_pieces))
    # full pieces need no partner: they are cells' cheap rows, spread by piece
    cell = F.pmod(F.xxhash64("doc_id", "length", "ids_crc32", F.when(F.col("length") == size, F.col("piece"))), F.lit(cells))
    found = pieces(docs, id_col, text_col, path, size, end_id).withColumn("cell", cell)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        length = t.column("length").to_numpy()
        full = length == size
        seq, at = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        seq[full] = np.arange(full.sum())
        part, at[~full] = best_two_fit(length[~full], size)
        seq[~full] = part + full.sum()
        base = int(t.column("cell")[0].as_py()) << 32
        t = t.drop_columns(["cell"])
        return t.append_column("sequence_id", pa.array(seq + base)).append_column("offset", pa.array(at))

    return found.groupBy("cell").applyInArrow(run, PIECES + ", sequence_id long, offset long")
