"""Byte-level BPE: encoding with token offsets, and decoding.

Pre-tokenisation uses no regular expression. Every code point gets a class; a
class is a transition function over the states of a small automaton, and
functions compose associatively, so the state at every place comes from a scan:
composed functions of blocks, a scan over the blocks, and one more step inside
them, all over whole arrays. The places where a token of the pattern starts are
read from (state, class). The slices between them go through pair merging, whose
results a worker keeps; ids, byte offsets and decoded bytes are gathered from
these results as arrays.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Slice, column_bytes, mix, slices

#: Slices whose ids a Python worker keeps (about 200 bytes each); longer slices
#: than this many bytes are merged each time, by a heap instead of together.
KEPT_SLICES = 400_000
KEPT_BYTES = 64
#: Slices are merged together in groups of up to this many bytes each.
WIDTHS = (4, 8, 12, 16, 24, 40, KEPT_BYTES)
NO_RANK = 1 << 31
#: Bytes of text in one work array.
WORK_BYTES = 1 << 20
BLOCK = 128

# Classes of code points: letter, number, other, white space.
LETTER, NUMBER, OTHER, SPACE = range(4)
# Classes that the automaton reads. A quote that opens a contraction of one or
# two letters is told apart, and so is the last white space before a word.
QUOTE_1, QUOTE_2, LAST_BLANK, LAST_SPACE = range(4, 8)
N_CLASSES = 8
# States: what the text read so far ends with.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, ONE_MORE, TWO_MORE, IN_SPACE = range(8)
N_STATES = 8

# The contractions of the published pattern.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a token starts here", by class and state. Classes from
    ``N_CLASSES`` on are those of a text's first code point, which forget the state."""
    step = np.zeros((2 * N_CLASSES, N_STATES), np.uint8)
    start = np.ones((2 * N_CLASSES, N_STATES), bool)
    step[LETTER], step[NUMBER], step[OTHER], step[SPACE] = IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE
    step[QUOTE_1], step[QUOTE_2], step[LAST_BLANK], step[LAST_SPACE] = ONE_MORE, TWO_MORE, AFTER_BLANK, FRESH
    for c, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (QUOTE_1, IN_OTHERS), (QUOTE_2, IN_OTHERS)):
        for state in (run, AFTER_BLANK):
            step[c, state], start[c, state] = run, False
    step[LETTER, TWO_MORE], step[LETTER, ONE_MORE] = ONE_MORE, FRESH
    start[LETTER, [TWO_MORE, ONE_MORE]] = False
    start[SPACE, IN_SPACE] = False
    step[N_CLASSES:] = step[:N_CLASSES, [FRESH]]
    return step, start


STEP, START = _automaton()


@lru_cache(maxsize=1)
def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """First code points and classes of the runs of equal class, by the Unicode
    tables of the library that defines the encoding: it is asked which code points
    a one-class pattern keeps."""
    import tiktoken

    points = np.array([p for p in range(0x110000) if not 0xD800 <= p < 0xE000], np.int64)
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    single = {bytes([b]): b for b in range(256)}
    kind = np.full(0x110000, OTHER, np.uint8)
    for c, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        probe = tiktoken.Encoding(f"class-{c}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        kind[np.frombuffer(bytes(probe.encode_ordinary(text)).decode().encode("utf-32-le"), "<u4")] = c
    first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    return first, kind[first]


def states_before(classes: np.ndarray) -> np.ndarray:
    """State before each place, for a sequence that begins with a first-of-text class."""
    n = len(classes)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, SPACE, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    table = STEP.ravel()
    whole = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8), (rows, N_STATES))
    grid <<= 3
    for column in grid:  # the function of each block: all blocks at once
        whole = table.take(column[:, None] | whole)
    width = 1
    while width < rows:  # scan over the blocks: compose with the function ``width`` blocks before
        whole = np.concatenate([whole[:width], np.take_along_axis(whole[width:], whole[:-width].astype(np.intp), 1)])
        width *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = whole[:-1, FRESH]
    out = np.empty_like(grid)
    for k, column in enumerate(grid):
        out[k] = state
        state = table.take(column | state)
    return out.T.ravel()[:n]


def boundaries(piece: Slice, kind: np.ndarray) -> np.ndarray:
    """Byte at which each token of the pattern starts, in a slice of valid UTF-8."""
    data, off = piece.data, piece.off
    if not len(data):
        return np.zeros(0, np.int64)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    c = kind[points]
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, off[off < len(data)])] = True
    first[n] = True
    ends = first[1:]  # the last code point of a text
    space = c == SPACE
    follows = np.zeros(n, bool)
    follows[:-1] = ~space[1:]
    last = space & follows & ~ends
    quote = np.flatnonzero(points == ord("'"))
    quote = quote[~ends[quote]]
    after = points[quote + 1]
    one = np.isin(after, [ord(x) for x in ONE_LETTER])
    c = c.copy()
    c[quote[one]] = QUOTE_1
    pair, after = quote[~one & ~ends[quote + 1]], after[~one & ~ends[quote + 1]]
    then = points[pair + 2]
    two = np.zeros(len(pair), bool)
    for x in TWO_LETTERS:
        two |= (after == ord(x[0])) & (then == ord(x[1]))
    c[pair[two]] = QUOTE_2
    c[last] = np.where(points[last] == 0x20, LAST_BLANK, LAST_SPACE)
    c[first[:-1]] += N_CLASSES
    return at[START[c, states_before(c)]]


#: Masks of the first n of eight bytes, as little-endian numbers.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def alike(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A first occurrence of each distinct slice, and for every slice the number of
    its own. Slices of over 16 bytes stand for themselves."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 8,), (1,))
    one = words[starts] & FIRST_BYTES[np.minimum(size, 8)]
    two = words[starts + 8] & FIRST_BYTES[np.clip(size - 8, 0, 8)]
    long = np.flatnonzero(size > 16)
    two[long] = long
    number, _ = pd.factorize(mix(one ^ mix(two + (size.astype(np.uint64) << np.uint64(56)))))
    first = np.zeros(number.max(initial=-1) + 1, np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    own = first[number]
    if not ((one == one[own]) & (two == two[own]) & (size == size[own])).all():  # two slices of one hash
        return np.arange(len(starts)), np.arange(len(starts))
    return first, number


class Merges:
    """Pair merging by ranks: the pair of least rank first, the leftmost of equal ones."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([self.ranks.get(bytes([b]), NO_RANK) for b in range(256)], np.int64)
        if self.single.max() == NO_RANK:
            raise ValueError(f"{path} has no token for some byte")
        pairs = {(x << 32) | y: rank for token, rank in self.ranks.items() for k in range(1, len(token))
                 if (x := self.ranks.get(token[:k])) is not None and (y := self.ranks.get(token[k:])) is not None}
        order = sorted(pairs)
        self.pair, self.pair_rank = np.array([*order, 1 << 62], np.int64), np.array([*map(pairs.get, order), NO_RANK], np.int64)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.flat, self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _keep(self, pieces: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        """Remember the ids of new pieces: ``size`` of ``ids`` for each."""
        lo, hi = len(self.slot), len(self.slot) + len(pieces)
        if hi > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros(max(hi, len(x)), np.int64)]) for x in (self.begin, self.size))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(ids), len(self.flat)), np.int64)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.begin[lo:hi], self.size[lo:hi] = self.used + np.cumsum(size) - size, size
        self.slot.update(zip(pieces, range(lo, hi)))
        self.used += len(ids)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.pair_rank[at], NO_RANK)

    def together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of one group of lengths, merged in step: each round joins the
        least-ranked pair of every piece that has one."""
        size = np.array([len(p) for p in pieces], np.int64)
        n, width = len(pieces), int(size.max())
        inside = np.arange(width + 1) < size[:, None]
        ids = np.full((n, width + 1), NO_RANK, np.int64)
        ids[inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((n, width), NO_RANK, np.int64)
        both = inside[:, 1:]
        rank[both] = self._rank(ids[:, :-1][both], ids[:, 1:][both])
        live, column = np.arange(n), np.arange(width + 1)
        while len(live):
            at = rank[live].argmin(1)
            least = rank[live, at]
            live, at, least = (x[least < NO_RANK] for x in (live, at, least))
            if not len(live):
                break
            ids[live, at] = least
            # what stands behind the pair moves up by one
            step = np.minimum(column + (column > at[:, None]), width)
            ids[live] = np.take_along_axis(ids[live], step, 1)
            ids[live, width] = NO_RANK
            moved = np.take_along_axis(rank[live], np.minimum(column[:-1] + (column[:-1] > at[:, None]), width - 1), 1)
            moved[:, -1] = NO_RANK
            rank[live] = moved
            size[live] -= 1
            rank[live, at] = np.where(at + 1 < size[live], self._rank(ids[live, at], ids[live, at + 1]), NO_RANK)
            left = at > 0
            rank[live[left], at[left] - 1] = self._rank(ids[live[left], at[left] - 1], ids[live[left], at[left]])
        return ids[column < size[:, None]], size

    def learn(self, pieces: set[bytes]) -> None:
        known = [p for p in pieces if p in self.ranks or not p]
        self._keep(known, np.array([self.ranks[p] for p in known if p], np.int64), np.array([bool(p) for p in known], np.int64))
        rest = sorted(pieces.difference(known), key=len)
        lo = 0
        for width in WIDTHS:
            hi = lo
            while hi < len(rest) and len(rest[hi]) <= width:
                hi += 1
            if hi > lo:
                self._keep(rest[lo:hi], *self.together(rest[lo:hi]))
            lo = hi

    def encode(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        parts = [piece[k:k + 1] for k in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := ranks.get(piece[k:k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            nxt = after[k]
            if not parts[k] or nxt >= n or ranks.get(parts[k] + parts[nxt]) != r:
                continue
            parts[k] += parts[nxt]
            parts[nxt] = b""
            after[k] = nxt = after[nxt]
            if nxt < n:
                before[nxt] = k
                if (r := ranks.get(parts[k] + parts[nxt])) is not None:
                    heapq.heappush(heap, (r, k))
            if (b := before[k]) >= 0 and (r := ranks.get(parts[b] + parts[k])) is not None:
                heapq.heappush(heap, (r, b))
        return [ranks[p] for p in parts if p]

    def ids(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slices that begin at ``starts``, and how many each gave."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(data))
        raw = data.tobytes()
        first, number = alike(data, starts, ends - starts)
        found = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        own = {}  # rare long slices are not worth their memory
        for k in np.flatnonzero(ends[first] - starts[first] > KEPT_BYTES).tolist():
            own[k], found[k] = np.array(self.encode(found[k]), np.int64), b""
        if len(self.slot) > KEPT_SLICES:
            self.forget()
        self.learn(set(found).difference(self.slot))
        slot = np.fromiter(map(self.slot.__getitem__, found), np.int64, len(found))[number]
        size = self.size[slot]
        out = self.flat[spans(self.begin[slot], size)]
        if own:
            long = np.flatnonzero(np.isin(number, list(own)))
            at = (np.cumsum(size) - size)[long]  # long slices gave none so far
            size[long] = [len(own[k]) for k in number[long].tolist()]
            out = np.insert(out, np.repeat(at, size[long]), np.concatenate([own[k] for k in number[long].tolist()]))
        return out, size

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the tokens, one after another, and the length of each."""
        n = self.length[ids]
        return self.bytes[spans(self.start[ids], n)], n


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start..start+length of each span, one span after another."""
    total = np.cumsum(length)
    out = np.arange(total[-1] if len(total) else 0)
    return out + np.repeat(start - (total - length), length)


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _valid(col: pa.Array) -> pa.Array:
    """The texts as valid UTF-8: a byte that is none becomes U+FFFD."""
    data, off = column_bytes(col)
    try:
        data.tobytes().decode()
        return col
    except UnicodeDecodeError:
        raw = data.tobytes()
        fixed = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        return pa.array(fixed, pa.large_binary())


def _long_lists(values: np.ndarray, per_row: np.ndarray, kind: pa.DataType) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           offsets: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array<int>) and, unless left out,
    offsets (array<long>): the byte of the text at which each token starts.

    A null or empty text has no ids; a byte that is no UTF-8 counts as U+FFFD;
    rows are encoded each for itself, whatever ids or texts they share; an empty
    table gives no rows. Other columns are not read, so their names don't matter.
    ``path`` names a file of ranks that every executor has."""
    path = path or ranks_path()
    first, kinds = class_runs()
    names = ["doc_id", "ids", *(["offsets"] if offsets else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.repeat(kinds, np.diff(np.append(first, 0x110000)))
        table = merges(path)
        for batch in batches:
            for p in slices(_valid(batch.column(1)), WORK_BYTES):
                starts = boundaries(p, kind)
                ids, n = table.ids(p.data, starts)
                per_row = np.diff(np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, p.off)])
                cols = [batch.column(0).slice(p.first, p.rows), _long_lists(ids, per_row, pa.int32())]
                if offsets:
                    size = table.length[ids]
                    at = np.cumsum(size) - size - np.repeat(p.off[:-1], per_row)
                    cols.append(_long_lists(at, per_row, pa.int64()))
                yield pa.RecordBatch.from_arrays(cols, names)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, ids array<int>" + ", offsets array<long>" * offsets)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and decoded (binary) of rows with ``doc_id`` and ``ids``: the
    tokens' bytes, one after another. Null or no ids give no bytes; an id that the
    file has no token for fails the job."""
    path = path or ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(path)
        for batch in batches:
            rows = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            lo, n = 0, len(rows)
            size = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            run_of = np.concatenate([[0], np.cumsum(size)])
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(run_of, run_of[lo] + WORK_BYTES // 4, "right")) - 1)
                ids = rows.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(ids) and not (0 <= ids.min() and ids.max() < len(table.length) and table.length[ids].all()):
                    raise ValueError("an id has no token")
                data, length = table.decode(ids)
                ends = np.concatenate([[0], np.cumsum(length)])[run_of[lo:hi + 1] - run_of[lo]]
                out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), rows.slice(lo, hi - lo), out.cast(pa.binary())],
                                                 ["doc_id", "ids", "decoded"])
                lo = hi

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
