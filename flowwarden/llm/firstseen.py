"""Which keys of a large table occur elsewhere, without moving rows per key.

Documents are cut into chunks by ranges of their id, a few megabytes each. A
chunk hashes its windows, sorts the distinct keys by bucket, and sends each
bucket one packed array. A bucket merges the arrays of all chunks and answers
each chunk with a bitmap over the keys it sent; the chunk hashes its text again
and reads the answer in the same order. A frequent key costs one entry per
chunk, so no key makes a large group, and as chunks follow the order of ids,
"seen in an earlier chunk" means "seen in a smaller id".
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import trimmed

#: Mean bytes of text in a chunk, and of text for each bucket of keys.
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 6 << 20
NO_ID = -(1 << 63)

SENT = "bucket int, chunk int, keys binary"
ANSWER = "step int, chunk int, bucket int, seen binary, mixed binary"
#: Entries that carry the group they belong to beside their key.
GROUPED = np.dtype([("group", "<u4"), ("key", "<u8")])


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text, rest) and the number of buckets, a power of two. Null
    ids count as the smallest; ``rest`` holds the other columns."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    size = docs.select(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    n = max(1, math.ceil(size / chunk_bytes))
    bounds = np.zeros(0, np.int64)
    if n > 1:
        cuts = docs.select(F.percentile_approx(key, [i / n for i in range(1, n)], F.lit(max(10_000, 4 * n)))).first()[0]
        bounds = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def chunk_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), "right").astype(np.int32))

    d = docs.select(chunk_of(key).alias("chunk"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                    F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(None).cast("int").alias("none")]).alias("rest"))
    return d, 1 << max(0, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))


def in_order(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A chunk's rows by id (then text), and the ids."""
    t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = t.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    return (t, ids) if np.array_equal(order, np.arange(len(ids))) else (t.take(pa.array(order)), ids[order])


class Keys:
    """Keys of a chunk's windows: the distinct ones by bucket (and ``group``, if
    keys belong to groups), and each window's."""

    def __init__(self, bucket: np.ndarray, key: np.ndarray, group: np.ndarray | None = None):
        order = np.argsort(key, kind="stable")
        for by in ([group] if group is not None else []) + [bucket]:
            order = order[np.argsort(by[order], kind="stable")]
        b, k = bucket[order], key[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
        if group is not None:
            g = group[order]
            new[1:] |= g[1:] != g[:-1]
        self.order, self.starts = order, np.flatnonzero(new)
        self.of = np.empty(len(k), np.int64)  # the distinct key of each window
        self.of[order] = np.cumsum(new) - 1
        self.bucket, self.entry = b[self.starts], k[self.starts]
        if group is not None:
            self.entry = np.empty(len(self.starts), GROUPED)
            self.entry["group"], self.entry["key"] = g[self.starts], k[self.starts]
        self.first = order[self.starts]  # the first window that has the key

    def sent(self, chunk: int) -> pa.Table:
        cut = np.flatnonzero(np.diff(self.bucket)) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(self.entry)]])
        some = [(self.bucket[a], self.entry[a:b].tobytes()) for a, b in zip(lo, hi) if b > a]
        return pa.table({"bucket": pa.array([x[0] for x in some], pa.int32()), "chunk": pa.array([chunk] * len(some), pa.int32()),
                         "keys": pa.array([x[1] for x in some], pa.binary())})

    def answered(self, answers: pa.Table, step: int, what: str = "seen") -> np.ndarray:
        """The answer's bit for each distinct key, in this object's order."""
        out = np.zeros(len(self.entry), bool)
        lo = np.searchsorted(self.bucket, np.arange(int(self.bucket[-1]) + 2 if len(self.bucket) else 1))
        for k, b, bits in zip(answers.column("step").to_pylist(), answers.column("bucket").to_pylist(), answers.column(what).to_pylist()):
            if k == step and bits is not None:
                out[lo[b]:lo[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=lo[b + 1] - lo[b])
        return out


def top_bits(h: np.ndarray, buckets: int, bits: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and the next ``bits`` bits of hashes, for steps that only prune."""
    b = buckets.bit_length() - 1
    shift = np.uint64(64 - b - bits)
    return ((h >> np.uint64(64 - b)) if b else np.zeros_like(h)).astype(np.uint32), (h >> shift).astype(np.uint32)


def answers(sent: DataFrame, step: int, dtype: np.dtype | str, where: str) -> DataFrame:
    """Bitmaps over each array of keys. ``seen``: the key is in a chunk before this
    one (``earlier``), in any ``other`` chunk, or in another chunk where one of the
    two is an index entry by its lowest bit, which isn't part of the key
    (``probed``). ``mixed``: the key's group has several keys."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        parts = [np.frombuffer(x, dtype) for x in t.column("keys").to_pylist()]
        entries = np.concatenate(parts)
        grouped = entries.dtype.names is not None
        keys = entries["key"] if grouped else entries >> 1 if where == "probed" else entries
        order = np.argsort(keys, kind="stable")
        if grouped:
            order = order[np.argsort(entries["group"][order], kind="stable")]
        k = keys[order]
        same = np.zeros(len(k) + 1, bool)  # as the one before
        same[1:-1] = k[1:] == k[:-1]
        found = {"seen": np.empty(len(k), bool), "mixed": np.zeros(len(k), bool)}
        if grouped:
            g = entries["group"][order]
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            same[starts] = False
            many = np.maximum.reduceat(k, starts) != np.minimum.reduceat(k, starts)
            found["mixed"][order] = np.repeat(many, np.diff(np.append(starts, len(k))))
        seen = same[:-1] if where == "earlier" else same[:-1] | same[1:]
        if where == "probed" and len(k):
            starts = np.flatnonzero(~same[:-1])
            indexed = np.repeat(np.add.reduceat((entries[order] & 1).astype(np.int64), starts), np.diff(np.append(starts, len(k))))
            seen = seen & (indexed > 0)  # an index entry is in another chunk, or is this one and another chunk probes it
        found["seen"][order] = seen
        ends = np.cumsum([len(p) for p in parts])
        bits = {n: pa.array([np.packbits(f[b - len(p):b]).tobytes() if f[b - len(p):b].any() else None
                             for p, b in zip(parts, ends)], pa.binary()) for n, f in found.items()}
        out = pa.table({"step": pa.array([step] * len(parts), pa.int32()), "chunk": t.column("chunk"), "bucket": t.column("bucket"), **bits})
        return out.filter(pc.or_(out.column("seen").is_valid(), out.column("mixed").is_valid()))

    return sent.groupBy("bucket").applyInArrow(lambda t: trimmed(run(t)), ANSWER)


def in_steps(chunks: DataFrame, steps: list[tuple[Callable, np.dtype | str, str]], finish: Callable, schema: str | T.StructType) -> DataFrame:
    """Steps ``(keys, dtype, where)``: ``keys(table, answers) -> Keys`` of a chunk,
    given the answers to the steps before; then ``finish(table, answers)`` makes
    the chunk's result. The chunks are shuffled once and read again by each step."""
    none = pa.table({"step": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()),
                     "seen": pa.array([], pa.binary()), "mixed": pa.array([], pa.binary())})
    nothing = pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), "keys": pa.array([], pa.binary())})

    def alone(keys: Callable) -> Callable:  # Spark calls by the number of parameters
        return lambda t: trimmed(keys(t, none).sent(t.column("chunk")[0].as_py()))

    def told(keys: Callable) -> Callable:
        return lambda t, a: trimmed(keys(t, a if a.num_rows else none).sent(t.column("chunk")[0].as_py()) if t.num_rows else nothing)

    got = None
    for n, (keys, dtype, where) in enumerate(steps, 1):
        g = chunks.groupBy("chunk")
        sent = g.applyInArrow(alone(keys), SENT) if got is None else g.cogroup(got.groupBy("chunk")).applyInArrow(told(keys), SENT)
        new = answers(sent, n, dtype, where)
        got = new if got is None else got.unionByName(new)
    return chunks.groupBy("chunk").cogroup(got.groupBy("chunk")).applyInArrow(
        lambda t, a: trimmed(finish(t, a if a.num_rows else none)), schema)


def with_rest(chunks: DataFrame, ddl: str) -> T.StructType:
    """The columns of ``ddl`` and the chunks' ``rest``."""
    return T.StructType([*T.StructType.fromDDL(ddl).fields, chunks.schema["rest"]])


def packed(data: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A string or binary column over ``data``, cut at ``off``."""
    return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
