"""Filter interaction audit: what each of five filters removes in every order.

Four filters look at one text; the fifth drops a text that a smaller id has. The
texts are range-partitioned by prefixes that are as long as their weight asks for,
and go in order into compressed (radix) tries, whose terminals hold the least id
of a text. In order, only the last path of a trie is open: a branch that closes is
read off and forgotten, so a range of any size needs the memory of its longest
text. Rows become masks of failed filters; masks are counted, and the counts are
reduced to all orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written
from .text import mix, slices, word_hashes

FILTERS = "ABCDE"
MIN_WORDS = 50
#: Least percentage of distinct words, most percentage of capitals.
DISTINCT_PCT, CAPITAL_PCT = 65, 5
#: Prefix lengths in bytes; a prefix that is too heavy for one range gives way to
#: the next length, the last one to the whole text.
DEPTHS = (32, 256, 2048, 16384)
#: Bytes of distinct texts in a range, where the session's partitions aren't more.
RANGE_BYTES = 1 << 29

MARKED = np.zeros(256, bool)
MARKED[list(b"#$%&*|")] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[ord("A"):ord("Z") + 1] = True


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Failed filters of each text alone (bits 0 to 3) and the text's digest."""
    for batch in batches:
        for p in slices(batch.column(2)):
            s, e, bounds = p.words()
            n = np.diff(bounds)
            row = np.repeat(np.arange(p.rows), n)
            number, _ = pd.factorize(word_hashes(p.data, s, e) ^ mix(row.astype(np.uint64) + np.uint64(1)))
            first = np.ones(len(number), bool)
            first[1:] = number[1:] > np.maximum.accumulate(number)[:-1]
            distinct = np.bincount(row[first], minlength=p.rows)
            points = p.per_row((p.data & 0xC0) != 0x80)
            mask = ((n < MIN_WORDS) * 1 + (100 * distinct < DISTINCT_PCT * n) * 2
                    + (100 * p.per_row(CAPITAL[p.data]) > CAPITAL_PCT * points) * 4 + (p.per_row(MARKED[p.data]) > 0) * 8)
            raw = p.data.tobytes()
            keys = [md5(raw[a:b]).digest() for a, b in zip(p.off[:-1].tolist(), p.off[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(p.first, p.rows), batch.column(1).slice(p.first, p.rows),
                 pa.array(mask.astype(np.int32)), pa.array(keys, pa.binary())], ["doc_id", "part", "mask", "key"])


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()


def _prefixes(depths: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of the distinct texts of a batch and of their prefixes."""
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            texts = set(_bytes(batch))
            rows = [(_hash(t), len(t), [_hash(t[:d]) for d in depths]) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 3, kinds)], ["text", "bytes", "prefixes"])
    return run


def _hash(b: bytes) -> int:
    return int.from_bytes(md5(b).digest()[:8], "little", signed=True)


def heavy_prefixes(docs: DataFrame, depths: tuple[int, ...] = DEPTHS) -> tuple[list[set[int]], int]:
    """Hashes of the prefixes of each depth that weigh more than a range should, and
    the number of ranges. Weights are bytes of distinct texts; as the weights of one
    depth add up to all bytes, no depth has more heavy prefixes than there are ranges."""
    spark = docs.sparkSession
    t = docs.mapInArrow(_prefixes(depths), "text long, bytes long, prefixes array<long>")
    t = written(t.groupBy("text").agg(F.first("bytes").alias("bytes"), F.first("prefixes").alias("prefixes")), "text-prefixes")
    total = t.agg(F.sum("bytes")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    weights = t.select(F.posexplode("prefixes").alias("depth", "prefix"), "bytes").groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"))
    heavy = [set() for _ in depths]
    for r in weights.filter(F.col("bytes") > total / ranges).collect():
        heavy[r.depth].add(r.prefix)
    return heavy, ranges


class Trie:
    """Compressed trie of texts that come in order. ``path`` holds the open nodes
    from the root on, as [depth, least id at the terminal or None]; ``text`` is the
    last text. Closed terminals go to ``closed`` as (least id, digest of the text)."""

    def __init__(self):
        self.text, self.path, self.closed = b"", [[0, None]], []

    def _close(self) -> None:
        depth, least = self.path.pop()
        if least is not None:
            self.closed.append((least, md5(self.text[:depth]).digest()))

    def insert(self, text: bytes, least: int) -> None:
        shared = common(self.text, text)
        while self.path[-1][0] > shared:
            if self.path[-2][0] < shared:  # the edge parts here: a node without a terminal takes its upper half
                self.path.insert(-1, [shared, None])
            self._close()
        if len(text) > shared:
            self.path.append([len(text), least])
        else:
            top = self.path[-1]
            top[1] = least if top[1] is None else min(top[1], least)
        self.text = text

    def finish(self) -> None:
        while self.path:
            self._close()


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo if a[lo:hi] != b[lo:hi] else hi


def _closed(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "key"])


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in batches:
        for text, least in zip(_bytes(batch), batch.column(0).to_pylist()):
            trie.insert(text, least)
        if trie.closed:
            yield _closed(trie.closed)
            trie.closed = []
    trie.finish()
    if trie.closed:
        yield _closed(trie.closed)


def first_holders(docs: DataFrame, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """(doc_id, key) for every distinct text of rows (doc_id, text) with an id: the
    least id that holds it, and the text's digest."""
    docs = docs.filter("doc_id IS NOT NULL")
    heavy, ranges = heavy_prefixes(docs, depths)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of a batch once, with their least ids and prefix lengths."""
        for batch in batches:
            least: dict[bytes, int] = {}
            for text, i in zip(_bytes(batch), batch.column(0).to_pylist()):
                if i < least.setdefault(text, i):
                    least[text] = i
            depth = []
            for text in least:
                k = 0
                while k < len(depths) and heavy[k] and _hash(text[:depths[k]]) in heavy[k]:
                    k += 1
                depth.append(depths[k] if k < len(depths) else len(text))
            yield pa.RecordBatch.from_arrays([pa.array(least.values(), pa.int64()), pa.array(least, pa.binary()), pa.array(depth, pa.int32())],
                                             ["doc_id", "text", "depth"])

    t = docs.mapInArrow(combine, "doc_id long, text binary, depth int")
    t = t.repartitionByRange(ranges, F.expr("substring(text, 1, depth)")).sortWithinPartitions("text")
    return t.select("doc_id", "text").mapInArrow(_tries, "doc_id long, key binary")


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """doc_id, part and mask (bit k: the text fails filter k of ``FILTERS``) of every row."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                    F.col(text_col).cast("string").alias("text"))
    alone = d.mapInArrow(_marks, "doc_id long, part string, mask int, key binary")
    first = first_holders(d.select("doc_id", "text"), depths).withColumn("first", F.lit(True))
    out = alone.join(first, ["doc_id", "key"], "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return out.select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def _orders() -> tuple[list[tuple[str, int]], np.ndarray, np.ndarray, np.ndarray]:
    """All (order, step) and, by mask and (order, step): kept after the step, removed
    in it, and failing its filter but removed before."""
    steps = [("".join(o), k) for o in permutations(FILTERS) for k in range(1, len(FILTERS) + 1)]
    mask = np.arange(1 << len(FILTERS))[:, None]
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    before = np.array([sum(bit[f] for f in o[:k - 1]) for o, k in steps])
    here = np.array([bit[o[k - 1]] for o, k in steps])
    fails, gone = (mask & here) > 0, (mask & before) > 0
    return steps, ~fails & ~gone, fails & ~gone, fails & gone


AUDIT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
         "good_lost long, toxic_lost long, shapley long")


def _reduce(t: pa.Table) -> pa.Table:
    steps, kept, removed, redundant = _orders()
    count = {c: np.zeros(1 << len(FILTERS), np.int64) for c in ("n", "good", "toxic")}
    for c, total in count.items():
        np.add.at(total, t.column("mask").to_numpy(), t.column(c).to_numpy())
    per = lambda c, m: count[c] @ m.astype(np.int64)
    lost = per("n", removed)
    letter = np.array([FILTERS.index(o[k - 1]) for o, k in steps])
    shapley = np.zeros(len(FILTERS), np.int64)
    np.add.at(shapley, letter, lost)
    cols = [[t.column("part")[0].as_py()] * len(steps), [o for o, _ in steps], [k for _, k in steps], per("n", kept), lost, per("n", redundant),
            count["n"][1 << letter], per("good", removed), per("toxic", removed), shapley[letter]]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split(" ")[0] for c in AUDIT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
          good: Column | None = None, toxic: Column | None = None, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """One row per part, order of the filters and step: documents kept after the
    step, removed in it, redundant (they fail its filter but went before), failing
    its filter only, good and toxic ones removed in it, and the filter's removed
    documents summed over all orders.

    Null texts count as empty, null parts as ''. A row without an id copies no text
    and is no text's first holder; rows that share id and text are no copies of each
    other, and each counts. Of several labels of an id one is enough; labels without
    a document don't count. An empty table gives no rows. Other columns are not read,
    so their names don't matter."""
    good = F.col("quality") == 1 if good is None else good
    toxic = F.col("toxic") == 1 if toxic is None else toxic
    flags = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(good, F.lit(False)).alias("good"), F.coalesce(toxic, F.lit(False)).alias("toxic"))
             .filter("doc_id IS NOT NULL AND (good OR toxic)").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")))
    found = masks(docs, id_col, text_col, part_col, depths).join(flags, "doc_id", "left")
    counts = found.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("good"), 1)).alias("good"),
                                               F.count(F.when(F.col("toxic"), 1)).alias("toxic"))
    return counts.groupBy("part").applyInArrow(_reduce, AUDIT)
