"""Phrase collocation mining by sorting suffix pointers.

A suffix is up to ``max_words`` words from a place in a piece of text. Leading words
are counted first, over all text: suffixes of words below the least count are
abandoned, and the others end before the first such word. Tasks that read text count
equal suffixes of their part. Suffixes are then dealt out by their leading words: by
one word, or by as many as it takes to leave no prefix with more suffixes than a
cell should get. In a cell, a multikey three-way
quicksort partitions the suffix pointers by one word after another, all
partitions of a round at once: the size of an equal partition is the count of its
phrase, and partitions below the least count are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written
from .text import BYTES, LOWER, SYMBOL, Slice, mix, slices

MAX_WORDS = 5
MIN_COUNT = 100
#: A phrase goes if a longer candidate with it has this percentage of its count.
INSIDE_PCT = 100
TOP = 2000
NO_LANG = "und"
#: Text in which equal suffixes are counted before they travel.
CHUNK_BYTES = 1 << 23
#: Suffixes that leave a task together.
BATCH_SUFFIXES = 32_000
#: Bits that say which words occur often enough. Words of the same bit pass together,
#: so that the table has this size whatever the vocabulary; counts don't depend on it.
WORD_BITS = 1 << 25
#: Suffixes in a cell, and in a prefix that need not be dealt out by more words.
CELL_SUFFIXES = 1_000_000
PREFIX_SUFFIXES = CELL_SUFFIXES // 4

BLANK, STOP = np.zeros(256, bool), np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True
STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_TIMES = np.uint64(0x9E3779B97F4A7C15)

PACKED = "cell long, langs array<string>, words binary, sizes binary, lang binary, suffix binary, n binary"


def _squeezed(data: bytes | np.ndarray) -> bytes:
    raw = data if isinstance(data, bytes) else data.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _loose(b: bytes) -> bytes:
    n = int.from_bytes(b[:8], "little")
    return pa.Codec("zstd").decompress(b[8:], n, asbytes=True) if n else b""


def _pack(x: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes each as the largest one takes; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << (8 * w - (w == 8)))
    return bytes([width]) + _squeezed(x.astype(f"<u{width}"))


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(_loose(b[1:]), f"<u{b[0]}")


def _words(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Row of each word, its id from 1 on, whether the next word continues its piece,
    and the words by id."""
    data = LOWER[piece.data]
    inside = ~(BLANK[data] | STOP[data])
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = piece.off[(piece.off > 0) & (piece.off < len(data))]
    begin[edge], end[edge - 1] = inside[edge], inside[edge - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    offsets = np.concatenate([[0], np.cumsum(e - s)])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    coded = column.dictionary_encode()
    row = np.searchsorted(piece.off, s, "right") - 1
    stops = np.flatnonzero(STOP[data])
    goes_on = np.zeros(len(s), bool)
    goes_on[:-1] = (row[1:] == row[:-1]) & (np.searchsorted(stops, s[1:]) == np.searchsorted(stops, e[:-1]))
    return row, coded.indices.to_numpy(zero_copy_only=False) + 1, goes_on, coded.dictionary.cast(pa.binary())


def _suffixes(ids: np.ndarray, goes_on: np.ndarray, lang: np.ndarray, max_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct suffixes (a row of ids each, 0 behind the end), their languages and counts."""
    n = len(ids)
    number, groups = pd.factorize(lang)
    most = int(ids.max(initial=0)) + 1
    follows = np.ones(n, bool)
    columns = []
    for k in range(max_words):
        at, left = np.zeros(n, np.int32), max(n - k, 0)
        at[:left] = ids[k:] * follows[:left]
        columns.append(at)
        number, groups = pd.factorize(number * most + at)
        follows[:left] &= goes_on[k:]
        follows[left:] = False
    first = np.zeros(len(groups), np.int64)
    first[number[::-1]] = np.arange(n)[::-1]
    return np.stack([c[first] for c in columns], 1), lang[first], np.bincount(number, minlength=len(groups))


def _read(batches: Iterator[pa.RecordBatch]):
    """Words of every chunk with their languages: as ``_words`` gives them."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        code, names = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), langs.dictionary.to_pylist()
        for p in slices(batch.column(1), CHUNK_BYTES):
            row, ids, goes_on, words = _words(p)
            if len(ids):
                yield names, code[p.first + row], ids, goes_on, words


def _leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of a chunk by language and word, and by language."""
    kinds = (pa.string(), pa.int64(), pa.int64())
    for names, lang, ids, _, words in _read(batches):
        pairs, groups = pd.factorize(lang * (len(words) + 1) + ids)
        n = np.bincount(pairs, minlength=len(groups))
        own, word = np.divmod(groups, len(words) + 1)
        h = _prefix_hashes(names, words, own, word[:, None])[:, 0].view(np.int64)
        total = np.bincount(lang, minlength=len(names))
        cols = ([None] * len(n) + names, h.tolist() + [None] * len(names), np.concatenate([n, total]))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["lang", "prefix", "n"])


def _counted(batches: Iterator[pa.RecordBatch], max_words: int, often: np.ndarray):
    """Distinct suffixes of every chunk, with their languages, counts and prefix hashes."""
    for names, lang, ids, goes_on, words in _read(batches):
        pairs, groups = pd.factorize(lang * (len(words) + 1) + ids)
        own, word = np.divmod(groups, len(words) + 1)
        slot = _slot(_prefix_hashes(names, words, own, word[:, None])[:, 0])
        good = ((often[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0)[pairs]
        goes_on[:-1] &= good[1:]
        kept = np.flatnonzero(good)
        if len(kept):
            # a word that stays is followed by one that stays wherever its piece goes on
            suffix, own, n = _suffixes(ids[kept], goes_on[kept], lang[kept], max_words)
            yield names, words, own, suffix, n, _prefix_hashes(names, words, own, suffix)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) & np.uint64(WORD_BITS - 1)).astype(np.int64)


def _share(h: np.ndarray, parts: int) -> np.ndarray:
    """Number of the part that a hash falls to."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _split(langs: list[str], words: pa.Array, lang: np.ndarray, suffix: np.ndarray, n: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """The suffixes of each part with the words that they use. Words and suffixes are
    in order, in which they squeeze well."""
    order = np.argsort(part, kind="stable")
    ends = np.flatnonzero(np.concatenate([part[order][1:] != part[order][:-1], [True]])) + 1
    for lo, hi in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
        own = order[lo:hi]
        ids, used = pd.factorize(np.concatenate([np.zeros(1, suffix.dtype), suffix[own].ravel()]))
        texts = words.take(pa.array(used[1:].astype(np.int64) - 1))
        by_text = pc.array_sort_indices(texts).to_numpy()
        place = np.zeros(len(used), np.int64)
        place[by_text + 1] = np.arange(1, len(used))
        rows = place[ids[1:]].reshape(-1, suffix.shape[1])
        nth = np.argsort((lang[own].astype(np.int64) * len(used) + rows[:, 0]) * len(used) + rows[:, min(1, rows.shape[1] - 1)])
        yield int(part[own[0]]), (langs, texts.take(pa.array(by_text)), lang[own][nth], rows[nth], n[own][nth])


def _packed(rows: list[tuple[int, tuple]]) -> pa.RecordBatch:
    """Rows (cell, suffixes with their words) for the exchange."""
    texts = [_blob(r[1]) for _, r in rows]
    cols = [pa.array([c for c, _ in rows], pa.int64()), pa.array([r[0] for _, r in rows], pa.list_(pa.string())),
            pa.array([_squeezed(data) for data, _ in texts], pa.binary()), pa.array([_pack(np.diff(off)) for _, off in texts], pa.binary()),
            *[pa.array([_pack(r[k].T.ravel()) for _, r in rows], pa.binary()) for k in (2, 3, 4)]]
    return pa.RecordBatch.from_arrays(cols, ["cell", "langs", "words", "sizes", "lang", "suffix", "n"])


def _unpacked(t: pa.Table, k: int, max_words: int):
    get = lambda c: t.column(c)[k].as_py()
    off = np.concatenate([[0], np.cumsum(_unpack(get("sizes")), dtype=np.int64)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(_loose(get("words")))])
    return get("langs"), words, _unpack(get("lang")), _unpack(get("suffix")).reshape(max_words, -1).T, _unpack(get("n"))


def _blob(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, and where each begins."""
    col = values.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2] if len(col) else None
    return np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if raw is not None else np.zeros(0, np.uint8), off - off[0]


def _hashes(values: pa.Array) -> np.ndarray:
    data, off = _blob(values)
    return BYTES.ranges(BYTES.running(SYMBOL[data]), off[:-1], off[1:])


def _prefix_hashes(langs: list[str], words: pa.Array, lang: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Hash of every prefix: a column for each number of words."""
    word = np.concatenate([np.zeros(1, np.uint64), _hashes(words)])
    h, out = mix(_hashes(pa.array(langs, pa.string()))[lang] + _TIMES), []
    for k in range(suffix.shape[1]):
        h = mix(h * _TIMES + word[suffix[:, k]])
        out.append(h)
    return np.stack(out, 1)


LOADS = "words int, prefix long, suffixes long"


def _loads(max_words: int, often: np.ndarray, least: int):
    """Suffixes of a chunk, and by prefix, where there are at least ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, suffix, _, h in _counted(batches, max_words, often):
            rows = [(0, 0, len(h))]
            left = np.arange(len(h))
            for m in range(1, max_words):
                left = left[suffix[left, m - 1] > 0]
                number, prefixes = pd.factorize(h[left, m - 1])
                count = np.bincount(number, minlength=len(prefixes))
                rows += [(m, int(p), int(c)) for p, c in zip(prefixes[count >= least].view(np.int64), count[count >= least])]
                left = left[count[number] >= least]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                list(zip(*rows)), (pa.int32(), pa.int64(), pa.int64()))], [c.split()[0] for c in LOADS.split(", ")])
    return run


def _depths(h: np.ndarray, suffix: np.ndarray, hot: list[np.ndarray]) -> np.ndarray:
    """By how many leading words each suffix is dealt out: the least prefix that is not
    hot, or one more than its words. Counts of shorter prefixes are partial in a cell."""
    depth = np.ones(len(h), np.int64)
    live = np.arange(len(h))
    for m, found in enumerate(hot):
        live = live[(suffix[live, m] > 0) & np.isin(h[live, m], found)]
        depth[live] = m + 2
    return depth


def _dealt(max_words: int, often: np.ndarray, hot: list[np.ndarray], cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, words, lang, suffix, n, h in _counted(batches, max_words, often):
            by = np.minimum(np.minimum(_depths(h, suffix, hot), (suffix > 0).sum(1)), max_words)
            rows, size = [], 0
            for cell, r in _split(langs, words, lang, suffix, n, _share(h[np.arange(len(h)), by - 1], cells)):
                rows.append((cell, r))
                size += len(r[2])
                if size >= BATCH_SUFFIXES:
                    yield _packed(rows)
                    rows, size = [], 0
            if rows:
                yield _packed(rows)
    return run


def three_way(suffix: np.ndarray, weight: np.ndarray, depth: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey three-way quicksort of pointers to rows of ``suffix``; column 0 stands
    before the words. Gives, for every equal partition that stays, one of its rows,
    its number of words and its weight.

    A round splits every open partition by a pivot of its own into smaller, equal and
    larger; equal ones go on with the next column. A partition of less than ``least``
    is abandoned, unless some row of it was dealt out by more words (``depth``), so
    that this is but a part of the phrase's count. Pointers of a partition lie
    together: a round moves them in order, and sums over them are sums of slices."""
    rows, sizes, counts = [], [], []
    width = suffix.shape[1]
    flat = np.ascontiguousarray(suffix).ravel()
    pointer = np.arange(len(suffix)) * width  # where a row begins
    deep = depth if depth.max(initial=1) > 1 else None
    size, column = np.array([len(suffix)]), np.zeros(1, np.int64)
    whole, weight = np.array([weight.sum()]), weight.astype(np.int64)
    while len(pointer):
        begin = np.cumsum(size) - size
        key = flat[pointer + np.repeat(column, size)]
        first, middle, last = key[begin], key[begin + size // 2], key[begin + size - 1]
        pivot = np.maximum(np.minimum(first, middle), np.minimum(np.maximum(first, middle), last))
        mine = np.repeat(pivot, size)
        sides = [key < mine, key == mine, key > mine]
        total = [np.add.reduceat(weight * side, begin) for side in sides[:2]]
        total.append(whole - total[0] - total[1])
        partial, later = [column < 1] * 3, np.zeros(len(column), bool)
        if deep is not None:
            deepest = [np.maximum.reduceat(deep * side, begin) for side in sides]
            partial, later = [d > column for d in deepest], deepest[1] > column + 1
        over = pivot == 0  # suffixes that end here
        found = ~over & (column > 0) & ((total[1] >= least) | partial[1])
        one = begin + np.where(first == pivot, 0, np.where(middle == pivot, size // 2, size - 1))
        rows.append(pointer[one[found]] // width)
        sizes.append(column[found])
        counts.append(total[1][found])
        # column 0 holds no word, so that nothing is abandoned there
        equal = ~over & (column < width - 1) & ((total[1] >= least) | later)
        stays = [(t > 0) & ((t >= least) | p) for t, p in zip(total, partial)]
        stays[1] = (total[1] > 0) & equal
        kept = [np.flatnonzero(side & np.repeat(s, size)) for side, s in zip(sides, stays)]
        size = np.concatenate([np.add.reduceat(side, begin, dtype=np.int64)[s] for side, s in zip(sides, stays)])
        column = np.concatenate([column[stays[0]], column[stays[1]] + 1, column[stays[2]]])
        whole = np.concatenate([t[s] for t, s in zip(total, stays)])
        kept = np.concatenate(kept)
        pointer, weight = pointer[kept], weight[kept]
        deep = deep[kept] if deep is not None else None
    return np.concatenate(rows), np.concatenate(sizes), np.concatenate(counts)


PHRASES = "lang string, phrase string, words int, f long"


def _cell(max_words: int, least: int, hot: list[np.ndarray]):
    def run(t: pa.Table) -> pa.Table:
        parts = [_unpacked(t, k, max_words) for k in range(t.num_rows)]
        words = pa.concat_arrays([p[1].cast(pa.large_binary()) for p in parts]).dictionary_encode()
        langs = sorted({x for p in parts for x in p[0]})
        nth = {x: k for k, x in enumerate(langs)}
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1
        ends = np.cumsum([len(p[1]) for p in parts])
        suffix = np.concatenate([np.concatenate([np.zeros(1, np.int32), code[e - len(p[1]):e]])[p[3]] for p, e in zip(parts, ends)])
        lang = np.concatenate([np.array([nth[x] for x in p[0]], np.int32)[p[2]] for p in parts])
        weight = np.concatenate([p[4] for p in parts])
        depth = np.ones(len(suffix), np.int64)
        if any(map(len, hot)):
            depth = _depths(_prefix_hashes(langs, words.dictionary, lang, suffix), suffix, hot)
        full = np.concatenate([lang[:, None] + 1, suffix], 1)
        row, size, count = three_way(full, weight, depth, least)
        text = words.dictionary
        out = [b" ".join(text.take(pa.array(suffix[r, :k] - 1)).to_pylist()) for r, k in zip(row.tolist(), size.tolist())]
        return pa.Table.from_arrays([pa.array([langs[k] for k in lang[row].tolist()], pa.string()), pa.array(out, pa.binary()).cast(pa.string()),
                                     pa.array(size.astype(np.int32)), pa.array(count)], ["lang", "phrase", "words", "f"])
    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
                  cell_suffixes: int = CELL_SUFFIXES, prefix_suffixes: int = PREFIX_SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """Counts of all phrases of up to ``max_words`` words that occur ``min_count`` times
    or more in a language (lang, phrase, words, f), and all words of each (lang, n)."""
    spark = docs.sparkSession
    d = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = d.mapInArrow(_leading, "lang string, prefix long, n long").groupBy("lang", "prefix").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("chunks"))
    words = written(words.filter(F.col("prefix").isNull() | (F.col("n") >= min_count)), "leading-words")
    slot = F.col("prefix").bitwiseAND(F.lit(WORD_BITS - 1))
    bits = words.filter("prefix IS NOT NULL").groupBy((F.shiftright(slot, 15)).alias("block")).agg(
        F.bitmap_construct_agg(slot.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    often = np.zeros(WORD_BITS >> 3, np.uint8)
    for r in bits.collect():  # at most WORD_BITS bits in all
        often[r.block << 12:(r.block + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    # a prefix above the limit has half of it in chunks that hold at least this many
    chunks = words.filter("prefix IS NULL").agg(F.sum("chunks")).first()[0] or 1
    least = max(1, prefix_suffixes // (2 * chunks))
    loads = written(d.mapInArrow(_loads(max_words, often, least), LOADS).groupBy("words", "prefix").agg(F.sum("suffixes").alias("suffixes")), "suffix-loads")
    total = loads.filter("words = 0").agg(F.sum("suffixes")).first()[0] or 0
    cells = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // cell_suffixes))
    # at most 2 * total / prefix_suffixes prefixes of each number of words
    heavy = loads.filter((F.col("words") > 0) & (2 * F.col("suffixes") >= prefix_suffixes)).collect()
    hot = [np.array([r.prefix for r in heavy if r.words == m], np.int64).view(np.uint64) for m in range(1, max_words)]
    dealt = d.mapInArrow(_dealt(max_words, often, hot, cells), PACKED)
    found = dealt.groupBy("cell").applyInArrow(_cell(max_words, min_count, hot), PHRASES)
    found = found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count)
    return written(found, "phrases"), words.filter("prefix IS NULL").select("lang", "n")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
         inside_pct: int = INSIDE_PCT, top: int = TOP, **how) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Null and empty texts have no words; a null language is ``und``, together with
    documents that say so; repeated rows count each; a table without words gives no
    rows. Equal scores and counts go by the phrase's bytes. Other columns are not
    read, so their names don't matter. Scores are exact: products are decimals of 38
    digits."""
    f, total = phrase_counts(docs, text_col, lang_col, max_words, min_count, **how)
    candidates = f.filter("words > 1")
    w = F.split("phrase", " ")
    join = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "words", F.col("f").alias("a"), "k", join(F.lit(1), F.col("k")).alias("first"), join(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    left = f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(total, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"over": big("a") * F.lit(1000).cast("decimal(4,0)"), "under": (big("l") * big("r")).cast("decimal(38,0)")})
    cuts = cuts.withColumn("over", (F.col("over") * F.col("n").cast("decimal(15,0)")).cast("decimal(38,0)")).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("c")).select("lang", "phrase", "c.*")
    place = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.struct(i.alias("i"), m.alias("m"))))))
    inside = (candidates.filter("words > 2").select("lang", "phrase", "f", place.alias("p"))
              .select("lang", join(F.col("p.i"), F.col("p.m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    kept = best.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < inside_pct * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
