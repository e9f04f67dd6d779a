"""Quality rules: statistics of each text, and cross-document line frequency.

Lines are normalised (ASCII lower case, words joined by one space) and hashed.
For each host the distinct documents that hold a line are counted; lines above
the host's limit are boilerplate. A document that keeps too few of its words
without such lines is depleted and rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import trimmed, written
from .text import BYTES, IS_SPACE, LOWER, SYMBOL, WORDS, covered, mix, slices, windows_in_rows, word_hashes

MIN_WORDS = 20
MAX_REPEAT_PCT = 30
REPEAT_WORDS = 8
#: A line is above its host's limit in more than this many distinct documents,
MIN_LINE_DOCS = 20
#: and in more than this percentage of the host's documents.
LINE_DOCS_PCT = 1
#: A document is depleted if it keeps less than this percentage of its words.
KEEP_PCT = 30

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
LINES = "line_set string, lines array<struct<h:string,n:int>>"


def _line_stats(piece) -> tuple[list[int], list[str], list[list[dict]]]:
    dup, sets, rows = [], [], []
    data = piece.data.tobytes()
    for lo, hi in zip(piece.off[:-1].tolist(), piece.off[1:].tolist()):
        seen, found, again = set(), {}, 0
        for line in data[lo:hi].split(b"\n"):
            words = line.lower().split()
            if words:
                if line in seen:
                    again += 1
                else:
                    seen.add(line)
                h = md5(b" ".join(words)).hexdigest()
                found[h] = found.get(h, 0) + len(words)
        dup.append(again)
        sets.append(md5("".join(sorted(found)).encode()).hexdigest() if found else "")
        rows.append([{"h": h, "n": n} for h, n in found.items()])
    return dup, sets, rows


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    line_type = pa.list_(pa.struct([("h", pa.string()), ("n", pa.int32())]))
    for batch in batches:
        for p in slices(batch.column(2)):
            s, e, bounds = p.words()
            n_words = np.diff(bounds)
            h = WORDS.running(word_hashes(p.data, s, e))
            starts, rows = windows_in_rows(bounds, REPEAT_WORDS)
            keys = WORDS.windows(h, REPEAT_WORDS)[starts] ^ mix(rows.astype(np.uint64) + np.uint64(1))
            _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
            again = covered(starts[count[back] > 1], REPEAT_WORDS, len(s))
            run = np.concatenate([[0], np.cumsum(again)])
            inside = ~IS_SPACE[p.data] & ((p.data & 0xC0) != 0x80)
            dup, sets, lines = _line_stats(p)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).slice(p.first, p.rows) for k in (0, 1, 3)]
                + [pa.array(np.asarray(x, np.int64)) for x in (
                    n_words, p.per_row(inside), p.per_row(SYMBOLS[p.data]), dup, run[bounds[1:]] - run[bounds[:-1]])]
                + [pa.array(sets, pa.string()), pa.array(lines, line_type)],
                ["doc_id", "host", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_set", "lines"])
    trimmed()


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          min_line_docs: int = MIN_LINE_DOCS, line_docs_pct: float = LINE_DOCS_PCT, keep_pct: float = KEEP_PCT,
          key_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, the statistics, words_on_frequent_lines,
    base_failed, depleted, kept.

    Distinct documents are counted by a hash of their whole set of lines: copies
    of one document count once, so that copies don't turn its own lines into
    boilerplate; documents that differ in any line count each. A null text has no words and fails; a null host is a host
    of its own; rows with the same id are judged each for itself; an empty table
    gives no rows. ``key_col``, if given, is a string that each row carries to its
    verdict as ``key``; other columns are not read."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"),
                    F.col(text_col).cast("string").alias("text"), (F.col(key_col) if key_col else F.lit(None)).cast("string").alias("key"))
    t = d.mapInArrow(_statistics, f"doc_id long, host string, key string, {STATS}, {LINES}")
    t = written(t.withColumn("row", F.monotonically_increasing_id()), "line-stats")
    t = t.withColumn("host", F.coalesce(F.concat(F.lit("="), "host"), F.lit("")))
    lines = t.select("row", "host", "line_set", F.inline("lines"))
    limit = t.filter("line_set <> ''").groupBy("host", "line_set").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    often = (lines.groupBy("host", "h", "line_set").agg(F.lit(1).alias("one"))
             .groupBy("host", "h").agg(F.count(F.lit(1)).alias("line_docs")).filter(F.col("line_docs") > min_line_docs))
    often = (often.join(limit, "host").filter(F.col("line_docs") * 100 > line_docs_pct * F.col("host_docs")).select("host", "h"))
    gone = lines.join(often, ["host", "h"]).groupBy("row").agg(F.sum("n").alias("gone"))
    out = t.drop("lines", "line_set").join(gone, "row", "left").withColumn("gone", F.coalesce("gone", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("gone")) * 100 < keep_pct * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      F.col("gone").alias("words_on_frequent_lines"), failed.alias("base_failed"), depleted.alias("depleted"),
                      (~failed & ~depleted).alias("kept"), *(["key"] if key_col else []))
