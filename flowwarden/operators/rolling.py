"""Ordered rolling statistics and sequence windows without a single partition.

``Window.orderBy(key)`` with no partition key moves the whole table into one
task. Instead:

1. ``global_index``: range-partition on the (unique) order key, sort inside
   partitions, tag rows with ``monotonically_increasing_id`` (partition id in
   the high bits, position in the low bits), count rows per partition (P rows),
   turn the counts into start offsets and join them back as a broadcast (P is
   the number of range partitions: a fixed, configured bound). The tagged,
   sorted frame is checkpointed (reliably, into ``spark.checkpoint.dir``)
   before it is read twice: two evaluations of a range exchange sample their
   bounds independently (and column pruning makes the two branches different
   plans), so without the materialised copy the counts and the rows could
   disagree. The checkpoint also cuts the lineage, so a lost executor costs a
   re-read, not a re-sort.
2. ``halo_blocks``: ``block = idx div B``; a row in the last w-1 positions of
   its block is also emitted (flagged ``_halo``) into the next block.
3. A normal ``Window.partitionBy(block).orderBy(idx).rowsBetween(-(w-1), 0)``;
   halo rows are dropped afterwards.

Blocks hold exactly B rows, so a hot key or a hot time range cannot overload
one task, and the halo overhead is (w-1)/B. With ``partition_by`` (per-host
variant) the host columns lead the order key and join the window partition
key, so a host's rows never see another host's rows and a host with a third
of the table still spreads over many blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..session import cut_lineage
from .features import numeric_columns

_POS_BITS = 33
_POS_MASK = (1 << _POS_BITS) - 1
ROWS_PER_PARTITION = 2_000_000


def range_partitions(spark, n_rows: int | None = None, rows_per_partition: int = ROWS_PER_PARTITION) -> int:
    """Range partitions for an ordered operator: at least the session's
    shuffle partitions, and enough that each holds about
    ``rows_per_partition`` rows (explicit repartitions are not resized by
    AQE, so the count must follow the data). The offsets table broadcast by
    ``global_index`` has one row per partition: n / rows_per_partition."""
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n_rows is None:
        return base
    return max(base, math.ceil(n_rows / rows_per_partition))


def _q(c):
    return F.col(f"`{c}`")


def global_index(df: DataFrame, key, num_partitions: int | None = None, idx_col: str = "_idx") -> DataFrame:
    """Add the 0-based position of each row in the total order ``key``."""
    key = [key] if isinstance(key, str) else list(key)
    spark = df.sparkSession
    p = int(num_partitions or range_partitions(spark))
    s = (df.repartitionByRange(p, *[_q(k) for k in key]).sortWithinPartitions(*[_q(k) for k in key])
           .withColumn("_mid", F.monotonically_increasing_id()))
    s = cut_lineage(s)
    s = s.withColumns({"_pid": F.shiftright("_mid", _POS_BITS).cast("int"),
                       "_pos": F.col("_mid").bitwiseAND(F.lit(_POS_MASK))})
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # offsets over at most p rows: a window without partition key is fine here
    offsets = counts.select("_pid", F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_start"))
    return (s.join(F.broadcast(offsets), "_pid")
             .withColumn(idx_col, F.col("_start") + F.col("_pos"))
             .drop("_mid", "_pid", "_pos", "_start"))


def choose_block_size(n_rows: int, lookback: int, num_partitions: int, min_block: int = 1024,
                      blocks_per_partition: int = 4) -> int:
    """Rows per block: about ``blocks_per_partition`` blocks per partition
    (hash placement of several blocks per partition evens out the load),
    never below the look-back (B >= w-1 is required for single-block halos)."""
    target = math.ceil(max(n_rows, 1) / max(num_partitions * blocks_per_partition, 1))
    return max(lookback, min(min_block, max(n_rows, 1)), target)


def halo_blocks(indexed: DataFrame, lookback: int, block_size: int, idx_col: str = "_idx") -> DataFrame:
    """Each row in its block; the last ``lookback`` rows of a block are also
    copied (``_halo`` = true) into the next block."""
    if block_size < lookback:
        raise ValueError("block size must be at least the look-back")
    b = F.floor(F.col(idx_col) / block_size).cast("long")
    tail = (F.col(idx_col) % block_size) >= (block_size - lookback)
    blocks = F.when(F.lit(lookback > 0) & tail, F.array(b, b + 1)).otherwise(F.array(b))
    return (indexed.withColumn("_home", b).withColumn("_block", F.explode(blocks))
                   .withColumn("_halo", F.col("_block") != F.col("_home")).drop("_home"))


def _block_frame(partition_by, lookback, idx_col="_idx"):
    return (Window.partitionBy("_block", *[_q(c) for c in partition_by]).orderBy(idx_col)
                  .rowsBetween(-lookback, 0))


def _frame_stats(blocks: DataFrame, cols, partition_by, lookback: int) -> DataFrame:
    """Mean and sample std per row by re-aggregating the sliding frame:
    exact, O(window) work per row and column."""
    w = _block_frame(partition_by, lookback)
    out = {}
    for c in cols:
        x = finite(_q(c))
        out[f"{c}_rolling_mean"] = F.avg(x).over(w)
        out[f"{c}_rolling_std"] = F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0))
    return blocks.withColumns(out)


def _segment_stats(blocks: DataFrame, cols, partition_by, lookback: int) -> DataFrame:
    """Mean and sample std per row in O(1) work per row and column, without
    subtracting running sums: rows are cut into segments as long as the window,
    so a frame is the end of one segment and the start of the next. (n, mean,
    variance) of every segment start and end are running aggregates, and a frame
    merges two of them. One extreme value thus touches only frames that hold it.
    Four window steps, however many columns."""
    part = ["_block", *[_q(c) for c in partition_by]]
    ordered = Window.partitionBy(*part).orderBy("_idx")
    so_far = (Window.unboundedPreceding, 0)
    start = Window.partitionBy(*part, "_seg").orderBy("_idx").rowsBetween(*so_far)
    end = Window.partitionBy(*part, "_seg").orderBy(F.desc("_idx")).rowsBetween(*so_far)
    width = lookback + 1
    b = blocks.withColumns({f"_x{i}": finite(_q(c)) for i, c in enumerate(cols)})
    b = b.withColumn("_at", F.row_number().over(ordered) - 1).withColumn("_seg", F.floor(F.col("_at") / width))

    def state(x, w):
        return F.struct(F.count(x).over(w).cast("double").alias("n"), F.coalesce(F.avg(x).over(w), F.lit(0.0)).alias("m"),
                        F.coalesce(F.var_pop(x).over(w), F.lit(0.0)).alias("v"))

    b = b.withColumns({f"_s{i}": state(F.col(f"_x{i}"), start) for i in range(len(cols))})
    b = b.withColumns({f"_e{i}": state(F.col(f"_x{i}"), end) for i in range(len(cols))})
    # a row that ends its segment has its whole frame in the segment's start
    tail = F.col("_at") % width != lookback
    b = b.withColumns({f"_e{i}": F.when(tail, F.lag(f"_e{i}", lookback).over(ordered)) for i in range(len(cols))})
    out, drop = {}, ["_at", "_seg"]
    for i, c in enumerate(cols):
        n1, m1, v1 = (F.col(f"_s{i}.{f}") for f in "nmv")
        n2, m2, v2 = (F.coalesce(F.col(f"_e{i}.{f}"), F.lit(0.0)) for f in "nmv")
        n, d = n1 + n2, m2 - m1
        mean = F.when(n2 == 0, m1).when(n1 == 0, m2).otherwise(m1 + d * n2 / n)
        squares = n1 * v1 + n2 * v2 + F.when(n > 0, d * d * n1 * n2 / n).otherwise(F.lit(0.0))
        out[f"{c}_rolling_mean"] = F.when(n > 0, mean)
        out[f"{c}_rolling_std"] = F.when(n > 1, F.sqrt(squares / (n - 1))).otherwise(F.lit(0.0))
        drop += [f"_x{i}", f"_s{i}", f"_e{i}"]
    return b.withColumns(out).drop(*drop)


def rolling_features(df: DataFrame, key=("ts", "flow_id"), window: int = 100, max_cols: int = 10,
                     cols=None, partition_by=(), exclude=("label",), block_size: int | None = None,
                     num_partitions: int | None = None, keep_index: bool = False,
                     method: str = "segment") -> DataFrame:
    """For the first ``max_cols`` numeric columns: trailing-``window`` mean,
    sample std (single observation -> 0) and |x - mean|, in key order.
    NaN and infinite values count as missing; a missing value has no deviation.
    ``method="segment"`` (default) merges running aggregates, O(1) per row;
    ``method="frame"`` re-aggregates each sliding frame, O(window) per row."""
    key = [key] if isinstance(key, str) else list(key)
    partition_by = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    if cols is None:
        cols = [c for c in numeric_columns(df, exclude) if c not in key and c not in partition_by][:max_cols]
    spark = df.sparkSession
    lookback = max(window - 1, 0)
    n = df.count() if (block_size is None or num_partitions is None) else None
    p = int(num_partitions or range_partitions(spark, n))
    if block_size is None:
        block_size = choose_block_size(n, lookback, p)
    idx = global_index(df, partition_by + key, p)
    # explicit block shuffle sized like the range partitions (the window's
    # own exchange would use the session default, which AQE cannot split)
    blocks = halo_blocks(idx, lookback, block_size).repartition(p, "_block")
    stats = _segment_stats if method == "segment" else _frame_stats
    res = stats(blocks, cols, partition_by, lookback)
    res = res.withColumns({f"{c}_deviation": F.abs(finite(_q(c)) - F.col(f"{c}_rolling_mean")) for c in cols})
    res = res.where(~F.col("_halo")).drop("_block", "_halo")
    return res if keep_index else res.drop("_idx")


def frequency_encode(df: DataFrame, cols=("src_ip", "dst_ip"), suffix: str = "_frequency",
                     table: DataFrame | None = None, table_rows: dict | None = None,
                     broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows per value over the table (or over a fitted frequency table),
    joined back; null values get null. Counts are combined map-side. A
    fitted table whose per-column size is known (``table_rows``) and at most
    ``broadcast_rows`` is broadcast; otherwise AQE measures the count table
    and broadcasts it when small, else keeps a shuffle join with skewed
    partitions split. Each column is handled on its own."""
    out = df
    for c in cols:
        if c not in df.columns:
            continue
        if table is not None:
            counts = table.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("n").alias("_f"))
            if table_rows is not None and table_rows.get(c, broadcast_rows + 1) <= broadcast_rows:
                counts = F.broadcast(counts)
        else:
            counts = df.where(_q(c).isNotNull()).groupBy(_q(c).alias("_v")).agg(F.count(F.lit(1)).alias("_f"))
        out = (out.join(counts, _q(c).cast("string") == F.col("_v"), "left")
                  .withColumn(f"{c}{suffix}", F.col("_f").cast("bigint")).drop("_v", "_f"))
    return out


def frequency_table(df: DataFrame, cols=("src_ip", "dst_ip")) -> DataFrame:
    """Fitted (column, value, n) table, saved for streaming lookups."""
    parts = [df.where(_q(c).isNotNull()).groupBy(_q(c).cast("string").alias("value"))
               .agg(F.count(F.lit(1)).cast("bigint").alias("n")).select(F.lit(c).alias("column"), "value", "n")
             for c in cols if c in df.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fitted_length(n_rows: int, length: int = 5, min_sequences: int = 100) -> int:
    """Window length to fit with: ``length``, a third of a table of fewer than
    2L rows, and 1 where fewer than ``min_sequences`` windows would be left.
    Scoring always uses the length that was fitted."""
    if n_rows < 2 * length:
        length = max(1, n_rows // 3)
    return 1 if n_rows - length < min_sequences else length


def sequence_windows(df: DataFrame, feature_cols, label: str = "label", key=("ts", "flow_id"), length: int = 5,
                     block_size: int | None = None, num_partitions: int | None = None,
                     n_rows: int | None = None) -> DataFrame:
    """Row i (i >= L) with the features of rows i-L .. i-1 (oldest first) and
    its own label; a table of L rows or fewer gives no row."""
    key = [key] if isinstance(key, str) else list(key)
    n = df.count() if n_rows is None else n_rows
    spark = df.sparkSession
    p = int(num_partitions or range_partitions(spark, n))
    if block_size is None:
        block_size = choose_block_size(n, length, p)
    vec = F.array(*[_q(c).cast("double") for c in feature_cols])
    # what the windows don't need is neither kept nor moved (nor computed, as scores of other models)
    idx = global_index(df.select(*[_q(k) for k in key], vec.alias("_vec"), _q(label).alias("_target")), key, p)
    blocks = halo_blocks(idx, length, block_size).repartition(p, "_block")
    w = Window.partitionBy("_block").orderBy("_idx").rowsBetween(-length, -1)
    res = (blocks.withColumn("sequence", F.collect_list("_vec").over(w))
                 .where(~F.col("_halo") & (F.col("_idx") >= length))
                 .select(*[_q(k) for k in key], F.col("_idx").alias("row_index"), "sequence",
                         F.col("_target").alias("target")))
    return res.withColumn("seq_length", F.lit(length))


def importance_summary(df: DataFrame, name_col: str = "feature", score_col: str = "importance") -> DataFrame:
    """Sorted importances with cumulative sum and rank. The input has one row
    per feature (bounded by the feature count), so one ordered window is fine."""
    w = Window.orderBy(F.desc(score_col), F.asc(name_col))
    return df.select(F.col(name_col).alias("feature"), F.col(score_col).alias("importance"),
                     F.sum(score_col).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative_importance"),
                     F.row_number().over(w).alias("rank"))


def prefix_sums(df: DataFrame, key, cols, partition_by=(), inclusive: bool = True,
                num_partitions: int | None = None, suffix: str = "_cum") -> DataFrame:
    """Running sums of ``cols`` in ``key`` order (within ``partition_by``
    groups), computed without a single-partition exchange: range-partition
    and checkpoint, sum each partition (P rows per group), turn the partition
    sums into offsets, add the within-partition running sum. ``inclusive``
    False gives the sum over strictly earlier rows."""
    key = [key] if isinstance(key, str) else list(key)
    partition_by = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    spark = df.sparkSession
    p = int(num_partitions or range_partitions(spark, df.count()))
    order = [_q(c) for c in partition_by + key]
    s = cut_lineage(df.repartitionByRange(p, *order).sortWithinPartitions(*order)
                      .withColumn("_pid", F.spark_partition_id()))
    tot = s.groupBy("_pid", *[_q(c) for c in partition_by]).agg(*[F.sum(_q(c)).alias(f"_t{i}") for i, c in enumerate(cols)])
    wo = Window.partitionBy(*[_q(c) for c in partition_by]).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # (partitions x groups) rows: bounded by P times the group count
    off = tot.select("_pid", *[_q(c) for c in partition_by],
                     *[F.coalesce(F.sum(f"_t{i}").over(wo), F.lit(0)).alias(f"_o{i}") for i in range(len(cols))])
    wi = (Window.partitionBy("_pid", *[_q(c) for c in partition_by]).orderBy(*[_q(k) for k in key])
                .rowsBetween(Window.unboundedPreceding, 0))
    out = s.join(off, ["_pid", *partition_by])
    out = out.withColumns({f"{c}{suffix}": F.col(f"_o{i}") + F.sum(_q(c)).over(wi) - (F.lit(0) if inclusive else _q(c))
                           for i, c in enumerate(cols)})
    return out.drop("_pid", *[f"_o{i}" for i in range(len(cols))])


def exact_percentile(df: DataFrame, col: str, q: float, tiebreak: str | None = None,
                     accuracy: int = 100_000) -> DataFrame:
    """Exact quantile with linear interpolation (position q * (n - 1)).

    ``approx_percentile`` brackets the position, one aggregate counts the rows
    below the bracket, and only the bracket's rows (about 4 / accuracy of the
    table) are ordered."""
    x = df.select(finite(_q(col)).alias("_x"), *([_q(tiebreak)] if tiebreak else [])).where(F.col("_x").isNotNull())
    near = [max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy)]
    got = x.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_x", near, accuracy).alias("b"), F.min("_x"), F.max("_x")).first()
    if not got[0]:
        return df.sparkSession.createDataFrame([(None,)], "percentile double")
    n, (low, high) = got[0], got[1]
    pos = q * (n - 1)
    lo, hi = int(math.floor(pos)), int(math.ceil(pos))
    low = got[2] if lo < 2 or low > high else low
    high = got[3] if hi > n - 3 else high
    below, inside = x.agg(F.count(F.when(F.col("_x") < low, 1)), F.count(F.when(F.col("_x").between(low, high), 1))).first()
    if not below <= lo <= hi < below + inside:  # the bracket missed: order everything
        low, high, below, inside = got[2], got[3], 0, n
    mid = x.where(F.col("_x").between(low, high))
    if tiebreak is None:
        mid, tiebreak = mid.withColumn("_t", F.monotonically_increasing_id()), "_t"
    idx = global_index(mid, ["_x", tiebreak], range_partitions(df.sparkSession, inside))
    at = F.col("_idx") + below
    pair = idx.where(at.isin(lo, hi))
    return pair.agg((F.max(F.when(at == lo, F.col("_x"))) * F.lit(1.0 - (pos - lo))
                     + F.max(F.when(at == hi, F.col("_x"))) * F.lit(pos - lo)).alias("percentile"))
