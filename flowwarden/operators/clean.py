"""Cleaning: null/Inf filling, category codes, labels, IP conversion, coercion.

All steps are projections, except that ``category_codes`` first asks for the
distinct values: columns with few values are coded in the projection, others by a
join to their counted code table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import epoch_to_timestamp, ip_to_int, standardize_label
from ..session import cut_lineage


def _q(c):
    return F.col(f"`{c}`")


def fill_missing(df: DataFrame, exclude=("label",), string_fill: str = "0") -> DataFrame:
    """null (and NaN) -> 0 for numeric columns, '0' for string columns."""
    out = {}
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.coalesce(F.nanvl(_q(f.name), F.lit(None).cast(f.dataType)), F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, T.NumericType):
            out[f.name] = F.coalesce(_q(f.name), F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, T.StringType):
            out[f.name] = F.coalesce(_q(f.name), F.lit(string_fill))
    return df.withColumns(out) if out else df


def replace_infinite(df: DataFrame) -> DataFrame:
    """+-Inf (and NaN) -> 0 in floating columns."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = _q(f.name)
            out[f.name] = F.when(c.isin(float("inf"), float("-inf")) | F.isnan(c), F.lit(0.0)).otherwise(c)
    return df.withColumns(out) if out else df


def code_table(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values of ``col`` with their 0-based code. The codes
    are global positions in value order (``global_index``: range partitions
    plus partition offsets), so a column with millions of distinct values is
    still coded in parallel, never in one task."""
    from .rolling import global_index, range_partitions
    vals = df.select(_q(col).cast("string").alias("_v")).where(F.col("_v").isNotNull()).distinct()
    return global_index(vals, ["_v"], range_partitions(df.sparkSession, vals.count())).select("_v", F.col("_idx").cast("int").alias("_code"))


def category_codes(df: DataFrame, cols=None, exclude=("label",), literal: int = 200,
                   broadcast_rows: int = 1_000_000) -> DataFrame:
    """String columns -> sorted-category integer codes; null -> -1.

    One aggregate estimates the distinct values of all columns, a second collects
    the values of those with few (``literal`` at most): their codes are a
    projection. A column with more values is joined to its counted code table,
    which is broadcast up to ``broadcast_rows``."""
    if cols is None:
        cols = [f.name for f in df.schema.fields
                if isinstance(f.dataType, T.StringType) and f.name not in exclude]
    if not cols:
        return df
    about = df.agg(*[F.approx_count_distinct(_q(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    few = [c for c, n in zip(cols, about) if n <= literal // 2]  # the estimate is off by a few percent
    out, projected = df, {}
    if few:
        for c, values in zip(few, df.agg(*[F.array_sort(F.collect_set(_q(c))) for c in few]).first()):
            known = F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")
            projected[c] = F.when(_q(c).isNull(), F.lit(-1)).otherwise((F.array_position(known, _q(c)) - 1).cast("int"))
    for c in [c for c in cols if c not in few]:
        codes = cut_lineage(code_table(df, c).withColumnRenamed("_v", "_cv"))
        codes = F.broadcast(codes) if codes.count() <= broadcast_rows else codes
        out = (out.join(codes, _q(c) == F.col("_cv"), "left")
                  .withColumn(c, F.coalesce(F.col("_code"), F.lit(-1)))
                  .drop("_cv", "_code"))
    return out.withColumns(projected) if projected else out


def standardize_labels(df: DataFrame, col: str = "label", out: str | None = None) -> DataFrame:
    numeric = isinstance(df.schema[col].dataType, T.NumericType)
    return df.withColumn(out or col, standardize_label(col, numeric=numeric))


def ip_columns_to_int(df: DataFrame, cols=("src_ip", "dst_ip")) -> DataFrame:
    return df.withColumns({c: ip_to_int(c) for c in cols if c in df.columns})


def preprocess(df: DataFrame, label: str = "label") -> DataFrame:
    """fill -> IPs to integers -> category codes -> labels -> Inf to 0."""
    out = fill_missing(df, exclude=(label,))
    out = ip_columns_to_int(out)
    out = category_codes(out, exclude=(label,))
    if label in out.columns:
        out = standardize_labels(out, label)
    return replace_infinite(out)


def coerce_numeric(df: DataFrame, cols) -> DataFrame:
    """Unparseable values -> null."""
    return df.withColumns({c: _q(c).try_cast("double") for c in cols if c in df.columns})


def coerce_timestamp(df: DataFrame, col: str = "timestamp") -> DataFrame:
    """Epoch seconds (any type) -> TIMESTAMP; invalid -> null."""
    return df.withColumn(col, epoch_to_timestamp(_q(col)))
