"""Profiling and data-quality checks.

Every metric of one kind is computed in a single aggregate pass (one wide
``agg``); duplicates need one extra grouped aggregate over all columns, which
is combined map-side so a heavily duplicated row costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .alerts import numeric_histogram  # noqa: F401  (re-exported: C10)


def _q(c):
    return F.col(f"`{c}`")


def _is_missing(f: T.StructField):
    c = _q(f.name)
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _numeric(df):
    return [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("total_records")).withColumn(
        "total_features", F.lit(len(df.columns)))


def missing_cells(df: DataFrame) -> DataFrame:
    total = sum((F.sum(_is_missing(f).cast("bigint")) for f in df.schema.fields), F.lit(0).cast("bigint"))
    return df.agg(F.coalesce(total, F.lit(0)).cast("bigint").alias("missing_values"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of identical rows. Rows are told apart by
    two 64-bit hashes of all columns and of which are null, so that 16 bytes of a
    row are shuffled, however wide it is (different rows of n share both with
    probability n^2 / 2^129); up to two columns are grouped as they are."""
    cols = [_q(c) for c in df.columns]
    if len(cols) > 2:
        nulls = F.concat(*[c.isNull().cast("int").cast("string") for c in cols])  # hashes pass over nulls
        cols = [F.xxhash64(nulls, *cols).alias("_h1"), F.xxhash64(F.lit(1), *reversed(cols), nulls).alias("_h2")]
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_records"))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).cast("bigint").alias("label_count"))


def anomaly_rate(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.avg(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("anomaly_rate"))


def quality_flags(df: DataFrame) -> DataFrame:
    num = _numeric(df)
    neg = [F.max((_q(f.name) < 0).cast("int")) for f in num]
    inf = [F.max(_q(f.name).isin(float("inf"), float("-inf")).cast("int"))
           for f in num if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    nul = [F.max(_is_missing(f).cast("int")) for f in df.schema.fields]

    def any_of(xs):
        return (F.coalesce(F.greatest(*xs), F.lit(0)) == 1) if len(xs) > 1 else \
               (F.coalesce(xs[0], F.lit(0)) == 1) if xs else F.lit(False)
    return df.agg(any_of(neg).alias("has_negative_values"), any_of(inf).alias("has_infinite_values"),
                  any_of(nul).alias("has_null_values"))


def validate(df: DataFrame, label: str = "label") -> DataFrame:
    """C1-C6 as one long report (metric, value). One wide aggregate for counts
    and flags, one grouped aggregate for labels, one for duplicates."""
    fields = df.schema.fields
    num = _numeric(df)
    wide = df.agg(
        F.count(F.lit(1)).cast("double").alias("total_records"),
        F.lit(float(len(df.columns))).alias("total_features"),
        sum((F.sum(_is_missing(f).cast("bigint")) for f in fields), F.lit(0).cast("bigint")).cast("double")
        .alias("missing_values"),
        *([F.avg(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("anomaly_rate")] if label in df.columns else []),
        F.coalesce(F.greatest(F.lit(0), *[F.max((_q(f.name) < 0).cast("int")) for f in num]), F.lit(0))
         .cast("double").alias("has_negative_values"),
        F.coalesce(F.greatest(F.lit(0), *[F.max(_q(f.name).isin(float("inf"), float("-inf")).cast("int"))
                                          for f in num if isinstance(f.dataType, (T.DoubleType, T.FloatType))]),
                   F.lit(0)).cast("double").alias("has_infinite_values"),
        F.coalesce(F.greatest(F.lit(0), *[F.max(_is_missing(f).cast("int")) for f in fields]), F.lit(0))
         .cast("double").alias("has_null_values"),
    )
    metrics = [c for c in wide.columns]
    long = wide.unpivot([], metrics, "metric", "value")
    dup = duplicate_rows(df).select(F.lit("duplicate_records").alias("metric"),
                                    F.col("duplicate_records").cast("double").alias("value"))
    out = long.unionByName(dup)
    if label in df.columns:
        lab = label_distribution(df, label).select(
            F.concat(F.lit("label_"), F.col("label").cast("string")).alias("metric"),
            F.col("label_count").cast("double").alias("value"))
        out = out.unionByName(lab)
    return out


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: Spark type name and non-null count (one aggregate, then a
    stack of the single result row)."""
    counts = df.agg(*[F.count(_q(c)).cast("bigint").alias(f"c{i}") for i, c in enumerate(df.columns)])
    types = dict(df.dtypes)
    stack = ", ".join(f"'{c}', '{types[c]}', c{i}" for i, c in enumerate(df.columns))
    return counts.selectExpr(f"stack({len(df.columns)}, {stack}) AS (column_name, dtype, non_null)")


def preview(df: DataFrame, key=("ts", "flow_id"), n: int = 100) -> DataFrame:
    """First rows by the order key (a top-k, never a full sort)."""
    return df.orderBy(*key).limit(n)
