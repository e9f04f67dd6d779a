"""Mixing sources to target weights by systematic sampling, in DataFrame
operations only.

Each source gets a target share of all words. Within a source every document
is expected ``target / source size`` times; the expected copies are summed up
along the source, from the longest document to the shortest, one random offset
is added, and a document is emitted once per whole number that the running sum
crosses. Long documents thus are strata of their own, which keeps the words
taken near the target.

The running sum is the rate times the document's rank, and the rank is the
sum of three counts: documents of larger size in the source, documents of the
same size in earlier salt groups, and the row number in the salt group. A
source that holds a third of all rows is therefore never ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
#: Rows that one salt group of a (source, size) holds on average, if that many.
GROUP_ROWS = 20_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> also target, rate and offset.

    Sources in code point order, null last, weigh ``weights`` in turn. The
    targets are ``weight * level``, or ``cap * source_size`` where that is less;
    the level at which they add up to all words follows from sorting the
    sources by the level at which each meets its cap. One row per source goes
    through one task."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = (sizes.withColumn("nth", F.row_number().over(by_name))
         .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") - 1) % len(weights) + 1))
         .withColumn("most", cap * F.col("source_size"))
         .withColumn("meets", F.col("most") / F.col("weight")))
    by_meets = Window.orderBy("meets", "nth")
    w = (w.withColumn("total", F.sum("source_size").over(everything))
         .withColumn("capped", F.coalesce(F.sum("most").over(by_meets.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("free", F.sum("weight").over(by_meets.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("try", (F.col("total") - F.col("capped")) / F.col("free"))
         .withColumn("level", F.first(F.when(F.col("try") <= F.col("meets"), F.col("try")), True)
                     .over(by_meets.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    offset = (F.conv(F.substring(F.md5(F.coalesce("source", F.lit(""))), 1, 4), 16, 10).cast("double") + 0.5) / 65536
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.col("level"))
    return w.select("source", "source_size", target.alias("target"),
                    F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
                    offset.alias("offset"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, nth (the row's number among the rows
    that share its id, ordered by the hash of their texts), source_size, target,
    size and copies.

    A null text has size 0, a null source is a source of its own, equal rows are
    interchangeable; an empty table gives no rows. Other columns are not read.
    Reruns give the same copies: order and offset follow from hashes of ids and
    source names."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"),
                    F.xxhash64(F.col(text_col)).alias("h"))
    d = d.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = cut_lineage(d)
    salts = max(1, math.ceil(math.log(max(1, d.count() / group_rows), 16)))
    d = (d.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("h", "size", "source")))
         .withColumn("salt", F.substring("key", 1, salts))
         .withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    targets = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    targets = targets.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    groups = d.groupBy("src", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("before", F.coalesce(
        F.sum("n").over(Window.partitionBy("src", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    larger = (groups.groupBy("src", "size").agg(F.sum("n").alias("n"))
              .withColumn("longer", F.coalesce(F.sum("n").over(
                  Window.partitionBy("src").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .drop("n"))
    groups = groups.join(larger, ["src", "size"]).join(targets, "src").drop("n")
    ranked = d.withColumn("row", F.row_number().over(Window.partitionBy("src", "size", "salt").orderBy("key", "doc_id", "h")) - 1)
    rank = F.col("longer") + F.col("before") + F.col("row")
    crossed = lambda r: F.floor(F.col("rate") * r + F.col("offset"))
    return (ranked.join(groups, ["src", "size", "salt"])
            .select("doc_id", "nth", "size", "source_size", "target",
                    F.greatest(F.lit(0), F.least(F.lit(cap), crossed(rank + 1) - crossed(rank))).cast("long").alias("copies")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, all columns as they are."""
    taken = copies(docs, id_col, text_col, source_col, **how).filter("copies > 0")
    taken = taken.select(F.col("doc_id").alias("__id"), F.col("nth").alias("__of"), F.col("copies").alias("__copies"))
    by_id = Window.partitionBy("__key").orderBy("__h", "__size", "__source")
    d = docs.withColumns({"__key": F.col(id_col), "__h": F.xxhash64(F.col(text_col)), "__size": words_in(F.col(text_col)),
                          "__source": F.col(source_col)})
    d = d.withColumn("__nth", F.row_number().over(by_id))
    out = d.join(taken, d["__key"].eqNullSafe(taken["__id"]) & (d["__nth"] == taken["__of"]))
    return (out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
