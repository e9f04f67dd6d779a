"""Cleaning pipeline over ``documents``: quality rules, near duplicates, repeated
passages, mixing, packing. Each stage reads the rows that the one before wrote."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowwarden.llm import mixing, ngram_join, packing, quality_rules, suffix_dedup  # noqa: E402
from flowwarden.llm.tables import table, written  # noqa: E402

#: Near duplicates in the pipeline: words in a shingle and least similarity.
NGRAM = 5
PERCENT = 80
#: Mean bytes of text that a task of the suffix stage sorts at once; results don't depend on it.
SUFFIX_CHUNK_BYTES = 1 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules, as they are, each by its own verdict: a
    verdict depends on source and text, so rows that share these and the id (or
    have none) share it."""
    parts = [F.md5(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))) for c in ("doc_id", "source", "text")]
    keyed = docs.withColumn("row_key", F.md5(F.concat(*parts)))
    gone = quality_rules.judge(keyed, key_col="row_key").filter("NOT kept").select(F.col("key").alias("row_key")).distinct()
    return keyed.join(gone, "row_key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component of similar documents. Texts that share
    an id are documents of their own; of rows with one id and text, the first in
    the order of the other columns stays. A row without an id stays."""
    node = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.coalesce(F.md5("text"), F.lit(""))))
    d = docs.withColumn("node", node)
    found = ngram_join.components(d.select("node", "text"), id_col="node", ngram=NGRAM, percent=PERCENT)
    rows = d.filter("node IS NOT NULL").groupBy("node").agg(F.first("doc_id").alias("id"), F.count(F.lit(1)).alias("rows"))
    member = found.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), "component_id").distinct().join(rows, "node")
    first = member.groupBy("component_id").agg(F.min(F.struct("id", "node"))["node"].alias("first"), F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    marks = (member.join(first, "component_id", "left").withColumn("gone", F.coalesce(F.col("node") != F.col("first"), F.lit(False)))
             .filter("gone OR rows > 1").select("node", "gone", "rows"))
    marked = d.filter("node IS NOT NULL").join(written(marks, "pipeline-marks"), "node", "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    others = Window.partitionBy("node").orderBy(*[c for c, name in zip(columns, docs.columns) if name not in ("doc_id", "text")] or [F.lit(0)])
    once = marked.filter("rows > 1 AND NOT gone").withColumn("nth", F.row_number().over(others)).filter("nth = 1").select(*columns)
    return marked.filter("gone IS NULL").select(*columns).unionByName(once).unionByName(d.filter("node IS NULL").select(*columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that repeat a smaller doc_id, with n_chars
    counted again. A document of nothing else stays, with an empty text."""
    out = suffix_dedup.deduplicate(docs, chunk_bytes=SUFFIX_CHUNK_BYTES)
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*[new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, copies included, with their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("ngram_join", near_duplicates), ("suffix_dedup", repeated_passages),
          ("mixing", mixed), ("packing", packed)]

#: Tokens, suffixes and connected components are beyond SQL; tests hold the
#: pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
