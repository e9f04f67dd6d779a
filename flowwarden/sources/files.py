"""File sources and sinks: flow CSVs, input manifests, report export."""

from __future__ import annotations

import _hashlib
import ctypes
import ctypes.util
import hashlib
import os
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CONN_FEATURES, CONN_SCHEMA, INPUT_EXTENSIONS, MAX_INPUT_MB
from .pcap import _open

#: What one task reads of a file to hash, and at a time.
PIECE_BYTES, READ_BYTES = 256 << 20, 8 << 20
#: Room for the state of an MD5 (92 bytes).
STATE_BYTES = 128


def read_flows_csv(spark: SparkSession, path: str, header: bool = True,
                   schema: T.StructType | None = None) -> DataFrame:
    """Flow CSV files. With a header: the given schema, else inferred types.
    Without one: 42 columns get the 41 connection features + ``label``
    (typed by ``CONN_SCHEMA``); any other width gets ``feature_0..`` +
    ``label``."""
    r = spark.read.option("header", header)
    if header:
        return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)
    if schema is not None:
        return r.schema(schema).csv(path)
    # the width comes from the first line only (a one-row read), then the
    # full read is typed: no inference pass over the data
    first = spark.read.text(path).limit(1).first()
    width = len(first[0].split(",")) if first else 0
    if width == len(CONN_FEATURES) + 1:
        return r.schema(CONN_SCHEMA).csv(path)
    names = [f"feature_{i}" for i in range(width - 1)] + ["label"]
    return r.option("inferSchema", True).csv(path).toDF(*names)


@cache
def _crypto():
    """MD5 of the C library that Python's own links to, whose state is plain memory (that of
    ``hashlib`` can't leave its process). None where there is none."""
    for name in (getattr(_hashlib, "__file__", None), ctypes.util.find_library("crypto")):
        try:
            lib = ctypes.CDLL(name) if name else None
            state = lib and ctypes.create_string_buffer(STATE_BYTES)
            if lib and lib.MD5_Init(state) and lib.MD5_Update(state, b"abc", ctypes.c_size_t(3)) and _final(lib, state) == hashlib.md5(b"abc").hexdigest():
                return lib
        except (OSError, AttributeError):
            continue
    return None


def _final(lib, state) -> str:
    out = ctypes.create_string_buffer(16)
    lib.MD5_Final(out, state)
    return out.raw.hex()


def _pieces(path: str, start: int, stop: int):
    with _open(path) as stream:
        stream.seek(start)
        while start < stop:
            if not (data := stream.read(min(READ_BYTES, stop - start))):
                raise OSError(f"{path} ends at byte {start}, not at {stop}")
            start += len(data)
            yield data


def _hashed_on(file, stop: int, lib):
    """(path, size, byte that the state has reached, state), read on up to ``stop``. At the end of the
    file the digest takes the state's place. Without ``lib`` the last step reads all."""
    path, size, at, state = file
    stop = min(stop, size)
    if lib is None:
        if stop < size:
            return file
        whole = hashlib.md5()
        for data in _pieces(path, 0, size):
            whole.update(data)
        return path, size, size, whole.hexdigest()
    if at >= stop:
        return file
    held = ctypes.create_string_buffer(state, STATE_BYTES) if at else ctypes.create_string_buffer(STATE_BYTES)
    if not at:
        lib.MD5_Init(held)
    for data in _pieces(path, at, stop):
        lib.MD5_Update(held, data, ctypes.c_size_t(len(data)))
    return path, size, stop, _final(lib, held) if stop == size else held.raw


def _readable(path: str) -> bool:
    """Whether tasks can read parts of the file: it is mounted, or in a file system that Arrow knows."""
    try:
        _open(path).close()
        return True
    except (OSError, ValueError, ImportError):
        return False


def _hash_large(spark: SparkSession, files: list, piece_bytes: int) -> DataFrame:
    """Each file is hashed piece by piece, in stages: a task reads one piece and hands the state of
    the digest to the task of the next."""
    rows = spark.sparkContext.parallelize([(i, (f.path, f.length, 0, b"")) for i, f in enumerate(files)], len(files))
    for stop in range(piece_bytes, max(f.length for f in files) + piece_bytes, piece_bytes):
        step = lambda part, stop=stop: [(i, _hashed_on(f, stop, _crypto())) for i, f in part]
        rows = rows.mapPartitions(step).partitionBy(len(files), lambda i, stop=stop: i)
    return rows.map(lambda r: (r[1][0], r[1][1], r[1][3])).toDF("path string, size_bytes long, md5 string")


def file_manifest(spark: SparkSession, path_glob: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """MD5 and byte size of every input file. A file of up to ``piece_bytes`` is one value of one task; of
    larger ones each task reads that much, one after the other, as the digest of a file is sequential. In a
    store that only Spark's readers open a file stays one value (2 GB at most)."""
    files = spark.read.format("binaryFile").load(path_glob)
    hashed = files.select(F.col("path"), F.col("length").alias("size_bytes"), F.md5(F.col("content")).alias("md5"))
    # paths and sizes alone: as many as the driver lists for the reader
    large = files.where(F.col("length") > piece_bytes).select("path", "length").orderBy("path").collect()
    if not large or not all(_readable(p) for p in {os.path.dirname(f.path): f.path for f in large}.values()):
        return hashed
    return hashed.where(F.col("size_bytes") <= piece_bytes).unionByName(_hash_large(spark, large, piece_bytes))


def file_sizes(spark: SparkSession, path_glob: str) -> DataFrame:
    """Path and size only: the binary source prunes the content column."""
    return spark.read.format("binaryFile").load(path_glob).select("path", F.col("length").alias("size_bytes"))


def accepted_inputs(manifest: DataFrame, max_mb: float = MAX_INPUT_MB, extensions=None) -> DataFrame:
    """Files within the size bound whose extension is accepted."""
    ext = F.lower(F.regexp_extract(F.col("path"), r"\.([A-Za-z0-9]+)$", 1))
    return manifest.withColumn("extension", ext).withColumn(
        "accepted", (F.col("size_bytes") <= F.lit(int(max_mb * 1024 * 1024))) &
                    ext.isin(list(extensions or INPUT_EXTENSIONS)))


def export_report(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    """Write a report in csv (with header) / json / parquet."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)
    return path


def read_report(spark: SparkSession, path: str, fmt: str = "csv", schema=None) -> DataFrame:
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if schema is not None:
        r = r.schema(schema)
    elif fmt == "csv":
        r = r.option("inferSchema", True)
    return r.load(path)
