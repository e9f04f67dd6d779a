"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine ``c`` lie within squared distance ``2 - 2 c``. After a
fixed rotation they are split into blocks of about ``BLOCK`` coordinates; in some
block two near vectors are within that block's share of the squared distance.
Each block is range-joined on a grid as wide as its range, so partners are in
neighbouring cells, and candidates are verified on the whole vectors in double
precision. A pair counts in the first block that brings it together, so links are
counted without listing pairs; a tile sends link counts and one edge per vector.

Identical vectors are joined as one with a weight. A cell of many vectors is
split into parts, and parts meet in pairs, so no task holds more than two parts.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import connected_components

COSINE = 0.93
BLOCK = 8
#: Vectors in a part of a cell.
PART = 4096
#: Rounding that a squared distance may carry.
SLACK = 1e-9


def rotation(dims: int) -> np.ndarray:
    """A seeded orthogonal matrix; it spreads the distance over all coordinates."""
    q, r = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def block_bounds(dims: int, block: int = BLOCK) -> list[tuple[int, int]]:
    cuts = np.linspace(0, dims, max(1, round(dims / block)) + 1).astype(int).tolist()
    return list(zip(cuts[:-1], cuts[1:]))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(col: pa.Array, dims: int) -> np.ndarray:
    raw = b"".join(col.to_pylist())
    return np.frombuffer(raw, "<f8").reshape(-1, dims)


def links_in(a: np.ndarray, b: np.ndarray | None, turn: np.ndarray, bounds: list[tuple[int, int]], block: int, budget: float,
             cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked vectors of ``a`` and ``b`` (of ``a`` alone if None)
    that ``block`` is the first to bring together."""
    ra = a @ turn
    rb = ra if b is None else b @ turn
    other = a if b is None else b
    lo, hi = bounds[block]
    xa, xb = ra[:, lo:hi], rb[:, lo:hi]
    nb = (xb * xb).sum(1)
    step = max(1, (1 << 22) // max(1, len(xb)))
    for s in range(0, len(xa), step):
        part = xa[s:s + step]
        near = (part * part).sum(1)[:, None] + nb[None] - 2 * part @ xb.T <= budget * (hi - lo) / turn.shape[0] + 1e-6
        i, j = np.nonzero(near)
        i += s
        if b is None:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            p, q = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
            good = np.einsum("ij,ij->i", a[p], other[q]) >= cosine
            p, q = p[good], q[good]
            gap = (ra[p] - rb[q]) ** 2
            share = [gap[:, u:v].sum(1) <= budget * (v - u) / turn.shape[0] + SLACK for u, v in bounds[:block + 1]]
            first = share[block]
            for earlier in share[:block]:
                first = first & ~earlier
            if first.any():
                yield p[first], q[first]


def local_components(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Least index reachable from each of ``n`` nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        np.minimum.at(new, root[p], low)
        np.minimum.at(new, root[q], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         cosine: float = COSINE, block: int = BLOCK, part: int = PART) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row.

    Vectors link when their labels are equal and not null, their lengths are equal
    and their cosine is ``cosine`` (above 0) or more. Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing, and so does a
    null id. Ids are expected once; rows that repeat an id share one result. An
    empty table gives no rows; other columns are not read."""
    v = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    usable = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite)
              & F.exists("v", lambda x: x != 0))
    good = d.filter(F.coalesce(usable, F.lit(False)))
    classes = cut_lineage(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("weight")))
    sizes = [r[0] for r in classes.select(F.size("v")).distinct().collect()]  # lengths of vectors, not data
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    # coordinates of the grid: enough for cells of about a part, as ranges span about a fifth of a coordinate's spread
    axes = max(1, min(block, math.ceil(math.log(max(1, largest / part), 5))))
    turns = {n: rotation(n) for n in sizes}
    bounds = {n: block_bounds(n, block) for n in sizes}
    budget = 2 - 2 * cosine

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, weights = (batch.column(i).to_pylist() for i in range(3))
            for lo in range(0, batch.num_rows, 1024):
                out: list[tuple] = []
                for i, x in enumerate(batch.column(3).slice(lo, 1024).to_pylist(), lo):
                    n = len(x)
                    u = unit(np.array([x], np.float64))
                    turned = (u @ turns[n])[0]
                    raw = u.astype("<f8").tobytes()
                    for b, (s, e) in enumerate(bounds[n]):
                        width = math.sqrt(budget * (e - s) / n) * (1 + 1e-9) + 1e-9
                        cell = tuple(int(math.floor(c / width)) for c in turned[s:min(e, s + axes)])
                        name = f"{n}/{b}/{labels[i]}/"
                        home = name + ",".join(map(str, cell))
                        for step in itertools.product((-1, 0, 1), repeat=len(cell)):
                            near = name + ",".join(str(c + o) for c, o in zip(cell, step))
                            first = step >= (0,) * len(cell)
                            out.append((home if first else near, near if first else home, not first, ids[i], weights[i], n, b, raw))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (
                    pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                    ["cell", "other", "right", "id", "weight", "n", "block", "x"])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in deal(batches):
            own = np.array(batch.column(0).to_pylist(), object) == np.array(batch.column(1).to_pylist(), object)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(own))], ["cell"])

    tiles_of = "cell string, other string, right boolean, id long, weight long, n int, block int, x binary"
    spread = classes.select("rep", "label", "weight", "v")
    crowded = (spread.mapInArrow(homes, "cell string").groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > part)
               .select("cell", F.ceil(F.col("rows") / part).cast("int").alias("parts")))
    rows = (spread.mapInArrow(deal, tiles_of)
            .join(crowded, "cell", "left").join(crowded.select(F.col("cell").alias("other"), F.col("parts").alias("other_parts")), "other", "left"))
    parts, other_parts = F.coalesce("parts", F.lit(1)), F.coalesce("other_parts", F.lit(1))
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("right"), other_parts).otherwise(parts)).cast("int")
    rows = rows.withColumns({"mine": mine, "theirs": F.explode(F.sequence(F.lit(0), F.when(F.col("right"), parts).otherwise(other_parts) - 1))})
    same = F.col("cell") == F.col("other")
    # inside one cell, part p is left of the parts from p on and right of those before
    rows = rows.select("cell", "other", F.when(same, F.least("mine", "theirs")).when(F.col("right"), F.col("theirs")).otherwise(F.col("mine")).alias("p"),
                       F.when(same, F.greatest("mine", "theirs")).when(F.col("right"), F.col("mine")).otherwise(F.col("theirs")).alias("q"),
                       F.when(same, F.col("mine") > F.col("theirs")).otherwise(F.col("right")).alias("right"), "id", "weight", "n", "block", "x")

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by([("right", "ascending"), ("id", "ascending")])
        n, b = t.column("n")[0].as_py(), t.column("block")[0].as_py()
        ids, weight = t.column("id").to_numpy(), t.column("weight").to_numpy()
        x = matrix(t.column("x"), n)
        cut = int(np.count_nonzero(~t.column("right").to_numpy()))
        alone = t.column("cell")[0].as_py() == t.column("other")[0].as_py() and t.column("p")[0].as_py() == t.column("q")[0].as_py()
        count, edges = np.zeros(len(ids), np.int64), []
        for p, q in links_in(x[:cut], None if alone else x[cut:], turns[n], bounds[n], b, budget, cosine) if alone or 0 < cut < len(ids) else ():
            q = q if alone else q + cut
            np.add.at(count, p, weight[q])
            np.add.at(count, q, weight[p])
            edges.append((p, q))
        found = np.flatnonzero(count)
        root = local_components(len(ids), *map(np.concatenate, zip(*edges))) if edges else np.arange(len(ids))
        return pa.table({"id": pa.array(ids[found], pa.int64()), "links": pa.array(count[found], pa.int64()), "near": pa.array(ids[root[found]], pa.int64())})

    found = cut_lineage(rows.groupBy("cell", "other", "p", "q").applyInArrow(compare, "id long, links long, near long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("id").alias("a"), F.col("near").alias("b")))
    reps = (classes.join(links, F.col("rep") == F.col("id"), "left").drop("id").join(groups, F.col("rep") == F.col("node"), "left")
            .select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = good.join(reps, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = d.filter(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
