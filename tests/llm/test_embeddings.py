import math

import numpy as np
import pytest
from .brute import reach

from flowwarden.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, weight string, v string, rep long"


def brute(rows, cosine=0.93):
    def usable(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    good = [r for r in rows if usable(r)]
    x = {r[0]: np.array(r[1], np.float32).astype(float) for r in good}
    links = [(a[0], b[0]) for i, a in enumerate(good) for b in good[:i] if a[2] == b[2] and len(a[1]) == len(b[1])
             and x[a[0]] @ x[b[0]] / math.sqrt((x[a[0]] @ x[a[0]]) * (x[b[0]] @ x[b[0]])) >= cosine]
    root = reach(x, links)
    out = []
    for r in rows:
        c = root.get(r[0], r[0]) if usable(r) else r[0]
        out.append((r[0], sum(r[0] in p for p in links), c, r[0] == c))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(5)
    rows = []
    for i in range(150):
        v = draw.normal(size=16)
        if i % 3 == 1:  # near some earlier vector, on either side of the bound
            base = np.array(rows[int(draw.integers(len(rows)))][1])
            v = base + draw.normal(size=16) * np.linalg.norm(base) / 4 * draw.uniform(0.1, 0.5)
        rows.append((i + 10, [float(np.float32(c)) for c in v * draw.uniform(0.1, 9)], int(draw.integers(0, 2))))
    hot = draw.normal(size=16)
    rows += [(1000 + i, [float(np.float32(c)) for c in hot + draw.normal(size=16) * 0.02], 1) for i in range(60)]  # one dense group
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(30)]  # one vector many times
    inf, nan = float("inf"), float("nan")
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [nan] * 16, 1), (3003, [inf] + [1.0] * 15, 1), (3004, [None] + [1.0] * 15, 1),
             (3005, rows[0][1], None), (3006, [], 1), (3007, [1.0, 2.0], 1), (3008, [2.0, 4.0], 1), (3009, [1e-30] * 16, 0), (3010, [1e30] * 16, 0)]
    return rows


@pytest.mark.parametrize("part", [16, 4096])
def test_links_equal_brute_force(spark, vectors, part):
    df = spark.createDataFrame([(*r, "x", "x", "x", 0) for r in vectors], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in embedding_dedup.link(df, part=part).collect()), key=repr)
    assert got == brute(vectors)


def test_empty_table(spark):
    assert embedding_dedup.link(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("dims", [1, 2, 7, 64, 100])
def test_some_block_is_within_its_share(dims):
    """Pigeonhole over blocks, whatever the number of coordinates."""
    draw = np.random.default_rng(dims)
    turn, bounds = embedding_dedup.rotation(dims), embedding_dedup.block_bounds(dims)
    assert bounds[0][0] == 0 and bounds[-1][1] == dims and np.allclose(turn @ turn.T, np.eye(dims))
    for _ in range(50):
        a = embedding_dedup.unit(draw.normal(size=(1, dims)))
        b = embedding_dedup.unit(a + draw.normal(size=(1, dims)) * draw.uniform(0, 1) / math.sqrt(dims))
        budget = 2 - 2 * float((a @ b.T)[0, 0])
        gap = ((a - b) @ turn)[0] ** 2
        assert any(gap[s:e].sum() <= budget * (e - s) / dims + embedding_dedup.SLACK for s, e in bounds)
