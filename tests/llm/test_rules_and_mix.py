import os
from collections import defaultdict

import duckdb
import pytest
from .brute import WORD
from pyspark.sql import functions as F

from flowwarden.llm import mixing, quality_rules
from flowwarden.llm.queries import ORACLES


def oracle(name, df, tmp_path):
    path = str(tmp_path / "documents.parquet")
    if not os.path.exists(path):
        df.write.parquet(path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    res = c.execute(ORACLES[name])
    return [d[0] for d in res.description], res.fetchall()


def same(df, names, want):
    got = [tuple(r) for r in df.select(*names).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_rules_equal_sql(make, rows, tmp_path):
    known = [r for r in rows if r[0] is not None]  # the statement joins by id
    df = make(known)
    same(quality_rules.judge(df), *oracle("op9_quality_rules", df, tmp_path))
    assert quality_rules.judge(make(rows)).count() == len(rows)
    assert quality_rules.judge(make(rows).limit(0)).count() == 0


def test_boilerplate_depletes_but_copies_do_not(make):
    line = "All rights reserved by the owner of this site and its many friends"
    own = [f"word{i} " * 3 + " ".join(f"u{i}x{k}" for k in range(30)) for i in range(60)]
    rows = [(i, f"{own[i]}\n{line}", None, "h") for i in range(30)]
    rows += [(100 + i, f"{line}\n{line}\nown {i}\n  {line.upper()} \nthree {i} more", None, "h") for i in range(30)]
    rows += [(200 + i, own[40], None, "h") for i in range(50)]  # one document many times
    rows += [(300 + i, line + "\n" + own[50 + i], None, "other") for i in range(5)]
    got = {r.doc_id: r for r in quality_rules.judge(make(rows), min_line_docs=20).collect()}
    n = len(line.split())
    assert all(got[i].kept and got[i].words_on_frequent_lines == n for i in range(30))
    assert all(got[100 + i].depleted and got[100 + i].words_on_frequent_lines == 3 * n and not got[100 + i].kept for i in range(30))
    assert all(got[200 + i].words_on_frequent_lines == 0 for i in range(50))
    assert all(got[300 + i].words_on_frequent_lines == 0 for i in range(5))


def test_documents_that_share_many_lines_count_each(make):
    shared = [f"common line {k} of the whole site" for k in range(20)]
    rows = [(i, "\n".join([*shared, " ".join(f"own{i}x{k}" for k in range(40))]), None, "h") for i in range(100)]
    rows += [(1000 + i, " ".join(f"other{i}x{k}" for k in range(40)), None, "h") for i in range(3000)]  # 100 of 3100 is above 1 %
    n = sum(len(x.split()) for x in shared)
    got = quality_rules.judge(make(rows)).collect()
    assert all(r.words_on_frequent_lines == (n if r.doc_id < 1000 else 0) for r in got)


def test_mix_equals_sql(make, rows, tmp_path):
    df = make(rows)
    out = mixing.copies(df, group_rows=5)
    same(out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")),
         *oracle("op4_mixing", df, tmp_path))


def test_targets_share_all_words(spark):
    """By hand: 5, 2, 1 and 5 of 13 shares of 1000 words; the first and the last
    source stop at three times their sizes, and the others share the excess."""
    df = spark.createDataFrame([("a", 10), ("b", 400), ("c", 580), (None, 10)], "source string, source_size long")
    got = {r.source: r for r in mixing.source_targets(df).collect()}
    assert got["a"].target == 30 and got[None].target == 30
    assert got["b"].target == pytest.approx(940 * 2 / 3) and got["c"].target == pytest.approx(940 / 3)
    nothing = mixing.source_targets(df.withColumn("source_size", F.lit(0).cast("long"))).collect()
    assert [r.target for r in nothing] == [0.0] * 4


def test_systematic_sampling(make, rows):
    out = [r for r in mixing.copies(make(rows), group_rows=5).collect()]
    assert len(out) == len(rows) and all(0 <= r.copies <= 3 for r in out)
    again = [tuple(r) for r in mixing.copies(make(rows[::-1]), group_rows=1000).collect()]
    assert sorted(map(tuple, out), key=repr) == sorted(again, key=repr)
    size, taken = defaultdict(int), defaultdict(int)
    for r in out:
        size[r.target] = r.source_size
        taken[r.target] += r.copies * r.size
    for target in size:  # an error of one longest document at most
        longest = max(len(WORD.findall(r[1] or "")) for r in rows)
        assert abs(taken[target] - target) <= longest


def test_mixed_rows_are_the_copies(make, rows):
    df = make([*rows, rows[3], rows[3]])  # a row three times
    want = defaultdict(int)
    for r in mixing.copies(df).collect():
        want[r.doc_id] += r.copies
    out = mixing.mix(df)
    assert out.columns == df.columns
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert mixing.mix(df.limit(0)).count() == 0
