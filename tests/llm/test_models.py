import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from flowwarden.llm import language_id, quality_fm

MEDIUM = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    got = E.queries()["op2_language_id"](spark, MEDIUM).alias("g")
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    r = got.join(docs, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.98 and 0 <= r[1] and r[2] <= 1
    assert got.count() == docs.count()


def test_language_edges(make, rows):
    d = make(rows).withColumn("lang", F.when(F.col("text").contains("é"), "fr").otherwise(F.col("lang")))
    model = language_id.fit(d)
    got = {r.doc_id: r for r in language_id.predict(make(rows), model).collect()}
    assert {i for i in got if got[i].lang_pred == "und"} >= {500, 501, 502, 511}
    assert got[500].score == 0 and got[500].ambiguous
    assert all(0 <= r.score <= 1 and r.lang_pred in {*model.languages, "und"} for r in got.values())
    assert language_id.predict(make(rows).limit(0), model).count() == 0
    with pytest.raises(ValueError):
        language_id.fit(d.filter("lang = 'none'"))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 30])
def test_codewords_differ(n):
    c = language_id.codewords(n)
    assert len({tuple(r) for r in c.tolist()}) == n
    assert n == 1 or all(abs(s) < n for s in c.sum(0))  # each bit splits the languages


def test_one_wrong_bit_is_corrected():
    c = language_id.codewords(4)
    m = language_id.LanguageModel(list("abcd"), c, np.zeros((2, c.shape[1])), np.ones(c.shape[1]))
    for i in range(4):
        for b in range(c.shape[1]):
            margins = c[i].astype(float)
            margins[b] *= -1
            assert m.decode(margins[None])[0][0] == i
    assert m.decode(np.zeros((1, c.shape[1])))[2][0]  # no evidence is ambiguous


def test_quality_held_out(spark):
    got = E.queries()["op10_quality_fm"](spark, MEDIUM)
    r = got.join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").filter("held_out AND quality IS NOT NULL").toPandas()
    rank, good = r.score.rank(), r.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / good.sum() / (~good).sum()
    assert auc > 0.95 and (r.predicted == (r.score >= 0.7)).all()
    assert got.count() == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()


def test_quality_edges(make, rows):
    d = make(rows).withColumn("quality", (F.length("text") > 60).cast("int"))
    model = quality_fm.fit(d)
    out = quality_fm.score(make(rows), model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert quality_fm.score(make(rows).limit(0), model).count() == 0
    with pytest.raises(ValueError):
        quality_fm.fit(d.filter("quality = 5"))


def test_pairwise_part_is_the_sum_over_pairs():
    """The linear-time form equals the sum over all pairs of features."""
    draw = np.random.default_rng(0)
    m = quality_fm.FactorisationMachine(0.3, draw.normal(size=(6, 3)), draw.normal(size=(2, 3)), np.zeros(2), np.ones(2))
    grams, rows, x, stats = np.array([1, 4, 4, 2, 0]), np.array([0, 0, 0, 1, 1]), np.array([.5, .2, .2, .7, 1.]), draw.normal(size=(2, 2))
    z, _ = m.raw(grams, rows, x, stats)
    for row in range(2):
        own = [(m.words[g], v) for g, r, v in zip(grams, rows, x) if r == row] + list(zip(m.stats, stats[row]))
        want = 0.3 + sum(w[0] * v for w, v in own)
        want += sum(own[i][0][1:] @ own[j][0][1:] * own[i][1] * own[j][1] for i in range(len(own)) for j in range(i))
        assert abs(z[row] - want) < 1e-9
