from collections import Counter

import pytest
from .brute import WORD, byte_dedup, reach, shingles
from .conftest import make_docs
from .test_packing import check_sequences, piece_rows

import corpus_pipeline as P
from flowwarden.llm import mixing, quality_rules


@pytest.fixture(scope="module")
def stages(spark, make, tmp_path_factory):
    """What each stage returned, by running it on the one before."""
    docs = make(make_docs(seed=8, n=90))
    d = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{d}/documents.parquet")
    out = [spark.read.parquet(f"{d}/documents.parquet")]
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, out[-1], d).write.parquet(f"{d}/{k}")
        out.append(spark.read.parquet(f"{d}/{k}"))
    return d, [x.collect() for x in out], out


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_columns_of_documents(stages):
    _, _, frames = stages
    assert len(P.STAGES) == 5 and all(f.columns == frames[0].columns and f.dtypes == frames[0].dtypes for f in frames[:-1])


def test_quality_stage(spark, stages):
    _, rows, frames = stages
    kept = Counter(r.doc_id for r in quality_rules.judge(frames[0]).filter("kept").collect())
    assert Counter(r.doc_id for r in rows[1]) == kept and None in kept  # rows without an id are judged each for itself
    texts = {(r.doc_id, r.text) for r in rows[0]}
    assert all((r.doc_id, r.text) in texts and len(WORD.findall(r.text)) >= 20 for r in rows[1])


def test_near_duplicate_stage(stages):
    _, rows, _ = stages
    sets = {r.doc_id: shingles(r.text, 5) for r in rows[1] if r.doc_id is not None}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a]]
    root = reach(sets, links)
    assert links and {r.doc_id for r in rows[2] if r.doc_id is not None} == {i for i in sets if root[i] == i}


def test_repeated_passage_stage(stages):
    _, rows, _ = stages
    want = {i: removed for i, _, removed, *_ in byte_dedup([(r.doc_id, r.text) for r in rows[2]])}
    before, after = by_id(rows[2]), by_id(rows[3])
    assert len(rows[2]) == len(rows[3]) and any(want.values())
    for i in before:
        lost = len(before[i].text.encode()) - len(after[i].text.encode())
        assert want[i] <= lost <= want[i] + 6 and after[i].n_chars == len(after[i].text) and (want[i] or after[i].text == before[i].text)
        assert (after[i].source, after[i].lang) == (before[i].source, before[i].lang)


def test_mixing_stage(stages):
    _, rows, frames = stages
    want = Counter()
    for r in mixing.copies(frames[3]).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in rows[4]) == +want
    assert {(r.doc_id, r.text) for r in rows[4]} <= {(r.doc_id, r.text) for r in rows[3]}


def test_packing_stage_and_run(spark, stages):
    d, rows, _ = stages
    for got in (rows[5], P.run(spark, d).collect()):
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == piece_rows([(r.doc_id, r.text) for r in rows[4]])
        check_sequences(got)


def test_each_row_by_its_own_text(spark, make):
    """Rows that share an id, or have none, neither fall nor stay together."""
    words = lambda k: " ".join(f"{k}w{j}" for j in range(40))
    rows = [(None, words("a"), "en", "s"), (None, None, "en", "s"), (1, words("b"), "en", "s"), (1, "too short", "en", "s"),
            (2, words("c"), "en", "s"), (3, words("c"), "en", "s"), (3, words("d"), "en", "s"), (4, words("e"), "en", "s"), (4, words("e"), "en", "s")]
    good = P.quality(spark, make(rows), "")
    ids = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    assert ids(good) == sorted(((r[0], r[1]) for r in rows if r[1] and len(r[1]) > 20), key=repr)
    want = [(None, words("a")), (1, words("b")), (2, words("c")), (3, words("d")), (4, words("e"))]
    left = P.near_duplicates(spark, good, "")
    assert ids(left) == sorted(want, key=repr) and left.columns == good.columns


def test_no_documents(spark, make, tmp_path):
    """An empty table goes through all stages."""
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
