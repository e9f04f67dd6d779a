import numpy as np
import pytest
from .brute import byte_dedup, ngram_components, word_dedup
from pyspark.sql import functions as F

from flowwarden.llm import ngram_join, substring_dedup, suffix_dedup
from flowwarden.llm.components import connected_components
from flowwarden.llm.text import Poly, covered, slices, windows_in_rows

import pyarrow as pa


def order(rows):
    return sorted(rows, key=repr)


def digest_bytes(df):
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return [tuple(r) for r in df.select("doc_id", "n_bytes", n, F.size("spans"), F.sha2("kept", 256)).collect()]


def digest_words(df):
    return [tuple(r) for r in df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()]


@pytest.mark.parametrize("chunk_bytes", [700, 1 << 20])
def test_byte_dedup_equals_brute_force(make, rows, chunk_bytes):
    got = suffix_dedup.deduplicate(make(rows), chunk_bytes=chunk_bytes)
    assert order(digest_bytes(got)) == order(byte_dedup(rows))


@pytest.mark.parametrize("chunk_bytes", [700, 1 << 20])
def test_word_dedup_equals_brute_force(make, rows, chunk_bytes):
    got = substring_dedup.deduplicate(make(rows), chunk_bytes=chunk_bytes)
    assert order(digest_words(got)) == order(word_dedup(rows))


def test_word_dedup_within_one_text(make):
    rows = [(1, "a b c d e f g h i j k l m n o p q r s t " * 3, None, "a"), (2, "x " * 100, None, "a")]
    assert order(digest_words(substring_dedup.deduplicate(make(rows)))) == order(word_dedup(rows))


def test_other_columns_come_through(make, rows):
    out = suffix_dedup.deduplicate(make(rows)).select("doc_id", "rest.*")
    assert {"lang", "source", "n_chars", "kept", "rest", "chunk", "a.b"} <= set(out.columns)
    assert out.filter("doc_id = 512").first()["kept"] == "x"


def test_text_loses_whole_characters(make):
    rows = [(1, "x" + "é" * 40, None, "a"), (2, "yé" + "é" * 40, None, "a")]
    got = {r.doc_id: r for r in suffix_dedup.deduplicate(make(rows)).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "y"


@pytest.mark.parametrize("run", [suffix_dedup.deduplicate, substring_dedup.deduplicate, ngram_join.components])
def test_empty_table(make, rows, run):
    assert run(make(rows).limit(0)).count() == 0


def test_hot_copies(make):
    """A third of the rows are one text, another third near copies of it."""
    base = [f"v{i}" for i in range(120)]
    rows = [(i, " ".join(base) if i % 3 else " ".join(base[:i % 110] + ["new"] + base[i % 110 + 1:]) if i % 2 else f"alone {i} " * 9, None, "a")
            for i in range(90)]
    assert order(digest_words(substring_dedup.deduplicate(make(rows), chunk_bytes=3000))) == order(word_dedup(rows))
    assert order(digest_bytes(suffix_dedup.deduplicate(make(rows), chunk_bytes=3000))) == order(byte_dedup(rows))
    got = [tuple(r) for r in ngram_join.components(make(rows), chunk_bytes=3000).collect()]
    assert order(got) == order(ngram_components(rows))


@pytest.mark.parametrize("chunk_bytes,partner", [(700, 4.0), (1 << 20, 1e9)])
def test_ngram_join_equals_brute_force(make, rows, chunk_bytes, partner, monkeypatch):
    monkeypatch.setattr(ngram_join, "PARTNER", partner)  # the second makes deletion segments pay
    known = [r for r in rows if r[0] is not None]
    got = [tuple(r) for r in ngram_join.components(make(rows), chunk_bytes=chunk_bytes).filter("doc_id IS NOT NULL").collect()]
    assert order(got) == order(ngram_components(known))
    loose = [tuple(r) for r in ngram_join.components(make(rows), ngram=3, percent=60, chunk_bytes=chunk_bytes).filter("doc_id IS NOT NULL").collect()]
    assert order(loose) == order(ngram_components(known, 60))


def test_null_ids_link_with_nothing(make, rows):
    assert {r.component_id for r in ngram_join.components(make(rows)).filter("doc_id IS NULL").collect()} == {None}


@pytest.mark.parametrize("edits,shared,group_bytes", [(5, 0, 1 << 22), (6, 2, 1 << 22), (5, 0, 9000), (6, 2, 9000)])
def test_families_around_no_original(make, edits, shared, group_bytes, monkeypatch):
    """Many edits of one text, most too far from each other and from any centre;
    some pairs of them share edits and link across components. A centre's documents
    are one group, or several with one order of differences."""
    import random
    monkeypatch.setattr(ngram_join, "GROUP_BYTES", group_bytes)
    r = random.Random(edits)
    base = [f"v{i}" for i in range(260)]
    rows = []
    for i in range(70):
        words = list(base)
        if rows and i % 5 == 0 and shared:
            words = rows[r.randrange(len(rows))][1].split(" ")
        for _ in range(r.randint(1, edits) if not (rows and i % 5 == 0 and shared) else shared):
            at = r.randrange(len(words))
            words[at] = f"e{r.randrange(400)}"
        rows.append((i, " ".join(words), None, "a"))
    want = order(ngram_components(rows))
    assert 5 < len({c for *_, c in want}) < 70
    assert order([tuple(x) for x in ngram_join.components(make(rows), chunk_bytes=9000).collect()]) == want


def test_common_passages(make):
    """Documents that share passages but don't link, and copies of some of them."""
    import random
    r = random.Random(3)
    passages = [" ".join(f"p{k}x{i}" for i in range(40)) for k in range(4)]
    rows = []
    for i in range(60):
        text = " ".join([passages[i % 4], *[f"t{r.randrange(10 ** 6)}" for _ in range(r.choice([10, 40, 120]))], passages[(i + 1) % 4]])
        if rows and i % 7 == 0:
            text = rows[r.randrange(len(rows))][1] + " more"
        rows.append((i, text, None, "a"))
    for percent in (90, 80):
        got = ngram_join.components(make(rows), percent=percent, chunk_bytes=2000).collect()
        assert order([tuple(x) for x in got]) == order(ngram_components(rows, percent))


@pytest.mark.parametrize("count,percent", [(0, 90), (10 ** 4, 90), (10 ** 12, 90), (10 ** 4, 80), (10 ** 8, 80), (10 ** 6, 60)])
def test_linked_sets_share_a_signature(count, percent):
    """Pigeonhole: whatever the allocation, linked sets meet in a signature."""
    draw = np.random.default_rng(3)
    by = ngram_join.schemes(400, {n: count for n in range(1, 400)}, percent)
    assert all(s + 2 * d >= ngram_join.differing(2 * (hi - 1), percent) + 1 + z
               for s, d, z, hi in zip(by.subset[:-1], by.deletion, by.spare, by.start[1:]))
    if count == 10 ** 12:
        assert by.deletion.any()
    for _ in range(400):
        n, most = int(draw.integers(1, 350)), 0.6 * (1 - percent / 100)
        x = draw.integers(0, 1 << 64, n, dtype=np.uint64)
        y = np.concatenate([x[int(n * draw.uniform(0, most)):], draw.integers(0, 1 << 64, int(n * draw.uniform(0, most)), dtype=np.uint64)])
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= percent * (len(x) + len(y) - both):
            s = ngram_join._Sets.__new__(ngram_join._Sets)
            s.ids, s.size = np.arange(2), np.array([len(x), len(y)])
            s.member, s.owner = np.concatenate([x, y]), np.repeat([0, 1], s.size)
            signature, of, *rest = s.signatures(np.arange(2), by)
            assert np.intersect1d(signature[of == 0], signature[of == 1]).size
            use, left, need = rest
            for second in range(2):  # as many agree as the scheme says, whichever are left out first
                mine = signature[use == second]
                for other in (2, 3):
                    both = np.intersect1d(mine, signature[use == other])
                    kept = np.intersect1d(np.sort(mine)[left[second]:], np.sort(signature[use == other])[left[other]:])
                    if both.size and by.band(np.array([len(x)]))[0] + second == by.band(np.array([len(y)]))[0] + other - 2:
                        assert len(kept) >= min(need[second], need[other]) or by.deletion[by.band(np.array([len(x)]))[0] + second]


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5000, i) for i in range(3000, 3200)] + [(9, 9), (7, 8), (8, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100}
    assert {got[i] for i in [*range(3000, 3200), 5000]} == {3000}
    assert got[7] == got[8] == 7 and 9 not in got


def test_slices_and_windows():
    col = pa.array(["ab cd", None, "", " x ", "y" * 50, "é z"])
    for limit in (1, 7, 1000):
        parts = list(slices(col, limit))
        assert sum(p.rows for p in parts) == 6
        words = [p.data[s:e].tobytes().decode() for p in parts for s, e in zip(*p.words()[:2])]
        assert words == ["ab", "cd", "x", "y" * 50, "é", "z"]
    starts, rows = windows_in_rows(np.array([0, 3, 3, 8]), 3)
    assert starts.tolist() == [0, 3, 4, 5] and rows.tolist() == [0, 2, 2, 2]
    assert covered(np.array([1, 2]), 3, 6).tolist() == [False, True, True, True, True, False]
    p = Poly(0x9E3779B97F4A7C15)
    x = np.array([5, 6, 7, 5, 6, 7, 8], np.uint64)
    h = p.windows(p.running(x), 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4
