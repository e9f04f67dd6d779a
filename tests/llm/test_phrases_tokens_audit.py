"""op11, op12 and op13 against plain statements of what they return."""

import base64
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowwarden.llm import byte_bpe, collocations, filter_audit
from flowwarden.llm.text import slices

from .brute import WORD

# --- phrases ------------------------------------------------------------------------


def phrases(rows, least, pct=100, top=2000, most=5):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, most + 1):
                f.update((lang or "und", tuple(w[i:i + m])) for i in range(len(w) - m + 1))
    out = {}
    for (lang, p), a in f.items():
        if a >= least and len(p) > 1:
            cut = min(((1000 * a * n[lang]) // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang, p] = (cut[0], a, f[lang, p[:cut[1]]], f[lang, p[cut[1]:]])
    gone = {(lang, q[i:j]) for lang, q in out for i in range(len(q)) for j in range(i + 2, len(q) + 1)
            if j - i < len(q) and 100 * f[lang, q] >= pct * f[lang, q[i:j]]}
    got = []
    for lang in {x for x, _ in out}:
        own = sorted(((-s[0], -s[1], " ".join(p).encode(), s) for (x, p), s in out.items() if x == lang and (x, p) not in gone))[:top]
        got += [(lang, k + 1, p.decode(), s[1], s[2], s[3], n[lang], s[0]) for k, (_, _, p, s) in enumerate(own)]
    return sorted(got)


def phrase_rows(seed=4):
    r = random.Random(seed)
    words = [f"v{i}" for i in range(12)] + ["Ü", "the"]
    out = [(i, " ".join(r.choice(words) + r.choice(["", "", "", ".", ",", "\t", "\n", " ! "]) for _ in range(r.randrange(60))), r.choice(["en", "de", None, "und"]), "s")
           for i in range(120)]
    out += [(k, "The Hot line is here again, the hot line", "en", "s") for k in range(60)]  # a third of all suffixes
    return out + [(None, "v1 v2 v3", None, None), (900, None, "en", None), (901, "", "en", None), (902, " ,. ", "fr", None), (903, "one " * 3000, "en", "s")]


@pytest.mark.parametrize("limits", [{}, {"cell_suffixes": 200, "prefix_suffixes": 40}, {"cell_suffixes": 50, "prefix_suffixes": 1}])
def test_phrases_equal_brute_force(make, limits):
    rows = phrase_rows()
    got = [tuple(r) for r in collocations.mine(make(rows), min_count=5, **limits).collect()]
    want = phrases(rows, 5)
    assert sorted(got) == want and len(want) > 100


def test_phrases_top_and_containment(make):
    rows = phrase_rows(5)
    assert sorted(tuple(r) for r in collocations.mine(make(rows), min_count=4, top=7, inside_pct=60).collect()) == phrases(rows, 4, 60, 7)


def test_phrases_of_nothing(make):
    assert collocations.mine(make([])).collect() == []
    assert collocations.mine(make([(1, None, None, None), (2, " ... ", "en", "a")]), min_count=1).collect() == []


def test_three_way_quicksort():
    r = np.random.default_rng(1)
    suffix = np.concatenate([np.ones((4000, 1), int), r.zipf(1.6, (4000, 3)).clip(0, 50) * (r.random((4000, 3)) > 0.05)], 1)
    for k in (2, 3):
        suffix[suffix[:, k - 1] == 0, k] = 0
    weight = r.integers(1, 4, 4000)
    row, size, count = collocations.three_way(suffix, weight, np.ones(4000, int), 30)
    want = Counter()
    for s, w in zip(suffix.tolist(), weight.tolist()):
        for k in range(1, 4):
            if s[k]:
                want[tuple(s[1:k + 1])] += w
    assert {tuple(suffix[a, 1:k + 1].tolist()): c for a, k, c in zip(row, size, count)} == {p: c for p, c in want.items() if c >= 30}
    assert len(row) == len({(int(a), int(k)) for a, k in zip(row, size)})


# --- tokens -------------------------------------------------------------------------

PARTS = ["a", "s", "t", "re", "ve", "ll", "d", "m", "'", "''", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "　", "​", "漢", "!", "#", "²", "́",
         "'s", "'re", "don't", " 's", "\r\n", "x" * 70, "\x85", "\xa0", "😀", "'l", "'S", "ab" * 40]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(byte_bpe.ranks_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(seed=2, n=3000):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(30))) for _ in range(n)]


def test_encoding_equals_the_library(spark, make, rows, library):
    table = rows + [(1000 + i, t, None, None) for i, t in enumerate(texts())] + [(7, "twice", None, None)] * 2 + [(8, "b" * 30_000, None, None)]
    out = byte_bpe.decode(byte_bpe.encode(make(table)).select("doc_id", "ids")).collect()
    want = sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in table), key=repr)
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in out), key=repr) == want


def test_offsets_point_at_tokens(make, rows, library):
    by_id = {i: (t or "").encode() for i, t, *_ in rows if i is not None}
    for r in byte_bpe.encode(make(rows)).filter("doc_id IS NOT NULL").collect():
        ends = [*r.offsets[1:], len(by_id[r.doc_id])]
        assert [by_id[r.doc_id][a:b] for a, b in zip(r.offsets, ends)] == library.decode_tokens_bytes(r.ids)


def test_encoding_of_odd_bytes_and_no_rows(spark, make):
    odd = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    got = byte_bpe.decode(byte_bpe.encode(odd)).first()
    assert bytes(got.decoded).decode() == "a�b"
    assert byte_bpe.decode(byte_bpe.encode(make([]))).collect() == []
    no_ids = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(no_ids).collect()] == [b"", b""]


def test_scan_equals_a_loop():
    r = np.random.default_rng(5)
    c = r.integers(0, byte_bpe.N_CLASSES, 5000).astype(np.uint8)
    c[r.random(5000) < 0.02] += byte_bpe.N_CLASSES
    c[0] = byte_bpe.N_CLASSES
    state, want = 0, []
    for x in c:
        want.append(state)
        state = byte_bpe.STEP[x, state]
    assert byte_bpe.states_before(c).tolist() == want


def test_cache_is_cleared(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_SLICES", 20)
    first, kinds = byte_bpe.class_runs()
    kind = np.repeat(kinds, np.diff(np.append(first, 0x110000)))
    table, ts = byte_bpe.Merges(byte_bpe.ranks_path()), texts(9, 200)
    for p in slices(pa.array(ts), 300):
        ids, n = table.ids(p.data, starts := byte_bpe.boundaries(p, kind))
        want = [library.encode_ordinary(t) for t in ts[p.first:p.first + p.rows]]
        assert ids.tolist() == [i for x in want for i in x] and len(n) == len(starts)


# --- filters ------------------------------------------------------------------------

def fails(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, _, source in rows:
        t, w = t or "", WORD.findall(t or "")
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
               "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        out.append((i, source or "", {k for k, v in bad.items() if v}))
    return out


def audited(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out, marks = Counter(), fails(rows)
    parts = {p for _, p, _ in marks}
    cells = {(p, o, s): Counter() for p in parts for o in map("".join, permutations("ABCDE")) for s in range(1, 6)}
    for i, p, bad in marks:
        for o in map("".join, permutations("ABCDE")):
            for s in range(1, 6):
                f, gone = o[s - 1], bad & set(o[:s - 1])
                c = cells[p, o, s]
                c["kept"] += not gone and f not in bad
                removed = not gone and f in bad
                c["removed"] += removed
                c["redundant"] += bool(gone) and f in bad
                c["unique"] += bad == {f}
                c["good"] += removed and i in good
                c["toxic"] += removed and i in toxic
                out[p, f] += removed
    return sorted((p, o, s, c["kept"], c["removed"], c["redundant"], c["unique"], c["good"], c["toxic"], out[p, o[s - 1]]) for (p, o, s), c in cells.items())


LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 101, 3)] + [(500, 1, None), (None, 1, 1), (9999, 1, 1), (3, 1, 1), (3, 0, None)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def audit_rows(rows):
    hot = ("A shared opening that many texts have " * 3).strip()
    r = random.Random(8)
    extra = [(600 + k, hot + " " + "x" * r.randrange(40), "en", "a") for k in range(80)] + [(700 + k, "Copy & paste", "en", "b") for k in range(60)]
    return rows + extra + [(700, "Copy & paste", "en", "a"), (1, "same id", "en", "a"), (1, "same id", "en", "b"), (510, "SHOUT " * 60, "en", "a")]


@pytest.mark.parametrize("depths", [filter_audit.DEPTHS, (1, 4, 120)])
def test_audit_equals_brute_force(make, rows, labels, depths):
    table = audit_rows(rows)
    got = sorted(tuple(r) for r in filter_audit.audit(make(table), labels, depths=depths).collect())
    assert got == audited(table, LABELS) and any(r[-1] and r[0] == "" for r in got)


def test_masks_of_rows(make, rows):
    table = audit_rows(rows)
    got = Counter((r.doc_id, r.part, r.mask) for r in filter_audit.masks(make(table)).collect())
    assert got == Counter((i, p, sum(1 << "ABCDE".index(f) for f in bad)) for i, p, bad in fails(table))


def test_audit_of_no_documents(make, labels, rows):
    assert filter_audit.audit(make([]), labels).collect() == []
    assert filter_audit.audit(make(rows[:3]), labels.filter(F.lit(False))).count() == 600 * len({r[3] or "" for r in rows[:3]})


def test_trie_keeps_only_its_last_path():
    r = random.Random(3)
    held = {}
    for _ in range(3000):
        t = "".join(r.choice("ab") for _ in range(r.randrange(12))).encode()
        held.setdefault(t, []).append(r.randrange(1000))
    trie, most = filter_audit.Trie(), 0
    for t in sorted(held):
        for i in held[t]:
            trie.insert(t, i)
            most = max(most, len(trie.path))
    trie.finish()
    assert Counter(trie.closed) == Counter((min(ids), filter_audit.md5(t).digest()) for t, ids in held.items()) and most <= 13
    assert [filter_audit.common(a, b) for a, b in ((b"", b""), (b"a", b""), (b"abc", b"abd"), (b"ab", b"abc"), (b"x", b"y"))] == [0, 0, 2, 2, 0]


def test_three_way_costs_about_a_sort():
    """Rows in order within each chunk, as they come: counts as by counting every prefix, in a few times the CPU time
    of a sort of the rows (a pivot at the end of such a partition would take off one word in a round)."""
    import time
    from collections import Counter

    import numpy as np

    from flowwarden.llm.collocations import three_way
    rng = np.random.default_rng(5)
    n = 200_000
    words = np.where(np.arange(5) < rng.integers(1, 6, n)[:, None], (rng.pareto(0.7, (n, 5)) * 20).clip(0, 5000).astype(np.int32) + 1, 0)
    rows = np.concatenate([rng.integers(1, 4, (n, 1)), words], 1).astype(np.int32)
    weight, depth = rng.integers(1, 4, n), np.ones(n, np.int64)
    began = time.process_time()
    np.lexsort(rows.T[::-1])
    sort = time.process_time() - began
    rows = np.concatenate([rows[i::4][np.lexsort(rows[i::4].T[::-1])] for i in range(4)])
    began = time.process_time()
    row, size, count = three_way(rows, weight, depth, 20)
    took = time.process_time() - began
    want = Counter()
    for k in range(1, 6):
        long = rows[:, k] > 0
        prefixes, at = np.unique(rows[long, :k + 1], axis=0, return_inverse=True)
        sums = np.bincount(at.ravel(), weight[long]).astype(int)
        want.update({tuple(p): int(c) for p, c in zip(prefixes[sums >= 20].tolist(), sums[sums >= 20])})
    assert {tuple(rows[r, :k + 1].tolist()): int(c) for r, k, c in zip(row, size, count)} == dict(want)
    assert took < 40 * sort, (took, sort)
