import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from flowwarden.llm import packing


def piece_rows(rows, size=1024):
    """What every document's pieces are, by the tokenizer itself."""
    t = Tokenizer.from_file(packing.tokenizer_path())
    out = []
    for doc_id, text, *_ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        first = (len(ids) - 1) % size + 1
        for k, at in enumerate([0, *range(first, len(ids), size)]):
            part = ids[at:first if not k else at + size]
            out.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def check_sequences(got, size=1024):
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(held)


@pytest.mark.parametrize("cell_pieces", [20, 40_000])
def test_pieces_and_sequences(make, rows, cell_pieces):
    got = packing.pack(make(rows), cell_pieces=cell_pieces).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == piece_rows(rows)
    check_sequences(got)


def test_empty_table(make, rows):
    assert packing.pack(make(rows).limit(0)).count() == 0


ODD = ["", " ", "  ", "a  b", " a", "a ", "a \n b", "\n\n x", "a\t b", "é ü  ß", "don't we'll I'M", "x<|endoftext|>y <|endoftext|>", "日本 語", "a b   c",
       "12 345,67 $!?", "\r\n a\r\n", "a\n  b", "👍🏽 ok"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_ids_equal_the_tokenizer(name):
    ours = packing.token_ids(packing.tokenizer_path(name))
    t = Tokenizer.from_file(packing.tokenizer_path(name))
    for text in ODD + [a + b for a in ODD for b in ODD]:
        assert np.frombuffer(ours(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_best_two_fit_fills_sequences():
    draw = np.random.default_rng(1)
    for lengths, slack in ((draw.integers(1, 1025, 5000), 1.01), (np.minimum(1024, draw.lognormal(5, 1, 5000)).astype(int) + 0, 1.002),
                           (np.full(300, 513), 2.1), (np.array([], int), 1), (np.array([600, 400, 300, 124, 500, 100]), 1.0)):
        lengths = np.maximum(lengths, 1)
        seq, at = packing.best_two_fit(lengths)
        used = np.bincount(seq, lengths, minlength=0) if len(seq) else np.array([])
        assert (used <= 1024).all() and len(used) <= max(1, np.ceil(lengths.sum() / 1024)) * slack + 1
        for s in range(len(used)):
            o = np.argsort(at[seq == s])
            ends = np.cumsum(lengths[seq == s][o])
            assert (at[seq == s][o] == ends - lengths[seq == s][o]).all()


def test_two_pieces_replace_the_smallest():
    """600 and 400 leave a gap of 24; without 400 there is room for 224 and 200."""
    lengths = np.array([600, 400, 224, 200])
    seq, _ = packing.best_two_fit(lengths)
    assert {tuple(sorted(lengths[seq == s].tolist())) for s in set(seq)} == {(200, 224, 600), (400,)}
