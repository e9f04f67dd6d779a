import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, chunk string, bucket string, rest string, kept string, size string, "
          "copies string, row string, host string, h string, n string, cell string, signature string, component string, label string, `a.b` string")


def make_docs(seed=1, n=60):
    """Rows (doc_id, text, lang, source) with copies, edits, shared passages and
    every edge case the operators define."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, out = prose(60), []
    for i in range(n):
        text = prose(r.choice([3, 15, 40, 90, 200]))
        kind = i % 6
        if kind == 1 and out:
            text = r.choice(out)[1] or ""
        elif kind == 2 and out:
            words = (r.choice(out)[1] or "x").split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            text = " ".join(words)
        elif kind == 3:
            text = f"{text}\n{passage} {prose(5)}"
        elif kind == 4:
            text = f"Ünï {text}\téö\r\n{prose(8)}\n{prose(8)}\n" + "the same line of words again\n" * r.choice([1, 2])
        out.append((i * 7 % 101, text, r.choice(["en", "de", None]), r.choice(["a", "a", "b", "ä", None])))
    out += [(500, None, None, None), (501, "", "en", "a"), (502, " \t\n ", "en", "a"), (503, "One", "en", "b"), (504, "one two", "en", "b"),
            (505, "ONE Two", "en", "c"), (506, "é" * 80, "fr", "a"), (507, "é" * 81, "fr", "a"), (508, "ab" * 200, "en", "z"),
            (509, prose(6000), "en", "a"), (510, ("x y " * 3000) + prose(40), "en", "a"), (511, "12 34 .. !!", "en", "a"),
            (512, passage, "en", "a"), (513, passage, "en", None), (None, passage, "en", "a"), (None, None, None, "a")]
    return out


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with extra columns whose names the operators use."""
    def build(rows):
        return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *["x"] * 15) for r in rows], SCHEMA).repartition(3)
    return build
