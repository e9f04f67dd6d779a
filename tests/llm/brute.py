"""Plain-Python statements of what the operators return."""

import re
from hashlib import sha256

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(doc_id):
    return (doc_id is not None, doc_id or 0)


def byte_dedup(rows, depth=50):
    """rows: (doc_id, text). Per row: id, bytes, removed, spans, digest."""
    least = {}
    for i, t, *_ in sorted(rows, key=lambda r: key(r[0])):
        b = (t or "").encode()
        for p in range(len(b) - depth + 1):
            least.setdefault(b[p:p + depth], key(i))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if least[b[p:p + depth]] < key(i):
                gone[p:p + depth] = b"\1" * depth
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def word_dedup(rows, window=20):
    """rows: (doc_id, text). Per row: id, words, removed, digest."""
    seen, out = set(), []
    for i, t, *_ in sorted(rows, key=lambda r: (key(r[0]), r[1] or "")):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            if k in seen:
                gone[p:p + window] = [True] * window
            seen.add(k)
        out.append((i, len(w), sum(gone), sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def shingles(text, k=3):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def reach(ids, links):
    """Least id reachable from each id."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def ngram_components(rows, percent=90):
    """rows: (doc_id, text). Per row: id, set size, component."""
    sets = {i: shingles(t) for i, t, *_ in rows}
    owners = {}
    for i, s in sets.items():
        for x in s:
            owners.setdefault(x, []).append(i)
    links = []
    for i, s in sets.items():
        both = {}
        for x in s:
            for j in owners[x]:
                if j < i:
                    both[j] = both.get(j, 0) + 1
        links += [(i, j) for j, n in both.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)]
    root = reach(sets, links)
    return [(i, len(sets[i]), root[i]) for i, *_ in rows]
