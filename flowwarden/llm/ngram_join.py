"""N-gram Jaccard join by universe partitions.

A document's set is its distinct word n-grams, hashed. Sets that link differ in
few members for their sizes: with Jaccard similarity ``t`` at most
``(1 - t) / (1 + t)`` of the sum of both sizes. The universe is hashed into
segments; a scheme has so many segments that two linked sets agree wholly in one
of its subset segments or differ by one member at most in one of its deletion
segments (pigeonhole). Sizes fall into bands as wide as ``1 / t``; a scheme serves
a band and the one below it. How many segments of either kind a scheme has is
decided by cost: signatures written, and chance partners at the band's count.

Equal sets are joined as one. Signatures that no other document has are found
without rows per signature (``firstseen``); documents that share one are
verified on whole sets against a centre of each signature's group. Documents of a
group that then are in different components are joined again by what they differ
in from the centre, in which linked ones must agree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .firstseen import CHUNK_BYTES, Keys, chunked, in_order, in_steps, top_bits
from .mixing import WORD
from .tables import trimmed, written
from .text import LOWER, WORDS, Slice, column_bytes, mix, windows_in_rows, word_hashes

NGRAM = 3
PERCENT = 90
#: Spare segments as a share of the differences allowed.
SPARE = 0.3
#: Cost of one chance partner in signatures.
PARTNER = 4.0
#: Mean bytes of the sets that meet their centre in one group.
GROUP_BYTES = 4 << 20
_OTHER = np.uint64(0x8CB92BA72F3D8DD7)


@dataclass
class Schemes:
    """``start[k]`` is the least size in band k; ``subset`` and ``deletion`` count
    the segments of each scheme, ``spare`` the subset segments beyond the
    pigeonhole's: so many signatures a set can leave out."""

    start: np.ndarray
    subset: np.ndarray
    deletion: np.ndarray
    spare: np.ndarray

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, n, "right") - 1


def differing(size_sum: int, percent: int = PERCENT) -> int:
    """Most members that may be in one of two linked sets only."""
    return size_sum * (100 - percent) // (100 + percent)


def least_spare(h: int) -> list[int]:
    """Numbers of spare segments to choose from: a share of the differences
    allowed for signatures of common passages, and more for empty ones."""
    z = int(SPARE * h) + 4 if h > 1 else 0
    return [z, *(z + k for k in (2, 4, 8, 16, 32) if z)]


def allocate(size: int, h: int, count: int) -> tuple[int, int, int]:
    """Subset, deletion and spare segments of least cost for sets of about
    ``size``, of which there are ``count``, that may differ in ``h`` members.

    Chance partners mostly agree in empty segments and in those of a common
    passage. Spare segments let each set leave out half as many signatures, the
    empty and most frequent ones in one order of all signatures; linked sets then
    still agree in the other half of the spare ones and one more (a prefix filter),
    and a set that shares fewer has no partner."""
    def cost(at: tuple[int, int]) -> float:
        d, spare = at
        s = max(0, h + 1 + spare - 2 * d)
        load = size / max(1, s + d)
        empty = s * math.exp(-load)
        term, more = math.exp(-empty), 1.0  # more: that a set has more empty segments than spare ones
        for k in range(spare + 1):
            more -= term
            term *= empty / (k + 1)
        chance = s * math.exp(-2 * load) * max(more, 0.0) + d * ((1 + load) * math.exp(-load)) ** 2
        return s + d * (1 + load) + PARTNER * count * chance / 2
    most = (h + 2) // 2
    deletions = {*range(0, min(most, 8) + 1), *np.linspace(0, most, 9).astype(int).tolist()}
    d, spare = min(((d, z) for d in sorted(deletions) for z in least_spare(h)), key=cost)
    return max(0, h + 1 + spare - 2 * d), d, spare


def schemes(largest: int, counts: dict[int, int], percent: int = PERCENT) -> Schemes:
    start = [1]
    while start[-1] <= largest:
        start.append(max(start[-1] + 1, -(-start[-1] * 100 // percent)))
    start.append(max(start[-1] + 1, -(-start[-1] * 100 // percent)))
    sizes = np.array(sorted(counts) or [1])
    number = np.array([counts[n] for n in sizes] if counts else [0])
    found = []
    for lo, hi, below in zip(start[:-1], start[1:], [1, *start[:-2]]):
        many = int(number[(sizes >= below) & (sizes < hi)].sum())
        found.append(allocate(lo, differing(2 * (hi - 1), percent), many))
    return Schemes(np.array(start[:-1]), *(np.array(x) for x in zip(*found)))


class _Sets:
    """The distinct n-grams of a chunk's documents."""

    def __init__(self, t: pa.Table, ngram: int):
        self.rows, self.ids = in_order(t)
        data, off = column_bytes(self.rows.column("text"))
        s, e, bounds = Slice(data, off, 0).words()
        run = WORDS.running(word_hashes(LOWER[data], s, e))
        starts, rows = windows_in_rows(bounds, ngram)
        member = [WORDS.windows(run, ngram)[starts]]
        owner = [rows]
        for k in range(1, ngram):  # shorter texts are one member as a whole
            short = np.flatnonzero(np.diff(bounds) == k)
            if len(short):
                member.append(mix(WORDS.windows(run, k)[bounds[short]] + np.uint64(k)))
                owner.append(short)
        member, owner = np.concatenate(member), np.concatenate(owner)
        order = np.lexsort((member, owner))
        member, owner = member[order], owner[order]
        new = np.ones(len(member), bool)
        new[1:] = (member[1:] != member[:-1]) | (owner[1:] != owner[:-1])
        self.member, self.owner = member[new], owner[new]
        self.size = np.bincount(self.owner, minlength=len(self.ids))
        self.bounds = np.concatenate([[0], np.cumsum(self.size)])
        self.key, self.key2 = (self.total(mix(self.member + c)) for c in (np.uint64(1), _OTHER))
        known = self.rows.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        self.some = np.flatnonzero((self.size > 0) & known)  # a null id joins nothing and stands for no other

    def total(self, x: np.ndarray) -> np.ndarray:
        run = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=run[1:])
        return run[self.bounds[1:]] - run[self.bounds[:-1]]

    def set_keys(self, buckets: int) -> Keys:
        return Keys(top_bits(mix(self.key2[self.some]), buckets)[0], self.key[self.some])

    def firsts(self, answers: pa.Table, buckets: int) -> np.ndarray:
        """Rows with an id and members whose set is in no smaller document."""
        k = self.set_keys(buckets)
        again = k.answered(answers, 1)[k.of] | (k.first[k.of] != np.arange(len(self.some)))
        return self.some[~again]

    def signatures(self, rows: np.ndarray, by: Schemes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Signatures of some rows, the row of each, and its use: twice the row, and
        one more for the second scheme, if it is a subset segment's, else -1. By
        use, how many more segments can be left out, and in how many of the rest
        linked sets agree at least."""
        use = np.zeros(len(self.ids), bool)
        use[rows] = True
        at = use[self.owner]
        member, owner = self.member[at], self.owner[at]
        weight = mix(member ^ _OTHER)
        band = by.band(np.maximum(self.size, 1))
        found, of, use_of = [], [], []
        left, need = np.zeros(2 * len(self.ids), int), np.ones(2 * len(self.ids), int)
        for second, scheme in enumerate((band, band + 1)):
            subset, deletion = by.subset[scheme], by.deletion[scheme]
            segments = np.where(use, subset + deletion, 0)
            base = np.cumsum(segments) - segments
            seg = ((member >> np.uint64(32)) * segments[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(int(segments.sum()), np.uint64)
            np.add.at(sums, base[owner] + seg, weight)
            row = np.repeat(np.arange(len(segments)), segments)
            number = np.arange(len(sums)) - base[row]
            salt = mix((scheme[row].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64) + np.uint64(1))
            empty = np.bincount(base[owner] + seg, minlength=len(sums)) == 0
            empty &= number >= deletion[row]
            spare = by.spare[scheme] - np.bincount(row[empty], minlength=len(segments))
            # half of the spare ones go, the empty ones first; the other half are agreements more
            half, out = by.spare[scheme] // 2, by.spare[scheme] - spare
            left[second::2] = np.where(use & (spare >= 0), np.maximum(half - out, 0), 0)
            need[second::2] = np.where(use & (spare >= 0) & (deletion == 0), by.spare[scheme] + 1 - np.maximum(half, out), 1)
            write = ~(empty & (spare >= 0)[row])
            found.append(mix(sums + salt)[write])
            of.append(row[write])
            use_of.append(np.where(number >= deletion[row], 2 * row + second, -1)[write])
            one_less = seg < deletion[owner]
            place = (base[owner] + seg)[one_less]
            found.append(mix(sums[place] - weight[one_less] + salt[place]))
            of.append(owner[one_less])
            use_of.append(np.full(int(one_less.sum()), -1))
        return np.concatenate(found), np.concatenate(of), np.concatenate(use_of), left, need


SETS = "doc_id long, n int, key long, key2 long, signatures array<struct<signature:long,scheme:int,spare:int,need:int>>, members binary"


def _at_centre(pairs: DataFrame, sets: DataFrame, run, schema: str, orders: DataFrame | None = None) -> DataFrame:
    """``run(own, ids, parts, table)`` for each centre a of ``pairs`` (a, b, n, ...):
    the sets of all b, n members each, travel to a in salted groups of about
    ``GROUP_BYTES`` that each hold a's set (and its row of ``orders``) once."""
    many = pairs.groupBy("a").agg(F.ceil(F.sum("n") * 8 / GROUP_BYTES).cast("int").alias("groups"))
    salted = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("groups")))
    centre = salted.select("a", "salt", "groups", F.col("a").alias("b")).distinct()
    if orders is not None:
        centre = centre.join(orders, "a", "left")
    rows = salted.unionByName(centre, allowMissingColumns=True).join(sets.select(F.col("doc_id").alias("b"), "members"), "b")

    def group(t: pa.Table) -> pa.Table:
        a, ids = t.column("a")[0].as_py(), t.column("b").to_numpy()
        parts = [np.frombuffer(x.as_buffer(), "<u8") for x in t.column("members")]
        out = run(a, next(p for p, i in zip(parts, ids) if i == a), ids, parts, t)
        del parts, t
        return trimmed(out)

    return rows.groupBy("a", "salt").applyInArrow(group, schema)


def _slots(members: np.ndarray, size: int) -> np.ndarray:
    """Places of members in a centre's table of counts of a size, a power of two."""
    return (mix(members) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _apart(own: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Members in which each part differs from ``own``, and how many each has."""
    found, n = [], np.zeros(len(parts), np.int64)
    for i, x in enumerate(parts):
        place = np.minimum(np.searchsorted(own, x), len(own) - 1)
        common = own[place] == x
        lost = np.ones(len(own), bool)
        lost[place[common]] = False
        found += [x[~common], own[lost]]
        n[i] = len(found[-1]) + len(found[-2])
    return np.concatenate(found), n


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, count: bool = False) -> DataFrame:
    """Pairs (a, b) that link, with their whole sets compared. With ``count``, a row
    (a, null, counts) for each group of a centre that has several: how many of the
    group's documents differ from the centre in the members of each slot."""
    def run(a: int, own: np.ndarray, ids: np.ndarray, parts: list[np.ndarray], t: pa.Table) -> pa.Table:
        n = np.array([len(p) for p in parts])
        both = np.array([np.count_nonzero(own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x) for x in parts])
        good = (100 * both >= percent * (n + len(own) - both)) & (ids != a)
        b, counts, groups = ids[good].tolist(), [None] * int(good.sum()), t.column("groups")[0].as_py()
        if count and groups > 1:
            size = 1 << min(18, 12 + (groups - 1).bit_length())
            b, counts = [*b, None], [*counts, np.bincount(_slots(_apart(own, parts)[0], size), minlength=size)]
        return pa.table({"a": pa.array([a] * len(b), pa.int64()), "b": pa.array(b, pa.int64()), "counts": pa.array(counts, pa.list_(pa.int64()))})

    return _at_centre(pairs, sets, run, "a long, b long, counts array<long>")


def _orders(verified: DataFrame) -> DataFrame:
    """(a, size, slots, counts): the counts of all groups of a centre, by slot."""
    slots = verified.filter("b IS NULL").select("a", F.size("counts").alias("size"), F.posexplode("counts").alias("slot", "rows")).filter("rows > 0")
    slots = slots.groupBy("a", "size", "slot").agg(F.sum("rows").alias("rows"))
    return (slots.groupBy("a", "size").agg(F.collect_list(F.struct("slot", "rows")).alias("o"))
            .select("a", "size", F.col("o.slot").alias("slots"), F.col("o.rows").alias("counts")))


def _differences(pairs: DataFrame, sets: DataFrame, orders: DataFrame, percent: int) -> DataFrame:
    """(a, b, n, component, probe) -> (a, b, n, component, d, place, member, finds):
    members by which b is found, and if ``finds`` also finds, among the documents
    of centre a; b differs from a in ``d`` members, of which it is the one at ``place``.

    Let D be the members in which a document differs from the centre. Two documents
    of different components have one that doesn't link with the centre. If their D
    were disjoint, both would be near enough to link with it; so the D of linked
    ones share members: at least half of what their sizes exceed the allowed
    difference by, and all but the allowed difference. A document thus is found by
    a prefix of its D in any order that all documents of a centre have in common.
    The order is by the number of them that differ in a member: those that no other
    differs in are not written, and those that the centre alone has, or a common
    passage, come last."""
    def run(a: int, own: np.ndarray, ids: np.ndarray, parts: list[np.ndarray], t: pa.Table) -> pa.Table:
        member, d = _apart(own, parts)
        of = np.repeat(np.arange(len(ids)), d)
        at = int(np.flatnonzero(ids == a)[0])
        if t.column("slots")[at].is_valid:
            counts = np.zeros(t.column("size")[at].as_py(), np.int64)
            counts[t.column("slots")[at].values.to_numpy()] = t.column("counts")[at].values.to_numpy()
            rows = counts[_slots(member, len(counts))]
        else:
            _, which, counts = np.unique(member, return_inverse=True, return_counts=True)
            rows = counts[which]
        order = np.lexsort((member, rows, of))
        member, rows = member[order], rows[order]
        place = np.arange(len(member)) - (np.cumsum(d) - d)[of]
        n = np.array([len(x) for x in parts])
        longer = np.maximum(0, n - len(own))
        give = np.where(longer > 0, -(-longer * (100 - percent) // (100 + percent)) + 1, 0)
        near = (n + n * 100 // percent) * (100 - percent) // (100 + percent)  # most that a linked one differs in
        least = np.maximum(1, d - near)
        shared = np.maximum(least, -(-(d + 1 - give) // 2))  # least overlap with a document that doesn't link with a
        probe = t.column("probe").combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
        index, finds = place <= (d - shared)[of], probe[of] & (place <= (d - least)[of])
        keep = np.flatnonzero((rows > 1) & (index | finds))
        of = of[keep]
        return pa.table({"a": pa.array(np.full(len(keep), a), pa.int64()), "b": pa.array(ids[of], pa.int64()), "n": pa.array(n[of], pa.int64()),
                         "component": t.column("component").take(pa.array(of)), "d": pa.array(d[of], pa.int64()), "place": pa.array(place[keep], pa.int64()),
                         "member": pa.array(member[keep].view(np.int64), pa.int64()), "index": pa.array(index[keep]), "finds": pa.array(finds[keep])})

    return _at_centre(pairs, sets, run, "a long, b long, n long, component long, d long, place long, member long, index boolean, finds boolean", orders)


def _may_link(n: str, m: str, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, percent: int = PERCENT,
               chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links,
    itself included) for each row of ``docs``.

    Texts are lower-cased in ASCII. A text of fewer words than ``ngram`` is one
    member as a whole; without words, or a text, the set is empty and links with
    nothing. A null id links with nothing. Ids are expected once; rows that share
    an id are one node. An empty table gives no rows; other columns are not read."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    about = F.greatest(F.lit(1), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) - (ngram - 1))
    # sizes to two digits: some hundred rows however many documents
    digits = F.pow(F.lit(10.0), F.greatest(F.lit(0.0), F.floor(F.log10(about.cast("double"))) - 1))
    counts = {int(r[0]): r[1] for r in d.groupBy((F.floor(about / digits) * digits).cast("long").alias("size")).count().collect()}
    chunks, buckets = chunked(d, "doc_id", "text", chunk_bytes)
    by = schemes(2 * max(counts, default=1) + 20, counts, percent)

    def set_keys(t: pa.Table, answers: pa.Table) -> Keys:
        return _Sets(t, ngram).set_keys(buckets)

    def signature_keys(t: pa.Table, answers: pa.Table) -> Keys:
        x = _Sets(t, ngram)
        return Keys(*top_bits(x.signatures(x.firsts(answers, buckets), by)[0], buckets))

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        x = _Sets(t, ngram)
        rows = x.firsts(answers, buckets)
        signature, of, use, left, need = x.signatures(rows, by)
        k = Keys(*top_bits(signature, buckets))
        lo = np.minimum.reduceat(of[k.order], k.starts) if len(k.starts) else of
        hi = np.maximum.reduceat(of[k.order], k.starts) if len(k.starts) else of
        shared = (k.answered(answers, 2) | (lo != hi))[k.of]
        signature, of, use = signature[shared], of[shared], use[shared]
        # without what goes as most frequent, too few are left for a partner: nothing of this scheme is needed
        enough = np.bincount(use[use >= 0], minlength=len(left)) - left >= need
        some = (use < 0) | enough[use]
        signature, of, use = signature[some], of[some], use[some]
        order = np.lexsort((signature, of))
        cut = np.searchsorted(of[order], np.arange(len(x.ids) + 1))
        use = use[order]
        written_as = pa.StructArray.from_arrays(
            [pa.array(signature[order].view(np.int64)), pa.array(np.where(use < 0, 2, use % 2).astype(np.int32)),
             pa.array(np.where(use < 0, 0, left[use]).astype(np.int32)), pa.array(np.where(use < 0, 1, need[use]).astype(np.int32))],
            ["signature", "scheme", "spare", "need"])
        members = [x.member[x.bounds[i]:x.bounds[i + 1]].tobytes() if cut[i] < cut[i + 1] else None for i in range(len(x.ids))]
        return pa.table({"doc_id": x.rows.column("doc_id"), "n": pa.array(x.size.astype(np.int32)), "key": pa.array(x.key.view(np.int64)),
                         "key2": pa.array(x.key2.view(np.int64)), "signatures": pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), written_as),
                         "members": pa.array(members, pa.binary())})

    found = written(in_steps(chunks, [(set_keys, "<u8", "earlier"), (signature_keys, "<u4", "other")], finish, SETS), "ngram-sets")
    named = found.filter(F.col("doc_id").isNotNull())
    sets = named.filter(F.col("members").isNotNull()).select("doc_id", "n", "members")
    shared = named.select("doc_id", "n", F.inline("signatures"))
    size = shared.groupBy("signature").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    # in one order of all signatures, each set leaves out its most frequent ones, as many as it has spare,
    # and a set that shares fewer of the rest than linked sets agree in has no partner
    own = Window.partitionBy("doc_id", "scheme")
    shared = (shared.join(size, "signature").withColumn("nth", F.row_number().over(own.orderBy(F.desc("rows"), "signature"))).filter("nth > spare")
              .withColumn("have", F.count(F.lit(1)).over(own)).filter("have >= need").select("signature", "doc_id", "n"))
    shared = written(shared, "ngram-shared")
    size = shared.groupBy("signature").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    shared = shared.join(size, "signature")
    # the centre of a group shares its signatures with most documents: an original, rather than its copies
    popular = shared.groupBy("doc_id").agg(F.sum("rows").alias("popular"))
    members = written(shared.join(popular, "doc_id"), "ngram-groups")
    centre = members.groupBy("signature").agg(F.max(F.struct("popular", (-F.col("doc_id")).alias("id"))).alias("c"))
    pairs = written(members.join(centre.select("signature", (-F.col("c.id")).alias("a")), "signature").filter(F.col("a") != F.col("doc_id"))
                    .groupBy("a", F.col("doc_id").alias("b")).agg(F.max("rows").alias("rows"), F.max("n").alias("n")), "ngram-pairs")
    verified = written(_verify(pairs.select("a", "b", "n"), sets, percent, count=True), "ngram-links")
    links = verified.filter("b IS NOT NULL").select("a", "b")
    group = connected_components(links)
    # centres whose documents are in several components: partners may have been missed there
    of = group.select(F.col("node").alias("b"), F.col("component").alias("own"))
    to = group.select(F.col("node").alias("a"), F.col("component").alias("theirs"))
    labelled = (pairs.filter("rows > 2").join(of, "b", "left").join(to, "a", "left")
                .select("a", "b", "n", F.coalesce("own", "b").alias("component"), (F.coalesce("own", "b") != F.coalesce("theirs", "a")).alias("probe")))
    open_centres = labelled.filter("probe").select("a").distinct()
    labelled = written(labelled.join(open_centres, "a"), "ngram-open")
    apart = written(_differences(labelled, sets, _orders(verified), percent), "ngram-apart")
    index = apart.filter("index").select("a", "b", "n", "component", "d", "place", "member")
    probes = apart.filter("finds").select("a", F.col("b").alias("c"), F.col("n").alias("m"), F.col("component").alias("other"), F.col("d").alias("e"), F.col("place").alias("at"), "member")
    # at the first member that both share, enough follow for the overlap they need
    enough = 2 * F.least(F.col("d") - F.col("place"), F.col("e") - F.col("at")) >= F.col("d") + F.col("e") - F.floor((F.col("n") + F.col("m")) * (100 - percent) / (100 + percent))
    rest = (index.join(probes, ["a", "member"]).filter((F.col("b") != F.col("c")) & (F.col("component") != F.col("other")) & _may_link("n", "m", percent) & enough)
            .select(F.least("b", "c").alias("a"), F.greatest("b", "c").alias("b"), F.when(F.col("b") > F.col("c"), F.col("n")).otherwise(F.col("m")).alias("n")).distinct())
    more = written(_verify(rest, sets, percent).select("a", "b"), "ngram-more")
    if not more.isEmpty():
        group = connected_components(links.union(more))
    first = found.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "key", "key2").agg(F.min("doc_id").alias("rep"))
    first = first.join(group, F.col("rep") == F.col("node"), "left").select("n", "key", "key2", F.coalesce("component", "rep").alias("component"))
    return (found.select("doc_id", "n", "key", "key2").join(first, ["n", "key", "key2"], "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")))
