"""Substring dedup by collinear chaining: passages that documents share, word for word or with edits.

1. Seeds. Every place of a document has a key of eight words: four, one left out, four more. So a word changed in every
   five hides nothing. Minimizers (of every `window`) of keys of `long` words come beside them, for passages whose short
   phrases stand one by one in other documents. Of words said over and over, only the first and the last turn has keys.
2. Owners. A key's owner is the smallest document id that holds it (its first place there). Every other occurrence is
   matched with the owner's only. So matches are as many as occurrences, however many documents share a passage. Keys
   travel packed, 40 bits and a place, to parts whose number follows from the corpus; a key of the wrong words that
   agrees in those bits comes to nothing in the alignment. A key that many documents of one step hold is matched within
   the step, and one occurrence travels: no task gets all holders of a frequent passage.
3. Chains. The matches of a document with one owner are chained in order of both texts. A match adds its weight, a step
   costs in proportion to the words left out on either side; as that cost is linear, the best predecessor is a prefix
   maximum, which a Fenwick tree over the owner's places gives in logarithmic time.
4. Alignment. Chains are aligned word by word between their matches and outwards as long as words agree, to the ends of
   the texts if need be; what is long and alike enough is a passage. Of a document's passages the fewest that cover all
   words of all of them are returned.

Words are runs of anything but ASCII white space, A-Z in lower case. Defined results: null, empty and short texts have no
passages; rows without a document id take no part and stay as they are; rows with the same document id count as one
document; repeats within one document alone are not passages; other columns stay (drop_passages) or aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, hashed_words, id_and_text, lean, ranges, rolled, ship, steps, written

WORD = re.compile("[^\x20\x09-\x0d]+")
#: Keys that one task holds at a time, about, and the bits of a key that deal them into the shares it compares one by one.
PART_KEYS = 3_000_000
SHARE_BITS = 4
#: Documents of one step (see common.steps) that hold a key before it is matched within the step.
HOT = 8
KEY_BITS = np.uint64((1 << 40) - 1)


@dataclass(frozen=True)
class PassageRules:
    """k words on each side of the word a key leaves out; words of the long keys and their minimizer window; least words
    and least share of equal words of a passage."""

    k: int = 4
    long: int = 20
    window: int = 12
    #: A key that stands again within so many words is one of words said over and over.
    turn: int = 16
    least_words: int = 50
    least_alike: float = 0.8
    #: A match's weight, the cost of each word left out on either side, and the most words between two matches.
    weight: float = 20.0
    gap_cost: float = 0.2
    most_gap: int = 50
    #: Words beyond a chain's ends that its alignment sees at first; where it goes on there it is made anew with 16 times as many.
    reach: int = 64
    #: Outward alignment: a word that differs costs so many equal ones, and ends at so much below the best.
    mismatch: float = 1.5
    drop: float = 8.0


def minimizers(h: np.ndarray, valid: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
    """Places of h that are the least of a window of w valid places; where fewer stand together from a `first` place on,
    of those. After valid places at least w - 1 others follow."""
    n, most = len(h), np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.concatenate((np.where(valid, h, most), np.full(w, most)))
    whole = np.zeros(n, bool)
    whole[: max(0, n - w + 1)] = valid[w - 1 :]
    whole = (whole | first) & valid

    def over(v: np.ndarray, reduce) -> np.ndarray:
        """reduce over the w entries from each on."""
        out, span = v, 1
        while 2 * span <= w:
            out = reduce(out[:-span], out[span:])
            span *= 2
        return reduce(out[: len(v) - w + 1], out[w - span : w - span + len(v) - w + 1])

    least = over(low, np.minimum)[:n]
    # a window's least, brought back to all its places: the greatest of them is reached where a place is the least of one
    back = over(np.concatenate((np.zeros(w - 1, np.uint64), np.where(whole, least, np.uint64(0)))), np.maximum)
    return np.flatnonzero(valid & (h == back))


def seeds_of(words: np.ndarray, starts: np.ndarray, r: PassageRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the keys of several texts, their texts and places; the lowest bit of a hash is set for long keys."""
    one = np.uint64(1)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    left = starts[1:][row] - np.arange(len(row))  # words from here to the text's end
    short = rolled(words, [*range(r.k), *range(r.k + 1, 2 * r.k + 1)]) & ~one
    there = left[: len(short)] > 2 * r.k
    # words said over and over: their keys come at the first and at the last turn only, the alignment goes over the rest
    before, after = np.zeros(len(short), bool), np.zeros(len(short), bool)
    for p in range(1, min(r.turn, len(short) - 1) + 1):
        same = (short[p:] == short[:-p]) & (row[p : len(short)] == row[: len(short) - p]) & there[p:]
        before[p:] |= same
        after[:-p] |= same
    a = np.flatnonzero(there & ~(before & after))
    long = rolled(words, list(range(r.long)))
    b = np.zeros(0, np.int64)
    if len(long):
        n = len(long)
        first = np.zeros(n + 1, bool)
        first[np.minimum(starts[:-1], n)] = True
        b = minimizers(long, left[:n] >= r.long, first[:n], min(r.window, r.long))
    at = np.concatenate((a, b))
    return np.concatenate((short[a], long[b] | one)), row[at], at - starts[row[at]]


def planes(v: np.ndarray, n: int) -> bytes:
    """The n low bytes of each number, all first bytes, then all second ones: what is alike in them compresses."""
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def unplaned(b: bytes, n: int) -> np.ndarray:
    rows = np.zeros((len(b) // n, 8), np.uint8)
    rows[:, :n] = np.frombuffer(b, np.uint8).reshape(n, -1).T
    return rows.view("<u8").ravel()


#: A cell: part, keys, places; ids and how many keys each has. Of matches made already: keys, both places, both ids, none.
CELL = ["part", "keys", "at", "ids", "n"]


def met(keys: np.ndarray, docs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, owner, place, the owner's place, key of all occurrences in other documents than the key's owner."""
    order = np.argsort(keys)
    s = keys[order]
    same = s[1:] == s[:-1]
    order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    order = order[np.lexsort((at[order], docs[order], keys[order]))]
    k, d, p = keys[order], docs[order], at[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    owner = np.repeat(first, np.diff(np.append(first, len(k))))
    other = d != d[owner]
    return d[other], d[owner][other], p[other], p[owner][other], k[other]


def met_in_shares(held: list[list[np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
    """met over keys, docs and places that came in pieces (which are used up), a share of the keys at a time: what the
    comparison makes on its way, several times the keys where most are held by many documents, is of one share only."""
    keys, docs, at = (np.concatenate(held.pop(0)) for _ in range(3))
    share = (keys >> np.uint64(40 - SHARE_BITS)).astype(np.uint8)
    for i in range(1 << SHARE_BITS):
        own = np.flatnonzero(share == i)
        if len(own):
            yield met(keys[own], docs[own], at[own])


def combined(keys: np.ndarray, docs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Which occurrences still have to travel, and the matches made here: a key that HOT documents of one step hold is
    matched with the smallest of them at once, and only that one's occurrence goes on. So however many documents hold a
    passage, a task gets few rows of each step of it; a later document's source is then an earlier one, not always the
    earliest."""
    bucket = (keys >> np.uint64(20)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(bucket, minlength=1 << 20)[bucket] >= HOT)
    k, d = keys[maybe], docs[maybe]
    order = maybe[np.lexsort((at[maybe], d, k))]
    k, d, x = keys[order], docs[order], at[order]
    rest = np.ones(len(keys), bool)
    if not len(k):
        return rest, (d, d, x, x, k)
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    size = np.diff(np.append(first, len(k)))
    holders = np.add.reduceat(np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]))).astype(np.int64), first)
    owner, hot = np.repeat(first, size), np.repeat(holders >= HOT, size)
    rest[order[hot & (np.arange(len(k)) != owner)]] = False
    other = hot & (d != d[owner])
    return rest, (d[other], d[owner][other], x[other], x[owner][other], k[other])


def matches_of(docs: DataFrame, r: PassageRules) -> tuple[DataFrame, int]:
    """doc_id, owner, at, owner_at, step: places where two documents hold a key; its last k words begin `step` later. And
    how many parts the corpus makes, none with more matches than PART_KEYS or so."""
    ship(docs.sparkSession)
    texts = id_and_text(docs).filter("doc_id is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (5 * PART_KEYS)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for b in steps(batches, "text"):
            h, row, at = seeds_of(*hashed_words(b.column(1)), r)
            ids = np.asarray(b.column(0)).astype(np.int64)
            rest, local = combined(h & KEY_BITS, ids[row], at)
            h, row, at = h[rest], row[rest], at[rest]
            part = ((h >> np.uint64(40)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
            order = np.argsort(row.astype(np.uint16) if len(ids) < 1 << 16 else row, kind="stable")
            order = order[np.argsort(part[order], kind="stable")]
            h, at, row = h[order], at[order], row[order]
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            there = np.flatnonzero(np.diff(bounds))
            cells: list[list] = [[], [], [], []]
            for p in there.tolist():
                x = slice(bounds[p], bounds[p + 1])
                rows, n = np.unique(row[x], return_counts=True)
                for c, v in zip(cells, (planes(h[x], 5), planes(at[x], 4), ids[rows].astype("<i8").tobytes(), n.astype("<i4").tobytes())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), *(pa.array(c, pa.binary()) for c in cells)], names=CELL)
            if len(local[0]):
                turn += 1
                yield pa.RecordBatch.from_arrays([pa.array([turn % parts], pa.int32()), *(pa.array([x], pa.binary()) for x in (planes(local[4], 5), planes(np.concatenate(local[2:4]), 4), np.concatenate(local[:2]).astype("<i8").tobytes(), b""))], names=CELL)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: int | None = None
        held: list[list[np.ndarray]] = [[], [], []]

        def rows_of(d: np.ndarray, o: np.ndarray, x: np.ndarray, y: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
            step = np.where(k & np.uint64(1), r.long - r.k, r.k + 1)
            for i in range(0, len(d), 1 << 18):
                cut = slice(i, i + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(d[cut]), pa.array(o[cut]), *(pa.array(v[cut].astype(np.int32)) for v in (x, y, step))], names=["doc_id", "owner", "at", "owner_at", "step"])

        def done() -> Iterator[pa.RecordBatch]:
            if held[0]:
                for found in met_in_shares(held):
                    yield from rows_of(*found)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != part:
                    yield from done()
                    part, held = row[0], [[], [], []]
                if not row[4]:  # matches made where the texts were read
                    k, at, ids = unplaned(row[1], 5), unplaned(row[2], 4).astype(np.int64), np.frombuffer(row[3], "<i8")
                    yield from rows_of(ids[: len(k)], ids[len(k) :], at[: len(k)], at[len(k) :], k)
                    continue
                ids = np.repeat(np.frombuffer(row[3], "<i8"), np.frombuffer(row[4], "<i4"))
                for c, v in zip(held, (unplaned(row[1], 5), ids, unplaned(row[2], 4).astype(np.int32))):
                    c.append(v)
        yield from done()

    dealt = texts.mapInArrow(lean(deal), "part int, keys binary, at binary, ids binary, n binary")
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(lean(meet), "doc_id long, owner long, at int, owner_at int, step int"), parts


def thinned(group: np.ndarray, x: np.ndarray, y: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, ...]:
    """group, x, y, run of the distinct matches of k words in order of group and diagonal: of each run along one diagonal
    the first, the last and every eighth place (the alignment compares all words between two matches anyway)."""
    g, d, x = np.concatenate((group, group)), np.concatenate((x - y, x - y)), np.concatenate((x, x + step))
    order = np.lexsort((x, d, g))
    g, d, x = g[order], d[order], x[order]
    other = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])))
    new = other | np.concatenate(([True], x[1:] != x[:-1]))
    g, d, x, other = g[new], d[new], x[new], other[new]
    begins = other | np.concatenate(([True], np.diff(x) != 1))
    keep = begins | np.append(begins[1:], True) | (x % 8 == 0)
    return g[keep], x[keep], x[keep] - d[keep], np.cumsum(begins)[keep]


def chained(doc: np.ndarray, owner: np.ndarray, x: np.ndarray, y: np.ndarray, step: np.ndarray, r: PassageRules) -> tuple[np.ndarray, ...]:
    """doc, owner, where each chain's matches begin (one more at the end), and the matches x, y of all chains. The rows
    come sorted by document and owner. Matches of a pair on one diagonal are a chain as they are (a step within most_gap
    costs no more than a match weighs), the others are chained by the tree."""
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1])))
    at = np.flatnonzero(new)
    g, x, y, run = thinned(np.cumsum(new) - 1, x, y, step)
    bounds = np.searchsorted(g, np.arange(len(at) + 1))
    d = x - y
    crooked = d[bounds[:-1]] != d[bounds[1:] - 1]
    straight = ~crooked[g]
    sx, sy, sg, sr = x[straight], y[straight], g[straight], run[straight]
    cut = np.concatenate(([True], (sg[1:] != sg[:-1]) | (np.diff(sx) > r.most_gap))) if len(sx) else np.zeros(0, bool)
    xs, ys, runs, of, lens = [sx], [sy], [sr], [sg[cut]], [np.diff(np.append(np.flatnonzero(cut), len(sx)))]
    for i in np.flatnonzero(crooked).tolist():
        own = slice(bounds[i], bounds[i + 1])
        inside, own_lens = chain_indices(x[own], y[own], r)
        inside += bounds[i]
        xs.append(x[inside])
        ys.append(y[inside])
        runs.append(run[inside])
        of.append(np.full(len(own_lens), i))
        lens.append(own_lens)
    of, lens = np.concatenate(of).astype(np.int64), np.concatenate(lens).astype(np.int64)
    keep, starts = needed(doc[at][of], owner[at][of], np.concatenate(xs), np.concatenate(ys), np.concatenate(runs), lens, r)
    xs, ys = (np.concatenate(v)[ranges(starts[:-1][keep], lens[keep])] for v in (xs, ys))
    return doc[at][of[keep]], owner[at][of[keep]], np.concatenate(([0], np.cumsum(lens[keep]))), xs, ys


def needed(doc: np.ndarray, owner: np.ndarray, x: np.ndarray, y: np.ndarray, run: np.ndarray, lens: np.ndarray, r: PassageRules) -> tuple[np.ndarray, np.ndarray]:
    """Which chains are aligned, in order of documents, and where each begins. Of a document's chains that are passages by
    their matches alone (sure) a least cover is, and no other whose stretch lies within a sure one: so copies of copies
    don't report a stretch once for each. Of several chains that hold nearly the same stretch of one owner at places that
    overlap, as a text that repeats a few words over and over has them at every turn, a least cover is aligned too."""
    starts = np.concatenate(([0], np.cumsum(lens)))
    a, z = starts[:-1], starts[1:] - 1
    gap = np.minimum(np.diff(x), np.diff(y))
    equal = np.concatenate(([0], np.cumsum(np.where(np.diff(run) == 0, gap, np.minimum(gap, r.k)))))
    x0, x1, y0, y1 = x[a], x[z] + r.k, y[a], y[z] + r.k
    sure = (x1 - x0 >= r.least_words) & (equal[z] - equal[a] + r.k >= r.least_alike * np.maximum(x1 - x0, y1 - y0))
    # a chain has a whole key at least: no more, as edits may take up the rest of a passage; half a key is another's rest
    order = np.flatnonzero(x1 - x0 > 2 * r.k)
    order = order[np.lexsort((x0[order], doc[order]))]
    cuts = np.flatnonzero(np.diff(doc[order])) + 1
    alone = np.diff(np.concatenate(([0], cuts, [len(order)]))) == 1 if len(order) else np.zeros(0, bool)
    kept = [order[np.concatenate(([0], cuts))[alone]]] if len(order) else []
    for own in (c for c, one in zip(np.split(order, cuts), alone) if not one):
        mine = own[sure[own]]
        mine = mine[least_cover(x0[mine], x1[mine])]
        rest = own[~sure[own]]
        if len(mine):  # their ends rise with their begins
            last = np.searchsorted(x0[mine], x0[rest], side="right") - 1
            rest = rest[(last < 0) | (x1[mine][last] < x1[rest])]
        kept.append(mine)
        rest = rest[np.lexsort((y0[rest], owner[rest]))]
        if len(rest):
            apart = np.flatnonzero((np.diff(owner[rest]) != 0) | (np.diff(y0[rest]) > r.k)) + 1
            for near in np.split(rest, apart):
                near = near[np.argsort(x0[near], kind="stable")]
                kept.append(near[least_cover(x0[near], x1[near])])
    keep = np.concatenate(kept).astype(np.int64) if kept else np.zeros(0, np.int64)
    return keep[np.argsort(doc[keep], kind="stable")], starts


def least_cover(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places of the fewest of the stretches (sorted by begin) that cover all that any covers; both ends rise in them."""
    out: list[int] = []
    i, n, covered = 0, len(begin), -1
    while i < n:
        if begin[i] > covered:  # a gap: the next group
            covered = begin[i]
        best = -1
        while i < n and begin[i] <= covered:
            if end[i] > (end[best] if best >= 0 else covered):
                best = i
            i += 1
        if best >= 0:
            out.append(best)
            covered = end[best]
    return np.array(out, np.int64)


def chains_of(x: np.ndarray, y: np.ndarray, r: PassageRules) -> list[np.ndarray]:
    """Chains (places in x and y, rising in both) of one pair of documents, best first; each match is in one chain."""
    at, lens = chain_indices(x, y, r)
    return [np.stack((x[own], y[own])) for own in np.split(at, np.cumsum(lens)[:-1])]


def chain_indices(x: np.ndarray, y: np.ndarray, r: PassageRules) -> tuple[np.ndarray, list[int]]:
    """The chains' matches as indices of x and y, one chain after the other, and the chains' lengths."""
    order = np.lexsort((-y, x))
    xs, ys = x[order].tolist(), y[order].tolist()
    ranks = (np.unique(y, return_inverse=True)[1][order] + 1).tolist()
    n, top = len(xs), max(ranks)
    tree, who = [-np.inf] * (top + 1), [-1] * (top + 1)
    score, before = [0.0] * n, [-1] * n
    for i in range(n):
        k, best, j = ranks[i] - 1, -np.inf, -1
        while k > 0:
            if tree[k] > best:
                best, j = tree[k], who[k]
            k &= k - 1
        cost = r.gap_cost * (xs[i] + ys[i])
        gain = best - cost
        score[i] = r.weight + max(0.0, gain)
        if gain > 0:
            before[i] = j
        value, k = score[i] + cost, ranks[i]
        while k <= top:
            if value > tree[k]:
                tree[k], who[k] = value, i
            k += k & -k
    used, out, lens = bytearray(n), [], []
    for i in sorted(range(n), key=score.__getitem__, reverse=True):
        chain, last = [], -1
        while i >= 0 and not used[i]:
            if last >= 0 and (xs[last] - xs[i] > r.most_gap or ys[last] - ys[i] > r.most_gap):
                out += chain[::-1]
                lens.append(len(chain))
                chain = []
            used[i] = 1
            chain.append(i)
            last, i = i, before[i]
        if chain:
            out += chain[::-1]
            lens.append(len(chain))
    return order[out], lens


def outward(a: np.ndarray, b: np.ndarray, r: PassageRules) -> tuple[int, bool]:
    """How many words of a and b go on alike from their beginnings; whether that was still open where one of them ended."""
    n = min(len(a), len(b))
    if not n:
        return 0, True
    total = np.cumsum(np.where(a[:n] == b[:n], 1.0, -r.mismatch))
    best = np.maximum(np.maximum.accumulate(total), 0)
    stop = np.flatnonzero(best - total > r.drop)
    upto = int(stop[0]) if len(stop) else n
    if not upto:
        return 0, False
    k = int(np.argmax(total[:upto]))
    return (k + 1 if total[k] > 0 else 0), not len(stop)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence of two short gaps."""
    if len(a) == len(b):
        same = int((a == b).sum())
        if same >= len(a) - 1:
            return same
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        new = row.copy()
        new[1:] = np.maximum(row[1:], row[:-1] + (b == w))
        row = np.maximum.accumulate(new)
    return int(row[-1])


def aligned(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, r: PassageRules) -> tuple[int, int, int, int, int, bool, bool]:
    """Begin and end in a, begin and end in b, and equal words, of the passage around the matches x, y; whether its left
    and its right end might lie beyond a and b."""
    same, turns = r.k, np.flatnonzero(np.diff(x - y))
    for i, j in zip([0, *(turns + 1).tolist()], [*turns.tolist(), len(x) - 1]):  # stretches along one diagonal
        same += int((a[x[i] : x[j]] == b[y[i] : y[j]]).sum())
        if j + 1 < len(x):
            same += common(a[x[j] : x[j + 1]], b[y[j] : y[j + 1]])
    inner = int(x[0]), int(x[-1]) + r.k, int(y[0]), int(y[-1]) + r.k, same
    left, on_left = outward(a[: x[0]][::-1], b[: y[0]][::-1], r)
    right, on_right = outward(a[x[-1] + r.k :], b[y[-1] + r.k :], r)
    x0, x1, y0, y1 = int(x[0]) - left, int(x[-1]) + r.k + right, int(y[0]) - left, int(y[-1]) + r.k + right
    same += int((a[x0 : x[0]] == b[y0 : y[0]]).sum()) + int((a[x[-1] + r.k : x1] == b[y[-1] + r.k : y1]).sum())
    alike = lambda p: p[1] - p[0] >= r.least_words and p[4] >= r.least_alike * max(p[1] - p[0], p[3] - p[2])
    whole = x0, x1, y0, y1, same
    return *(inner if alike(inner) and not alike(whole) else whole), on_left, on_right


def passages(docs: DataFrame, rules: PassageRules | None = None) -> DataFrame:
    """doc_id, begin, end (words, end excluded), source_id, source_begin, source_end, equal_words: each passage of a
    document that an earlier document (smaller id) has too."""
    r = rules or PassageRules()
    matches, parts = matches_of(docs, r)
    # chaining is heavy for its few bytes, so partitions aren't merged by size
    parts = max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = matches.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "owner", "at")
    chain_schema = pa.schema([("doc_id", pa.int64()), ("owner", pa.int64()), ("x", pa.list_(pa.int32())), ("y", pa.list_(pa.int32()))])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def done(cols: list[np.ndarray]) -> pa.RecordBatch:
            d, o, at, x, y = chained(*cols, r)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v.astype(np.int32))) for v in (x, y)]
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(o), *lists], schema=chain_schema)

        for b in batches:
            cols = [np.asarray(c, np.int64) for c in b.columns]
            if rest is not None:
                cols = [np.concatenate(p) for p in zip(rest, cols)]
            last = np.flatnonzero(cols[0] != cols[0][-1]) if len(cols[0]) else []
            at = int(last[-1]) + 1 if len(last) else 0  # the last document may go on in the next batch
            if at:
                yield done([c[:at] for c in cols])
            rest = [c[at:] for c in cols]
        if rest is not None and len(rest[0]):
            yield done(rest)

    chains = written(dealt.mapInArrow(lean(chain), "doc_id long, owner long, x array<int>, y array<int>"), "chains")
    # the words of documents that a chain concerns, as hashes; the slices around a chain are cut before they move on
    concerned = written(chains.select("doc_id").union(chains.select("owner")).distinct().withColumnRenamed("doc_id", "id"), "concerned")
    texts = id_and_text(docs).withColumnRenamed("doc_id", "id").join(few(concerned), "id", "left_semi")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            h, at = hashed_words(b.column(1))
            cells = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), cells], names=["id", "words"])

    hashes = written(texts.mapInArrow(lean(hashed), "id long, words array<int>"), "words")
    words = hashes
    found, left, reach = None, chains, r.reach
    while True:
        tried = written(_aligned(left, words, r, reach), "aligned")
        ended = tried.filter("not more").select(*FOUND)
        found = ended if found is None else found.union(ended)
        left = tried.filter("more").select("doc_id", F.col("source_id").alias("owner"), "x", "y")
        again = written(left.select("doc_id").union(left.select("owner")).distinct().withColumnRenamed("doc_id", "id"), "concerned")
        if again.isEmpty():
            break
        reach *= 16
        words = hashes.join(few(again), "id", "left_semi")  # only the words of what is made anew travel
    found = found.filter(f"end - begin >= {r.least_words}")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The fewest of each document's passages that cover all of them; of equal ones that of the smallest source."""
        held: list[pa.RecordBatch] = []

        def of(t: pa.Table) -> list[pa.RecordBatch]:
            doc, begin, end = (np.asarray(t[c]) for c in ("doc_id", "begin", "end"))
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]))
            kept = [a + least_cover(begin[a:z], end[a:z]) if z - a > 1 else [a] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            return t.take(pa.array(np.concatenate(kept).astype(np.int64))).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            doc = np.asarray(b.column(0))
            last = np.flatnonzero(doc != doc[-1])
            at = int(last[-1]) + 1 if len(last) else 0
            if at or held and held[-1].column(0)[-1].as_py() != doc[0]:
                yield from of(pa.Table.from_batches([*held, b.slice(0, at)]))
                held = []
            held.append(b.slice(at))
        if held:
            yield from of(pa.Table.from_batches(held))

    dealt = found.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "begin", "source_id", "source_begin")
    return dealt.mapInArrow(lean(once), FOUND_TYPES)


FOUND = ["doc_id", "begin", "end", "source_id", "source_begin", "source_end", "equal_words"]
FOUND_TYPES = ", ".join(f"{n} long" for n in FOUND)


def _aligned(chains: DataFrame, words: DataFrame, r: PassageRules, reach: int) -> DataFrame:
    """The chains' passages (FOUND; those that are none are left out), each with `more` and its matches x, y if the alignment
    was still going on where the words of `reach` around the chain ended, but the text didn't."""

    def around(side: str, name: str):
        begin = F.greatest(F.lit(0), F.get(F.col(side), F.lit(0)) - reach)
        end = F.element_at(F.col(side), -1) + r.k + reach
        return begin.alias(f"{name}_from"), F.slice("words", begin + 1, end - begin).alias(name), F.size("words").alias(f"{name}_words")

    one = chains.join(words, chains["doc_id"] == words["id"]).select("doc_id", "owner", "x", "y", *around("x", "a"))
    one = written(one, "chains")
    two = one.join(words, one["owner"] == words["id"]).select(*one.columns, *around("y", "b"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            cols = {n: b.column(n) for n in ("x", "y", "a", "b")}
            offsets = {n: np.asarray(c.offsets) for n, c in cols.items()}
            values = {n: np.asarray(c.values) for n, c in cols.items()}
            plain = {n: b.column(n).to_pylist() for n in ("doc_id", "owner", "a_from", "b_from", "a_words", "b_words")}
            for i in range(b.num_rows):
                x, y, a, c = (values[n][offsets[n][i] : offsets[n][i + 1]] for n in ("x", "y", "a", "b"))
                fx, fy = plain["a_from"][i], plain["b_from"][i]
                if x[-1] - fx + r.k > len(a) or y[-1] - fy + r.k > len(c):
                    continue  # another row with the same document id
                x0, x1, y0, y1, same, on_left, on_right = aligned(a, c, x - fx, y - fy, r)
                # the slices end `reach` words out, or where a text does
                more = on_left and min(x[0], y[0]) > reach
                more = more or on_right and min(plain["a_words"][i] - x[-1], plain["b_words"][i] - y[-1]) - r.k > reach
                if more or x1 - x0 >= r.least_words and same >= r.least_alike * max(x1 - x0, y1 - y0):
                    rows.append((plain["doc_id"][i], x0 + fx, x1 + fx, plain["owner"][i], y0 + fy, y1 + fy, same, bool(more), x if more else None, y if more else None))
            types = [pa.int64()] * 7 + [pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [[]] * 10, types)], names=[*FOUND, "more", "x", "y"])

    return two.mapInArrow(lean(align), FOUND_TYPES + ", more boolean, x array<int>, y array<int>")


def drop_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the passages in `found`: the words go with the white space after them; all else stays as it is."""
    names = docs.columns
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("begin", "end")).alias("__spans")).withColumnRenamed("doc_id", "__doc")
    joined = docs.join(spans, docs["doc_id"] == spans["__doc"], "left").select(*[docs[c] for c in names], "__spans")
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            texts, spans = b.column("text").to_pylist(), b.column("__spans")
            for i in range(b.num_rows):
                if spans[i].is_valid and texts[i]:
                    at = [m.start() for m in WORD.finditer(texts[i])] + [len(texts[i])]
                    kept, done = [], 0
                    for s in sorted(spans[i].as_py(), key=lambda s: s["begin"]):
                        a, z = at[min(s["begin"], len(at) - 1)], at[min(s["end"], len(at) - 1)]
                        kept.append(texts[i][done : max(a, done)])
                        done = max(done, z)
                    texts[i] = "".join(kept) + texts[i][done:]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names], names=names)

    return joined.mapInArrow(lean(cut), types)
