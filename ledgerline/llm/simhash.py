"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits have a common variant within r / 2 bits of either. So every different
fingerprint emits all its variants within half the radius, equal variants meet, and colliding pairs are checked.

The variants themselves needn't travel. Their low bits, a linear code, deal them into slices; which flips take a
fingerprint into a slice depends on the fingerprint's own low bits only. So the fingerprints are sent to the slices,
each slice makes just the variants that fall in it, block by block, sorts them, and looks at the ones that repeat. The
shuffle is a small constant times the fingerprints instead of thousands of variants each, memory holds a slice's
fingerprints and one block, and nothing depends on how many copies a document has: equal fingerprints are one.

Several tables (independent fingerprints of a document) raise the recall for similarities whose expected distance is
over the radius. Colliding pairs whose check words are near enough are candidates. A collision group isn't paired all
with all: its first member is paired with all that are near it, the nearest leave, each of the others is paired with the
nearest of those that left, and so on with the next member until none is left. So whoever was near anybody of the group
is in one component with them. A few candidates for each document (see certificate) are then verified by the exact share of
common shingles on Spark. They connect whatever any candidates connect; where verifying leaves such a whole in several
parts, its documents meet in tasks, two bounded sides at a time with their shingles, and each task verifies all candidates
between parts that it finds no link for, and gives only the links that join parts (see between).

Defined results: see near_duplicates and first_of_each; texts of fewer words than a shingle are one shingle; rows with
equal fingerprints are copies; an empty table gives no rows; other columns aren't read or stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ODD, few, give_back, hashed_words, id_and_text, lean, ranges, rolled, ship, steps, written
from .graph import components, forest, spanning


@dataclass(frozen=True)
class SimHash:
    """words: of a shingle; tables fingerprints of `bits` bits each; two link if one of them differs in at most `radius`
    bits (even). Where there are check words of 64 bits, a repeated shingle counts once, those may differ in at most
    `check` bits altogether, and the two sets of shingles must have the given Jaccard similarity."""

    words: int = 5
    tables: int = 24
    bits: int = 40
    radius: int = 4
    check_words: int = 4
    check: int = 58
    #: Members of a collision group that differ from its first in so few check bits leave the group (see above).
    leave: int = 38
    #: Candidates of so few check bits are as good as links, and one path of them between two documents is enough; of the
    #: others a slice keeps `spare` edge-disjoint forests.
    sure: int = 30
    spare: int = 3
    similarity: float = 0.8
    #: Least number of slices each table's variants are dealt into (a power of two); it is raised until a slice's
    #: fingerprints take no more than `held` bytes. A slice gets the fingerprints that have a variant in it: all of them for
    #: up to 4 slices, 34 % of them for 64, 14 % for 256, 2 % for 4096; the fingerprints then travel 22, 37, 79 times.
    slices: int = 2
    held: int = 400 << 20
    #: Variants made at a time within a slice.
    block: int = 1 << 20
    #: Documents of a side, about, that one task compares with as many others, and their shingles (see between).
    side: int = 2048
    side_shingles: int = 1 << 20
    #: Candidates of a document that a task verifies at a time, the nearest first (see between).
    most: int = 192

    def for_nodes(self, n: int) -> SimHash:
        """With as many slices as n different fingerprints need."""
        p = self
        while p.slices < 1 << min(20, p.bits) and n * p.reach().size / p.slices * 8 * (2 + p.check_words) > p.held:
            p = replace(p, slices=2 * p.slices)
        return p

    def reach(self) -> np.ndarray:
        """Codes of the slices in which a fingerprint of code 0 has variants."""
        width = self.slices.bit_length() - 1
        return flips(width, min(width, self.radius // 2)).astype(np.int64)


#: One 64-bit fingerprint, linked at 4 bits or fewer.
EXACT = SimHash(words=4, tables=1, bits=64, radius=4, check_words=0, similarity=0, slices=16)
#: Five words and similarity 0.8: then fingerprints differ in 15 % of the bits on average, 6 of 40, with a spread that lets
#: 26 % come within 4, so that of 24 tables at least one does in 999 of 1000 cases. The check words then differ in 39 of 256
#: bits, give or take 6.
NEAR = SimHash()


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 with seed 42 of each shingle, repeats included."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    lens = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lens) - 1
    starts = ends - lens + 1
    k = min(words, len(found))
    h = xxhash.xxh64_intdigest
    return np.array([h(line[a:z], 42) for a, z in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The different shingles of each text as hashes, in ascending order."""
    words, at = hashed_words(texts)
    h = rolled(words, list(range(k)))
    out = []
    for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
        out.append(np.unique(h[a : z - k + 1] if z - a >= k else rolled(words[a:z], list(range(z - a))) if z > a else h[:0]))
    return out


def ones(rows: np.ndarray) -> np.ndarray:
    """Of rows of 64-bit words: for each bit, in how many it is set."""
    n = np.zeros(rows.shape[1] * 64, np.int64)
    for i in range(0, len(rows), 255):  # sums of 255 fit a byte
        bits = np.unpackbits(rows[i : i + 255].astype("<u8").view(np.uint8), axis=1, bitorder="little")
        n += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return n


def majority(rows: np.ndarray) -> np.ndarray:
    """Of rows of 64-bit words: a byte for each bit, 1 if it is set in over half of them."""
    return (ones(rows) * 2 > len(rows)).astype(np.uint8)


def fingerprint(text: bytes, p: SimHash) -> np.ndarray:
    """The 64-bit fingerprint over all shingles."""
    h = shingle_hashes(text, p.words)
    return np.packbits(majority(h[:, None]), bitorder="little").view("<u8")


def near_fingerprint(shingles: np.ndarray, p: SimHash) -> np.ndarray:
    """A word of `bits` bits for each table and the check words, over the different shingles."""
    key = np.zeros((p.tables + p.check_words, 64), np.uint8)
    own = p.tables * p.bits
    if len(shingles):
        factors = np.arange(1, -(-own // 64) + p.check_words + 1, dtype=np.uint64) * ODD | np.uint64(1)
        n = np.zeros(64 * len(factors), np.int64)
        for i in range(0, len(shingles), 255 * 32):  # however long the text, a few MB at a time
            v = shingles[i : i + 255 * 32, None] * factors
            v ^= v >> np.uint64(29)
            v *= np.uint64(0xBF58476D1CE4E5B9)
            v ^= v >> np.uint64(32)
            n += ones(v)
        bits = (n * 2 > len(shingles)).astype(np.uint8)
        key[: p.tables, : p.bits] = bits[:own].reshape(p.tables, p.bits)
        key[p.tables :] = bits[len(bits) - 64 * p.check_words :].reshape(p.check_words, 64)
    return np.packbits(key, axis=1, bitorder="little").reshape(-1).view("<u8")


def fingerprints(docs: DataFrame, p: SimHash = NEAR) -> DataFrame:
    """doc_id, fp (binary: big-endian 64-bit words). A null, empty or wordless text has fingerprint zero."""
    ship(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            if p.check_words:
                prints = (near_fingerprint(s, p) for s in shingle_sets(b.column(1), p.words))
            else:
                prints = (fingerprint((t or "").encode(), p) for t in b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(">u8").tobytes() for x in prints], pa.binary())], schema=out)

    return id_and_text(docs).mapInArrow(lean(make), "doc_id long, fp binary")


def flips(bits: int, most: int) -> np.ndarray:
    """All masks with at most `most` of `bits` bits."""
    return np.array([sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(bits), n)], np.uint64)


def code(v: np.ndarray, width: int) -> np.ndarray:
    """A linear code of `width` bits, the lowest ones: code(a ^ b) = code(a) ^ code(b)."""
    return (v & np.uint64((1 << width) - 1)).astype(np.int64)


def collisions(keys: np.ndarray, checks: np.ndarray, target: int, p: SimHash) -> tuple[np.ndarray, np.ndarray]:
    """Links (places of keys) whose common variant's code ends in `target`."""
    n, masks = len(keys), flips(p.bits, p.radius // 2)
    low = p.slices.bit_length() - 1
    more = max(0, math.ceil(math.log2(max(1, n * len(masks) / p.slices / p.block))))
    width = low + more
    own, of_mask = code(keys, width), code(masks, width)
    groups = [np.flatnonzero(own == c) for c in range(1 << width)]
    by_code = [masks[of_mask == c] for c in range(1 << width)]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for high in range(1 << more):
        at = target | high << low
        made = [(keys[g][:, None] ^ by_code[c ^ at][None, :], g) for c, g in enumerate(groups) if len(g) and len(by_code[c ^ at])]
        if not made:
            continue
        v = np.concatenate([m.ravel() for m, _ in made])
        s = np.sort(v)
        twice = s[1:][s[1:] == s[:-1]]
        if not len(twice):
            continue
        twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
        owner = np.concatenate([np.repeat(g, m.shape[1]) for m, g in made])
        odd = np.uint64(0x9E3779B97F4A7C15)
        maybe = np.zeros(1 << 20, bool)
        maybe[(twice * odd) >> np.uint64(44)] = True
        pick = np.flatnonzero(maybe[(v * odd) >> np.uint64(44)])
        place = np.minimum(np.searchsorted(twice, v[pick]), len(twice) - 1)
        hit = twice[place] == v[pick]
        group, member = place[hit], owner[pick[hit]]
        order = np.lexsort((member, group))
        group, member = group[order], member[order]
        for x, y in paired(group, member, checks, p):
            pair = np.unique(x * n + y)
            left.append(pair // n)
            right.append(pair % n)
    pair = np.unique(np.concatenate(left) * max(n, 1) + np.concatenate(right))
    return pair // max(n, 1), pair % max(n, 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def paired(group: np.ndarray, member: np.ndarray, checks: np.ndarray, p: SimHash) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within groups (sorted by group and member), so that members with check words within p.check are connected."""
    while len(group):
        first = np.concatenate(([True], group[1:] != group[:-1]))
        pivot = member[np.flatnonzero(first)[np.cumsum(first) - 1]]
        far = distances(checks[pivot], checks[member])  # no check words: nothing is far
        link = (far <= p.check) & (pivot != member)
        yield pivot[link], member[link]
        leaves = (far <= p.leave) | (pivot == member)
        if not leaves.all():
            # whoever stays is paired with the nearest of those that leave
            out, size = member[leaves & ~first], np.bincount(group[leaves & ~first], minlength=int(group[-1]) + 1)
            at = np.cumsum(size) - size
            for i in np.flatnonzero(~leaves & (size[group] > 0)).tolist():
                rivals = out[at[group[i]] : at[group[i]] + size[group[i]]]
                d = distances(checks[rivals], checks[member[i]])
                k = int(d.argmin())
                if d[k] <= p.check:
                    yield rivals[k : k + 1], member[i : i + 1]
        group, member = group[~leaves], member[~leaves]


def certificate(x: np.ndarray, y: np.ndarray, far: np.ndarray, p: SimHash) -> np.ndarray:
    """Which of a slice's candidates go on to be verified, a few for each document however many copies it has: a least
    spanning forest of the sure ones; then, between its trees, `spare` edge-disjoint least forests of the others. If
    candidates turn out not to be similar enough, two documents can fall apart where over `spare` candidates between their
    parts did so here, and in every other slice and table that has them too: the rest is for `settled`."""
    kept = [np.flatnonzero(far <= p.sure)]
    kept[0] = kept[0][spanning(x[kept[0]], y[kept[0]], far[kept[0]])]
    n = int(max(x.max(initial=-1), y.max(initial=-1))) + 1
    part = np.arange(n)
    a, z = forest(x[kept[0]], y[kept[0]])
    part[a] = z
    left = np.flatnonzero(part[x] != part[y])
    for _ in range(p.spare):
        own = left[spanning(part[x[left]], part[y[left]], far[left])]
        kept.append(own)
        left = np.setdiff1d(left, own, assume_unique=True)
    return np.concatenate(kept)


def links(nodes: DataFrame, p: SimHash) -> DataFrame:
    """Edges (a, b, tree) between nodes(rep, fp): from each slice a forest that joins all that link or are candidates (tree),
    and with check words also the slice's certificate (not tree)."""
    ship(nodes.sparkSession)
    total, words = p.tables * p.slices, 2 + p.check_words
    reach = p.reach()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                fp = np.frombuffer(b"".join(b.column("fp").to_pylist()), ">u8").reshape(b.num_rows, -1)
                rep = np.asarray(b.column("rep")).astype("<i8").view("<u8")
                slices, cells = [], []
                for t in range(p.tables):
                    rows = np.column_stack([rep, fp[:, t], fp[:, p.tables :]]).astype("<u8")
                    own = code(fp[:, t].astype(np.uint64), p.slices.bit_length() - 1)
                    for s in range(p.slices):
                        here = np.isin(own ^ s, reach)
                        if here.any():
                            slices.append(t * p.slices + s)
                            cells.append(rows[here].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(cells, pa.binary())], names=["slice", "rows"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                rows = np.unique(np.frombuffer(b"".join(held), "<u8").reshape(-1, words), axis=0)
                held.clear()
                reps = rows[:, 0].astype("<i8").view("<i8")
                x, y = collisions(rows[:, 1], rows[:, 2:], now % p.slices, p)
                a, z = forest(reps[x], reps[y])
                trees = len(a)
                if p.check_words:
                    own = certificate(x, y, distances(rows[x, 2:], rows[y, 2:]), p)
                    a, z = np.concatenate((a, reps[x[own]])), np.concatenate((z, reps[y[own]]))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z), pa.array(np.arange(len(a)) < trees)], names=["a", "b", "tree"])

        for b in batches:  # a slice's rows stand together
            for s, rows in zip(b.column("slice").to_pylist(), b.column("rows").to_pylist()):
                if s != now:
                    yield from done()
                    now = s
                held.append(rows)
        yield from done()

    dealt = nodes.select("rep", "fp").mapInArrow(lean(deal), "slice int, rows binary")
    return dealt.repartition(total, "slice").sortWithinPartitions("slice").mapInArrow(lean(meet), "a long, b long, tree boolean")


def shingled(nodes: DataFrame, ids: DataFrame, docs: DataFrame, p: SimHash) -> DataFrame:
    """id, fp, n, shingles: the different shingles, n of them, of each different text of those nodes(rep, fp) whose rep is
    among the ids. Texts of other fingerprints that repeat a document id belong to other nodes."""
    own = nodes.join(few(ids), nodes["rep"] == ids["id"], "left_semi").select(F.col("rep").alias("id"), F.xxhash64("fp").alias("print"))
    texts = id_and_text(docs).withColumnRenamed("doc_id", "id").join(few(ids), "id", "left_semi").distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            own = shingle_sets(b.column(1), p.words)
            n = np.array([len(s) for s in own], np.int32)
            fp = pa.array([near_fingerprint(s, p).astype(">u8").tobytes() for s in own], pa.binary())
            at = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            lists = pa.ListArray.from_arrays(at, pa.array(np.concatenate(own).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), fp, pa.array(n), lists], names=["id", "fp", "n", "shingles"])

    made = texts.mapInArrow(lean(sets), "id long, fp binary, n int, shingles array<long>").withColumn("print", F.xxhash64("fp"))
    return made.join(few(written(own, "concerned")), ["id", "print"], "left_semi").drop("print")


def verified(pairs: DataFrame, texts: DataFrame, p: SimHash) -> DataFrame:
    """The different pairs(a, b) of ids whose sets of shingles in texts(id, shingles) have the similarity. Of texts with the
    same id any may be the one that is similar."""
    # first the later documents, of which each has few pairs; then the first ones, where a hot one can be split
    one = pairs.join(texts.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = one.join(texts.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    common, all_ = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return both.filter(common >= F.lit(p.similarity) * (all_ - common) - 1e-9).select("a", "b").distinct()


def joined(t: pa.Table, p: SimHash) -> tuple[np.ndarray, np.ndarray]:
    """Links between parts, one for each time that two become one: from rows(whole, part, side, fp, shingles) the candidates
    of the similarity between rows of side 0 and side 1, or where there is no side 1, between all rows of a whole."""
    t = t.take(pc.sort_indices(t["whole"]))
    fp = np.frombuffer(b"".join(t["fp"].to_pylist()), ">u8").reshape(t.num_rows, -1).astype(np.uint64)
    side = np.asarray(t["side"])
    parts, label = np.unique(np.asarray(t["part"]), return_inverse=True)
    lists = t["shingles"].combine_chunks()
    n = np.asarray(pc.list_value_length(lists), np.int64)
    ends = np.cumsum(n)
    kinds, at = np.unique(np.asarray(lists.flatten()), return_inverse=True)
    own = np.zeros(len(kinds), bool)
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    last = np.searchsorted(np.asarray(t["whole"]), np.asarray(t["whole"]), side="right")
    left, right = [], []
    for row in one.tolist():
        to = two if len(two) else np.arange(row + 1, last[row])
        to = to[label[to] != label[row]]
        to = to[np.minimum(n[to], n[row]) >= p.similarity * np.maximum(n[to], n[row]) - 1e-9]  # else too few can be common
        far = distances(fp[row, p.tables :], fp[to, p.tables :])
        to, far = to[far <= p.check], far[far <= p.check]
        met = (np.bitwise_count(fp[row, : p.tables] ^ fp[to, : p.tables]) <= p.radius).any(axis=1)
        to = to[met][np.argsort(far[met], kind="stable")]
        mine = at[ends[row] - n[row] : ends[row]]
        own[mine] = True
        while len(to):
            now, to = to[: p.most], to[p.most :]
            hits = np.concatenate(([0], np.cumsum(own[at[ranges(ends[now] - n[now], n[now])]])))
            z = np.cumsum(n[now])
            common = hits[z] - hits[z - n[now]]
            similar = common >= p.similarity * (n[row] + n[now] - common) - 1e-9
            for other in np.unique(label[now[similar]]).tolist():
                left.append(label[row])
                right.append(other)
                label[label == other] = label[row]
            to = to[label[to] != label[row]]
        own[mine] = False
    return parts[np.array(left, np.int64)], parts[np.array(right, np.int64)]


def between(rows: DataFrame, p: SimHash) -> DataFrame:
    """a, b: links that join the parts of each whole, from rows(whole, part, fp, shingles, main: whether it is the whole's
    largest part, mains and others: how many sides the whole's rows that are so and not are dealt into). Two sides meet in a
    task, except two of the largest part; wholes of one side in all meet as a whole, about `side` rows of them in a task.
    Every two rows of different parts of a whole so meet once, and a task gives fewer links than it has parts."""
    rows = written(rows.withColumn("small", F.col("mains") + F.col("others") <= 1), "rows")
    cols = ["whole", "part", "fp", "shingles"]
    tasks = F.lit(-(-rows.filter("small").count() // p.side) or 1)
    small = rows.filter("small").select(F.pmod(F.xxhash64("whole"), tasks).alias("task"), *cols, F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(False).alias("main"), F.lit(0).alias("side"))
    dealt = rows.filter("not small").withColumn("own", F.pmod(F.xxhash64("fp", "part"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    turns = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = [F.col("whole").alias("task"), *cols]
    at_main = dealt.filter("main").select(*key, turns("others").alias("i"), F.col("own").alias("j"), F.lit(True).alias("main"), F.lit(1).alias("side"))
    rest = dealt.filter("not main")
    with_main = rest.select(*key, F.col("own").alias("i"), turns("mains").alias("j"), F.lit(True).alias("main"), F.lit(0).alias("side"))
    turned = rest.select(*key, "own", turns("others").alias("other"))
    with_rest = turned.select("task", *cols, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.lit(False).alias("main"), (F.col("own") > F.col("other")).cast("int").alias("side"))

    def compare(t: pa.Table) -> pa.Table:
        two_sides = t["main"][0].as_py() or t["i"][0] != t["j"][0]
        if two_sides and len(pc.unique(t["side"])) == 1:  # the other one turned out empty
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = joined(t, p)
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return small.union(at_main).union(with_main).union(with_rest).groupBy("task", "main", "i", "j").applyInArrow(compare, "a long, b long")


def settled(nodes: DataFrame, docs: DataFrame, p: SimHash) -> DataFrame:
    """node, component of the nodes(rep, fp) that candidates of the similarity connect. First the candidates of the
    certificates are verified. The trees connect what all candidates connect (a whole); where one has several parts, all
    candidates between its parts are verified where they meet."""
    met = links(nodes, p.for_nodes(nodes.count())).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "tree")
    met = written(met.distinct(), "candidates")
    wholes = components(met.filter("tree")).withColumnRenamed("component", "whole")
    texts = written(shingled(nodes, wholes.select(F.col("node").alias("id")), docs, p), "shingles")
    parts = components(written(verified(met.filter("not tree").select("a", "b"), texts, p), "links"))
    named = parts.select(F.col("node").alias("n"), F.col("component").alias("part"))
    placed = written(wholes.join(named, wholes["node"] == named["n"], "left").select("node", "whole", F.coalesce("part", "node").alias("part")), "parts")
    # of each whole the largest part; sides by rows and by shingles
    sized = placed.join(texts.select("id", "n"), placed["node"] == texts["id"]).groupBy("whole", "part").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    split = sized.groupBy("whole").agg(F.max(F.struct("size", "n", "part")).alias("top"), F.sum("size").alias("size"), F.sum("n").alias("n")).filter("size > top.size")
    sides = lambda size, n: F.ceil(F.greatest(size / p.side, n / p.side_shingles)).cast("int")
    fits = (F.col("size") <= p.side) & (F.col("n") <= p.side_shingles)
    mains = F.when(fits, 0).otherwise(sides(F.col("top.size"), F.col("top.n"))).alias("mains")
    others = F.when(fits, 1).otherwise(sides(F.col("size") - F.col("top.size"), F.col("n") - F.col("top.n"))).alias("others")
    split = written(split.select("whole", F.col("top.part").alias("largest"), mains, others), "wholes")
    if split.isEmpty():
        return placed.select("node", F.col("part").alias("component"))
    rows = placed.join(split, "whole").withColumn("main", F.col("part") == F.col("largest"))
    rows = rows.join(texts.drop("n"), rows["node"] == texts["id"]).select("whole", "part", "fp", "shingles", "main", "mains", "others")
    merged = components(written(between(rows, p), "links"))
    return placed.join(merged.toDF("joined", "component"), F.col("part") == F.col("joined"), "left").select("node", F.coalesce("component", "part").alias("component"))


def near_duplicates(docs: DataFrame, p: SimHash = NEAR) -> DataFrame:
    """doc_id, fp, component_id for every row: the smallest document id reachable over links, itself included.

    Rows with a null document id get a component only through other rows with the same fingerprint, else null.
    """
    prints = written(fingerprints(docs, p), "fingerprints")
    nodes = written(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = settled(nodes, docs, p) if p.check_words else components(links(nodes, p.for_nodes(nodes.count())))
    classes = nodes.join(found, nodes["rep"] == found["node"], "left").select(F.col("fp").alias("f"), F.coalesce("component", "rep").alias("component_id"))
    classes = written(classes, "classes")
    return prints.join(classes, prints["fp"] == classes["f"], "left").select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, p: SimHash = NEAR) -> DataFrame:
    """The documents without near duplicates: the one with the smallest id of each component stays, with all its columns.

    Rows without a document id stay. Rows that repeat a document id stay or go together; they go if all of them are in
    components of smaller ids. Wordless texts are copies of each other.
    """
    found = near_duplicates(docs, p).filter("doc_id is not null")
    gone = found.groupBy(F.col("doc_id").alias("gone")).agg(F.bool_and(F.col("component_id") < F.col("doc_id")).alias("all")).filter("all")
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
