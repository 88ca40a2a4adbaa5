"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line stripped of ASCII white space at both ends, with A-Z in lower case; keys of at least ten code
points count. The postings table holds one row for each key and document, so a key's reference count and its owner (the
smallest document id) are exact at any time. Keys that at least two documents hold are shared; each shard (by key hash)
has a cuckoo filter of its shared keys, from which keys can be deleted again. A document's lines are first probed
against the filters; only those that may be shared go on to the exact table, which decides.

Documents can be inserted and deleted later: only the keys they hold are counted anew, and filters of their shards get
the keys that became shared and lose those that no longer are. Deleting what was inserted restores the earlier state.

Defined results: a null or empty text is one empty line; rows with the same document id are one holder, so they don't
make a line shared; rows without a document id hold nothing and keep their text; other columns stay as they are.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, lean, ship, steps, written

#: Least code points of a key.
LEAST = 10
SPACE = b" \t\n\x0b\x0c\r"
#: The filters are sent to the tasks only if they take no more bytes than this; else filters and keys meet by shard.
BROADCAST_BYTES = 64 << 20
#: Keys of a shard's filter, about; parts that a shard's keys are dealt into on their way to its filter.
SHARD_KEYS = 400_000
SALTS = 8


def key_of(line: bytes, least: int = LEAST) -> bytes | None:
    """The hash of a line's key, or None for a key that is too short. 128 bits stand for the key."""
    k = line.strip(SPACE).lower()
    if len(k) < least or (len(k) < 4 * least and len(k.decode("utf-8", "replace")) < least):
        return None
    return xxhash.xxh3_128_digest(k)


class Cuckoo:
    """Buckets of four 16-bit fingerprints; a key has two buckets, and one is told from the other by the fingerprint."""

    def __init__(self, buckets: int, slots: bytes | None = None):
        self.buckets = buckets
        self.slots = array("H", slots if slots is not None else bytes(8 * buckets))

    @classmethod
    def of(cls, hashes: np.ndarray) -> Cuckoo:
        size = 1
        while size * 4 * 0.85 < len(hashes):
            size *= 2
        while True:
            own = cls(size)
            if all(own.insert(h) for h in hashes.tolist()):
                return own
            size *= 2

    @staticmethod
    def print_(h: int) -> int:
        return (h >> 48 & 0xFFFF) or 1

    def other(self, bucket: int, p: int) -> int:
        return (bucket ^ (p * 0x5BD1E995 & 0xFFFFFFFF)) & (self.buckets - 1)

    def insert(self, h: int) -> bool:
        p, s = self.print_(h), self.slots
        a = h & (self.buckets - 1)
        for turn in range(500):
            for b in (a, self.other(a, p)):
                for i in range(4 * b, 4 * b + 4):
                    if not s[i]:
                        s[i] = p
                        return True
            a = self.other(a, p) if turn & 1 else a
            i = 4 * a + (turn * 7 + p) % 4
            p, s[i] = s[i], p
            a = self.other(a, p)
        return False

    def delete(self, h: int) -> bool:
        p = self.print_(h)
        a = h & (self.buckets - 1)
        for b in (a, self.other(a, p)):
            for i in range(4 * b, 4 * b + 4):
                if self.slots[i] == p:
                    self.slots[i] = 0
                    return True
        return False

    def contains(self, h: np.ndarray) -> np.ndarray:
        t = np.frombuffer(self.slots, np.uint16).reshape(-1, 4)
        p = (h >> np.uint64(48)).astype(np.uint16)
        p[p == 0] = 1
        a = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        b = a ^ (p.astype(np.int64) * 0x5BD1E995 & 0xFFFFFFFF & (self.buckets - 1))
        return (t[a] == p[:, None]).any(axis=1) | (t[b] == p[:, None]).any(axis=1)

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Cuckoo:
        return cls(len(data) // 8, data)


def line_keys(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, h1, h2: each different key of each row."""
    ship(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            found = [{k for x in t.encode().split(b"\n") if (k := key_of(x, least))} if t else () for t in b.column(1).to_pylist()]
            h = np.frombuffer(b"".join([k for own in found for k in own]), "<i8").reshape(-1, 2)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in found])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], schema=out)

    return id_and_text(docs).filter("doc_id is not null").mapInArrow(lean(keys), "doc_id long, h1 long, h2 long")


@dataclass(frozen=True)
class LineIndex:
    """Tables in the shared folder: postings (doc_id, h1, h2), shared (h1, h2, owner, refs), filters (shard, slots)."""

    postings: DataFrame
    shared: DataFrame
    filters: DataFrame
    shards: int

    def shard(self, h: str = "h1") -> Column:
        return F.pmod(F.shiftright(F.col(h), 20), F.lit(self.shards)).cast("int")


def counted(postings: DataFrame) -> DataFrame:
    """The keys held by two documents or more: the smallest id and the number of references. A frequent key is counted
    by partial aggregation; no task gets its rows."""
    held = postings.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("refs"))
    return held.filter("owner < last").drop("last")


def _filters(keys: DataFrame, shards: int) -> DataFrame:
    index = LineIndex(keys, keys, keys, shards)

    def fill(key, rows):
        import pandas as pd

        return pd.DataFrame({"shard": [key[0]], "slots": [Cuckoo.of(rows["h1"].to_numpy().view("<u8")).to_bytes()]})

    return keys.select(index.shard().alias("shard"), "h1").groupBy("shard").applyInPandas(fill, "shard int, slots binary")


def build(docs: DataFrame, shards: int | None = None, least: int = LEAST) -> LineIndex:
    """The index of a corpus. A shard's filter is made in one task; their number follows from that of the shared keys."""
    postings = written(line_keys(docs, least), "postings")
    shared = written(counted(postings), "shared")
    shards = shards or max(64, -(-shared.count() // SHARD_KEYS))
    return LineIndex(postings, shared, written(_filters(shared, shards), "filters"), shards)


def _changed(index: LineIndex, postings: DataFrame, touched: DataFrame) -> LineIndex:
    """The index after a change of postings: only the touched keys are counted anew."""
    postings = written(postings, "postings")
    touched = written(touched.select("h1", "h2").distinct(), "touched")
    on = ["h1", "h2"]
    again = counted(postings.join(touched, on, "left_semi"))
    old = index.shared.join(touched, on, "left_semi")
    shared = written(index.shared.join(touched, on, "left_anti").unionByName(again), "shared")
    now = shared.join(touched, on, "left_semi")
    plus = now.join(old, on, "left_anti").select("h1", F.lit(True).alias("add"))
    minus = old.join(now, on, "left_anti").select("h1", F.lit(False).alias("add"))
    moves = plus.union(minus).select(index.shard().alias("shard"), "h1", "add")

    def update(key, had, rows):
        import pandas as pd

        hashes, add = rows["h1"].to_numpy().view("<u8"), rows["add"].to_numpy(bool)
        own = Cuckoo.from_bytes(bytes(had["slots"].iloc[0])) if len(had) else Cuckoo(1)
        for h in hashes[~add].tolist():
            own.delete(h)
        fits = all(own.insert(h) for h in hashes[add].tolist())
        return pd.DataFrame({"shard": [key[0]], "slots": [own.to_bytes() if fits else None]})

    updated = index.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(update, "shard int, slots binary")
    updated = written(updated, "filters")
    full = updated.filter("slots is null").select("shard")  # those grow: made anew from the exact table
    anew = _filters(shared.join(full, index.shard() == full["shard"], "left_semi"), index.shards)
    return LineIndex(postings, shared, written(updated.filter("slots is not null").unionByName(anew), "filters"), index.shards)


def insert(index: LineIndex, docs: DataFrame, least: int = LEAST) -> LineIndex:
    """The index with more documents, whose ids it doesn't hold yet."""
    new = written(line_keys(docs, least), "postings")
    return _changed(index, index.postings.unionByName(new), new)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents of doc_ids(doc_id): references go, owners move on, lines held once come back."""
    gone = doc_ids.select(F.col("doc_id").cast("long")).distinct()
    out = index.postings.join(gone, "doc_id", "left_semi")
    return _changed(index, index.postings.join(gone, "doc_id", "left_anti"), out)


def lost_lines(index: LineIndex, probe: DataFrame | None = None) -> DataFrame:
    """doc_id, keys (binary: 16 bytes each): the keys whose lines a document loses, being another's."""
    spark = index.postings.sparkSession
    probe = index.postings if probe is None else probe
    size = index.filters.agg(F.coalesce(F.sum(F.octet_length("slots")), F.lit(0)).alias("n")).first()["n"]
    if size <= BROADCAST_BYTES:
        slots = spark.sparkContext.broadcast({r["shard"]: bytes(r["slots"]) for r in index.filters.collect()})
        shards = index.shards

        def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = {s: Cuckoo.from_bytes(x) for s, x in slots.value.items()}
            for b in batches:
                h1 = np.asarray(b.column("h1"))
                shard, hit = (h1 >> 20) % shards, np.zeros(len(h1), bool)
                for s in np.unique(shard).tolist():
                    if s in own:
                        at = np.flatnonzero(shard == s)
                        hit[at] = own[s].contains(h1[at].view("<u8"))
                yield b.filter(pa.array(hit))

        probe = probe.mapInArrow(lean(maybe), "doc_id long, h1 long, h2 long")
    else:
        probe = _met_by_shard(index, probe)
    owner = index.shared.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "owner")
    exact = probe.join(owner, (probe["h1"] == owner["k1"]) & (probe["h2"] == owner["k2"])).filter("doc_id <> owner")
    return exact.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("keys"))


def _met_by_shard(index: LineIndex, probe: DataFrame) -> DataFrame:
    """The rows of probe whose key may be in its shard's filter. Keys and filters go to the same tasks, a shard's filter
    before its keys, which stream by; a shard's keys are dealt by document as well, so a frequent line is no task's alone."""
    empty = lambda t, *names: [F.lit(None).cast(t).alias(n) for n in names]
    filters = index.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "slots", *empty("long", "doc_id", "h1", "h2"))
    keys = probe.select(index.shard().alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), *empty("binary", "slots"), "doc_id", "h1", "h2")
    dealt = filters.union(keys).repartition(index.shards * SALTS, "shard", "salt")
    dealt = dealt.sortWithinPartitions("shard", "salt", F.col("slots").isNull())

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for b in batches:
            places = list(zip(b.column("shard").to_pylist(), b.column("salt").to_pylist()))
            cuts = [0, *(i for i in range(1, len(places)) if places[i] != places[i - 1]), len(places)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                part = b.slice(a, z - a)
                if places[a] != now:
                    now, own = places[a], None
                if part.column("slots")[0].is_valid:
                    own, part = Cuckoo.from_bytes(part.column("slots")[0].as_py()), part.slice(1)
                if own is not None and part.num_rows:
                    part = part.select(["doc_id", "h1", "h2"])
                    yield part.filter(pa.array(own.contains(np.asarray(part.column("h1")).view("<u8"))))

    return dealt.mapInArrow(lean(maybe), "doc_id long, h1 long, h2 long")


def drop_lines(docs: DataFrame, lost: DataFrame, least: int = LEAST, counts: bool = True) -> DataFrame:
    """docs with the lost lines taken out of `text`; with counts also n_lines (before) and n_dropped, instead of columns
    of these names."""
    names = [c for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))]
    gone = lost.select(F.col("doc_id").alias("__doc"), F.col("keys").alias("__keys"))
    joined = docs.join(gone, docs["doc_id"] == gone["__doc"], "left").select(*[docs[c] for c in names], "__keys")
    types = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]
    more = ["n_lines", "n_dropped"] if counts else []

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            keys, texts = b.column("__keys"), b.column("text").to_pylist()
            kept, before, dropped = texts[:], [], []
            for i, t in enumerate(texts):
                n = (t or "").count("\n") + 1
                before.append(n)
                dropped.append(0)
                if keys[i].is_valid:
                    own = keys[i].values.flatten()
                    h = np.stack([np.asarray(own[0]), np.asarray(own[1])], axis=1).astype("<i8").tobytes()
                    gone = {h[k : k + 16] for k in range(0, len(h), 16)}
                    stay = [x for x in (t or "").encode().split(b"\n") if key_of(x, least) not in gone]
                    kept[i], dropped[-1] = b"\n".join(stay).decode(), n - len(stay)
            cols = [pa.array(kept, pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(x, pa.int64()) for x in (before, dropped)][: len(more)], names=[*names, *more])

    return joined.mapInArrow(lean(render), ", ".join(types + [f"{c} long" for c in more]))


def dedup_lines(docs: DataFrame, counts: bool = False) -> DataFrame:
    """The documents, each shared line only in the one with the smallest id."""
    return drop_lines(docs, lost_lines(build(docs)), counts=counts)
