"""Best-fit decreasing packing of token pieces into sequences of one fixed capacity.

Best-fit decreasing looks at nothing but lengths, and equal lengths are interchangeable. So the plan is made from the
histogram of lengths (at most `capacity` rows, whatever the corpus), a run of equal lengths at a time: a segment tree
over remaining capacities finds the tightest open bin in logarithmic time, and all bins with equal room are one run.
The plan is the very one that document-by-document best-fit decreasing makes. The pieces then find their places in
parallel: each counts the equal lengths before it, within its task and then over all tasks, and looks its number up.

Defined results: a null text is an empty text (one id, the end id); rows with the same document id are packed each on
their own; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunks, tokens
from .common import id_and_text, lean, ship, steps, written


class Tightest:
    """A segment tree over 0..capacity: which of the capacities held is the least one that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.held = bytearray(2 * self.size)

    def put(self, r: int, there: bool) -> None:
        i = r + self.size
        self.held[i] = there
        while i > 1:
            i >>= 1
            self.held[i] = self.held[2 * i] | self.held[2 * i + 1]

    def least(self, r: int) -> int | None:
        i = r + self.size
        if self.held[i]:
            return r
        while i > 1:  # up, until a right neighbour holds something
            if not i & 1 and self.held[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.size:
            i = 2 * i if self.held[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first, bin, each, offset): from number `first` on, pieces of this length go `each` to a bin, to
    bin, bin + 1, ... beginning at `offset`; and the number of bins. The runs grow with capacity, not with the pieces."""
    tree, open_, bins, plan = Tightest(capacity), defaultdict(list), 0, []

    def put(r: int, first: int, n: int) -> None:
        if n and r:
            open_[r].append((first, n))
            tree.put(r, True)

    for length in sorted(histogram, reverse=True):
        left, done = histogram[length], 0
        while left:
            r = tree.least(length)
            if r is None:
                r, each = capacity, capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                first, n = open_[r].pop()
                if not open_[r]:
                    tree.put(r, False)
                each = r // length
            full, rest = min(n, left // each), 0
            plan.append((length, done, first, each, capacity - r))
            used = full * each
            put(r - each * length, first, full)
            if full < n and left > used:
                rest = left - used
                used = left
                put(r - rest * length, first + full, 1)
            put(r, first + full + (rest > 0), n - full - (rest > 0))
            left, done = left - used, done + used
    return np.array(plan, np.int64).reshape(-1, 5), bins


PIECE = "task int, nth long, doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: whole where it fits; a longer one is cut into full pieces after a first shorter one.

    task and nth number the pieces of one length within the task that made them.
    """
    spark = docs.sparkSession
    ship(spark)
    vocabulary = tokens.vocabulary(spark, vocabulary_path)
    fields = [("task", pa.int32()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    out = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary.value)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4")
        for b in steps(batches, "text"):
            flat, starts = chunks.encoded(b.column(1), encode)
            doc, piece, start, length, crc, cells = [], [], [], [], [], []
            flat = flat.astype("<u4")
            for k, (a, z) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                ids = np.concatenate((flat[a:z], end))
                n = len(ids)
                cuts = [0, n] if n <= capacity else [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    data = ids[x:y].tobytes()
                    doc.append(k)
                    piece.append(i)
                    start.append(x)
                    length.append(y - x)
                    crc.append(zlib.crc32(data))
                    if with_ids:
                        cells.append(data)
            length = np.array(length, np.int64)
            order = np.argsort(length, kind="stable")
            run = length[order]
            first = np.searchsorted(run, run, side="left")
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(run)) - first + seen[run]
            seen += np.bincount(length, minlength=capacity + 1)
            cols = [pa.array(np.full(len(doc), task, np.int32)), pa.array(nth), b.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(cells, pa.binary())] * with_ids, schema=out)

    return id_and_text(docs).mapInArrow(lean(cut, keep=True), PIECE + ", ids binary" * with_ids)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Each piece with its sequence_id and offset. `pieces` is a stored table with task, nth and length."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan, _ = best_fit_plan(total, capacity)
    # a number over all lengths, so that one search finds length and run
    lengths = np.unique(plan[:, 0])
    sizes = np.array([total[int(x)] for x in lengths], np.int64)
    begins = np.cumsum(sizes) - sizes
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    first = begins[np.searchsorted(lengths, plan[:, 0])] + plan[:, 1]
    shared = spark.sparkContext.broadcast((lengths, begins, first, plan))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("task").alias("t"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    located = pieces.join(bases, (pieces["task"] == bases["t"]) & (pieces["length"] == bases["l"])).drop("t", "l", "task")
    names = [c for c in located.columns if c not in ("nth", "base")]
    schema = ", ".join(f"{c} {located.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, begins, first, plan = shared.value
        for b in batches:
            length = np.asarray(b.column("length"))
            nth = np.asarray(b.column("nth")) + np.asarray(b.column("base"))
            row = np.searchsorted(first, begins[np.searchsorted(lengths, length)] + nth, side="right") - 1
            p = plan[row]
            own = nth - p[:, 1]
            bin_, slot = p[:, 2] + own // p[:, 3], own % p[:, 3]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(bin_), pa.array(p[:, 4] + slot * length)], names=[*names, "sequence_id", "offset"])

    return located.mapInArrow(lean(place, keep=True), schema)


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of every document."""
    return pack(written(token_pieces(docs, vocabulary_path, capacity, end_id, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the pieces of pack_documents(with_ids=True) joined; a sequence holds `capacity` ids at most."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("p"))
    return parts.select("sequence_id", F.unhex(F.concat_ws("", F.transform("p", lambda x: x["ids"]))).alias("ids"))
