"""Fill-in-the-middle: documents cut into prefix, middle and suffix at places that their ids choose.

Content-defined chunk memoization: a rolling hash over the bytes cuts texts into chunks, so passages that documents share
fall into equal chunks. A chunk's summary (ends of units inside, code points, a marker inside, what stands at its two
edges) is made once and kept in a cache; a chunk found there is compared byte by byte before its summary is used. The
summaries of a document's chunks, combined over their edges, give the number of units; their running sums tell in which
chunk a cut lies, and only that chunk is looked through.

A unit is white space and the word behind it; white space at the end of a text is a unit of its own. So units end where
white space follows a word, and at the end of the text.

Defined results: a null text is an empty text, which is plain; a null id counts as no digits after the seed; rows with
the same id are cut alike, each on its own; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, lean, ship, steps, strings
from .rolling import Rolling

#: Bytes of text in one step; a longer text is a step of its own.
STEP = 2 << 20
MARKERS = (b"<P>", b"<S>", b"<M>")
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Fim:
    seed: int = 42
    #: Per cent of the texts that are cut, and per cent of those that are written suffix first.
    rate: int = 50
    suffix_first: int = 80
    #: Chunks: bytes of the rolling window, one cut in so many places (a power of two), fewest bytes between two cuts.
    window: int = 32
    spacing: int = 512
    least: int = 64
    #: Bytes of chunks that a task keeps; a full cache begins anew.
    cache: int = 32 << 20


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four numbers below 2 ** 32 from a document's id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[4 * i : 4 * i + 4], "big") for i in range(4))


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Places in `data` where white space follows a word."""
    white = WHITE[data]
    return np.flatnonzero(white[1:] & ~white[:-1]) + 1


def chunk_starts(data: np.ndarray, docs: np.ndarray, f: Fim, room: dict) -> np.ndarray:
    """Where chunks begin: where texts (docs: their bounds) begin, and where the window before a place says so."""
    first = np.unique(docs[:-1][docs[:-1] < docs[1:]])
    if len(data) <= f.window:
        return first
    hit = np.flatnonzero(Rolling(data, room).windows(f.window)[:-1] & np.uint64(f.spacing - 1) == 0) + f.window
    begin = docs[np.searchsorted(docs, hit, side="right") - 1]
    hit = hit[hit - begin >= max(f.window, f.least)]
    if (np.diff(hit) < f.least).any():
        kept, at = [], 0
        while at < len(hit):
            kept.append(hit[at])
            at = int(np.searchsorted(hit, hit[at] + f.least))
        hit = np.array(kept)
    return np.union1d(first, hit)


def summaries(pieces: list[bytes]) -> np.ndarray:
    """A row for each chunk: ends of units inside, code points, white space first, white space last, a marker inside,
    the first two bytes, the last two."""
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    at = np.concatenate(([0], np.cumsum(lens)))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    out = np.zeros((len(pieces), 7), np.int64)
    ends = unit_ends(data)
    owner = np.searchsorted(at, ends, side="right") - 1
    out[:, 0] = np.bincount(owner[ends > at[owner]], minlength=len(pieces))  # not where two chunks meet
    out[:, 1] = np.add.reduceat(data & 0xC0 != 0x80, at[:-1], dtype=np.int64)
    out[:, 2], out[:, 3] = WHITE[data[at[:-1]]], WHITE[data[at[1:] - 1]]
    out[:, 4] = [any(m in p for m in MARKERS) for p in pieces]
    out[:, 5] = [int.from_bytes(p[:2].ljust(2, b"\0"), "big") for p in pieces]
    out[:, 6] = [int.from_bytes(p[-2:].rjust(2, b"\0"), "big") for p in pieces]
    return out


class Memo:
    """Summaries of chunks by content."""

    def __init__(self, most: int):
        self.most, self.held, self.known = most, 0, {}

    def __call__(self, pieces: list[bytes]) -> np.ndarray:
        out, new = [None] * len(pieces), {}
        for i, p in enumerate(pieces):
            had = self.known.get(xxhash.xxh3_64_intdigest(p))
            if had is not None and had[0] == p:
                out[i] = had[1]
            else:
                new.setdefault(p, []).append(i)
        if new:
            for (p, places), s in zip(new.items(), summaries(list(new))):
                for i in places:
                    out[i] = s
                if self.held + len(p) > self.most:
                    self.known, self.held = {}, 0
                self.known[xxhash.xxh3_64_intdigest(p)] = (p, s)
                self.held += len(p)
        return np.array(out, np.int64).reshape(-1, 7)


def across(tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Whether a marker lies across the edge between chunks that end and begin with these bytes."""
    found = np.zeros(len(tail), bool)
    for a, b, c in MARKERS:
        found |= (tail == a << 8 | b) & (head >> 8 == c) | (tail & 0xFF == a) & (head == b << 8 | c)
    return found


class Cutter:
    """Counts and cuts of the texts of one step, from the summaries of their chunks."""

    def __init__(self, data: np.ndarray, docs: np.ndarray, f: Fim, memo: Memo, room: dict):
        self.data, self.docs = data, docs
        self.starts = chunk_starts(data, docs, f, room)
        self.ends = np.append(self.starts[1:], len(data))
        raw = data.tobytes()
        s = memo([raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())])
        self.first = np.searchsorted(self.starts, docs)  # each text's first chunk
        inner = np.ones(len(self.starts), bool)
        inner[self.first[:-1][docs[:-1] < docs[1:]]] = False  # edges inside a text
        before = lambda col: np.concatenate(([0], s[:-1, col])) if len(s) else s[:, col]
        self.edge = (inner & (before(3) == 0) & (s[:, 2] == 1)).astype(np.int64)
        total = lambda x: np.concatenate(([0], np.cumsum(x)))
        self.units, self.chars = total(self.edge + s[:, 0]), total(s[:, 1])
        marks = total(s[:, 4] + (inner & across(before(6), s[:, 5])))
        self.marked = np.diff(marks[self.first]) > 0
        self.n = np.diff(self.units[self.first]) + (np.diff(docs) > 0)

    def place(self, doc: int, k: int) -> int:
        """The byte at which the k-th unit of a text ends."""
        if k == 0 or k == self.n[doc]:
            return int(self.docs[doc + (k > 0)])
        k += int(self.units[self.first[doc]])
        c = int(np.searchsorted(self.units, k)) - 1
        k -= int(self.units[c] + self.edge[c])
        return int(self.starts[c]) + (int(unit_ends(self.data[self.starts[c] : self.ends[c]])[k - 1]) if k else 0)

    def chars_to(self, place: int) -> int:
        """Code points of the step before a byte."""
        c = int(np.searchsorted(self.starts, place, side="right")) - 1
        if c < 0:
            return 0
        return int(self.chars[c] + np.count_nonzero(self.data[self.starts[c] : place] & 0xC0 != 0x80))


def fill_in_middle(docs: DataFrame, rules: Fim | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output."""
    f = rules or Fim()
    ship(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, room = Memo(f.cache), {}
        for b in steps(batches, "text", STEP):
            texts, ids = strings(b.column(1)), b.column(0).to_pylist()
            docs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[docs[0] : docs[-1]]
            docs = docs - docs[0]
            c = Cutter(data, docs, f, memo, room)
            raw, rows = data.tobytes(), []
            for i, doc_id in enumerate(ids):
                n, (h1, h2, h3, h4) = int(c.n[i]), draws(doc_id, f.seed)
                a, z = int(docs[i]), int(docs[i + 1])
                if not n or c.marked[i] or h3 % 100 >= f.rate:
                    rows.append((n, "plain", None, None, raw[a:z]))
                    continue
                lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
                p, q = c.place(i, lo), c.place(i, hi)
                chars = [c.chars_to(x) for x in (a, p, q)]
                prefix, middle, suffix = raw[a:p], raw[p:q], raw[q:z]
                spm = h4 % 100 < f.suffix_first
                text = b"<S>%b<P>%b<M>%b" % (suffix, prefix, middle) if spm else b"<P>%b<S>%b<M>%b" % (prefix, suffix, middle)
                rows.append((n, "spm" if spm else "psm", chars[1] - chars[0], chars[2] - chars[1], text))
            cols = [b.column(0), *(pa.array(col, kind) for col, kind in zip(list(zip(*rows))[:4], [pa.int64(), pa.string(), pa.int64(), pa.int64()]))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([r[4] for r in rows], pa.large_binary()).cast(pa.large_string())], schema=out)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return id_and_text(docs, id_col, text_col).mapInArrow(lean(cut), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No part of a cut text holds a marker, and none can come about where parts
    and markers meet, so the three markers stand where they were put."""
    part = lambda i: F.get(F.split(output, "<[PSM]>"), F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


def fim_digests(cut: DataFrame) -> DataFrame:
    """The columns of `fill_in_middle` with SHA-256 in place of the output, and that of the text rebuilt from it."""
    d = cut.withColumn("restored", restored(F.col("output"), F.col("form")))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
