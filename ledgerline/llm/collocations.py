"""Collocations: phrases of two or three words that come together more often than their parts.

Prefix-free parsing. A pair of words whose hash says so ends a chunk, and the next chunk begins with that pair again, so
neighbours overlap by two words and texts that share a passage share its chunks. Spark counts the different chunks of
each language (the dictionary and its parse frequencies), and n-grams are counted inside the different chunks only, each
weighted by its chunk's frequency. An n-gram counts in the chunk in which it begins before the overlap, so those of an
overlap count once, in the chunk behind it.

Two rounds keep rare n-grams, most of all, from travelling as text. In the first, tasks send hashes with counts, and
what reaches the threshold by hash is marked in a bitmap of bounded size: words and pairs, then triples both of whose pairs
are marked. In the second, marked n-grams are counted as text. Hashes that collide, or a full bitmap, only let more through;
what is counted at last is exact.

Defined results: a null text is an empty text; a null language is "und"; documents are rows, so repeated rows count again;
doc_id and other columns aren't read; no words, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, ranges, ship, spent, steps, strings, written
from .rolling import Rolling, mixed

#: Bytes of text in one step; n-grams a task gathers before it sends what it has counted.
STEP = 3 << 20
GATHERED = 3_000_000
#: Hashed n-grams that one section of the first round's counts holds, about.
SECTION = 2_000_000
#: The bitmap of marked n-grams has 2 ** MOST_BITS bits at most (16 MB).
MOST_BITS = 27
LINE, SPACE = 10, 32
#: A-Z in lower case, piece marks as line feeds, tabs as spaces.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[65:91] += 32
PLAIN[[*b".,;:!?\n\x0b\x0c\r"]] = LINE
PLAIN[9] = SPACE


@dataclass(frozen=True)
class Collocations:
    least: int = 10
    #: A triple with so many per cent of a pair's count takes that pair's place.
    contained: int = 50
    top: int = 2000
    #: One pair of words in so many ends a chunk.
    spacing: int = 32
    #: Parts that a language's candidates are ranked in before they meet.
    salts: int = 64


class Words:
    """The words of a step: where they begin and end in `data`, their text's number, and whether the piece goes on."""

    def __init__(self, data: np.ndarray, docs: np.ndarray, room: dict):
        self.data = data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = (data != LINE) & (data != SPACE)
        bounds = np.unique(docs)
        meet = bounds[inside[bounds] & inside[bounds + 1]]  # where a text ends in a word and the next begins with one
        places = np.sort(np.concatenate((np.flatnonzero(inside[1:] != inside[:-1]), meet, meet)))
        self.starts, self.ends = places[0::2], places[1::2]
        self.doc = np.searchsorted(docs, self.starts, side="right") - 1
        lines = np.concatenate(([0], np.cumsum(data == LINE)))
        self.same = self.doc[1:] == self.doc[:-1]
        self.goes_on = self.same & (lines[self.starts[1:]] == lines[self.ends[:-1]])
        self.rolling = Rolling(data, room)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array and where its strings begin (one more at the end)."""
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _chunks(texts: pa.Array, spacing: int, room: dict) -> tuple[pa.Array, np.ndarray]:
    """The chunks of texts, and each one's text. Words stand in them with one space between, or a line feed where a piece
    ends; a line feed ends a text's last chunk, a space all others."""
    data, docs = buffers(texts)
    data = PLAIN[data]
    w = Words(data, docs, room)
    n = len(w.starts)
    if not n:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    first = np.concatenate(([True], ~w.same))
    last = np.append(~w.same, True)
    pair = np.zeros(n, np.uint64)
    own = w.rolling.of(w.starts, w.ends)
    pair[:-1] = mixed(own[:-1] * np.uint64(3) + own[1:])
    cut = (pair % np.uint64(spacing) == 0) & ~first & ~last
    begins = np.flatnonzero(first | cut)
    final = np.append(first[begins[1:]], True)
    ends = np.append(begins[1:] - 1, n - 1)  # the last word of each chunk
    ends[~final] = begins[np.flatnonzero(~final) + 1] + 1
    word = ranges(begins, ends - begins + 1)
    lens = w.ends[word] - w.starts[word] + 1
    out = np.append(data, np.uint8(SPACE))[ranges(w.starts[word], lens)]
    stop = np.cumsum(lens)
    out[stop - 1] = np.where(np.append(w.goes_on, False)[word], SPACE, LINE)
    close = np.cumsum(ends - begins + 1) - 1
    at = stop[close]
    out[at - 1] = np.where(final, LINE, SPACE)
    offsets = np.concatenate(([0], at)).astype(np.int64)
    made = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))
    return made, w.doc[begins]


def dictionary(docs: DataFrame, rules: Collocations | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, chunk, freq: the different chunks of each language."""
    r = rules or Collocations()
    ship(docs.sparkSession)
    out = pa.schema([("lang", pa.string()), ("chunk", pa.large_string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room: dict = {}
        for b in steps(batches, "text", STEP):
            chunks, doc = _chunks(strings(b.column(1)), r.spacing, room)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), chunks], schema=out)

    d = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("string").alias("text"))
    return d.mapInArrow(lean(parse), "lang string, chunk string").groupBy("lang", "chunk").agg(F.count("*").alias("freq"))


class Grams:
    """The n-grams of a step of the dictionary."""

    def __init__(self, b: pa.RecordBatch, room: dict):
        langs = b.column("lang").dictionary_encode()
        names = langs.dictionary.to_pylist()
        data, at = buffers(strings(b.column("chunk")))
        self.w = w = Words(data, at, room)
        salt = np.array([xxhash.xxh3_64_intdigest(x) for x in names], np.uint64)
        self.langs, self.lang = langs.dictionary, np.asarray(langs.indices, np.int64)[w.doc]
        self.salt, self.weight = salt[self.lang], np.asarray(b.column("freq"), np.int64)[w.doc]
        n = len(w.starts)
        place = np.arange(n)
        length = np.bincount(w.doc, minlength=len(at) - 1)
        left = np.cumsum(length)[w.doc] - place  # words from here to the chunk's end
        self.counted = (left > 2) | (data[at[1:] - 1] == LINE)[w.doc]

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The places at which counted n-grams begin, and their hashes (with that of the language)."""
        w, ok = self.w, self.counted.copy()
        for k in range(n - 1):
            ok[: len(ok) - k - 1] &= w.goes_on[k:]
            ok[len(ok) - k - 1 :] = False
        at = np.flatnonzero(ok)
        return at, self.hashes(at, n)

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        return mixed(self.w.rolling.of(self.w.starts[at], self.w.ends[at + n - 1]) ^ self.salt[at])


def summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes in order, and the sum of the counts of each."""
    if not len(h):
        return h, c
    order = np.argsort(h)
    h, c = h[order], c[order]
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[at], np.add.reduceat(c, at)


class Marks:
    """A bitmap over the leading bits of hashes."""

    def __init__(self, data: bytes, bits: int):
        self.data, self.shift = np.frombuffer(data, np.uint8), np.uint64(64 - bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


def _marked(chunks: DataFrame, sizes: tuple[int, ...], words: int, least: int, below=None):
    """A broadcast bitmap of the n-grams of these sizes whose hashes count to `least`. below: the bitmap of pairs,
    for triples; one goes on only if both pairs within it are there. Tasks send a section's hashes and counts as one value,
    so what travels is 8 bytes and a little for each n-gram and task; sections are ranges of the hashes."""
    bits = min(MOST_BITS, max(16, (4 * words).bit_length()))
    sections = 1 << max(6, min(bits - 3, (2 * words // SECTION).bit_length()))
    per = 64 - sections.bit_length() + 1
    out = pa.schema([("section", pa.int32()), ("hashes", pa.large_binary()), ("counts", pa.large_binary())])

    def send(parts: list) -> pa.RecordBatch:
        h, c = summed(*(np.concatenate(x) for x in zip(*parts)))
        own, at = np.unique(h >> np.uint64(per), return_index=True)
        cuts = [*at.tolist(), len(h)]
        rows = [[x[a:z].tobytes() for a, z in zip(cuts, cuts[1:])] for x in (h, c)]
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(x, pa.large_binary()) for x in rows)], schema=out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, parts, held = {}, [], 0
        marks = below and Marks(below[0].value, below[1])
        for b in steps(batches, "chunk", STEP):
            g = Grams(b, room)
            for n in sizes:
                at, h = g.of(n)
                if marks:
                    known = np.zeros(len(g.counted), bool)
                    pairs = np.flatnonzero(g.w.goes_on)
                    known[pairs] = marks.has(g.hashes(pairs, 2))
                    keep = known[at] & known[at + 1]
                    at, h = at[keep], h[keep]
                parts.append(summed(h, g.weight[at]))
                held += len(parts[-1][0])
            if held > GATHERED:
                yield send(parts)
                parts, held = [], 0
        if held:
            yield send(parts)

    def mark(key, rows):
        import pandas as pd

        h, c = (np.concatenate([np.frombuffer(x, t) for x in rows[name]]) for name, t in (("hashes", np.uint64), ("counts", np.int64)))
        h, c = summed(h, c)
        own = np.zeros(1 << bits - sections.bit_length() + 1, np.uint8)
        own[(h[c >= least] >> np.uint64(64 - bits)).astype(np.int64) & len(own) - 1] = 1
        return pd.DataFrame({"section": [key[0]], "bits": [np.packbits(own).tobytes()]})

    found = chunks.mapInArrow(lean(count), "section int, hashes binary, counts binary").groupBy("section").applyInPandas(mark, "section int, bits binary")
    each = 1 << bits - sections.bit_length() + 1 - 3
    data = bytearray(each * sections)
    for row in found.collect():  # as many bytes as the bitmap has, whatever the corpus
        data[row["section"] * each : (row["section"] + 1) * each] = row["bits"]
    return chunks.sparkSession.sparkContext.broadcast(bytes(data)), bits


def _as_text(g: Grams, at: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the different n-grams among those at `at`, and their counts. What has another's hash but not its bytes
    stays apart."""
    order = np.argsort(h, kind="stable")
    at, h = at[order], h[order]
    starts, lens = g.w.starts[at], g.w.ends[at + n - 1] - g.w.starts[at]
    first = np.concatenate(([True], h[1:] != h[:-1]))
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    same = (lens == lens[head]) & (g.lang[at] == g.lang[at[head]])
    check = np.flatnonzero(same & ~first)
    differs = g.w.data[ranges(starts[check], lens[check])] != g.w.data[ranges(starts[head[check]], lens[check])]
    bad = np.add.reduceat(differs, np.cumsum(lens[check]) - lens[check]) > 0 if len(check) else np.zeros(0, bool)
    same[check[bad]] = False
    weight = g.weight[at]
    sums = np.bincount(head[same], weights=weight[same].astype(np.float64), minlength=len(at)) if weight.max() < 1 << 20 else None
    if sums is None:
        sums = np.zeros(len(at), np.int64)
        np.add.at(sums, head[same], weight[same])
    rows = np.flatnonzero(first | ~same)
    return at[rows], np.where(first[rows], sums[rows].astype(np.int64), weight[rows])


def phrase_counts(chunks: DataFrame, words: int, least: int) -> DataFrame:
    """lang, n, phrase, f: the n-grams of one to three words that come `least` times or more; and for each language a row
    with n = 0 and all its words' number."""
    pairs = _marked(chunks, (1, 2), words, least)
    triples = _marked(chunks, (3,), words, least, below=pairs)
    out = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.large_string()), ("f", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room: dict = {}
        known = {1: Marks(pairs[0].value, pairs[1]), 3: Marks(triples[0].value, triples[1])}
        known[2] = known[1]
        for b in steps(batches, "chunk", STEP):
            g = Grams(b, room)
            total = np.bincount(g.lang[g.counted], weights=g.weight[g.counted], minlength=len(g.langs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([g.langs.cast(pa.string()), pa.array(np.zeros(len(g.langs), np.int32)), pa.array([""] * len(g.langs), pa.large_string()), pa.array(total)], schema=out)
            for n in (1, 2, 3):
                at, h = g.of(n)
                keep = known[n].has(h)
                at, h = at[keep], h[keep]
                if not len(at):
                    continue
                at, f = _as_text(g, at, h, n)
                starts, lens = g.w.starts[at], g.w.ends[at + n - 1] - g.w.starts[at]
                offsets = np.concatenate(([0], np.cumsum(lens))).astype(np.int64)
                phrases = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(g.w.data[ranges(starts, lens)].tobytes()))
                yield pa.RecordBatch.from_arrays([pc.take(g.langs, pa.array(g.lang[at])).cast(pa.string()), pa.array(np.full(len(at), n, np.int32)), phrases, pa.array(f)], schema=out)

    counts = chunks.mapInArrow(lean(count), "lang string, n int, phrase string, f long").groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))
    return counts.filter((F.col("n") == 0) | (F.col("f") >= least))


def scored(counts: DataFrame, r: Collocations) -> DataFrame:
    """lang, phrase, a, l, r, score of all candidates that no longer one replaces."""
    part = counts.filter("n in (1, 2)").select("lang", F.col("phrase").alias("part"), "f")
    words = F.split("phrase", " ")
    cut = lambda k: F.struct(F.lit(k).alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("head"), F.array_join(F.slice(words, k + 1, 2), " ").alias("tail"))
    cands = counts.filter("n in (2, 3)")
    cuts = cands.select("lang", "n", "phrase", F.col("f").alias("a"), F.explode(F.when(F.col("n") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))).alias("c")).select("lang", "n", "phrase", "a", "c.*")
    left, right = part.toDF("lang", "head", "l"), part.toDF("lang", "tail", "r")
    cuts = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"])
    whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    # 10^6 * a * a over l * r in whole numbers: exact for counts below 10^13
    cuts = cuts.withColumn("top", F.lit(1_000_000).cast("decimal(7,0)") * whole("a", 13) * whole("a", 13)).withColumn("bottom", whole("l", 18) * whole("r", 18))
    best = cuts.groupBy("lang", "n", "phrase", "a").agg(F.min(F.struct(F.expr("top div bottom").alias("score"), "k", "l", "r")).alias("b"))
    inner = cands.filter("n = 3").select("lang", F.explode(F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " "))).alias("phrase"), F.col("f").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left_over = best.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("n") == 3) | (100 * F.col("longer") < r.contained * F.col("a")))
    return left_over.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, rules: Collocations | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best `top` phrases. A language's candidates are ranked in
    parts first, so no task gets all of them."""
    r = rules or Collocations()
    chunks = written(dictionary(docs, r, text_col, lang_col), "chunks")
    words = chunks.agg(F.coalesce(F.sum(F.length("chunk")), F.lit(0)).alias("n")).first()["n"] // 6 + 1
    counts = written(phrase_counts(chunks, words, r.least), "phrases")
    spent(chunks)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    ranked = lambda d, *by: d.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= r.top)
    salted = scored(counts, r).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(r.salts)))
    best = ranked(ranked(salted, "lang", "salt").drop("rank", "salt"), "lang")
    total = counts.filter("n = 0").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
