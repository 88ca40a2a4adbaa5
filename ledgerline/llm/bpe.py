"""Byte-level BPE by automaton and backtracking, in time linear in the text.

The bytes of a piece are read as Latin-1 text, so that one Aho-Corasick pass (pyahocorasick) finds every vocabulary
token at every place. The longest token at a place is tried first; two neighbours are compatible if merging their joined
bytes by rank gives these two again, which is remembered for each pair. A sequence whose neighbours are all compatible
is the very one that rank-by-rank merging makes, so a dead end goes back to the next shorter token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .common import id_and_text, kept, lean, ranges, ship, steps

#: Bytes of text encoded and ids decoded at a time.
STEP_TEXT, STEP_IDS = 2 << 20, 300_000


class BytePairs:
    #: Entries of the pair and piece memories. A full pair memory starts anew; a full piece memory stays as it is, with
    #: the pieces met first, which are the frequent ones.
    PAIRS, PIECES = 300_000, 250_000

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for b, i in ranks.items():
            self.token[i] = b
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.length = [len(b) for b in self.token]
        self.pairs: dict[int, bool] = {}
        #: The longest token that is a proper prefix of each, or -1.
        self.shorter = [-1] * len(self.token)
        for b, i in ranks.items():
            self.shorter[i] = next((ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in ranks), -1)
        self.pieces: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[int]:
        """Rank by rank, as defined; only for the few bytes of two neighbours."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether right may follow left; left -1: whether right may begin a piece."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.PAIRS:
                self.pairs.clear()
            known = self.merged(self.token[right]) == [right] if left < 0 else self.merged(self.token[left] + self.token[right]) == [left, right]
            self.pairs[key] = known
        return known

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, length, shorter, known, fits = len(data), self.length, self.shorter, self.pairs.get, self.fits
        longest = [-1] * n
        for end, t in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - length[t]] = t  # a later end is a longer token
        dead, out, at, t, last = bytearray(n + 1), [], 0, longest[0], -1
        while True:
            while t >= 0:
                if not dead[at + length[t]]:
                    ok = known(last << 32 | t)
                    if fits(last, t) if ok is None else ok:
                        break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                at += length[t]
                if at == n:
                    return out
                last, t = t, longest[at]
            elif out:
                dead[at] = 1
                t = out.pop()
                at -= length[t]
                last, t = out[-1] if out else -1, shorter[t]
            else:
                raise ValueError("the vocabulary lacks single bytes of this text")

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different chunks (see chunks.Encode); each match of the pattern is a piece of its own."""
        pieces, find = self.pieces, self.find
        free = self.PIECES - len(pieces)
        parts: list[bytes] = []
        counts = np.zeros(len(words), np.int64)
        for k, w in enumerate(words):
            found = find(w)
            counts[k] = len(found)
            for p in found:
                ids = pieces.get(p)
                if ids is None:
                    ids = np.array(self.piece(p.encode()), "<i4").tobytes()
                    if free > 0 and len(p) < 100:
                        pieces[p] = ids
                        free -= 1
                parts.append(ids)
        lens = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        ends = np.concatenate(([0], np.cumsum(lens)))
        at = np.concatenate(([0], np.cumsum(counts)))
        return np.frombuffer(b"".join(parts), "<i4"), np.diff(ends[at])


def built(data: bytes, pattern: str) -> BytePairs:
    """From the bytes of a rank file; once for each worker."""
    key = ("pairs", hashlib.md5(data + pattern.encode()).hexdigest())
    if key not in kept:
        kept[key] = BytePairs({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}, pattern)
    return kept[key]


def rank_file(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # one file of under 1 MB, whatever the corpus


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids (array of int) of every whole text. A null or empty text has no ids; rows stay apart even if their
    document ids are equal or null; other columns are not read. No special tokens: their strings are ordinary text."""
    ship(docs.sparkSession)
    ranks = rank_file(docs, ranks_path)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = built(ranks.value, pattern)
        for b in steps(batches, "text", STEP_TEXT):
            flat, starts = chunks.encoded(b.column(1), bpe)
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], schema=out)

    return id_and_text(docs).mapInArrow(lean(encode, keep=True), "doc_id long, ids array<int>")


def bpe_decode(tokens: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """The ids column replaced by `decoded`, the bytes that the ids stand for (null ids: null). Other columns stay."""
    ship(tokens.sparkSession)
    ranks = rank_file(tokens, ranks_path)
    names = [c for c in tokens.columns if c != ids]
    schema = ", ".join([f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in names] + ["decoded binary"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = {int(b): base64.b64decode(a) for a, b in map(bytes.split, ranks.value.splitlines())}
        table = [data.get(i, b"") for i in range(max(data, default=-1) + 1)]
        lens = np.array([len(x) for x in table], np.int64)
        begins, joined = np.cumsum(lens) - lens, np.frombuffer(b"".join(table), np.uint8)
        for b in batches:
            ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(b.column(ids)), 0), np.int64))
            x = 0
            while x < b.num_rows:  # steps of so many ids, or a single row
                to = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + STEP_IDS, side="right")))
                own, x = b.slice(x, to - x), to
                col = own.column(ids)
                at = np.asarray(col.offsets, np.int64)
                flat = np.asarray(col.flatten() if col.null_count else col.values[at[0] : at[-1]])
                at = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0), np.int64))))
                each = lens[flat]
                cut = np.concatenate(([0], np.cumsum(each)))[at]
                out = joined[ranges(begins[flat], each)].tobytes()
                cells = [out[a:z] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())]
                mask = np.asarray(col.is_null())
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), pa.array(cells, pa.binary(), mask=mask)], names=[*names, "decoded"])

    return tokens.select(*names, ids).mapInArrow(lean(decode, keep=True), schema)


def token_digests(docs: DataFrame, ranks_path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the round trip."""
    encoded = bpe_encode(docs, ranks_path, pattern)
    decimal = F.concat_ws(",", F.col("ids").cast("array<string>"))
    kept = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), "ids")
    return bpe_decode(kept, ranks_path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
