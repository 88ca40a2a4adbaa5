"""Encoding with a tokenizers-library vocabulary inside tasks."""

from __future__ import annotations

import hashlib
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from .common import kept, ranges


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast value: one file of a few MB that doesn't grow with the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def load(data: bytes, literal: bool = False):
    """The tokenizer as the library loads it; each worker builds it once. literal: special tokens' strings in a text are
    ordinary text."""
    key = (f"tokenizer {literal}", hashlib.md5(data).hexdigest())
    if key not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(data.decode())
        t.encode_special_tokens = literal
        kept[key] = t
    return kept[key]


class Encoder:
    """Encodes different chunks and keeps the ids of the first `most` chunks it met, which hold the frequent words.

    Chunks that begin with a space and a non-space are joined and encoded many at a time: the pre-tokenizer cuts
    between them by itself, and the byte lengths of the tokens tell whose ids are whose. Special tokens' strings (`special`)
    are chunks of their own, as the library takes them out of a text before all else.
    """

    def __init__(self, data: bytes, most: int = 400_000, join: int = 1000, literal: bool = False):
        self.tokenizer, self.most, self.join = load(data, literal), most, join
        added = {} if literal else self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("special tokens that take what stands beside them need whole texts")
        self.special = tuple(t.content for t in added.values())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max([*vocabulary.values(), *added]) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(w) for w in vocabulary]
        self.bytes[list(added)] = [len(t.content.encode()) for t in added.values()]
        self.place: dict[str, int] = {}
        self.lens, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def fresh(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lens, parts = np.zeros(len(chunks), np.int64), []
        size = np.asarray(pc.binary_length(pa.array(chunks, pa.large_string())), np.int64)
        joined = [i for i, c in enumerate(chunks) if len(c) > 1 and c[0] == " " and not c[1].isspace()]
        groups = [joined[i : i + self.join] for i in range(0, len(joined), self.join)]
        alone = np.ones(len(chunks), bool)
        alone[joined] = False
        groups += [[i] for i in np.flatnonzero(alone).tolist()]
        order: list[int] = []
        texts = ["".join([chunks[i] for i in g]) for g in groups]
        for k in range(0, len(texts), 256):
            for g, e in zip(groups[k : k + 256], self.tokenizer.encode_batch_fast(texts[k : k + 256], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                ends = np.cumsum(size[g])
                at = np.searchsorted(np.cumsum(self.bytes[ids]), ends, side="left") + (ends > 0)
                lens[g] = np.diff(at, prepend=0)
                parts.append(ids)
                order += g
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        own = lens[order]
        begins = np.zeros(len(chunks), np.int64)
        begins[order] = np.cumsum(own) - own
        return flat[ranges(begins, lens)], lens

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known = np.fromiter(map(self.place.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(known < 0)
        ids, lens = self.fresh([chunks[i] for i in new.tolist()])
        had = len(self.lens)
        known[new] = had + np.arange(len(new))
        all_ids, all_lens = np.concatenate((self.ids, ids)), np.concatenate((self.lens, lens))
        begins = np.cumsum(all_lens) - all_lens
        if had < self.most and len(new):
            keep = min(len(new), self.most - had)
            self.place.update((chunks[i], had + k) for k, i in enumerate(new[:keep].tolist()))
            self.lens, self.ids = all_lens[: had + keep], all_ids[: int(all_lens[: had + keep].sum())].copy()
        each = all_lens[known]
        return all_ids[ranges(begins[known], each)], each


def encoder(data: bytes, literal: bool = False) -> Encoder:
    """One for each worker and vocabulary."""
    key = (f"encoder {literal}", hashlib.md5(data).hexdigest())
    if key not in kept:
        kept[key] = Encoder(data, literal=literal)
    return kept[key]
