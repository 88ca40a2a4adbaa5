"""Texts cut where every byte-level pre-tokenizer cuts too, so that each different chunk is encoded once a step.

The published pattern (public_tokenizers.PATTERN) never lets a token run on over the place before a space that a
non-space follows, nor from a non-space to white space. Chunks between such places can be encoded apart from their
text, and most are words that come again and again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ranges, strings

#: Unicode's White_Space, which \s means in the pattern (fixed values).
WHITE = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Characters that str.isspace takes for white.
SPACES = pa.array([chr(c) for c in range(0x110000) if chr(c).isspace()], pa.large_string())

#: Encodes different chunks: all ids, one after the other, and the number of each chunk.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def coded(texts: pa.Array, special: tuple[str, ...] = ()) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different chunks, each text's chunks as places among them, and where each text's chunks begin. Strings in
    `special` are chunks of their own (the longest where several begin), and what stands between them is cut by itself."""
    texts = strings(texts)
    n = len(texts)
    parts = pc.split_pattern(texts, " ")
    at = np.asarray(parts.offsets, dtype=np.int64)
    at = at - at[0]
    flat = parts.flatten().dictionary_encode()
    words, code = flat.dictionary, np.asarray(flat.indices, dtype=np.int64)
    first = np.zeros(len(code), bool)
    first[at[:-1][at[:-1] < at[1:]]] = True
    none = np.asarray(pc.equal(pc.binary_length(words), 0))
    bare = none | np.asarray(pc.is_in(pc.utf8_slice_codeunits(words, 0, 1), value_set=SPACES))
    odd_text = np.zeros(n, bool)
    odd_text[np.searchsorted(at, np.flatnonzero(bare[code] & ~first), side="right") - 1] = True
    empty = first & none[code]
    for s in special:
        odd_text |= np.asarray(pc.match_substring(texts, s))
    key = code * 2 + first
    plain = ~np.repeat(odd_text, np.diff(at)) & ~empty
    there = np.zeros(2 * len(words), bool)
    there[key[plain]] = True
    used = np.flatnonzero(there)
    place = (np.cumsum(there) - 1)[key[plain]]
    own = words.take(pa.array(used >> 1))
    spaced = pc.binary_join_element_wise(pa.scalar(" ", own.type), own, pa.scalar("", own.type))
    chunks = pc.if_else(pa.array((used & 1).astype(bool)), own, spaced).to_pylist()
    counts = np.bincount(np.repeat(np.arange(n), np.diff(at))[plain], minlength=n)
    if not odd_text.any():
        return chunks, place, np.concatenate(([0], np.cumsum(counts)))
    seen = {w: i for i, w in enumerate(chunks)}
    more: list[int] = []
    apart = re.compile(f"({'|'.join(re.escape(s) for s in sorted(special, key=len, reverse=True))})") if special else None
    for i in np.flatnonzero(odd_text).tolist():
        parts = apart.split(texts[i].as_py()) if apart else [texts[i].as_py()]
        own = [w for k, part in enumerate(parts) for w in ([part] if k % 2 else CHUNK.findall(part))]
        for w in own:
            k = seen.get(w)
            if k is None:
                k = seen[w] = len(chunks)
                chunks.append(w)
            more.append(k)
        counts[i] = len(own)
    starts = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(int(starts[-1]), np.int64)
    odd = np.repeat(odd_text, counts)
    out[~odd], out[odd] = place, more
    return chunks, out, starts


def encoded(texts: pa.Array, encode: Encode) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, one after the other, and where each text's ids begin (one more at the end)."""
    chunks, place, starts = coded(texts, getattr(encode, "special", ()))
    ids, lens = encode(chunks)
    lens = np.asarray(lens, np.int64)
    begins = np.cumsum(lens) - lens
    each = lens[place]
    flat = ids[ranges(begins[place], each)]
    ends = np.concatenate(([0], np.cumsum(each)))
    return flat, ends[starts]
