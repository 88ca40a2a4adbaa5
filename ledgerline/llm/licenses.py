"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Windows are as long as a template and a stride more, and overlap so that every occurrence of a template lies whole in one
of them. A window and a template get the same number of minima under the same permutations; templates that share a band
(`rows` minima in a row) are candidates. For a window that holds `contained` of a template's shingles the similarity s
of the two sets is at least contained * m / (2 * m + stride - contained * m) with m shingles, over 0.45 in the worst
case, so with 2 rows and 32 bands a collision comes with probability 1 - (1 - s ** 2) ** 32 > 0.999. Then all shingles
of the candidate are looked for in the window; the shares that reach `contained` are hits.

A band can collide only where a window's minimum is a template's shingle. So windows without any shingle of a template
of their size are passed over before their minima are made, with the same result.

Words are runs of letters and digits, A-Z in lower case; shingles have five words (a shorter template is one shingle).
Defined results: null, empty and short texts have no hits; rows are scanned each on their own, whatever their document
ids; templates without a word are left out; other columns aren't read.

scan_licenses gives every hit of the templates it is handed. find_licenses scans for all known notices and whole bodies;
there a hit gives way to a better one of a similar template over the same words, so that of several versions the one that
stands in the text is kept.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, lean, ship, steps

#: Notices of public licenses (fixed values).
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-notice": "licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-header": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "BSD-header": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "no-warranty": "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
}

CC = {
    "CC-BY": ("BY", "Attribution"),
    "CC-BY-SA": ("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-NC": ("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-ND": ("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-SA": ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND": ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
}
GNU = {"GPL": ("General", "1 2 3"), "LGPL": ("Lesser General", "2.1 3"), "AGPL": ("Affero General", "3")}
SPDX = (
    "MIT ISC 0BSD Zlib BSL-1.0 Unlicense CC0-1.0 Apache-2.0 BSD-2-Clause BSD-3-Clause MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 GPL-2.0-only"
    " GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later"
)


def notices() -> dict[str, str]:
    """The short notices beside TEMPLATES; each version is a template of its own."""
    out = {
        "MIT-licensed": "Licensed under the MIT License",
        "ISC-notice": "Licensed under the ISC License",
        "BSD-2-Clause-notice": "Licensed under the BSD 2-Clause License",
        "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License",
        "MPL-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0",
        "MPL-1.1-notice": "Licensed under the Mozilla Public License, Version 1.1",
        "EPL-1.0-notice": "Licensed under the Eclipse Public License, Version 1.0",
        "EPL-2.0-notice": "Licensed under the Eclipse Public License, Version 2.0",
        "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0",
        "Unlicense-notice": "This is free and unencumbered software released into the public domain",
        "CC0-1.0-notice": "CC0 1.0 Universal",
        "LGPL-2.0-header": "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation",
        "AGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    }
    for name, (short, long) in CC.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            kind = "International" if v == "4.0" else "Unported" if v == "3.0" else "Generic"
            out[f"{name}-{v}-short"] = f"Licensed under CC {short} {v}"
            out[f"{name}-{v}-notice"] = f"This work is licensed under a Creative Commons {long} {v} {kind} License"
    for name, (kind, versions) in GNU.items():
        out[f"{name}-notice"] = f"licensed under the GNU {kind} Public License"
        for v in versions.split():
            out[f"{name}-{v if '.' in v else v + '.0'}-notice"] = f"licensed under the GNU {kind} Public License, version {v}"
    for x in SPDX.split():
        out[f"{x}-spdx"] = f"SPDX-License-Identifier: {x}"
    return {n: t for n, t in out.items() if n not in TEMPLATES}


def bodies() -> dict[str, str]:
    """Whole licenses, from the folder beside this file; only the driver reads it."""
    folder = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
    out = {}
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            out[f"{name.removesuffix('.txt')}-text"] = f.read()
    return out


WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class ScanRules:
    words: int = 5
    contained: float = 0.8
    bands: int = 32
    rows: int = 2


def word_hashes(text: str) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.array([h(x) for x in WORD.findall(text.encode().lower())], np.uint64)


def shingles(text: str, k: int) -> np.ndarray:
    """A hash for each k-word shingle in order; a text of fewer words has one, of all it has."""
    return shingles_of(word_hashes(text), k)


def shingles_of(w: np.ndarray, k: int) -> np.ndarray:
    if not len(w):
        return w
    k = min(k, len(w))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(31))) * ODD + w[j : len(w) - k + 1 + j]
    return out


def minima(sets: np.ndarray, r: ScanRules) -> np.ndarray:
    """For each row of shingle hashes, bands * rows minima under multiply-and-shift permutations."""
    factors = np.random.default_rng(11).integers(1, 1 << 63, r.bands * r.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), len(factors)), np.uint64)
    for j, f in enumerate(factors):
        x = sets * f
        out[:, j] = ((x ^ (x >> np.uint64(32))) * ODD).min(axis=1)
    return out


class Scanner:
    def __init__(self, templates: Mapping[str, str], r: ScanRules):
        self.r = r
        self.sets = {n: np.unique(s) for n, t in sorted(templates.items()) if len(s := shingles(t, r.words))}
        self.sizes: dict[tuple[int, int], list[str]] = {}
        for n, s in self.sets.items():
            words = len(WORD.findall(templates[n].encode().lower()))
            self.sizes.setdefault((words, min(r.words, words)), []).append(n)
        self.bands = {}
        for size, names in self.sizes.items():
            table: dict[tuple[int, bytes], list[str]] = {}
            for n in names:
                m = minima(self.sets[n][None, :], r)[0].reshape(r.bands, r.rows)
                for b in range(r.bands):
                    table.setdefault((b, m[b].tobytes()), []).append(n)
            self.bands[size] = table, np.unique(np.concatenate([self.sets[n] for n in names]))
        #: All templates' shingles by their words; a text without any of them is passed over at once.
        self.known = {k: np.unique(np.concatenate([self.bands[s][1] for s in self.sizes if s[1] == k])) for _, k in self.sizes}

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, first word, end, share of its shingles) of each stretch of windows that hold it."""
        r, hits, by_k, w = self.r, [], {}, word_hashes(text)
        for (n, k), names in self.sizes.items():
            if k not in by_k:
                s, known = shingles_of(w, k), self.known[k]
                by_k[k] = s, bool((known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s).any())
            s, some = by_k[k]
            if not some:
                continue
            table, known = self.bands[n, k]
            there = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s
            # a window with fewer known shingles than the smallest template needs can hold none
            need = max(1, math.ceil(r.contained * min(len(self.sets[c]) for c in names) - 1e-9))
            if there.sum() < need:
                continue
            m = n - k + 1
            stride = max(1, m // 4)
            long = min(m + stride, len(s))
            starts = np.arange(0, max(1, len(s) - long + stride), stride)
            starts = np.unique(np.minimum(starts, len(s) - long))
            total = np.concatenate(([0], np.cumsum(there)))
            starts = starts[total[starts + long] - total[starts] >= need]
            least: dict[str, list[tuple[int, int, float]]] = {}
            block = max(1, (1 << 18) // max(long, 1))
            for x in range(0, len(starts), block):
                own = starts[x : x + block]
                rows = s[own[:, None] + np.arange(long)]
                sketch = minima(rows, r).reshape(len(own), r.bands, r.rows)
                for i, at in enumerate(own.tolist()):
                    found = {c for b in range(r.bands) for c in table.get((b, sketch[i, b].tobytes()), ())}
                    for c in sorted(found):
                        inside = np.flatnonzero(np.isin(rows[i], self.sets[c]))
                        share = len(np.unique(rows[i][inside])) / len(self.sets[c])
                        if share >= r.contained:
                            least.setdefault(c, []).append((at + int(inside[0]), at + int(inside[-1]) + k, share))
            for c, spans in least.items():
                spans.sort()
                begin, end, best = spans[0]
                for a, z, share in spans[1:]:
                    if a < end:
                        end, best = max(end, z), max(best, share)
                    else:
                        hits.append((c, begin, end, best))
                        begin, end, best = a, z, share
                hits.append((c, begin, end, best))
        return sorted(hits)

    def similar(self, a: str, b: str) -> bool:
        """Whether two templates share at least half of the larger one's shingles."""
        x, y = self.sets[a], self.sets[b]
        if 2 * min(len(x), len(y)) < max(len(x), len(y)):
            return False
        return 2 * len(np.intersect1d(x, y, assume_unique=True)) >= max(len(x), len(y))

    def best(self, hits: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
        """hits without those that overlap a better one of a similar template: a larger share, then more shingles."""

        def gives_way(a: tuple[str, int, int, float], b: tuple[str, int, int, float]) -> bool:
            over = a[1] < b[2] and b[1] < a[2] and a[0] != b[0]
            return over and (b[3], len(self.sets[b[0]])) > (a[3], len(self.sets[a[0]])) and self.similar(a[0], b[0])

        return [a for a in hits if not any(gives_way(a, b) for b in hits)]


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] | None = None, rules: ScanRules | None = None, best: bool = False) -> DataFrame:
    """doc_id, template, begin, end (words, end excluded), contained: every hit in every whole text, or the best ones.

    The templates are a parameter of the job and go to every task; they don't grow with the corpus.
    """
    spark = docs.sparkSession
    ship(spark)
    shared, r = spark.sparkContext.broadcast(dict(templates or TEMPLATES)), rules or ScanRules()
    out = pa.schema([("doc_id", pa.int64()), ("template", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("contained", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, r)
        found_in = (lambda t: scanner.best(scanner.scan(t))) if best else scanner.scan
        for b in steps(batches, "text"):
            found = [(i, *h) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for h in found_in(t)]
            cols = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    return id_and_text(docs).mapInArrow(lean(scan), "doc_id long, template string, begin long, end long, contained double")


def find_licenses(docs: DataFrame, rules: ScanRules | None = None) -> DataFrame:
    """scan_licenses for all notices and whole bodies, with the best hits kept."""
    return scan_licenses(docs, TEMPLATES | notices() | bodies(), rules, best=True)


def licenses_of(docs: DataFrame, templates: Mapping[str, str] | None = None, rules: ScanRules | None = None) -> DataFrame:
    """doc_id, template, hits, contained (the best): one row for each document and template found in it."""
    found = scan_licenses(docs, templates, rules)
    return found.groupBy("doc_id", "template").agg(F.count("*").alias("hits"), F.max("contained").alias("contained"))
