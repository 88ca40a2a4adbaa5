import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import licenses, topk



def brute(rows, k):
    whole = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in whole:
        if q % 3 == 0:
            scores = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return out


@pytest.mark.parametrize("shards,block", [(1, 7), (5, 2048)])
def test_top_k(spark, shards, block):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)]) for i in range(90)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, [0.0] * 8), (103, None), (104, [float("nan")] * 8), (105, [None] + [0.1] * 7), (106, [float("inf")] * 8), (107, [0.5, 0.5]), (108, []), (None, [1.0] * 8)]
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, shard int, score int")
    got = topk.top_inner_products(vectors, F.col("vec_id") % 3 == 0, k=5, shards=shards, block=block)
    assert {tuple(r) for r in got.collect()} == brute(rows, 5)


def test_top_k_few_and_large(spark):
    rows = [(0, [1e9, -1e9, 3.0]), (3, [1e9, 1e9, 2.0]), (4, [-1e9, 1e9, 1.0])]
    few = spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>")
    small = [(i, [x / 1e9 for x in v]) for i, v in rows[:2]]
    assert {tuple(r) for r in topk.top_inner_products(spark.createDataFrame(small, few.schema), F.col("vec_id") % 3 == 0).collect()} == brute(small, 5)
    none = few.filter("false")
    assert topk.top_inner_products(none, F.col("vec_id") % 3 == 0).count() == 0


def windows_by_hand(text, r):
    """Templates whose shingles' share in some stretch of the text as long as the template reaches the limit."""
    found = set()
    for name, t in licenses.TEMPLATES.items():
        words = len(licenses.WORD.findall(t.encode().lower()))
        k = min(r.words, words)
        s, own = licenses.shingles(text, k), set(licenses.shingles(t, r.words).tolist())
        m = words - k + 1
        if len(s) and max(len(own & set(s[i : i + m].tolist())) for i in range(max(1, len(s) - m + 1))) >= r.contained * len(own):
            found.add(name)
    return found


def test_licenses(spark, odd, nothing):
    r = licenses.ScanRules()
    texts = ["", None, "nothing of the kind " * 50] + [("filler words go here " * 40) + t + (" and more of it" * 30) for t in licenses.TEMPLATES.values()]
    edited = licenses.TEMPLATES["MIT-grant"].replace("without restriction", "with no restriction")
    texts += [edited, "x " * 500 + "RELEASED   under the\nMIT License", "Released under the BSD License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for row in licenses.scan_licenses(docs).collect():
        got.setdefault(row["doc_id"], set()).add(row["template"])
        assert row["contained"] >= r.contained
    assert got == {i: w for i, t in enumerate(texts) if (w := windows_by_hand(t or "", r))}
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(nothing).count() == 0
    assert licenses.licenses_of(docs).filter("hits >= 1").count() >= len(licenses.TEMPLATES)


def test_license_lines_of_documents(spark):
    """Lines as they stand in the tables' documents and in the wild, not made from the templates."""
    want = {
        "Licensed under CC BY-NC 4.0.": {"CC-BY-NC-4.0-short"},
        "This work is licensed under the GNU General Public License, version 3.": {"GPL-3.0-notice"},
        "Licensed under the GNU General Public License, version 2.": {"GPL-2.0-notice"},
        "Released under the MIT License.": {"MIT-notice"},
        "Licensed under the Apache License, Version 2.0.": {"Apache-2.0-notice"},
        "Licensed under CC BY-NC-ND 3.0": {"CC-BY-NC-ND-3.0-short"},
        "// SPDX-License-Identifier: AGPL-3.0-only": {"AGPL-3.0-only-spdx"},
        "licensed under the GNU Affero General Public License, version 3": {"AGPL-3.0-notice"},
    }
    docs = spark.createDataFrame([(i, f"Mit und enbe ter\n{t}\nEn erach ge") for i, t in enumerate(want)], "doc_id long, text string")
    got = {}
    for r in licenses.find_licenses(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["template"])
    assert got == dict(enumerate(want.values()))


def test_whole_licenses(spark):
    texts = licenses.bodies()
    docs = spark.createDataFrame([(i, f"Ein wort davor {t} und danach") for i, t in enumerate(texts.values())], "doc_id long, text string")
    got = {}
    for r in licenses.find_licenses(docs).filter("template like '%-text' and contained = 1").collect():
        got.setdefault(r["doc_id"], set()).add(r["template"])
    assert got == {i: {n} for i, n in enumerate(texts)}


def test_top_k_tiles(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 6)]) for i in range(80)]
    got = topk.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 3 == 0, shards=3, tiles=4, block=9)
    assert {tuple(r) for r in got.collect()} == brute(rows, 5)


def test_bands_alone_find_templates_with_the_claimed_probability():
    r, rng = licenses.ScanRules(), np.random.default_rng(6)
    for m in (40, 200):
        stride, found = m // 4, 0
        for _ in range(300):
            template = rng.integers(0, 2**63, m, dtype=np.uint64)
            held = rng.permutation(template)[: math.ceil(r.contained * m)]
            window = np.concatenate((held, rng.integers(0, 2**63, m + stride - len(held), dtype=np.uint64)))
            a, b = (licenses.minima(v[None, :], r)[0].reshape(r.bands, r.rows) for v in (template, window))
            found += (a == b).all(axis=1).any()
        assert found >= 299, (m, found)
