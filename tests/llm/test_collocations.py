import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from ledgerline.llm import collocations as C

from .conftest import ODD


def by_hand(rows, r):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= r.least}
    longest = Counter()
    for (lang, w), a in cands.items():
        if len(w) == 3:
            for pair in (w[:2], w[1:]):
                longest[lang, pair] = max(longest[lang, pair], a)
    out = []
    for (lang, w), a in cands.items():
        if len(w) == 2 and 100 * longest[lang, w] >= r.contained * a:
            continue
        score, k, left, right = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[: r.top]
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(own)]
    return sorted(ranked)


def rows():
    rng = random.Random(12)
    words, marks = ["New", "york", "city", "of", "the", "a", "é", "日本", "x\x00y", "stock", "　", "a\x1cb"], [" ", " ", " ", "\t ", ", ", ". ", "\n", "!\r\n", ""]
    text = lambda: "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 90)))
    out = [(rng.choice(["en", "de", None, "und", ""]), text()) for _ in range(250)]
    passage = text() * 3
    return out + [("en", f"{text()} {passage}") for _ in range(60)] + [("en", t) for _, t in ODD] + [("one", "w " * 3000)]


def test_same_as_by_hand(spark, odd, nothing):
    data = rows()
    docs = spark.createDataFrame([(i, t, lang, "x", 1) for i, (lang, t) in enumerate(data)], "doc_id long, text string, lang string, phrase string, n int")
    for r in (C.Collocations(least=3, spacing=2, top=60), C.Collocations(spacing=7, salts=2)):
        got = C.collocations(docs.repartition(3), r)
        assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == by_hand(data, r)
    odd, nothing = (d.withColumnRenamed("begin", "lang") for d in (odd, nothing))
    assert C.collocations(nothing).count() == 0
    assert C.collocations(odd).count() == len(by_hand([("f", t) for _, t in ODD], C.Collocations()))


def test_a_full_bitmap_and_equal_hashes_change_nothing(spark, monkeypatch):
    data = rows()[:120]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(data)], "doc_id long, text string, lang string")
    r = C.Collocations(least=2, spacing=3)
    monkeypatch.setattr(C, "MOST_BITS", 9)
    assert sorted(map(tuple, C.collocations(docs, r).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == by_hand(data, r)
    chunks = pa.RecordBatch.from_pydict({"lang": ["en"] * 2, "chunk": ["a b a c\n", "a b a d\n"], "freq": [2, 3]}, pa.schema([("lang", pa.string()), ("chunk", pa.large_string()), ("freq", pa.int64())]))
    g = C.Grams(chunks, {})
    at, h = g.of(1)
    places, counts = C._as_text(g, at, np.zeros_like(h), 1)  # all hashes alike
    found = Counter()
    for p, c in zip(places, counts.tolist()):
        found[bytes(g.w.data[g.w.starts[p] : g.w.ends[p]])] += c
    assert found == {b"a": 10, b"b": 5, b"c": 2, b"d": 3}


def test_a_shared_passage_falls_into_shared_chunks(spark):
    rng = random.Random(5)
    passage = " ".join(f"w{rng.randint(0, 300)}" for _ in range(3000))
    docs = spark.createDataFrame([(f"begin{i} {passage} end{i}", "en") for i in range(40)], "text string, lang string")
    freq = [r["freq"] for r in C.dictionary(docs).collect()]
    assert sum(f == 40 for f in freq) > 50 and sum(f == 1 for f in freq) <= 3 * 40
