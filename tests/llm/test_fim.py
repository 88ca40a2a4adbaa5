import hashlib
import random
import re
from collections import Counter

from ledgerline.llm import fim

from .conftest import ODD

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def by_hand(doc_id, text, rate=50):
    t = text or ""
    units = UNIT.findall(t)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, t
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return doc_id, n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def texts():
    rng = random.Random(11)
    alphabet = ["a", "b", " ", "\n", "\t", "é", "日本", "🙂", "<P", "<", ">", "S>", "<S>", " the ", "\x1c", "　"]
    out = ["".join(rng.choices(alphabet, [9, 9, 5, 1, 1, 2, 1, 1, 0.3, 0.3, 0.3, 0.3, 0.05, 6, 1, 1], k=rng.randint(0, 120))) for _ in range(400)]
    shared = " ".join(f"word{i % 37}" for i in range(900))
    return [*out, *(f"{i} {shared} tail {i}" for i in range(30)), "a" * 5000, " " * 5000, "a " * 5000, " a" * 3000 + "\n"]


def test_outputs_and_round_trip(spark, odd, nothing):
    rows = ODD + list(enumerate(texts(), 100))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, output string")
    for rules in (fim.Fim(), fim.Fim(window=4, spacing=4, least=4, cache=200, rate=100)):
        cut = fim.fill_in_middle(docs, rules)
        assert Counter(map(tuple, cut.collect())) == Counter(by_hand(i, t, rules.rate) for i, t in rows)
        back = Counter((r["doc_id"], r["t"]) for r in cut.select("doc_id", fim.restored(cut["output"], cut["form"]).alias("t")).collect())
        assert back == Counter((i, t or "") for i, t in rows)
    assert fim.fim_digests(fim.fill_in_middle(nothing)).count() == 0
    assert fim.fim_digests(fim.fill_in_middle(odd)).count() == len(ODD)


def test_equal_chunks_are_summed_up_once():
    import numpy as np

    shared = b" ".join(b"passage%d" % (i % 101) for i in range(4000))
    data = np.frombuffer(b"one " + shared + b"another beginning " + shared, np.uint8)
    docs = np.array([0, 4 + len(shared), len(data)])
    asked = []

    class Counting(fim.Memo):
        def __call__(self, pieces):
            asked.extend(pieces)
            return super().__call__(pieces)

    memo = Counting(1 << 20)
    c = fim.Cutter(data, docs, fim.Fim(), memo, {})
    assert len(set(asked)) < 0.7 * len(asked) and c.n.tolist() == [4001, 4002]
    memo.known = {k: (b"other bytes", s) for k, (_, s) in memo.known.items()}  # the same hash, other bytes: not taken
    assert fim.Cutter(data, docs, fim.Fim(), memo, {}).n.tolist() == [4001, 4002]
