import random
import unicodedata

from pyspark.sql import functions as F

from ledgerline.functions.folding import PLAIN, POLISH, fold, normalize_name
from ledgerline.operators.matching import best_matches, lcs_lengths, match_entries, token_sort_ratio


def lcs_by_hand(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def ratio_by_hand(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    return 200 * lcs_by_hand(a, b) / (len(a) + len(b)) if a or b else 100.0


def test_lcs_of_short_and_long_strings():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdé🙂 ", k=n))
    lens = [0, 1, 2, 5, 30, 62, 63, 64, 65, 130]
    xs, ys = zip(*[(text(a), text(b)) for a in lens for b in lens for _ in range(2)])
    assert lcs_lengths(list(xs), list(ys)).tolist() == [lcs_by_hand(x, y) for x, y in zip(xs, ys)]
    assert lcs_lengths([], []).tolist() == []


def test_fold(spark):
    texts = ["Zażółć GĘŚLĄ jaźń", "ﬁn ﬀ ½ ㎏ Ⅳ", "ｆｕｌｌ １２", "straße € 日本 🙂", "é 𝐁old", None, "", "plain"]
    strip = lambda t: None if t is None else unicodedata.normalize("NFKD", t.translate(str.maketrans(POLISH, PLAIN))).encode("ascii", "ignore").decode()
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(fold(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in got] == [strip(t) for t in texts]


def test_normalize_name(spark):
    names = {"II LO im. Zofii Nałkowskiej": "II LICEUM OGOLNOKSZTALCACE ZOFII NALKOWSKIEJ", "lo nr. 5, z oddz. dwujęz.": "LICEUM OGOLNOKSZTALCACE NR 5 Z ODDZIALAMI DWUJEZYCZNYMI", "Lotnicze LO-2 Międzynar. ": "LOTNICZE LICEUM OGOLNOKSZTALCACE 2 MIEDZYNARODOWYMI", "zsim. x": "ZSIM X"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", normalize_name(F.col("n")).alias("f")).collect()
    assert {r["n"]: r["f"] for r in got} == names


def by_hand(entries, cands, least):
    norm = lambda t: " ".join((t or "").upper().split())
    out = {}
    for block, i, name in entries:
        best = None
        for other, k, cand in cands:
            if block is not None and other == block and k != i:
                score = ratio_by_hand(norm(name), norm(cand))
                if score >= least and (best is None or (score, -k) > (best[1], -best[0])):
                    best = (k, score)
        if best:
            out[i] = best
    return out


def test_best_matches_against_all_pairs(spark):
    rng = random.Random(8)
    words = ["red", "blue", "small", "smal", "ring", "bolt", "bolts", "nut", "7", "a"]
    name = lambda: rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 4)))])
    rows = [(rng.choice(["hot", "hot", "b", None]), i, " ".join(rng.choices(words, k=rng.randint(1, 5))) if rng.random() < 0.9 else name()) for i in range(400)]
    rows += [("hot", 1000 + i, "red ring small") for i in range(80)] + [("long", 2000 + i, f"{'very ' * 30}long name {i % 3}") for i in range(6)]
    entries = [r for r in rows if r[1] % 7 == 0]
    frame = lambda r, n: spark.createDataFrame(r, f"block string, {n} long, name string")
    for least in (80.0, 0.0):
        got = best_matches(frame(entries, "entry_id"), frame(rows, "cand_id"), ["block"], least).collect()
        want = by_hand(entries, rows, least)
        assert {r["entry_id"]: (r["cand_id"], round(r["score"], 6)) for r in got} == {i: (k, round(s, 6)) for i, (k, s) in want.items()}
    found = match_entries(frame(entries, "entry_id"), frame(rows, "cand_id"), ["block"])
    want = by_hand(entries, rows, 80)
    assert {r["entry_id"]: r["status"] for r in found.collect()} == {i: "discarded" if i not in want else "confirmed" if want[i][1] >= 90 else "auto" for _, i, _ in entries}
    assert best_matches(frame([], "entry_id"), frame(rows, "cand_id"), ["block"]).count() == 0


def test_ratio_of_sorted_words(spark):
    pairs = [("high school no 5", "no 5 high school"), ("abc", "abd"), ("", ""), ("a", ""), ("  x\ty ", "y x"), ("kitten", "sitting")]
    got = spark.createDataFrame(pairs, "a string, b string").select(token_sort_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [round(r["r"], 6) for r in got] == [round(ratio_by_hand(a, b), 6) for a, b in pairs]
