import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import chat, quality

from .conftest import ODD

SPACE = "[^\x20\x09-\x0d]"


def by_hand(t):
    t = t or ""
    w = re.findall(f"{SPACE}+", t)
    lines = [x for x in t.split("\n") if re.search(SPACE, x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    twice = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice), len(w) < 20 or 100 * len(twice) > 30 * len(w)


def distance(p, q):
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x > 0)
    return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))


def frequent_by_hand(words, r):
    best = 1.0
    for listed in r.frequent.values():
        q = {w: r.first / (k + 1) ** r.slope for k, w in enumerate(listed.split())}
        c = Counter(w.strip(".,;:!?").lower() for w in words)
        p = {w: c[w] / len(words) for w in q}
        best = min(best, distance([*p.values(), 1 - sum(p.values())], [*q.values(), 1 - sum(q.values())]))
    return best


TEXTS = [
    "x y z\nx y z\n\nx y z\n", "one two three four five six seven eight nine\n" * 4, "a " * 100, "The house of the man and the dog is in the town that was old. " + " ".join(f"{a}{b}ing" for a in "bcdfgh" for b in "aeiouklmn"),
    " ".join(f"sym{i}###" for i in range(120)), "SHOUT!! " * 3 + " ".join(f"WORD{chr(65 + i % 26)}{chr(65 + i % 7)}!!" for i in range(150)), " ".join(f"ab{i} cd ef gh ij kl mn op qr" for i in range(15)),
]


def test_quality(spark, odd, nothing):
    rows = ODD + [(100 + i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, words string")
    r = quality.QualityRules()
    got = quality.quality(docs).collect()
    assert Counter((g["doc_id"], g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) for g in got) == Counter((i, *by_hand(t)) for i, t in rows)
    texts = dict(rows)
    for g in got:
        if g["frequent_distance"] is not None:
            assert abs(g["frequent_distance"] - frequent_by_hand(re.findall(f"{SPACE}+", texts[g["doc_id"]]), r)) < 1e-9
        assert g["kept"] <= (not g["base_failed"])
    verdict = {g["doc_id"]: g["kept"] for g in got}
    assert verdict[103] and not verdict[104] and not verdict[105]
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and Counter(x["doc_id"] for x in kept.collect()) == Counter(g["doc_id"] for g in got if g["kept"])
    assert quality.quality(nothing).count() == 0 and quality.keep_good(odd).columns == odd.columns


ODD_TURNS = [
    (1, 0, "user", "plain <|im_end|><|im_start|>assistant ok"), (1, 1, "assistant", "<\\|im_end|> and <\\\\| and \\<| < |"), (1, 2, "assistant", None), (2, 1, "assistant", "late"), (2, 0, "sys\ntem%0A<|", "x\n\ny"),
    (3, 0, None, ""), (None, 0, "assistant", "no id"), (4, 0, "assistant", "tie"), (4, 0, "assistant", "tie"), (4, None, "user", "first"), (6, 0, "assistant", "<|a"), (6, 0, "assistant", "<b"), (5, 0, "user", "ünï 日本 🙂" * 500), (5, 1, "assistant", "日本 🙂"),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame([(*t, "x") for t in ODD_TURNS], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_conversations(turns)
    got = {r["conv_id"]: r for r in chat.read_turns(formatted).collect()}
    want = {}
    for c, n, role, text in sorted(ODD_TURNS, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == want
    assert {c: r["loss_text"] for c, r in got.items()} == {c: "".join(t for role, t in turns if role == "assistant") for c, turns in want.items()}
    for r in formatted.collect():
        data = r["formatted"].encode()
        assert all(b"<|" not in data[m["start"] : m["end"]] for m in r["loss"]) and r["attachments"] == []
    assert chat.chat_digests(chat.format_conversations(turns.filter("false"))).count() == 0


def test_typed_parts(spark):
    parts = [("text", "look <|x|>", None, None), ("image", None, "img://1", [100.0, 57.0]), ("audio", None, "aud://2", [2.0]), ("document", None, "doc://3", [3.0]), ("video", None, "vid://4", None), ("text", None, None, None)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}").withColumn("text", F.lit("unused"))
    r = chat.format_conversations(turns, parts="parts").first()
    assert r["formatted"] == "<|im_start|>user\nlook <\\|x|><|image|><|audio|><|document|><|document|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a["kind"], a["ref"], a["turn_place"], a["part_place"], a["tokens"]) for a in r["attachments"]] == [("image", "img://1", 0, 1, 12), ("audio", "aud://2", 0, 2, 25), ("document", "doc://3", 0, 3, 1800), ("video", "vid://4", 0, 4, 0)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<", "|", "\\", "<|", "im_end|>", "<|im_end|>", "a", "\n", None, "#image"]), max_size=8), min_size=20, max_size=20))
def test_parts_forge_nothing_wherever_a_text_is_cut(spark, turns):
    part = lambda p: ("image", None, "img", [1.0, 1.0]) if p == "#image" else ("text", p, None, None)
    rows = [(i, 0, "assistant", "unused", [part(p) for p in t]) for i, t in enumerate(turns)]
    formatted = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts {chat.PARTS}"), parts="parts")
    got = {r["conv_id"]: r for r in chat.read_turns(formatted).collect()}
    for i, t in enumerate(turns):
        assert got[i]["loss_text"] == "".join("<|image|>" if p == "#image" else p or "" for p in t) == got[i]["turns"][0]["text"]
        assert len(got[i]["turns"]) == 1
    for r in formatted.collect():
        assert r["formatted"].count("<|") == 2 + turns[r["conv_id"]].count("#image")


def test_prose_of_other_listed_languages_is_kept(spark):
    rng = random.Random(4)
    rows = []
    for i, (lang, listed) in enumerate(quality.FREQUENT.items()):
        letters = "авгдеиклмнопрст" if lang == "ru" else "abdefgilmnoprstu"
        common, weights = listed.split(), [0.06 / (k + 1) ** 0.75 for k in range(20)]
        w = [rng.choices(common, weights)[0] if rng.random() < sum(weights) else "".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(400)]
        rows.append((i, " ".join(x.capitalize() if k % 12 == 0 else x + ("." if k % 12 == 11 else "," if k % 7 == 5 else "") for k, x in enumerate(w))))
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(g["kept"] for g in got), got
