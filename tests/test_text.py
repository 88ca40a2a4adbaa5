"""Words and windows in long texts and in characters outside the first plane, against Python's own expressions."""

import random
import re
import time

from pyspark.sql import functions as F

from ledgerline.functions import text as T


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def random_texts(words, n, seed, most=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(words) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_earliest_counts_code_points(spark):
    texts = ["\U0001f600\U0001f600 that", "the" + "\U0001f600" * 20 + "that", "the" + "\U0001f600" * 28 + "que", "the" + "." * 27 + "that", "the" + "." * 28 + "that", "the that License", "", None, "License", "thethat" * 9 + " " * 28 + "que"]
    texts += random_texts(["the", "that", "que", "License", " ", "\U0001f600", "xyz uvw klm ", "é", "\n"], 200, 1, 60)
    got = {r["id"]: r["m"] and tuple(r["m"]) for r in frame(spark, texts).select("id", T.earliest(F.col("text"), ["License", "that", "que"], "the").alias("m")).collect()}
    for i, t in enumerate(texts):
        found = [(m.start() + 1, w) for w in ("License", "that", "que") for m in re.finditer(w, t or "") if "the" not in t[max(m.start() - 30, 0) : m.start()]]
        assert got[i] == min(found, default=None)


def test_keyword_windows_as_the_expression_and_in_long_lines(spark):
    texts = ["", None, "License", "\U0001f600" * 300 + "License" + "é" * 300, "aLicense" * 90, "Ab Cd License\nLicense Ef Gh\nnone"]
    texts += random_texts(["License", "Lic", "Ab Cd ", "x" * 40, "y" * 97, "\U0001f600", "\n", "GNU "], 150, 2, 60)
    f = frame(spark, texts)
    for around, most in ((230, 6), (20, 100), (0, 3)):
        got = {r["id"]: r["w"] for r in f.select("id", T.keyword_windows(F.col("text"), "License", "[A-Z][a-z]+ [A-Z][a-z]+", "GNU.*GNU", around, most).alias("w")).collect()}
        for i, t in enumerate(texts):
            wins = re.findall(rf"[^\n]{{0,{around}}}License[^\n]{{0,{around}}}", t or "")
            want = [w for w in wins if re.search("[A-Z][a-z]+ [A-Z][a-z]+", w) and not re.search("GNU.*GNU", w)][:most]
            assert (got[i] or []) == want
    long = frame(spark, ["x" * 3_000_000 + "\n" + "y" * 3_000_000 + " Ab Cd License"])
    began = time.time()
    assert len(long.select(F.explode(T.keyword_windows(F.col("text"), "License", "[A-Z][a-z]+ [A-Z][a-z]+")).alias("w")).collect()) == 1
    assert time.time() - began < 10
