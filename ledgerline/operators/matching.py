"""Names matched on the exact token-sort ratio: 200 * LCS / (m + n) of the sorted words.

Pairs are met within blocks only. Each different name of a block is compared once, whoever holds it; lengths that can't
reach the threshold never meet, as the length is part of the join key; and an upper bound of the LCS, the characters both
names have in common, sorts most of the rest out before the LCS itself is computed, bit-parallel over Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from ledgerline.functions.folding import normalize_name, normalize_name_sql
from ledgerline.plans.registry import query
from ledgerline.plans.shipping import ship

#: Least scores of a sure and of a likely match; below, an entry has none (fixed values).
SURE, LIKELY = 90.0, 80.0
#: Characters counted one by one for the bound; all others count together.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 "
#: Parts that a block's candidates are dealt into.
SALTS = 8


def lcs_lengths(xs: list[str], ys: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs. One bit for each character of x holds a row of the table, and a
    step over y is a few operations on whole rows: for all pairs at once up to 63 characters, pair by pair beyond."""
    n = np.fromiter(map(len, xs), np.int64, len(xs))
    out = np.zeros(len(xs), np.int64)
    short = np.flatnonzero((n > 0) & (n < 64))
    if len(short):
        wide = max(len(xs[i]) for i in short)
        x = np.array([xs[i] for i in short], f"U{wide}").view(np.uint32).reshape(len(short), wide)
        long_y = max(1, max(len(ys[i]) for i in short))
        y = np.array([ys[i] for i in short], f"U{long_y}").view(np.uint32).reshape(len(short), long_y)
        bits = np.uint64(1) << np.arange(wide, dtype=np.uint64)
        row = np.full(len(short), ~np.uint64(0))
        for j in range(long_y):
            c = y[:, j, None]
            match = row & ((x == c) & (c != 0)) @ bits
            row = (row + match) | (row - match)
        row |= ~((np.uint64(1) << n[short].astype(np.uint64)) - np.uint64(1))
        out[short] = 64 - np.bitwise_count(row)
    for i in np.flatnonzero(n >= 64).tolist():
        all_, places = (1 << int(n[i])) - 1, {}
        for k, c in enumerate(xs[i]):
            places[c] = places.get(c, 0) | 1 << k
        row = all_
        for c in ys[i]:
            match = row & places.get(c, 0)
            row = ((row + match) | (row - match)) & all_
        out[i] = int(n[i]) - row.bit_count()
    return out


@pandas_udf(LongType())
def lcs(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series(lcs_lengths(x.fillna("").tolist(), y.fillna("").tolist()))


def sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda w: w != "")), " ")


def ratio(x: Column, y: Column) -> Column:
    """Of names whose words are sorted already; two empty ones are alike."""
    total = F.length(x) + F.length(y)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * lcs(x, y) / total)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(sorted_words(a), sorted_words(b))


def letter_counts(c: Column) -> Column:
    own = F.transform(F.array(*map(F.lit, LETTERS)), lambda x: F.length(c) - F.length(F.replace(c, x, F.lit(""))))
    return F.concat(own, F.array(F.length(F.regexp_replace(c, "[A-Z0-9 ]", ""))))


def most_common(a: Column, b: Column) -> Column:
    """No common subsequence of two names is longer than this, from their letters' counts."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)


def best_matches(entries: DataFrame, candidates: DataFrame, blocks: list[str], least: float = LIKELY, salts: int = SALTS) -> DataFrame:
    """entry_id, cand_id, score: each entry's best candidate of its block with `least` or more, ties to the smallest id. An
    entry isn't its own candidate. entries: blocks, entry_id, name; candidates: blocks, cand_id, name. A null block meets
    nothing, a null name is an empty one."""
    ship(entries.sparkSession)
    key = sorted_words(F.coalesce(normalize_name(F.col("name")), F.lit("")))
    e = entries.select(*blocks, "entry_id", key.alias("x"))
    c = candidates.select(*blocks, "cand_id", key.alias("y"))
    # of those with one name only two can be a best match: the smallest id, and the next for an entry that is the smallest
    first = Window.partitionBy(*blocks, "y").orderBy("cand_id")
    c = c.withColumn("n", F.row_number().over(first)).filter("n <= 2")
    c = c.groupBy(*blocks, "y").agg(F.min("cand_id").alias("first"), F.max("cand_id").alias("second")).withColumn("common_y", letter_counts(F.col("y")))
    c = c.withColumn("salt", F.pmod(F.xxhash64("y"), F.lit(salts)).cast("int")).withColumn("m", F.length("y"))
    e = e.withColumn("n", F.length("x")).withColumn("common_x", letter_counts(F.col("x"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = [*blocks, "salt"]
    if least > 0:
        # 200 * min(n, m) has to reach least * (n + m)
        share = least / (200 - least)
        e = e.withColumn("m", F.explode(F.sequence(F.ceil(F.col("n") * share - 1e-9).cast("int"), F.floor(F.col("n") / share + 1e-9).cast("int"))))
        on.append("m")
    else:
        c = c.withColumnRenamed("m", "length_y").withColumn("m", F.col("length_y"))
    total = F.col("n") + F.col("m")
    pairs = e.join(c, on).withColumn("cand_id", F.when(F.col("first") != F.col("entry_id"), F.col("first")).when(F.col("second") != F.col("first"), F.col("second")))
    pairs = pairs.filter(F.col("cand_id").isNotNull() & (200.0 * most_common(F.col("common_x"), F.col("common_y")) >= least * total))
    scored = pairs.select("entry_id", "cand_id", ratio(F.col("x"), F.col("y")).alias("score")).filter(F.col("score") >= least)
    best = scored.groupBy("entry_id").agg(F.max(F.struct("score", (-F.col("cand_id")).alias("neg"))).alias("b"))
    return best.select("entry_id", (-F.col("b.neg")).alias("cand_id"), "b.score")


def match_entries(entries: DataFrame, candidates: DataFrame, blocks: list[str], sure: float = SURE, likely: float = LIKELY) -> DataFrame:
    """Every entry: its best candidate and whether the match is confirmed, auto, or (without a candidate) discarded."""
    best = best_matches(entries, candidates, blocks, likely)
    status = F.when(F.col("score").isNull(), "discarded").when(F.col("score") >= sure, "confirmed").otherwise("auto")
    return entries.select("entry_id").join(best, "entry_id", "left").withColumn("status", status)


#: Scores of pairs(x, y): rows of the table, one for each character of x; a row's entry is the running maximum of what a
#: match or the row before gives.
RATIO_SQL = """dp(x, y, i, r) as (select distinct x, y, 0, list_transform(range(length(y)), lambda j: 0) from pairs union all
        select x, y, i + 1, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) from
        (select x, y, i, list_transform(range(1, length(y) + 1), lambda j: case when substr(x, i + 1, 1) = substr(y, j, 1) then coalesce(r[j - 1], 0) + 1 else r[j] end) as c from dp where i < length(x)) t),
    ratio as (select x, y, case when length(x) + length(y) = 0 then 100.0 else 200.0 * coalesce(r[-1], 0) / (length(x) + length(y)) end as score from dp where i = length(x))"""
SORTED_SQL = "array_to_string(list_sort(list_filter(string_split({}, ' '), lambda w: w <> '')), ' ')"


def matched_sql(block: str) -> str:
    return f"""with recursive p as (select p_partkey as k, {block} as block, {SORTED_SQL.format(normalize_name_sql("p_name"))} as name from part),
    met as (select e.k as entry_id, c.k as cand_id, e.name as x, c.name as y from p e join p c on e.block = c.block and e.k % 50 = 0 and c.k <> e.k),
    pairs as (select distinct x, y from met), {RATIO_SQL},
    best as (select entry_id, cand_id, score from (select *, row_number() over (partition by entry_id order by score desc, cand_id) as n from met join ratio using (x, y)) t where n = 1)"""


def parts(v, *blocks: str) -> tuple[DataFrame, DataFrame]:
    """Parts divisible by 50 as entries, all parts as candidates."""
    p = v.part.select(*blocks, F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    return p.filter("k % 50 = 0").withColumnRenamed("k", "entry_id"), p.withColumnRenamed("k", "cand_id")


STATUS_SQL = " select e.k as entry_id, cand_id, round(score, 6) as score, case when score >= 90 then 'confirmed' when score >= 80 then 'auto' else 'discarded' end as status from p e left join best on entry_id = e.k and score >= 80 where e.k % 50 = 0"


@query("fuzzy_blocked_join", matched_sql("p_brand || p_type") + STATUS_SQL)
def _(v):
    e, c = parts(v, "p_brand", "p_type")
    return match_entries(e, c, ["p_brand", "p_type"]).select("entry_id", "cand_id", F.round("score", 6).alias("score"), "status")


@query("match_counters", matched_sql("p_brand || p_type") + f" select status, count(*) as n from ({STATUS_SQL}) t group by 1")
def _(v):
    e, c = parts(v, "p_brand", "p_type")
    return match_entries(e, c, ["p_brand", "p_type"]).groupBy("status").agg(F.count("*").alias("n"))


@query("fuzzy_argmax", matched_sql("p_brand") + " select entry_id, cand_id, round(score, 6) as score from best")
def _(v):
    return best_matches(*parts(v, "p_brand"), ["p_brand"], least=0).withColumn("score", F.round("score", 6))


NEXT_SQL = f"""with recursive p as (select p_partkey as k, {SORTED_SQL.format("p_name || ' ' || p_type")} as x from part),
    met as (select p.k as a, q.k as b, p.x as x, q.x as y from p join p q on q.k = p.k + 1), pairs as (select distinct x, y from met), {RATIO_SQL}
    select a, b, round(score, 6) as ratio from met join ratio using (x, y)"""


@query("token_sort_ratio", NEXT_SQL)
def _(v):
    ship(v.spark)
    p = v.part.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), F.concat_ws(" ", "p_name", "p_type").alias("x"))
    q = p.select(F.col("a").alias("b"), F.col("x").alias("y"))
    return p.join(q, "b").select("a", "b", F.round(token_sort_ratio(F.col("x"), F.col("y")), 6).alias("ratio"))
