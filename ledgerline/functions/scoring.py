"""Rubric scoring: every criterion is data, unknown input earns nothing and says so, totals are sums of points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.registry import query

#: A rubric: (criterion, kind, most points, argument). linear: to the cap; tier: points by value; flag: all or nothing.
RUBRICS = {
    "primary": [("size", "linear", 30, ("size_n", 600)), ("city", "tier", 25, ("tier", {"capital": 25, "large_city": 15, "smaller_town": 5})), ("private", "flag", 20, "is_private"), ("name", "flag", 10, "has_two"), ("active", "flag", 15, "is_active")],
    "secondary": [("size", "linear", 20, ("size_n", 800)), ("city", "tier", 20, ("tier", {"capital": 20, "large_city": 10, "smaller_town": 5})), ("private", "flag", 15, "is_private"), ("name", "flag", 10, "has_two"), ("active", "flag", 10, "is_active"), ("rank", "tier", 25, ("rank_tier", {"top": 25, "listed": 10}))],
}


def points(kind: str, most: int, arg) -> Column:
    """Points of one criterion; 0 where its input is unknown. Linear points round half to even."""
    if kind == "linear":
        c, cap = arg
        return F.coalesce(F.bround(F.least(F.col(c).cast("double") / cap, F.lit(1.0)) * most).cast("int"), F.lit(0))
    if kind == "tier":
        c, table = arg
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(c)), F.lit(0))
    return F.when(F.col(arg), most).otherwise(0)


def breakdown(rubric: list[tuple]) -> Column:
    """criterion -> (points, max, basis)."""
    entries = []
    for name, kind, most, arg in rubric:
        source = F.col(arg if isinstance(arg, str) else arg[0])
        entries += [F.lit(name), F.struct(points(kind, most, arg).alias("points"), F.lit(most).alias("max"), F.when(source.isNull(), "unknown").otherwise("known").alias("basis"))]
    return F.create_map(*entries)


def score(rows: DataFrame, rubrics: dict[str, list[tuple]] = RUBRICS) -> DataFrame:
    """rows with a column `rubric`, scored by it: breakdown and total. No code changes for another rubric."""
    b = reduce(lambda a, kv: a.when(F.col("rubric") == kv[0], breakdown(kv[1])), rubrics.items(), F)
    return rows.withColumn("breakdown", b).withColumn("total", F.aggregate(F.map_values("breakdown"), F.lit(0), lambda a, x: a + x["points"]))


def scorable(v) -> DataFrame:
    tier = F.when(F.col("city").isin("NATION_0", "NATION_7"), "capital").when(F.col("city").isin("NATION_3", "NATION_12"), "large_city").otherwise("smaller_town")
    rank = F.when(F.col("id") % 10 == 0, "top").when(F.col("id") % 10 < 4, "listed")
    rubric = F.when(F.col("level").isin("BUILDING", "FURNITURE"), "secondary").otherwise("primary")
    return v.register.withColumns({"tier": tier, "rank_tier": rank, "rubric": rubric, "has_two": F.col("name").contains("2")})


SCORE_SQL = """with i as (select *, case when city in ('NATION_0', 'NATION_7') then 'capital' when city in ('NATION_3', 'NATION_12') then 'large_city' else 'smaller_town' end as tier,
      case when id % 10 = 0 then 'top' when id % 10 < 4 then 'listed' end as rank_tier, case when level in ('BUILDING', 'FURNITURE') then 'secondary' else 'primary' end as rubric, contains(name, '2') as has_two from register),
    p as (select *, coalesce(cast(round_even(least(size_n / 600.0, 1.0) * 30, 0) as int), 0) as ps1, coalesce(cast(round_even(least(size_n / 800.0, 1.0) * 20, 0) as int), 0) as ps2,
      case tier when 'capital' then 25 when 'large_city' then 15 else 5 end as pc1, case tier when 'capital' then 20 when 'large_city' then 10 else 5 end as pc2,
      case rank_tier when 'top' then 25 when 'listed' then 10 else 0 end as pr from i)"""


@query("criterion_points", SCORE_SQL + " select id, ps1 as size_points, pc1 as city_points, case when is_private then 20 else 0 end as private_points, case when size_n is null then 'unknown' else 'known' end as size_basis from p")
def _(v):
    b = scorable(v).withColumn("b", breakdown(RUBRICS["primary"]))
    return b.select("id", F.col("b")["size"]["points"].alias("size_points"), F.col("b")["city"]["points"].alias("city_points"), F.col("b")["private"]["points"].alias("private_points"), F.col("b")["size"]["basis"].alias("size_basis"))


TOTAL_SQL = """case rubric when 'primary' then ps1 + pc1 + case when is_private then 20 else 0 end + case when has_two then 10 else 0 end + case when is_active then 15 else 0 end
    else ps2 + pc2 + case when is_private then 15 else 0 end + case when has_two then 10 else 0 end + case when is_active then 10 else 0 end + pr end"""


@query("score_breakdown", SCORE_SQL + f" select id, rubric, {TOTAL_SQL} as total from p")
def _(v):
    return score(scorable(v)).select("id", "rubric", "total")


@query("rubric_as_config", SCORE_SQL + " select id, ps2 + case when is_private then 80 else 0 end as total, 'v2' as version from p")
def _(v):
    own = {"mine": [("size", "linear", 20, ("size_n", 800)), ("private", "flag", 80, "is_private")]}
    return score(scorable(v).withColumn("rubric", F.lit("mine")), own).select("id", "total", F.lit("v2").alias("version"))
