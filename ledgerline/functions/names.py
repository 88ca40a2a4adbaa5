"""People's and organisations' names: order, sameness, patrons, display names, rule-driven morphology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.registry import query

WORDS = ["small", "red", "blue", "hot", "old"]


@query("name_order", """with w as (select p_partkey, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b from (select p_partkey, case when p_partkey % 2 = 0 then p_name else split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) end as p_name from part) t)
    select p_partkey, case when a in ('small', 'red', 'blue') then a || ' ' || b when b in ('small', 'red', 'blue') then b || ' ' || a end as name from w""")  # fmt: skip
def _(v):
    known = F.broadcast(v.spark.createDataFrame([("small",), ("red",), ("blue",)], "forename string"))
    w = F.split("p_name", " ")
    d = v.part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, w[0]).otherwise(w[1]).alias("a"), F.when(F.col("p_partkey") % 2 == 0, w[1]).otherwise(w[0]).alias("b"))
    return name_order(d, known).select("p_partkey", "name")


def name_order(people: DataFrame, forenames: DataFrame) -> DataFrame:
    """a b: as it is if a is a known forename, swapped if only b is, else unknown."""
    one = people.join(forenames.withColumnRenamed("forename", "fa"), F.col("a") == F.col("fa"), "left").join(forenames.withColumnRenamed("forename", "fb"), F.col("b") == F.col("fb"), "left")
    name = F.when(F.col("fa").isNotNull(), F.concat_ws(" ", "a", "b")).when(F.col("fb").isNotNull(), F.concat_ws(" ", "b", "a"))
    return one.withColumn("name", name).drop("fa", "fb")


def sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.lower(F.trim(c)), " +")), " ")


@query("same_person", """with p as (select p_partkey as k, p_name, split_part(p_name, ' ', 2) || ' ' || upper(split_part(p_name, ' ', 1)) as other from part)
    select k, true as same, p_name = 'small ring' as ring from p""")  # fmt: skip
def _(v):
    w = F.split("p_name", " ")
    other = F.concat(w[1], F.lit(" "), F.upper(w[0]))
    return v.part.select(F.col("p_partkey").alias("k"), (sorted_words(F.col("p_name")) == sorted_words(other)).alias("same"), (sorted_words(F.col("p_name")) == sorted_words(F.lit("RING small"))).alias("ring"))
