"""The relations of a register, as views on the star tables; each has a twin in SQL for the oracle."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Levels of each group, and which rubric scores a level.
LEVELS = {"primary": ["AUTOMOBILE"], "secondary": ["BUILDING", "FURNITURE"], "vocational": ["BUILDING", "HOUSEHOLD", "MACHINERY"]}
SECONDARY = LEVELS["secondary"]
#: "Now" is always an argument: the day reports on orders look back from, and the one for events.
AS_OF = "2000-06-15 00:00:00"
EVENTS_AS_OF = "2024-02-10 00:00:00"


class Views:
    """Lazy views of one data folder; star tables by their own names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def register(self) -> DataFrame:
        places = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        return self.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
            "c_custkey as id", "c_name as name", "n_name as city", "r_name as region", "c_mktsegment as level",
            "case when c_custkey % 3 = 0 then true when c_custkey % 3 = 1 then false end as is_private",
            "case when c_acctbal < 0 then null else cast(floor(c_acctbal / 10) as int) end as size_n",
            "c_custkey % 17 <> 0 as is_active", "c_custkey % 23 = 0 as is_adult", "case when c_custkey % 29 = 0 then 'special' end as specialty",
        )

    @cached_property
    def score_history(self) -> DataFrame:
        return self.orders.filter("o_custkey % 11 <> 0").selectExpr(
            "o_custkey as id", "o_orderkey as hist_id", "case when o_orderstatus = 'P' then 'secondary' else 'primary' end as rubric",
            "cast(floor(o_totalprice / 5000) as int) as total", "o_orderdate as computed_at",
        )

    @cached_property
    def queue(self) -> DataFrame:
        newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
        own = self.orders.filter("o_custkey % 4 = 0").withColumn("rn", F.row_number().over(newest)).filter("rn = 1")
        return own.selectExpr(
            "o_custkey as id",
            "case o_orderpriority when '1-URGENT' then 'won' when '2-HIGH' then 'lost' when '3-MEDIUM' then 'responded' when '4-NOT SPECIFIED' then 'not_contacted' else 'contacted' end as stage",
            "o_orderdate as stage_updated_at", "case when o_orderkey % 5 <> 0 then o_orderdate + interval 30 days end as next_action_date",
        )

    @cached_property
    def batch_member(self) -> DataFrame:
        own = self.orders.filter("o_custkey % 4 = 1 and o_custkey % 3 = 0")
        return own.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("added_at")).selectExpr("id", "id % 7 as batch_id", "added_at")

    @cached_property
    def activity_log(self) -> DataFrame:
        return self.events.withColumnRenamed("user_id", "id")

    @cached_property
    def contact(self) -> DataFrame:
        own = self.lineitem.filter("l_quantity <= 2").join(self.orders, F.col("o_orderkey") == F.col("l_orderkey"))
        return own.selectExpr(
            "o_custkey as id", "case l_returnflag when 'A' then 'teacher' when 'N' then 'director' else 'general' end as role",
            "case when l_linestatus = 'F' then 'person' || cast(l_suppkey as string) end as person",
            "case when l_tax < 0.04 then case when l_linenumber = 1 then 'office' else 'p' end || cast(l_suppkey as string) || '@s' || cast(o_custkey as string) || '.example.com' end as addr",
            "l_shipdate as captured_at", "l_orderkey", "l_linenumber",
        )

    @cached_property
    def current_score(self) -> DataFrame:
        from ledgerline.operators.ranking import current_score

        return current_score(self.score_history)

    @cached_property
    def scored(self) -> DataFrame:
        from ledgerline.operators.segments import score_left_chain

        return score_left_chain(self.register, self.current_score)


#: The same relations in SQL.
SQL = {
    "register": """select c_custkey as id, c_name as name, n_name as city, r_name as region, c_mktsegment as level,
        case when c_custkey % 3 = 0 then true when c_custkey % 3 = 1 then false end as is_private,
        case when c_acctbal < 0 then null else cast(floor(c_acctbal / 10) as int) end as size_n,
        c_custkey % 17 <> 0 as is_active, c_custkey % 23 = 0 as is_adult, case when c_custkey % 29 = 0 then 'special' end as specialty
        from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey""",
    "score_history": """select o_custkey as id, o_orderkey as hist_id, case when o_orderstatus = 'P' then 'secondary' else 'primary' end as rubric,
        cast(floor(o_totalprice / 5000) as int) as total, o_orderdate as computed_at from orders where o_custkey % 11 <> 0""",
    "queue": """select o_custkey as id, case o_orderpriority when '1-URGENT' then 'won' when '2-HIGH' then 'lost' when '3-MEDIUM' then 'responded'
        when '4-NOT SPECIFIED' then 'not_contacted' else 'contacted' end as stage, o_orderdate as stage_updated_at,
        case when o_orderkey % 5 <> 0 then o_orderdate + interval 30 days end as next_action_date
        from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) t
        where rn = 1 and o_custkey % 4 = 0""",
    "batch_member": """select o_custkey as id, o_custkey % 7 as batch_id, min(o_orderdate) as added_at from orders
        where o_custkey % 4 = 1 and o_custkey % 3 = 0 group by o_custkey""",
    "activity_log": "select event_id, user_id as id, event_type, ts, value, props from events",
    "contact": """select o_custkey as id, case l_returnflag when 'A' then 'teacher' when 'N' then 'director' else 'general' end as role,
        case when l_linestatus = 'F' then 'person' || cast(l_suppkey as varchar) end as person,
        case when l_tax < 0.04 then case when l_linenumber = 1 then 'office' else 'p' end || cast(l_suppkey as varchar) || '@s' || cast(o_custkey as varchar) || '.example.com' end as addr,
        l_shipdate as captured_at, l_orderkey, l_linenumber from lineitem join orders on o_orderkey = l_orderkey where l_quantity <= 2""",
    "current_score": """select id, rubric, total, hist_id, computed_at from (select *, row_number() over (partition by id, rubric order by computed_at desc, hist_id desc) as rn
        from score_history) t where rn = 1""",
    "scored": """select r.*, c.total from register r left join current_score c on c.id = r.id
        and c.rubric = case when r.level in ('BUILDING', 'FURNITURE') then 'secondary' else 'primary' end""",
}
#: Which views a view is made from.
NEEDS = {"current_score": ["score_history"], "scored": ["register", "score_history", "current_score"]}
