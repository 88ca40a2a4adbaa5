"""Filters, segments, sorting, paging and set operations over the register.

Filters return a Column, so that any number of them make one predicate that Catalyst pushes to the scan; an argument that
is left out adds nothing. Unknown values stay unknown: each filter says whether it keeps them.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.plans.registry import query
from ledgerline.plans.views import AS_OF, LEVELS, SECONDARY

TARGET_SQL = "is_active and not is_adult and specialty is null"
AVAILABLE_SQL = "not exists (select 1 from queue q where q.id = r.id) and not exists (select 1 from batch_member b where b.id = r.id)"


def target_population() -> Column:
    """Active, not for adults, without a specialty: holds for every list and count."""
    return F.col("is_active") & ~F.col("is_adult") & F.col("specialty").isNull()


@query("target_population", f"select id, level from register where {TARGET_SQL}")
def _(v):
    return v.register.filter(target_population()).select("id", "level")


def available_pool(register: DataFrame, queue: DataFrame, members: DataFrame) -> DataFrame:
    """Targets that are neither queued nor in a batch."""
    return register.filter(target_population()).join(queue.select("id"), "id", "left_anti").join(members.select("id"), "id", "left_anti")


@query("available_pool", f"select id, name from register r where {TARGET_SQL} and {AVAILABLE_SQL}")
def _(v):
    return available_pool(v.register, v.queue, v.batch_member).select("id", "name")


def all_of(*conditions: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def equals(column: str, value) -> Column | None:
    """No value: no filter."""
    return None if value is None else F.col(column) == F.lit(value)


@query("equality_filters", "select id, city, region from register where region = 'ASIA' and city = 'NATION_2'")
def _(v):
    return v.register.filter(all_of(equals("region", "ASIA"), equals("city", "NATION_2"), equals("level", None))).select("id", "city", "region")


def level_group(group: str | None, column: str = "level") -> Column | None:
    """The levels of a group; an unknown group has none, so no row passes."""
    if group is None:
        return None
    return F.col(column).isin(LEVELS[group]) if group in LEVELS else F.lit(False)


@query("level_group_filter", """select id, 'secondary' as grp from register where level in ('BUILDING', 'FURNITURE')
    union all select id, 'vocational' from register where level in ('BUILDING', 'HOUSEHOLD', 'MACHINERY')""")  # fmt: skip
def _(v):
    return reduce(DataFrame.union, [v.register.filter(level_group(g)).select("id", F.lit(g).alias("grp")) for g in ("secondary", "vocational", "none such")])


def ownership(private: bool = True, public: bool = True, column: str = "is_private") -> Column:
    """Both: everything, unknown ones too; one: those known to be it; none: nothing."""
    if private and public:
        return F.lit(True)
    if not private and not public:
        return F.lit(False)
    return F.col(column).eqNullSafe(private)


@query("ownership_tristate", """select id, 'both' as mode from register union all select id, 'private' from register where is_private is true
    union all select id, 'public' from register where is_private is false""")  # fmt: skip
def _(v):
    modes = {"both": (True, True), "private": (True, False), "public": (False, True), "neither": (False, False)}
    return reduce(DataFrame.union, [v.register.filter(ownership(*m)).select("id", F.lit(k).alias("mode")) for k, m in modes.items()])


def in_range(column: str, low=None, high=None, unknown: bool = True) -> Column | None:
    """No bound: no filter. With unknown, rows without a value stay."""
    if low is None and high is None:
        return None
    c = F.col(column)
    inside = c.isNotNull() & all_of(c >= low if low is not None else None, c <= high if high is not None else None)
    return inside | c.isNull() if unknown else inside


@query("range_with_unknown", """select id, size_n, total from scored where ((size_n is not null and size_n between 200 and 700) or size_n is null)
    and ((total is not null and total >= 40) or total is null)""")  # fmt: skip
def _(v):
    return v.scored.filter(all_of(in_range("size_n", 200, 700), in_range("total", 40))).select("id", "size_n", "total")


def text_search(df: DataFrame, q: str, columns: Iterable[str], most: int | None = 20, order: Iterable[Column] = ()) -> DataFrame:
    """Rows with q (trimmed, two characters at least) in any of the columns, letter case aside; % and _ stay wildcards."""
    q = q.strip()
    if len(q) < 2:
        return df.limit(0)
    hit = reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{q}%") for c in columns])
    found = df.filter(hit)
    order = list(order) or [F.asc(c) for c in columns]
    return found.orderBy(*order).limit(most) if most else found


@query("text_search", "select id, name, total from scored where name ilike '%00012%' or city ilike '%00012%' order by total desc nulls last, id limit 20")
def _(v):
    return text_search(v.scored, " 00012 ", ["name", "city"], 20, [F.desc_nulls_last("total"), F.asc("id")]).select("id", "name", "total")


def issue_filter(mode: str | None, column: str) -> Column:
    """all: everything; any_issue: whatever is not null; else this very issue."""
    return F.lit(True) if mode in (None, "all") else F.col(column).isNotNull() if mode == "any_issue" else F.col(column) == mode


@query("issue_filter", """with i as (select event_id, case when event_type in ('error', 'view') then event_type end as issue from events)
    select event_id, 'any' as mode from i where issue is not null union all select event_id, 'error' from i where issue = 'error'""")  # fmt: skip
def _(v):
    i = v.events.select("event_id", F.when(F.col("event_type").isin("error", "view"), F.col("event_type")).alias("issue"))
    return i.filter(issue_filter("any_issue", "issue")).select("event_id", F.lit("any").alias("mode")).union(i.filter(issue_filter("error", "issue")).select("event_id", F.lit("error")))


@query("pipeline_filters", """select s.id, q.stage, s.total from queue q join scored s on s.id = q.id where q.stage in ('contacted', 'responded')
    and s.region = 'EUROPE' and s.level in ('BUILDING', 'FURNITURE') and s.is_private is false and (s.total >= 20 or s.total is null)""")  # fmt: skip
def _(v):
    conditions = all_of(F.col("stage").isin("contacted", "responded"), equals("region", "EUROPE"), level_group("secondary"), ownership(False, True), in_range("total", 20))
    return v.queue.join(v.scored, "id").filter(conditions).select("id", "stage", "total")


@query("directory_filters", """with d as (select r.id, r.size_n, case when b.id is not null then 'campaign' when q.id is not null then 'pipeline' else 'available' end as status
    from register r left join queue q on q.id = r.id left join batch_member b on b.id = r.id where r.size_n between 100 and 600)
    select * from d where status = 'pipeline'""")  # fmt: skip
def _(v):
    known = v.register.filter(in_range("size_n", 100, 600, unknown=False))
    return with_status(known, v.queue, v.batch_member).filter("status = 'pipeline'").select("id", "size_n", "status")


def with_status(register: DataFrame, queue: DataFrame, members: DataFrame) -> DataFrame:
    """One place per entity: campaign before pipeline before available."""
    q = queue.select("id", F.lit(True).alias("queued")).distinct()
    b = members.select("id", F.lit(True).alias("member")).distinct()
    status = F.when(F.col("member"), "campaign").when(F.col("queued"), "pipeline").otherwise("available")
    return register.join(q, "id", "left").join(b, "id", "left").withColumn("status", status).drop("queued", "member")


@query("status_derivation", """select r.id, case when b.id is not null then 'campaign' when q.id is not null then 'pipeline' else 'available' end as status
    from register r left join queue q on q.id = r.id left join batch_member b on b.id = r.id""")  # fmt: skip
def _(v):
    return with_status(v.register, v.queue, v.batch_member).select("id", "status")


def tagged(df: DataFrame, bridge: DataFrame, tag) -> DataFrame:
    return df.join(bridge.filter(F.col("tag") == tag).select("id"), "id", "left_semi")


@query("tag_filter", "select id, name from register where id in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def _(v):
    bridge = v.orders.selectExpr("o_custkey as id", "o_orderpriority as tag")
    return tagged(v.register, bridge, "1-URGENT").select("id", "name")


def tasks_due(queue: DataFrame, as_of: str, days: int) -> DataFrame:
    """Follow-ups due within so many days, overdue and closed ones included."""
    limit = F.lit(as_of).cast("timestamp_ntz") + F.expr(f"interval {days} days")
    return queue.filter(F.col("next_action_date") <= limit).orderBy("next_action_date", "id")


@query("tasks_due", f"select id, stage, next_action_date from queue where next_action_date <= timestamp '{AS_OF}' + interval 14 days")
def _(v):
    return tasks_due(v.queue, AS_OF, 14).select("id", "stage", "next_action_date")


def active_stage() -> Column:
    return ~F.col("stage").isin("won", "lost")


@query("active_stage_filter", "select id, stage from queue where stage not in ('won', 'lost')")
def _(v):
    return v.queue.filter(active_stage()).select("id", "stage")


def criteria_label(region: Column, least: Column, top: Column) -> Column:
    """A readable label of a saved filter set; absent parts are skipped."""
    parts = F.array_compact(F.array(region, F.concat(F.lit("score ≥ "), least.cast("string")), F.concat(F.lit("top "), top.cast("string"))))
    return F.when(F.size(parts) == 0, "all rows").otherwise(F.array_join(parts, " · "))


@query("criteria_label", """select n_nationkey as k, coalesce(nullif(concat_ws(' · ', case when n_nationkey % 2 = 0 then r_name end,
    case when n_nationkey % 3 = 0 then 'score ≥ ' || n_nationkey end, case when n_nationkey % 5 = 0 then 'top ' || n_nationkey * 10 end), ''), 'all rows') as label
    from nation join region on r_regionkey = n_regionkey""")  # fmt: skip
def _(v):
    d = v.nation.join(v.region, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    return d.select(k.alias("k"), criteria_label(F.when(k % 2 == 0, F.col("r_name")), F.when(k % 3 == 0, k), F.when(k % 5 == 0, k * 10)).alias("label"))


def saved_segments(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment, id) for all saved segments at once; a condition that is null adds nothing. Segments are few: a user saves them."""
    s = F.broadcast(segments)
    hit = (s["s_region"].isNull() | (rows["region"] == s["s_region"])) & (s["s_least"].isNull() | (rows["total"] >= s["s_least"])) & (s["s_level"].isNull() | (rows["level"] == s["s_level"]))
    return rows.join(s, hit).select("segment", "id")


@query("saved_segment_membership", """with s as (select r_regionkey as segment, case when r_regionkey <> 0 then r_name end as s_region,
    case when r_regionkey % 2 = 0 then 50 end as s_least, case when r_regionkey = 3 then 'BUILDING' end as s_level from region)
    select segment, id from scored join s on (s_region is null or region = s_region) and (s_least is null or total >= s_least) and (s_level is null or level = s_level)""")  # fmt: skip
def _(v):
    s = v.region.selectExpr("r_regionkey as segment", "case when r_regionkey <> 0 then r_name end as s_region", "case when r_regionkey % 2 = 0 then 50 end as s_least", "case when r_regionkey = 3 then 'BUILDING' end as s_level")
    return saved_segments(v.scored, s)


def score_left_chain(register: DataFrame, current: DataFrame) -> DataFrame:
    """Each row with its current score under the rubric of its level; rows without one stay."""
    c = current.select(F.col("id").alias("score_id"), "rubric", "total")
    wanted = F.when(F.col("level").isin(SECONDARY), "secondary").otherwise("primary")
    return register.join(c, (F.col("id") == F.col("score_id")) & (F.col("rubric") == wanted), "left").drop("score_id", "rubric")


@query("score_left_chain", "select id, level, total from scored")
def _(v):
    return v.scored.select("id", "level", "total")


SORTS = {"score": "total", "size": "size_n", "name": "name"}


def sort_by(spec: str | None, tiebreak: str = "id") -> list[Column]:
    """'field:dir' with an allow-list; anything else sorts by score, best first. Unknown values come last either way."""
    field, _, way = (spec or "").partition(":")
    if field not in SORTS:
        field, way = "score", "desc"
    c = F.col(SORTS[field])
    return [c.asc_nulls_last() if way == "asc" else c.desc_nulls_last(), F.asc(tiebreak)]


@query("whitelisted_sort", """select 'size:asc' as spec, id, row_number() over (order by size_n asc nulls last, id) as pos from register
    union all select 'drop:desc', id, row_number() over (order by total desc nulls last, id) from scored""")  # fmt: skip
def _(v):
    def numbered(spec):
        # positions over a whole table come from one sorted pass per key range, not from one task: count before + own
        d = v.scored.repartitionByRange(8, *sort_by(spec)).sortWithinPartitions(*sort_by(spec)).withColumn("part", F.spark_partition_id())
        d = d.withColumn("seq", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33))
        w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        before = d.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
        return d.join(F.broadcast(before), "part").select(F.lit(spec).alias("spec"), "id", (F.col("before") + F.col("seq") + 1).alias("pos"))

    return numbered("size:asc").union(numbered("drop:desc"))


def page(df: DataFrame, order: list[Column], number: int, size: int, cap: int | None = None) -> DataFrame:
    """One page inside an overall cap; the last page is cut."""
    skip = (number - 1) * size
    take = size if cap is None else max(0, min(size, cap - skip))
    return df.orderBy(*order).offset(skip).limit(take)


@query("capped_pagination", "select id, total from (select *, row_number() over (order by total desc nulls last, id) as n from scored) t where n between 101 and 120")
def _(v):
    return page(v.scored, sort_by("score:desc"), 3, 50, cap=120).select("id", "total")


@query("best_available", f"""select id, name, total from (select r.*, row_number() over (order by total desc nulls last, id) as n from scored r
    where {TARGET_SQL} and region = 'ASIA' and {AVAILABLE_SQL}) t where n <= 50""")  # fmt: skip
def _(v):
    rows = available_pool(v.scored, v.queue, v.batch_member).filter(equals("region", "ASIA"))
    return page(rows, sort_by("score:desc"), 1, 50).select("id", "name", "total")


@query("top_leads", f"""select id, total from (select r.*, row_number() over (order by total desc, id) as n from scored r where {TARGET_SQL}
    and total is not null and not exists (select 1 from queue q where q.id = r.id)) t where n <= 10""")  # fmt: skip
def _(v):
    return v.scored.filter(target_population() & F.col("total").isNotNull()).join(v.queue.select("id"), "id", "left_anti").orderBy(F.desc("total"), "id").limit(10).select("id", "total")


@query("recent_activity", """select e.event_id, e.event_type, e.ts, c_name as name from (select * from events order by ts desc, event_id desc limit 20) e
    left join customer on c_custkey = e.user_id""")  # fmt: skip
def _(v):
    newest = v.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(20)
    return newest.join(v.customer, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "event_type", "ts", F.col("c_name").alias("name"))


@query("filter_sort_take", f"""select id, total from (select r.*, row_number() over (order by total desc nulls last, id) as n from scored r where {TARGET_SQL}
    and {AVAILABLE_SQL} and level in ('BUILDING', 'HOUSEHOLD', 'MACHINERY') and (size_n >= 300 or size_n is null)) t where n <= 40""")  # fmt: skip
def _(v):
    rows = available_pool(v.scored, v.queue, v.batch_member).filter(all_of(level_group("vocational"), in_range("size_n", 300)))
    return rows.orderBy(*sort_by("score:desc")).limit(40).select("id", "total")


def seeded_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum, the same ones for the same seed on any engine. The window keeps the n first of each
    stratum in every task before the shuffle (WindowGroupLimit), so a large stratum isn't gathered."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


@query("seeded_sample", """select lang, doc_id from (select *, row_number() over (partition by lang order by md5('s7' || cast(doc_id as varchar)), doc_id) as rn
    from documents where n_chars > 200) t where rn <= 15""")  # fmt: skip
def _(v):
    return seeded_sample(v.documents.filter("n_chars > 200"), "lang", "doc_id", 15, "s7").select("lang", "doc_id")


@query("matching_ids", f"""select id, 'library' as scope from register r where {TARGET_SQL} and {AVAILABLE_SQL} and region = 'EUROPE'
    union all select q.id, 'pipeline' from queue q join register r on r.id = q.id where q.stage = 'contacted'""")  # fmt: skip
def _(v):
    library = available_pool(v.register, v.queue, v.batch_member).filter("region = 'EUROPE'").select("id", F.lit("library").alias("scope"))
    return library.union(v.queue.filter("stage = 'contacted'").join(v.register, "id").select("id", F.lit("pipeline")))


@query("union_distinct", "select id from queue where stage = 'won' union select id from activity_log where event_type = 'purchase'")
def _(v):
    return v.queue.filter("stage = 'won'").select("id").union(v.activity_log.filter("event_type = 'purchase'").select("id")).distinct()


@query("set_algebra", """with a as (select id from queue), b as (select id from batch_member), c as (select id from contact where addr is null)
    select id from ((select id from a union (select id from b except select id from c)) intersect select id from contact) x""")  # fmt: skip
def _(v):
    a, b, c = v.queue.select("id"), v.batch_member.select("id"), v.contact.filter("addr is null").select("id")
    return a.union(b.subtract(c)).intersect(v.contact.select("id"))


def first_seen(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Each key once, at its first place."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rn = 1").drop("rn")


@query("ordered_dedupe", """select l_suppkey as k, l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as rn
    from lineitem) t where rn = 1""")  # fmt: skip
def _(v):
    own = v.lineitem.select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber", "l_partkey")
    return own.groupBy("k").agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("s")).select("k", "s.*")


def partition_check(pool: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Whether two id sets part the pool: ids in both, and ids in neither."""
    flags = pool.select("id").distinct().join(left.select("id", F.lit(1).alias("l")).distinct(), "id", "left").join(right.select("id", F.lit(1).alias("r")).distinct(), "id", "left")
    return flags.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("in_both"), F.count_if(F.col("l").isNull() & F.col("r").isNull()).alias("in_neither"), F.count("*").alias("pool"))


@query("partition_check", """select count(*) filter (c and not c) as in_both, count(*) filter (c is null) as in_neither, count(*) as pool
    from (select r.id, r.id in (select id from contact) as c from register r) t""")  # fmt: skip
def _(v):
    touched = v.contact.select("id").distinct()
    return partition_check(v.register, touched, v.register.join(touched, "id", "left_anti"))


@query("address_union", """select source, string_agg(distinct lower(a), ',' order by lower(a)) as addresses from (select source,
    unnest(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+')) as a from documents) t where not starts_with(lower(a), 'iod') group by source""")  # fmt: skip
def _(v):
    found = v.documents.select("source", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+"), 0)).alias("a"))
    return found.filter(~F.lower("a").startswith("iod")).groupBy("source").agg(F.array_join(F.array_sort(F.collect_set(F.lower("a"))), ",").alias("addresses"))
