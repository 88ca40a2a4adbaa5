"""Reports: facets, funnels, coverage, ladders. One aggregate pass each; ratios are null where the denominator is zero."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.joins import last_activity
from ledgerline.operators.segments import AVAILABLE_SQL, TARGET_SQL, available_pool, target_population, with_status
from ledgerline.plans.registry import query
from ledgerline.plans.views import EVENTS_AS_OF


def n_if(condition: Column | str, name: str) -> Column:
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition).alias(name)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b rounded to 6 places; null where b is zero."""
    return F.round(F.try_divide(F.expr(a) if isinstance(a, str) else a, F.expr(b) if isinstance(b, str) else b), 6)


@query("column_profile", """with u as (select 'c_mktsegment' as col, c_mktsegment as value from customer union all select 'c_nationkey', cast(c_nationkey as varchar) from customer),
    c as (select col, value, count(*) as n from u where value is not null group by 1, 2), d as (select col, count(*) as n_distinct from c group by 1)
    select c.col, d.n_distinct, c.value, c.n from c join d using (col) where d.n_distinct <= 60""")  # fmt: skip
def _(v):
    return column_profile(v.customer, ["c_mktsegment", "c_nationkey"])


def column_profile(df: DataFrame, columns: Iterable[str], most: int = 60) -> DataFrame:
    """Distinct count of each column, and all value counts of those with at most `most` values; one pass for all columns."""
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "col", "value")
    counts = cells.filter("value is not null").groupBy("col", "value").agg(F.count("*").alias("n"))
    distinct = counts.groupBy("col").agg(F.count("*").alias("n_distinct")).filter(F.col("n_distinct") <= most)
    return counts.join(F.broadcast(distinct), "col").select("col", "n_distinct", "value", "n")


@query("region_facet", f"select region, count(*) as n from register where {TARGET_SQL} and region is not null group by region")
def _(v):
    return v.register.filter(target_population() & F.col("region").isNotNull()).groupBy("region").agg(F.count("*").alias("n")).orderBy("region")


@query("city_facet", f"select city, count(*) as n from register where {TARGET_SQL} and region = 'AFRICA' group by city")
def _(v):
    return v.register.filter(target_population() & (F.col("region") == "AFRICA")).groupBy("city").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "city")


@query("facet_scope", f"""select 'register' as scope, region, count(*) as n from register where {TARGET_SQL} group by region
    union all select 'pipeline', region, count(*) from register r join queue q on q.id = r.id where {TARGET_SQL} group by region
    union all select 'library', region, count(*) from register r where {TARGET_SQL} and {AVAILABLE_SQL} group by region""")  # fmt: skip
def _(v):
    target = v.register.filter(target_population())
    scopes = {"register": target, "pipeline": target.join(v.queue.select("id"), "id"), "library": available_pool(v.register, v.queue, v.batch_member)}
    return reduce(DataFrame.union, [d.groupBy("region").agg(F.count("*").alias("n")).select(F.lit(k).alias("scope"), "region", "n") for k, d in scopes.items()])


@query("stage_counts", "select stage, count(*) as n from queue group by stage")
def _(v):
    return v.queue.groupBy("stage").agg(F.count("*").alias("n"))


@query("level_counts", f"select level, count(*) as n from register where {TARGET_SQL} group by level")
def _(v):
    return v.register.filter(target_population()).groupBy("level").agg(F.count("*").alias("n"))


SUMMARY_SQL = f"""with t as (select s.*, q.stage, q.id is not null as queued, b.id is not null as member from scored s left join queue q on q.id = s.id left join batch_member b on b.id = s.id
    where {TARGET_SQL})"""


def counted_by(rows: DataFrame, column: str, name: str) -> DataFrame:
    """One row with value=count pairs of a column that has few values."""
    n = rows.groupBy(column).agg(F.count("*").alias("n")).filter(F.col(column).isNotNull())
    return n.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col(column), F.lit("="), F.col("n").cast("string")))), ",").alias(name))


def dashboard_summary(scored: DataFrame, queue: DataFrame, members: DataFrame, high: int = 70) -> DataFrame:
    """One row: seven numbers and two histograms. Entities are those of the target population; queue and batches count
    whole."""
    t = scored.filter(target_population())
    free = t.join(queue.select("id"), "id", "left_anti")
    rows = [
        t.agg(F.count("*").alias("n_target"), n_if("total is not null", "n_scored"), n_if("total is null", "n_unscored")), queue.agg(F.count("*").alias("n_queued")), members.agg(F.count("*").alias("n_members")),
        free.join(members.select("id"), "id", "left_anti").agg(F.count("*").alias("n_available")), free.agg(n_if(f"total >= {high}", "n_high_not_queued")), counted_by(t, "level", "by_level"), counted_by(queue, "stage", "by_stage"),
    ]
    return reduce(lambda a, b: a.join(F.broadcast(b)), rows)  # one row each


@query("dashboard_summary", f"""with t as (select * from scored where {TARGET_SQL}), f as (select * from t where id not in (select id from queue))
    select (select count(*) from t) as n_target, (select count(total) from t) as n_scored, (select count(*) - count(total) from t) as n_unscored, (select count(*) from queue) as n_queued, (select count(*) from batch_member) as n_members,
    (select count(*) from f where id not in (select id from batch_member)) as n_available, (select count(*) from f where total >= 70) as n_high_not_queued,
    (select string_agg(level || '=' || n, ',' order by level) from (select level, count(*) as n from t group by 1) x) as by_level, (select string_agg(stage || '=' || n, ',' order by stage) from (select stage, count(*) as n from queue group by 1) x) as by_stage""")  # fmt: skip
def _(v):
    return dashboard_summary(v.scored, v.queue, v.batch_member)


@query("distinct_entity_counts", """select (select count(distinct id) from score_history) as scored, (select count(distinct id) from contact) as attempted,
    (select count(distinct id) from contact where role = 'teacher' and addr is not null) as verified""")  # fmt: skip
def _(v):
    ids = v.score_history.selectExpr("id", "true as s", "false as a", "false as v").union(v.contact.selectExpr("id", "false", "true", "role = 'teacher' and addr is not null"))
    each = ids.groupBy("id").agg(F.bool_or("s").alias("s"), F.bool_or("a").alias("a"), F.bool_or("v").alias("v"))
    return each.agg(n_if("s", "scored"), n_if("a", "attempted"), n_if("v", "verified"))


LADDER_SQL = """with f as (select id, bool_or(role = 'teacher' and person is not null and addr is not null and not starts_with(addr, 'office')) as own_teacher,
      bool_or(addr is not null and not starts_with(addr, 'office')) as own, bool_or(addr is not null) as any_addr, bool_or(person is not null) as named from contact group by id),
    l as (select r.id, case when own_teacher and any_addr and named then 'complete' when own and named then 'successful' when named and any_addr then 'partial'
      when named or any_addr then 'basic' else 'not_enriched' end as ladder from register r left join f on f.id = r.id)"""


def contact_flags(contacts: DataFrame) -> DataFrame:
    """Any-match flags per entity: its own teacher address, an own address, any address, any named person."""
    own = F.col("addr").isNotNull() & ~F.col("addr").startswith("office")
    teacher = (F.col("role") == "teacher") & F.col("person").isNotNull() & own
    return contacts.groupBy("id").agg(F.bool_or(teacher).alias("own_teacher"), F.bool_or(own).alias("own"), F.bool_or(F.col("addr").isNotNull()).alias("any_addr"), F.bool_or(F.col("person").isNotNull()).alias("named"))


def contact_ladder(register: DataFrame, contacts: DataFrame) -> DataFrame:
    """complete > successful > partial > basic > not_enriched; entities without contacts are at the bottom."""
    f = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("own_teacher", "own", "any_addr", "named")}
    level = F.when(f["own_teacher"], "complete").when(f["own"] & f["named"], "successful").when(f["named"] & f["any_addr"], "partial").when(f["named"] | f["any_addr"], "basic").otherwise("not_enriched")
    return register.join(contact_flags(contacts), "id", "left").withColumn("ladder", level)


@query("contact_ladder", LADDER_SQL + " select id, ladder from l")
def _(v):
    return contact_ladder(v.register, v.contact).select("id", "ladder")


#: Named predicates over the ladder; an unknown name is no filter.
PREDICATES = {
    "complete": "ladder = 'complete'", "successful": "ladder in ('complete', 'successful')", "partial": "ladder = 'partial'", "basic": "ladder = 'basic'", "enriched": "ladder <> 'not_enriched'",
    "not_enriched": "ladder = 'not_enriched'", "attempted": "attempted", "never_attempted": "not attempted", "attempted_nothing_found": "attempted and ladder = 'not_enriched'", "successful_teacher": "ladder in ('complete', 'successful')",
}


def enrichment_filter(rows: DataFrame, name: str | None) -> DataFrame:
    return rows.filter(PREDICATES[name]) if name in PREDICATES else rows


@query("enrichment_predicate", LADDER_SQL + ", a as (select l.*, l.id in (select id from contact) as attempted from l) " + " union all ".join(f"select '{k}' as name, id from a where {c}" for k, c in PREDICATES.items()))
def _(v):
    rows = contact_ladder(v.register, v.contact).withColumn("attempted", F.col("any_addr").isNotNull())
    names = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in PREDICATES.items()]))
    return rows.select(F.explode(names).alias("name"), "id")  # all predicates in one pass


CLOSED = ["won", "lost"]


def data_quality_report(register: DataFrame, contacts: DataFrame, queue: DataFrame, log: DataFrame, items: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """One row of 16 numbers on coverage: the target population, the queue, and the runs. contacts: id, quality (verified,
    partial or failed; each entity counts with its best); items: status (success or failed). The rate of success is null
    without items. A contact of any quality is an attempt."""
    best = contacts.groupBy("id").agg(F.bool_or(F.col("quality") == "verified").alias("verified"), F.bool_or(F.col("quality") == "partial").alias("partial"))
    t = register.filter(target_population()).join(best, "id", "left")
    a = t.agg(F.count("*").alias("n_target"), n_if("verified is not null", "n_attempted"), n_if("verified is null", "n_never_attempted"), n_if("verified", "n_verified"), n_if("partial and not verified", "n_partial"))
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    q = queue.join(best, "id", "left").join(last_activity(log), "id", "left")
    q = q.withColumns({"active": ~F.col("stage").isin(CLOSED), "old": F.col("last_ts").isNull() | (F.col("last_ts") < cutoff)})
    b = q.agg(F.count("*").alias("q_total"), n_if("active", "q_active"), n_if("not coalesce(verified, false)", "q_missing_verified"), n_if("partial and not verified", "q_partial"), n_if("verified is null", "q_never_attempted"),
              n_if("active and next_action_date is null", "q_no_follow_up"), n_if("active and old", "q_stale"))
    c = items.agg(n_if("status in ('success', 'failed')", "items"), n_if("status = 'success'", "items_success"), n_if("status = 'failed'", "items_failed"), F.round(F.try_divide(F.count_if(F.col("status") == "success"), F.count_if(F.col("status").isin("success", "failed"))), 6).alias("success_rate"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each


@query("data_quality_report", f"""with c as (select id, case when person is null and addr is null then 'failed' when person is null or addr is null or starts_with(addr, 'office') then 'partial' else 'verified' end as quality from contact),
    b as (select id, bool_or(quality = 'verified') as verified, bool_or(quality = 'partial') as partial from c group by 1), l as (select id, max(ts) as last_ts from activity_log group by id),
    t as (select * from register left join b using (id) where {TARGET_SQL}), q as (select queue.*, verified, partial, stage not in ('won', 'lost') as active, last_ts is null or last_ts < timestamp '{EVENTS_AS_OF}' - interval 14 days as old from queue left join b using (id) left join l using (id))
    select * from (select count(*) as n_target, count(verified) as n_attempted, count(*) - count(verified) as n_never_attempted, count(*) filter (verified) as n_verified, count(*) filter (partial and not verified) as n_partial from t) x,
    (select count(*) as q_total, count(*) filter (active) as q_active, count(*) filter (not coalesce(verified, false)) as q_missing_verified, count(*) filter (partial and not verified) as q_partial, count(*) filter (verified is null) as q_never_attempted,
      count(*) filter (active and next_action_date is null) as q_no_follow_up, count(*) filter (active and old) as q_stale from q) y,
    (select count(*) filter (event_type in ('purchase', 'error')) as items, count(*) filter (event_type = 'purchase') as items_success, count(*) filter (event_type = 'error') as items_failed,
      round(count(*) filter (event_type = 'purchase') / nullif(count(*) filter (event_type in ('purchase', 'error')), 0), 6) as success_rate from activity_log) z""")  # fmt: skip
def _(v):
    quality = F.when(F.col("person").isNull() & F.col("addr").isNull(), "failed").when(F.col("person").isNull() | F.col("addr").isNull() | F.col("addr").startswith("office"), "partial").otherwise("verified")
    items = v.activity_log.select(F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failed").alias("status"))
    return data_quality_report(v.register, v.contact.select("id", quality.alias("quality")), v.queue, v.activity_log, items, EVENTS_AS_OF)


#: Which event types stand for which stage in the log.
STAGE_EVENTS = {"click": "contacted", "view": "responded", "purchase": "won", "error": "lost"}
FUNNEL_SQL = """with e as (select id, case event_type when 'click' then 'contacted' when 'view' then 'responded' when 'purchase' then 'won' when 'error' then 'lost' end as stage from activity_log),
    f as (select stage, count(distinct id) as n from (select id, stage from queue union select id, stage from e where stage is not null union select id, 'not_contacted' from queue) t group by stage)"""


def funnel_reached(queue: DataFrame, log: DataFrame) -> DataFrame:
    """Entities per stage: there now or ever moved there; the first stage is the queue's size. All stages in one job."""
    moved = F.element_at(F.create_map(*[F.lit(x) for kv in STAGE_EVENTS.items() for x in kv]), F.col("event_type"))
    logged = log.select("id", moved.alias("stage")).filter("stage is not null")
    first = queue.select("id", F.lit("not_contacted").alias("stage"))
    return queue.select("id", "stage").union(logged).union(first).distinct().groupBy("stage").agg(F.count("*").alias("n"))


@query("funnel_reached", FUNNEL_SQL + " select stage, n from f")
def _(v):
    return funnel_reached(v.queue, v.activity_log)


@query("funnel_rates", FUNNEL_SQL + """ select round(sum(n) filter (stage = 'won') / nullif(sum(n) filter (stage in ('won', 'lost')), 0), 6) as win_rate,
    round(sum(n) filter (stage = 'responded') / nullif(sum(n) filter (stage = 'contacted'), 0), 6) as response_rate from f""")  # fmt: skip
def _(v):
    f = funnel_reached(v.queue, v.activity_log)
    n = lambda *s: F.sum(F.when(F.col("stage").isin(*s), F.col("n")).otherwise(0))
    return f.agg(F.round(F.try_divide(n("won"), n("won", "lost")), 6).alias("win_rate"), F.round(F.try_divide(n("responded"), n("contacted")), 6).alias("response_rate"))


@query("avg_by_outcome", "select round(avg(total) filter (stage = 'won'), 6) as won, round(avg(total) filter (stage = 'lost'), 6) as lost from queue q join scored s on s.id = q.id")
def _(v):
    t = v.queue.join(v.scored, "id")
    return t.agg(*[F.round(F.avg(F.when(F.col("stage") == s, F.col("total"))), 6).alias(s) for s in ("won", "lost")])


BANDS = [(0, 39), (40, 59), (60, 79), (80, 200)]
BANDS_SQL = "(values (0, 39), (40, 59), (60, 79), (80, 200)) b(low, high)"


def score_bands(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """Rows per inclusive band with won, lost and rate; empty bands stay. The bands are a short list; counts come first."""
    counts = rows.filter("total is not null").groupBy("total").agg(F.count("*").alias("n"), n_if("stage = 'won'", "w"), n_if("stage = 'lost'", "l"))
    hit = F.col("total").between(F.col("low"), F.col("high"))
    sums = F.broadcast(bands).join(counts, hit, "left").groupBy("low", "high").agg(*[F.coalesce(F.sum(a), F.lit(0)).alias(b) for a, b in (("n", "rows"), ("w", "won"), ("l", "lost"))])
    return sums.withColumn("rate", ratio("won", "won + lost"))


@query("score_bands", f"""select low, high, count(t.id) as rows, count(*) filter (stage = 'won') as won, count(*) filter (stage = 'lost') as lost,
    round(count(*) filter (stage = 'won') / nullif(count(*) filter (stage in ('won', 'lost')), 0), 6) as rate
    from {BANDS_SQL} left join (select q.id, q.stage, s.total from queue q join scored s on s.id = q.id) t on total between low and high group by low, high""")  # fmt: skip
def _(v):
    return score_bands(v.queue.join(v.scored, "id"), v.spark.createDataFrame(BANDS, "low int, high int"))


@query("region_conversion", """select coalesce(r.region, 'Unknown') as region, count(*) as n, count(*) filter (stage = 'won') as won, count(*) filter (stage = 'lost') as lost,
    round(count(*) filter (stage = 'won') / nullif(count(*) filter (stage in ('won', 'lost')), 0), 6) as rate from queue q left join register r on r.id = q.id and r.id % 13 <> 0 group by 1""")  # fmt: skip
def _(v):
    t = v.queue.join(v.register.filter("id % 13 <> 0").select("id", "region"), "id", "left")
    g = t.groupBy(F.coalesce("region", F.lit("Unknown")).alias("region")).agg(F.count("*").alias("n"), n_if("stage = 'won'", "won"), n_if("stage = 'lost'", "lost"))
    return g.withColumn("rate", ratio("won", "won + lost")).orderBy(F.desc("n"), "region")


@query("last_activity", "select id, max(ts) as last_ts from activity_log group by id")
def _(v):
    return last_activity(v.activity_log)


@query("batch_sizes", "select b.batch_id, count(m.id) as n, max(m.added_at) as newest from (values (0), (1), (2), (3), (4), (5), (6), (7), (8)) b(batch_id) left join batch_member m on m.batch_id = b.batch_id group by 1")
def _(v):
    batches = v.spark.range(9).withColumnRenamed("id", "batch_id")
    sizes = v.batch_member.groupBy("batch_id").agg(F.count("*").alias("c"), F.max("added_at").alias("newest"))
    return batches.join(sizes, "batch_id", "left").select("batch_id", F.coalesce("c", F.lit(0)).alias("n"), "newest").orderBy(F.desc_nulls_last("newest"), "batch_id")


@query("status_totals", """select count(*) as n_all, count(q.id) filter (b.id is null) as pipeline, count(b.id) as campaign, count(*) filter (q.id is null and b.id is null) as available
    from register r left join queue q on q.id = r.id left join batch_member b on b.id = r.id where r.region in ('ASIA', 'EUROPE')""")  # fmt: skip
def _(v):
    t = with_status(v.register.filter("region in ('ASIA', 'EUROPE')"), v.queue, v.batch_member)
    return t.agg(F.count("*").alias("n_all"), *[n_if(f"status = '{s}'", s) for s in ("pipeline", "campaign", "available")])


@query("coverage_report", LADDER_SQL + """ select count(*) as processed, round(avg(case when ladder in ('complete', 'successful') then 1.0 else 0.0 end), 6) as reachable,
    round(avg(case when ladder in ('complete', 'successful', 'partial') then 1.0 else 0.0 end), 6) as named from l where id in (select id from contact)""")  # fmt: skip
def _(v):
    t = contact_ladder(v.register, v.contact).filter("any_addr is not null")
    share = lambda c, n: F.round(F.avg(F.expr(c).cast("double")), 6).alias(n)
    return t.agg(F.count("*").alias("processed"), share("ladder in ('complete', 'successful')", "reachable"), share("ladder in ('complete', 'successful', 'partial')", "named"))


@query("run_yield_bands", """with t as (select s.level, case when total is null then 'none' when total < 40 then 'low' when total < 80 then 'mid' else 'high' end as band, s.id in (select id from contact where addr is not null) as hit
    from scored s where s.id in (select o_custkey from orders where o_orderkey % 5 = 0)) select band, level, count(*) as processed, count(*) filter (hit) as hits from t group by grouping sets ((band), (level), ())""")  # fmt: skip
def _(v):
    band = F.when(F.col("total").isNull(), "none").when(F.col("total") < 40, "low").when(F.col("total") < 80, "mid").otherwise("high")
    hits = v.contact.filter("addr is not null").select("id", F.lit(True).alias("hit")).distinct()
    run = v.orders.filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("id"))
    t = v.scored.join(run, "id", "left_semi").join(hits, "id", "left").withColumn("band", band)
    return t.groupingSets([[F.col("band")], [F.col("level")], []], "band", "level").agg(F.count("*").alias("processed"), n_if("hit", "hits"))


def confusion(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels(id, truth) against found(id): recovered, missed, false alarms, rightly silent."""
    t = labels.join(found.select("id", F.lit(True).alias("fired")).distinct(), "id", "left").withColumn("fired", F.coalesce("fired", F.lit(False)))
    return t.agg(n_if("truth and fired", "recovered"), n_if("truth and not fired", "missed"), n_if("not truth and fired", "false_alarms"), n_if("not truth and not fired", "silent"))


@query("audit_confusion", """with t as (select l.doc_id, l.quality = 0 as truth, coalesce(d.fired, false) as fired from labels l left join
    (select doc_id, contains(text, '###') or contains(text, '!!') as fired from documents) d on d.doc_id = l.doc_id)
    select count(*) filter (truth and fired) as recovered, count(*) filter (truth and not fired) as missed, count(*) filter (not truth and fired) as false_alarms, count(*) filter (not truth and not fired) as silent from t""")  # fmt: skip
def _(v):
    return confusion(v.labels.selectExpr("doc_id as id", "quality = 0 as truth"), v.documents.filter("contains(text, '###') or contains(text, '!!')").selectExpr("doc_id as id"))


@query("issue_histogram", "select coalesce(case when value > 50 then event_type end, 'none') as issue, count(*) as n from events group by 1")
def _(v):
    issue = F.coalesce(F.when(F.col("value") > 50, F.col("event_type")), F.lit("none"))
    return v.events.groupBy(issue.alias("issue")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue")


def shared_shingles(pages: DataFrame, site: str, page: str, text: str, size: int = 40, least_pages: int = 3, share: float = 0.6) -> DataFrame:
    """(site, shingle, pages) for `size`-character pieces that at least `share` of a site's pages have."""
    n = F.floor((F.length(text) - 1) / size).cast("int")
    pieces = pages.filter(F.length(text) >= size).select(site, page, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(F.col(text), i * size + 1, F.lit(size))))).alias("shingle"))
    total = pages.groupBy(site).agg(F.count("*").alias("total")).filter(F.col("total") >= least_pages)
    counts = pieces.groupBy(site, "shingle").agg(F.count("*").alias("pages"))
    return counts.join(total, site).filter(F.col("pages") >= share * F.col("total")).select(site, "shingle", "pages")


@query("boilerplate_shingles", """with p as (select distinct lang, doc_id, substr(text, cast(i * 40 + 1 as bigint), 40) as shingle from (select lang, doc_id, text, unnest(range(cast(floor((length(text) - 1) / 40) as bigint) + 1)) as i from documents where length(text) >= 40) t),
    n as (select lang, count(*) as total from documents group by 1 having count(*) >= 3)
    select p.lang, shingle, count(*) as pages from p join n on n.lang = p.lang group by p.lang, shingle, total having count(*) >= 0.02 * total""")  # fmt: skip
def _(v):
    return shared_shingles(v.documents, "lang", "doc_id", "text", share=0.02)


@query("outbound_domain_dominance", r"""with l as (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) as own, unnest(regexp_extract_all(html, 'href="https?://([^/"]+)', 1)) as host from pages),
    c as (select page_id, lower(host) as host, count(*) as n from l where lower(host) <> own group by 1, 2), s as (select *, sum(n) over (partition by page_id) as total, row_number() over (partition by page_id order by n desc, host) as rn from c)
    select page_id, host, n from s where rn = 1 and n >= 2 and n >= 0.6 * total""")  # fmt: skip
def _(v):
    return dominant_domain(v.pages, least=2)


def dominant_domain(pages: DataFrame, least: int = 5, share: float = 0.6) -> DataFrame:
    """Per page the most linked foreign host, if linked often enough and most of the foreign links go there."""
    own = F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1))
    links = pages.select("page_id", own.alias("own"), F.explode(F.regexp_extract_all("html", F.lit('href="https?://([^/"]+)'), 1)).alias("host"))
    counts = links.filter(F.lower("host") != F.col("own")).groupBy("page_id", F.lower("host").alias("host")).agg(F.count("*").alias("n"))
    best = counts.groupBy("page_id").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("neg"), "host")).alias("b"))
    return best.select("page_id", "b.host", (-F.col("b.neg")).alias("n"), "total").filter((F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).drop("total")


@query("duplicate_name_groups", "select lower(trim(p_name)) as name_key, p_brand, count(*) as n, min(p_partkey) as first_id from part group by 1, 2 having count(*) > 1")
def _(v):
    return v.part.groupBy(F.lower(F.trim("p_name")).alias("name_key"), "p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id")).filter("n > 1")


OUTCOME = "case when id % 17 = 0 then 'inactive' when level = 'MACHINERY' then 'other_type' when id % 19 = 0 then 'online' when size_n is null then 'no_size' when id % 23 = 0 then 'adult' else 'imported' end"


def import_counters(rows: DataFrame, usable: Column, samples: int = 20) -> tuple[DataFrame, DataFrame]:
    """rows(id, outcome): how many came to each outcome (online ones count as another type, imported rows that can't be used as
    errors), and the errors with the smallest ids as samples."""
    bad = (F.col("outcome") == "imported") & ~F.coalesce(usable, F.lit(False))
    o = rows.withColumn("outcome", F.when(bad, "error").when(F.col("outcome") == "online", "other_type").otherwise(F.col("outcome")))
    return o.groupBy("outcome").agg(F.count("*").alias("n")), o.filter("outcome = 'error'").orderBy("id").limit(samples)


@query("import_counters", f"""with o as (select id, case when o = 'imported' and not coalesce(size_n >= 20, false) then 'error' when o = 'online' then 'other_type' else o end as outcome from (select *, {OUTCOME} as o from register) t)
    select outcome, count(*) as n from o group by 1 union all select 'sample', id from (select id from o where outcome = 'error' order by id limit 20) s""")  # fmt: skip
def _(v):
    counts, samples = import_counters(v.register.select("id", "size_n", F.expr(OUTCOME).alias("outcome")), F.col("size_n") >= 20)
    return counts.union(samples.select(F.lit("sample"), "id"))


@query("rescore_counters", "select coalesce(case when total is null then 'unscored' when level in ('BUILDING', 'FURNITURE') then 'secondary' else 'primary' end) as rubric, count(*) as n from scored group by 1")
def _(v):
    rubric = F.when(F.col("total").isNull(), "unscored").when(F.col("level").isin("BUILDING", "FURNITURE"), "secondary").otherwise("primary")
    return v.scored.groupBy(rubric.alias("rubric")).agg(F.count("*").alias("n"))


def run_cost_totals(before: DataFrame, after: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: entities that a run found, still lacks, lost (there before, not now) and failed on; its calls, tokens and
    mean seconds. before: id, found; after: id, found, failed; calls: tokens, seconds."""
    j = before.select("id", F.col("found").alias("had")).join(after, "id", "full_outer")
    had, has = F.coalesce("had", F.lit(False)), F.coalesce("found", F.lit(False))
    a = j.agg(F.count_if(has & ~had).alias("found"), F.count_if(~has & ~had).alias("missing"), F.count_if(had & ~has).alias("lost"), F.count_if("failed").alias("errors"))
    b = calls.agg(F.count("*").alias("calls"), F.round(F.sum("tokens"), 2).alias("tokens"), F.round(F.avg("seconds"), 6).alias("mean_seconds"))
    return a.join(F.broadcast(b))


@query("run_cost_totals", """with h as (select user_id as id, bool_or(event_type = 'purchase' and value > 60) as had from events where event_id % 2 = 0 group by 1),
    a as (select user_id as id, bool_or(event_type = 'purchase' and value > 60) as found, bool_or(event_type = 'error' and value > 80) as failed from events where event_id % 2 = 1 group by 1),
    j as (select coalesce(had, false) as had, coalesce(found, false) as has, coalesce(failed, false) as failed from h full join a on a.id = h.id)
    select * from (select count(*) filter (has and not had) as found, count(*) filter (not has and not had) as missing, count(*) filter (had and not has) as lost, count(*) filter (failed) as errors from j) x,
    (select count(*) as calls, round(sum(value), 2) as tokens, round(avg(value), 6) as mean_seconds from events where event_id % 2 = 1) y""")  # fmt: skip
def _(v):
    found, failed = F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 60)), F.bool_or((F.col("event_type") == "error") & (F.col("value") > 80))
    e = v.events.withColumnRenamed("user_id", "id")
    runs = e.filter("event_id % 2 = 1")
    return run_cost_totals(e.filter("event_id % 2 = 0").groupBy("id").agg(found.alias("found")), runs.groupBy("id").agg(found.alias("found"), failed.alias("failed")), runs.select(F.col("value").alias("tokens"), F.col("value").alias("seconds")))
