"""Joins over the register: look-ups, semi and anti joins, blocked fuzzy matching, evidence containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.addresses import domain_suffixes
from ledgerline.operators.segments import TARGET_SQL, target_population, with_status
from ledgerline.plans.registry import query
from ledgerline.plans.views import EVENTS_AS_OF


@query("queue_inner_join", "select q.id, q.stage, s.name, s.total from queue q join scored s on s.id = q.id")
def _(v):
    return v.queue.join(v.scored, "id").select("id", "stage", "name", "total")


@query("directory_star_join", """select s.id, s.city, s.total, q.stage, b.batch_id, case when b.id is not null then 'campaign' when q.id is not null then 'pipeline' else 'available' end as status
    from scored s left join queue q on q.id = s.id left join batch_member b on b.id = s.id""")  # fmt: skip
def _(v):
    rows = with_status(v.scored, v.queue, v.batch_member)
    return rows.join(v.queue.select("id", "stage"), "id", "left").join(v.batch_member.select("id", "batch_id"), "id", "left").select("id", "city", "total", "stage", "batch_id", "status")


@query("anti_not_exists", """select id from register r where not exists (select 1 from queue q where q.id = r.id) and not exists (select 1 from batch_member b where b.id = r.id)""")
def _(v):
    return v.register.join(v.queue, "id", "left_anti").join(v.batch_member, "id", "left_anti").select("id")


@query("semi_exists", "select id from register r where exists (select 1 from contact c where c.id = r.id and c.role = 'teacher' and c.addr is not null)")
def _(v):
    return v.register.join(v.contact.filter("role = 'teacher' and addr is not null"), "id", "left_semi").select("id")


@query("anti_not_in", "select distinct id from contact where person is not null and id not in (select id from contact where addr is not null)")
def _(v):
    # keys are never null, so an anti join says the same as NOT IN without its null-aware broadcast
    return v.contact.filter("person is not null").select("id").distinct().join(v.contact.filter("addr is not null").select("id"), "id", "left_anti")


@query("left_is_null", f"select id, total from scored r where {TARGET_SQL} and total >= 70 and not exists (select 1 from queue q where q.id = r.id)")
def _(v):
    return v.scored.filter(target_population() & (F.col("total") >= 70)).join(v.queue, "id", "left_anti").select("id", "total")


def last_activity(log: DataFrame) -> DataFrame:
    return log.groupBy("id").agg(F.max("ts").alias("last_ts"))


@query("join_to_aggregate", f"""with l as (select id, max(ts) as last_ts from activity_log group by id)
    select q.id, l.last_ts from queue q left join l on l.id = q.id where l.last_ts is null or l.last_ts < timestamp '{EVENTS_AS_OF}' - interval 14 days""")  # fmt: skip
def _(v):
    return stale(v.queue, v.activity_log, EVENTS_AS_OF, 14)


def stale(queue: DataFrame, log: DataFrame, as_of: str, days: int) -> DataFrame:
    """Queue members without activity for so many days, or ever."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    return queue.join(last_activity(log), "id", "left").filter(F.col("last_ts").isNull() | (F.col("last_ts") < cutoff)).select("id", "last_ts")


@query("bridge_join", """select t.tag, count(distinct r.id) as n_rows, (select count(distinct o_orderpriority) from orders) as n_tags from register r
    join (select distinct o_custkey as id, o_orderpriority as tag from orders) t on t.id = r.id group by t.tag""")  # fmt: skip
def _(v):
    bridge = v.orders.selectExpr("o_custkey as id", "o_orderpriority as tag").distinct()
    n = v.orders.agg(F.count_distinct("o_orderpriority").alias("n_tags"))
    return v.register.join(bridge, "id").groupBy("tag").agg(F.count("*").alias("n_rows")).crossJoin(F.broadcast(n))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Look a key up in a small configuration table; what it lacks gets the default."""
    return df.join(F.broadcast(table), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


TIERS = {"NATION_0": "capital", "NATION_7": "capital", "NATION_3": "large_city", "NATION_12": "large_city", "NATION_18": "large_city"}


@query("broadcast_lookup", """select id, city, case when city in ('NATION_0', 'NATION_7') then 'capital' when city in ('NATION_3', 'NATION_12', 'NATION_18')
    then 'large_city' else 'smaller_town' end as tier from register""")  # fmt: skip
def _(v):
    table = v.spark.createDataFrame(list(TIERS.items()), "city string, tier string")
    return lookup(v.register, table, "city", "tier", "smaller_town").select("id", "city", "tier")


def membership_split(requested: DataFrame, queue: DataFrame, members: DataFrame) -> DataFrame:
    """Each requested id once: in_campaign, in_pipeline or new."""
    return with_status(requested.select("id").distinct(), queue, members).select("id", F.when(F.col("status") == "campaign", "in_campaign").when(F.col("status") == "pipeline", "in_pipeline").otherwise("new").alias("outcome"))


SPLIT_SQL = """with req as (select distinct o_custkey as id from orders where o_orderkey % 7 = 0),
    s as (select r.id, case when b.id is not null then 'in_campaign' when q.id is not null then 'in_pipeline' else 'new' end as outcome
    from req r left join queue q on q.id = r.id left join batch_member b on b.id = r.id)"""


def requested(v) -> DataFrame:
    return v.orders.filter("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("id"))


@query("membership_split", SPLIT_SQL + " select * from s")
def _(v):
    return membership_split(requested(v), v.queue, v.batch_member)


@query("bulk_result_counts", SPLIT_SQL + """ select count(*) filter (outcome = 'new') as moved, count(*) filter (outcome = 'in_pipeline') as already_in_pipeline,
    count(*) filter (outcome = 'in_campaign') as already_in_campaign from s""")  # fmt: skip
def _(v):
    s = membership_split(requested(v), v.queue, v.batch_member)
    return s.agg(F.count_if(F.col("outcome") == "new").alias("moved"), F.count_if(F.col("outcome") == "in_pipeline").alias("already_in_pipeline"), F.count_if(F.col("outcome") == "in_campaign").alias("already_in_campaign"))


@query("latest_confirmed_lookup", """with m as (select o_custkey as id, year(o_orderdate) as yr, o_totalprice as conf, o_orderkey as match_id, o_orderkey % 500 + 1 as rnk from orders where o_orderstatus = 'F'),
    b as (select *, row_number() over (partition by id order by yr desc, conf desc, match_id desc) as rn from m)
    select r.id, b.yr, b.rnk, case when b.rnk <= 100 then 'top100' when b.rnk <= 300 then 'top300' when b.rnk is not null then 'listed' end as tier from register r left join b on b.id = r.id and b.rn = 1""")  # fmt: skip
def _(v):
    m = v.orders.filter("o_orderstatus = 'F'").selectExpr("o_custkey as id", "year(o_orderdate) as yr", "o_totalprice as conf", "o_orderkey as match_id", "o_orderkey % 500 + 1 as rnk")
    best = m.groupBy("id").agg(F.max(F.struct("yr", "conf", "match_id", "rnk")).alias("m"))
    tier = F.when(F.col("m.rnk") <= 100, "top100").when(F.col("m.rnk") <= 300, "top300").when(F.col("m.rnk").isNotNull(), "listed")
    return v.register.join(best, "id", "left").select("id", "m.yr", "m.rnk", tier.alias("tier"))


def two_sources(registry: DataFrame, site: DataFrame) -> DataFrame:
    """One row per key: the site's where both agree on the person or the site's is sure of itself, else the registry's.
    Name and address always come from one source together."""
    r, s = registry.select("k", F.struct("person", "addr").alias("r")), site.select("k", F.struct("person", "addr").alias("s"), "sure")
    differ = F.col("r").isNotNull() & F.col("s").isNotNull() & ~F.col("r.person").eqNullSafe(F.col("s.person"))
    use_site = F.col("s").isNotNull() & (F.col("r").isNull() | ~differ | F.coalesce("sure", F.lit(False)))
    one = F.when(use_site, F.col("s")).otherwise(F.col("r"))
    return r.join(s, "k", "full_outer").select("k", one["person"].alias("person"), one["addr"].alias("addr"), F.when(use_site, "site").otherwise("registry").alias("source"), differ.alias("conflict"))


@query("two_source_conflict", """with r as (select c_custkey as k, c_mktsegment as person, c_name as addr from customer where c_custkey % 3 <> 0),
    s as (select s_suppkey as k, case when s_suppkey % 2 = 0 then 'BUILDING' else 'MACHINERY' end as person, s_name as addr, s_suppkey % 5 = 0 as sure from supplier where s_suppkey % 4 <> 0),
    j as (select coalesce(r.k, s.k) as k, r.person rp, r.addr ra, s.person sp, s.addr sa, r.k is not null as inr, s.k is not null as ins, coalesce(s.sure, false) as sure from r full join s on r.k = s.k),
    u as (select *, inr and ins and rp is distinct from sp as conflict from j), w as (select *, ins and (not inr or not conflict or sure) as use_site from u)
    select k, case when use_site then sp else rp end as person, case when use_site then sa else ra end as addr, case when use_site then 'site' else 'registry' end as source, conflict from w""")  # fmt: skip
def _(v):
    r = v.customer.filter("c_custkey % 3 <> 0").selectExpr("c_custkey as k", "c_mktsegment as person", "c_name as addr")
    s = v.supplier.filter("s_suppkey % 4 <> 0").selectExpr("s_suppkey as k", "case when s_suppkey % 2 = 0 then 'BUILDING' else 'MACHINERY' end as person", "s_name as addr", "s_suppkey % 5 = 0 as sure")
    return two_sources(r, s)


def vendor_addresses(rows: DataFrame, vendors: DataFrame, addr: str = "addr") -> DataFrame:
    """rows whose address is of one of vendors(domain) or of a subdomain, with that domain: an equi-join on the suffixes."""
    d = rows.withColumn("domain", F.explode(domain_suffixes(F.rtrim(F.lower(F.element_at(F.split(addr, "@"), -1)), F.lit(".")))))
    return d.join(vendors.select("domain").distinct(), "domain")


#: Stored addresses: the contacts', some of them at a vendor's.
STORED_SQL = "s as (select id, case when l_orderkey % 6 = 0 then 'x@sub.librus.pl' when l_orderkey % 6 = 1 then 'y@cke.gov.pl' when l_orderkey % 6 = 2 then 'z@notlibrus.pl' else addr end as addr from contact)"
VENDORS = ["librus.pl", "cke.gov.pl", "vulcan.pl"]


def stored(v) -> DataFrame:
    k = F.col("l_orderkey") % 6
    return v.contact.select("id", F.when(k == 0, "x@sub.librus.pl").when(k == 1, "y@cke.gov.pl").when(k == 2, "z@notlibrus.pl").otherwise(F.col("addr")).alias("addr"))


@query("domain_suffix_join", f"with {STORED_SQL}, h as (select id, addr, lower(split_part(addr, '@', 2)) as dom from s) select id, addr, d.domain from h join (values ('librus.pl'), ('cke.gov.pl'), ('vulcan.pl')) d(domain) on dom = d.domain or ends_with(dom, '.' || d.domain)")
def _(v):
    return vendor_addresses(stored(v), v.spark.createDataFrame([(d,) for d in VENDORS], "domain string")).select("id", "addr", "domain")


def leak_audit(rows: DataFrame, vendors: DataFrame) -> DataFrame:
    """How many stored addresses each domain has that should have none, and of how many entities."""
    n = vendor_addresses(rows, vendors).groupBy("domain").agg(F.count("*").alias("c"), F.count_distinct("id").alias("e"))
    return vendors.join(n, "domain", "left").select("domain", F.coalesce("c", F.lit(0)).alias("n"), F.coalesce("e", F.lit(0)).alias("entities"))


@query("leak_audit", f"with {STORED_SQL}, h as (select id, lower(split_part(addr, '@', 2)) as dom from s) select d.domain, count(id) as n, count(distinct id) as entities from (values ('librus.pl'), ('cke.gov.pl'), ('vulcan.pl')) d(domain) left join h on dom = d.domain or ends_with(dom, '.' || d.domain) group by 1")
def _(v):
    return leak_audit(stored(v), v.spark.createDataFrame([(d,) for d in VENDORS], "domain string"))


SNAP_SQL = """with a as (select o_custkey as id, max(o_totalprice) as p, count(*) as n from orders where o_orderdate < '1998-01-01' group by 1),
    b as (select o_custkey as id, max(o_totalprice) as p, count(*) as n from orders where o_orderdate >= '1998-01-01' group by 1)"""


@query("snapshot_compare", SNAP_SQL + """ select count(*) filter (a.p < b.p) as up, count(*) filter (a.p > b.p) as down, count(*) filter (a.p = b.p) as same,
    count(*) filter (a.id is null) as gained, count(*) filter (b.id is null) as lost, count(*) filter (a.n <> b.n) as changed from a full join b on a.id = b.id""")  # fmt: skip
def _(v):
    def snap(c):
        return v.orders.filter(c).groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("p"), F.count("*").alias("n"))

    a, b = snap("o_orderdate < '1998-01-01'").alias("a"), snap("o_orderdate >= '1998-01-01'").alias("b")
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    return a.join(b, F.col("a.id") == F.col("b.id"), "full_outer").agg(n("a.p < b.p", "up"), n("a.p > b.p", "down"), n("a.p = b.p", "same"), n("a.id is null", "gained"), n("b.id is null", "lost"), n("a.n <> b.n", "changed"))


CASES = [(1, ["red", "bolt"], "Brand#1", ["old"]), (2, ["small"], "Brand#25", []), (3, ["ring"], "Brand#3", ["hot"])]


@query("case_resolution", """with c as (select * from (values (1, ['red', 'bolt'], 'Brand#1', ['old']), (2, ['small'], 'Brand#25', []), (3, ['ring'], 'Brand#3', ['hot'])) t(case_id, frags, place, banned)),
    h as (select case_id, p_partkey from part join c on contains(p_brand, place) and list_aggregate(list_transform(frags, lambda f: case when contains(p_name, f) then 0 else 1 end), 'sum') = 0
    and coalesce(list_aggregate(list_transform(banned, lambda f: case when contains(p_name, f) then 1 else 0 end), 'sum'), 0) = 0)
    select case_id, count(*) as hits, case when count(*) = 1 then min(p_partkey) end as resolved from h group by 1""")  # fmt: skip
def _(v):
    cases = F.broadcast(v.spark.createDataFrame(CASES, "case_id int, frags array<string>, place string, banned array<string>"))
    part = v.part
    name = part["p_name"]
    hit = F.contains("p_brand", "place") & F.forall("frags", lambda f: F.contains(name, f)) & ~F.exists("banned", lambda f: F.contains(name, f))
    return part.join(cases, hit).groupBy("case_id").agg(F.count("*").alias("hits"), F.when(F.count("*") == 1, F.min("p_partkey")).alias("resolved"))


def resolve_addresses(people: DataFrame, addresses: DataFrame) -> DataFrame:
    """Every unclaimed address of an entity with every named person of it, where the address has the person's name."""
    local = F.lower(F.split("addr", "@")[0])
    named = F.lower("person")
    pairs = people.join(addresses, "id").filter(F.contains(F.regexp_replace(local, "[^a-z0-9]", ""), F.regexp_replace(named, "[^a-z0-9]", "")))
    return pairs.select("id", "person", "addr").distinct()


@query("address_person_match", """with p as (select distinct o_custkey as id, 'p' || cast(l_suppkey as varchar) as person from lineitem join orders on o_orderkey = l_orderkey where l_quantity <= 2),
    a as (select distinct id, addr from contact where addr is not null) select distinct p.id, p.person, a.addr from p join a on a.id = p.id
    and contains(regexp_replace(lower(split_part(addr, '@', 1)), '[^a-z0-9]', '', 'g'), regexp_replace(lower(person), '[^a-z0-9]', '', 'g'))""")  # fmt: skip
def _(v):
    own = v.lineitem.filter("l_quantity <= 2").join(v.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    people = own.selectExpr("o_custkey as id", "'p' || cast(l_suppkey as string) as person").distinct()
    return resolve_addresses(people, v.contact.filter("addr is not null").select("id", "addr").distinct())
