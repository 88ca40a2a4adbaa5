"""Best rows per group: windows with a full tiebreak, and greedy choices within a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.addresses import DELIVERABLE, HINT_SQL, NAMES, PERSON_SQL, RULES, TIER_SQL, AddressRules, campaign_tier, deliverable, level_hint, one_person
from ledgerline.functions.urls import registrable, registrable_sql
from ledgerline.operators.segments import TARGET_SQL, target_population
from ledgerline.plans.registry import query
from ledgerline.plans.storage import written
from ledgerline.plans.views import AS_OF, EVENTS_AS_OF


def current_score(history: DataFrame) -> DataFrame:
    """The newest row of each (id, rubric): a view on the history, never stored. One aggregate with map-side combining."""
    newest = F.max(F.struct("computed_at", "hist_id", "total")).alias("s")
    return history.groupBy("id", "rubric").agg(newest).select("id", "rubric", "s.total", "s.hist_id", "s.computed_at")


@query("current_score", "select id, rubric, total, hist_id, computed_at from current_score")
def _(v):
    return current_score(v.score_history)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The n first rows of each group in a full order; each task keeps its own n first before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= n)


def address_tier(addr: Column) -> Column:
    """0 a person's, 1 an office's, 3 none."""
    return F.when(addr.isNull(), 3).when(addr.startswith("office"), 1).otherwise(0)


@query("contact_dedupe", """select id, role, person, addr, captured_at from (select *, row_number() over (partition by id, role, lower(trim(person))
    order by case when addr is null then 3 when starts_with(addr, 'office') then 1 else 0 end, captured_at desc, addr, l_orderkey, l_linenumber) as rn from contact) t where rn = 1""")  # fmt: skip
def _(v):
    c = v.contact.withColumns({"key": F.lower(F.trim("person")), "tier": address_tier(F.col("addr"))})
    return top_per_group(c, ["id", "role", "key"], [F.asc("tier"), F.desc("captured_at"), F.asc("addr"), F.asc("l_orderkey"), F.asc("l_linenumber")]).select("id", "role", "person", "addr", "captured_at")


@query("best_address", """select id, addr, owner from (select id, addr, role as owner, row_number() over (partition by id order by case role when 'teacher' then 0 when 'director' then 1 else 2 end, addr) as rn
    from contact where addr is not null) t where rn = 1""")  # fmt: skip
def _(v):
    return best_address(v.contact)


def best_address(contacts: DataFrame) -> DataFrame:
    """The first address by role: teacher, director, office; with whose it is."""
    rank = F.when(F.col("role") == "teacher", 0).when(F.col("role") == "director", 1).otherwise(2)
    best = contacts.filter("addr is not null").groupBy("id").agg(F.min(F.struct(rank.alias("rank"), "addr", "role")).alias("b"))
    return best.select("id", "b.addr", F.col("b.role").alias("owner"))


@query("work_queue", f"""with l as (select id, max(ts) as last_ts from activity_log group by id),
    t as (select q.id, stage, total, next_action_date as due, cast(date_diff('day', cast(next_action_date as date), date '{AS_OF[:10]}') as bigint) as late, last_ts from queue q join scored s on s.id = q.id left join l on l.id = q.id
      where stage not in ('won', 'lost')),
    p as (select *, case when late > 0 then 0 when late = 0 then 1 when stage = 'not_contacted' then 2 else 3 end as prio from t),
    o as (select *, row_number() over (order by prio, -coalesce(total, -1), case when prio in (0, 1) then -late when prio = 2 then id else coalesce(-cast(date_diff('day', cast(last_ts as date), date '{EVENTS_AS_OF[:10]}') as bigint), id) end, id) as pos from p)
    select pos, id, prio, case prio when 0 then 'overdue by ' || late || case when late = 1 then ' day' else ' days' end when 1 then 'due today' when 2 then 'not contacted yet' else 'in progress' end as reason from o where pos <= 40""")  # fmt: skip
def _(v):
    return work_queue(v.queue, v.scored, v.activity_log, AS_OF, EVENTS_AS_OF, 40)


def work_queue(queue: DataFrame, scored: DataFrame, log: DataFrame, as_of: str, log_as_of: str, n: int) -> DataFrame:
    """The n next entities: overdue, due today, not contacted, the rest; then by score, then by date, id or idle days."""
    t = queue.filter(~F.col("stage").isin("won", "lost")).join(scored.select("id", "total"), "id").join(log.groupBy("id").agg(F.max("ts").alias("last_ts")), "id", "left")
    t = t.withColumn("late", F.date_diff(F.lit(as_of).cast("date"), F.col("next_action_date").cast("date")).cast("long"))
    t = t.withColumn("prio", F.when(F.col("late") > 0, 0).when(F.col("late") == 0, 1).when(F.col("stage") == "not_contacted", 2).otherwise(3))
    idle = F.date_diff(F.lit(log_as_of).cast("date"), F.col("last_ts").cast("date")).cast("long")
    third = F.when(F.col("prio") < 2, -F.col("late")).when(F.col("prio") == 2, F.col("id")).otherwise(F.coalesce(-idle, F.col("id")))
    key = [F.asc("prio"), (-F.coalesce("total", F.lit(-1))).asc(), third.asc(), F.asc("id")]
    best = t.orderBy(*key).limit(n)  # a top-n; the numbering below sees these n rows only
    late = F.concat(F.lit("overdue by "), F.col("late").cast("string"), F.when(F.col("late") == 1, " day").otherwise(" days"))
    reason = F.when(F.col("prio") == 0, late).when(F.col("prio") == 1, "due today").when(F.col("prio") == 2, "not contacted yet").otherwise("in progress")
    return best.select(F.row_number().over(Window.orderBy(*key)).alias("pos"), "id", "prio", reason.alias("reason"))


@query("latest_event_per_entity", "select id, event_id, event_type, ts from (select *, row_number() over (partition by id order by ts desc, event_id desc) as rn from activity_log where value is not null) t where rn = 1")
def _(v):
    return latest_event(v.activity_log.filter("value is not null"))


def latest_event(log: DataFrame) -> DataFrame:
    best = log.groupBy("id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e"))
    return best.select("id", "e.event_id", "e.event_type", "e.ts")


#: Ranks of confidence (fixed values); others come last, as do pages without a tier.
CONFIDENCE = {"high": 0, "medium": 1, "low": 2}


def best_record_per_role(claims: DataFrame, tiers: DataFrame, roles: list[str], entity: str = "id") -> DataFrame:
    """Each entity's best claim among roles (in order of preference): by role, confidence, tier of the page, name and url.
    claims: entity, role, confidence, name, url, ...; tiers: entity, url, tier. Repeated rows are one claim."""
    place = F.element_at(F.create_map(*[F.lit(x) for p in zip(roles, range(len(roles))) for x in p]), F.col("role"))
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in CONFIDENCE.items() for x in p]), F.col("confidence")), F.lit(9))
    tier = tiers.groupBy(entity, "url").agg(F.min("tier").alias("tier"))
    d = claims.filter(F.col("role").isin(*roles)).join(tier, [entity, "url"], "left")
    key = F.struct(place.alias("k0"), rank.alias("k1"), F.coalesce("tier", F.lit(99)).alias("k2"), F.col("name").alias("k3"), F.col("url").alias("k4"))
    return d.groupBy(entity).agg(F.min(F.struct(key.alias("key"), F.col("role"), F.col("confidence"))).alias("b")).select(entity, "b.role", "b.confidence", F.col("b.key.k2").alias("tier"), F.col("b.key.k3").alias("name"), F.col("b.key.k4").alias("url"))


CLAIM_SQL = """with c as (select conv_id as id, ['director', 'deputy', 'teacher', 'other'][(conv_id + turn) % 4 + 1] as role, ['high', 'medium', 'low', 'odd'][length(text) % 4 + 1] as confidence, 'n' || md5(text) as name, 'u' || turn % 3 as url from conversations),
    t as (select distinct conv_id as id, 'u' || turn % 3 as url, (conv_id + turn) % 3 as tier from conversations where turn % 3 < 2 and turn < 2)"""


@query("best_record_per_role", CLAIM_SQL + """ select id, role, confidence, tier, name, url from (select c.*, coalesce(tier, 99) as tier, row_number() over (partition by c.id order by case role when 'director' then 0 else 1 end,
    case confidence when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 9 end, coalesce(tier, 99), name, c.url, role, confidence) as rn from c left join t on t.id = c.id and t.url = c.url where role in ('director', 'deputy')) x where rn = 1""")  # fmt: skip
def _(v):
    k, turn = F.col("conv_id"), F.col("turn")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % 4 + 1).cast("int"))
    url = F.concat(F.lit("u"), (turn % 3).cast("string")).alias("url")
    claims = v.conversations.select(k.alias("id"), pick(["director", "deputy", "teacher", "other"], k + turn).alias("role"), pick(["high", "medium", "low", "odd"], F.length("text")).alias("confidence"), F.concat(F.lit("n"), F.md5("text")).alias("name"), url)
    tiers = v.conversations.filter("turn % 3 < 2 and turn < 2").select(k.alias("id"), url, ((k + turn) % 3).cast("int").alias("tier")).distinct()
    return best_record_per_role(claims, tiers, ["director", "deputy"])


def office_rank(addr: Column, rules: AddressRules = RULES) -> list[Column]:
    """The eight parts by which an entity's office address is chosen, smallest first: one person's mailbox; a number that isn't
    the entity's; no place of the entity's; another's domain; the level (own, none, another's); not a central office's;
    the tier for mail to many; not the registered one. Reads the columns name, level, registered, places, site."""
    own = F.split(addr, "@")[0]
    number = F.nullif(F.regexp_extract(F.lower("name"), r"\bnr\.?\s*(\d+)\b", 1), F.lit(""))
    found = F.transform(F.regexp_extract_all(F.regexp_replace(F.lower(own), rf"({'|'.join(sorted(rules.complexes, key=len, reverse=True))})\s*\d+", ""), F.lit(r"\d+"), 0), lambda d: F.when(F.ltrim(d, F.lit("0")) == "", d).otherwise(F.ltrim(d, F.lit("0"))))
    conflict = number.isNotNull() & (F.size(found) > 0) & ~F.array_contains(found, F.coalesce(number, F.lit("")))
    plain = F.regexp_replace(F.translate(F.lower(own), "ąćęłńóśźż", "acelnoszz"), "[^a-z0-9]", "")
    placed = F.exists(F.coalesce("places", F.array().cast("array<string>")), lambda p: F.contains(plain, p))
    site = F.coalesce(registrable(F.lower(F.element_at(F.split(addr, "@"), -1))) == F.col("site"), F.lit(False))
    hint = level_hint(addr, rules)
    level = F.when(hint == F.col("level"), 0).when(hint.isNull(), 1).otherwise(2)
    first = F.lower(F.split(own, "[._-]")[0])
    central = first.isin(*rules.office, *rules.central) | F.lower(own).isin(*rules.office, *rules.central)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return [flag(one_person(addr, rules)), flag(conflict), flag(~placed), flag(~site), level, flag(~central), campaign_tier(addr, rules), flag(~F.coalesce(addr == F.col("registered"), F.lit(False)))]


def best_office_address(candidates: DataFrame, rules: AddressRules = RULES, entity: str = "id") -> DataFrame:
    """Each entity's office address: among those that can be written to, if there are any, the least by office_rank, then by
    place. candidates: entity, addr, pos, name, level, registered, places (array), site (registrable domain)."""
    d = candidates.filter("addr is not null and addr <> ''")
    keys = [(~deliverable(F.col("addr"))).cast("int"), *office_rank(F.col("addr"), rules), F.col("pos"), F.col("addr")]
    best = d.groupBy(entity).agg(F.min(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])).alias("b"))
    return best.select(entity, F.col(f"b.k{len(keys) - 1}").alias("addr"))


OFFICE_FORMS = ["sekretariat@", "sp3@", "lo7@", "j.nowak@", "zsp7.biuro@", "rekrutacja@", "wawer@", "broken", "centrum@", "iod@"]
OFFICE_PLACES = {"0": "s1.example.com", "1": "other.example.org", "2": "s1.example.com", "3": "sub.librus.pl"}


@query("best_office_address", rf"""with c as (select distinct c_custkey as id, [{", ".join(repr(f) for f in OFFICE_FORMS)}][o_orderkey % 10 + 1] as form, [{", ".join(repr(d) for d in OFFICE_PLACES.values())}][(o_orderkey // 10) % 4 + 1] as dom, o_orderkey as pos,
      case when c_custkey % 3 = 0 then 'School nr ' || c_custkey % 9 else 'School' end as name, ['primary', 'liceum', 'technikum'][c_custkey % 3 + 1] as level, case when c_custkey % 2 = 0 then ['wawer'] else [] end as places, case when c_custkey % 4 < 3 then 'example.com' end as site from customer join orders on o_custkey = c_custkey),
    a as (select *, case when ends_with(form, '@') then form || dom else form end as addr, case when id % 5 = 0 then 'lo7@s1.example.com' end as registered from c),
    l as (select *, lower(split_part(addr, '@', 1)) as loc, lower(split_part(addr, '@', 2)) as dom2, nullif(regexp_extract(lower(name), '\bnr[.]?\s*(\d+)\b', 1), '') as num from (select * exclude dom, dom as dom0 from a) x),
    k as (select *, dom2 as dom, regexp_extract_all(regexp_replace(loc, '({"|".join(sorted(RULES.complexes, key=len, reverse=True))})\s*[0-9]+', '', 'g'), '[0-9]+') as nums from l)
    select id, addr from (select id, addr, row_number() over (partition by id order by regexp_matches(addr, '{DELIVERABLE}') desc, {PERSON_SQL.replace(repr(NAMES), "('')")}, num is not null and len(nums) > 0 and not list_contains(nums, coalesce(num, '')), not coalesce(len(list_filter(places, lambda p: contains(loc, p))) > 0, false),
      not coalesce({registrable_sql("dom")} = site, false), case when {HINT_SQL} = level then 0 when {HINT_SQL} is null then 1 else 2 end,
      not (regexp_split_to_array(loc, '[._-]')[1] in {RULES.office + RULES.central!r} or loc in {RULES.office + RULES.central!r}), {TIER_SQL}, not coalesce(addr = registered, false), pos, addr) as rn from k) t where rn = 1""")  # fmt: skip
def _(v):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), n.cast("int"))
    form = pick(OFFICE_FORMS, o % 10 + 1)
    c = v.customer.join(v.orders, o_key(v)).select(
        k.alias("id"), F.when(form.endswith("@"), F.concat(form, pick(list(OFFICE_PLACES.values()), F.floor(o / 10) % 4 + 1))).otherwise(form).alias("addr"), o.alias("pos"),
        F.when(k % 3 == 0, F.concat(F.lit("School nr "), (k % 9).cast("string"))).otherwise("School").alias("name"), pick(["primary", "liceum", "technikum"], k % 3 + 1).alias("level"),
        F.when(k % 5 == 0, "lo7@s1.example.com").alias("registered"), F.when(k % 2 == 0, F.array(F.lit("wawer"))).alias("places"), F.when(k % 4 < 3, "example.com").alias("site"),
    )
    return best_office_address(c)


def o_key(v) -> Column:
    return F.col("o_custkey") == F.col("c_custkey")


@query("first_occurrence_dedupe", "select p_size as rnk, upper(p_name) as name, upper(p_type) as city, min(p_partkey) as pos from part group by 1, 2, 3")
def _(v):
    return v.part.groupBy(F.col("p_size").alias("rnk"), F.upper("p_name").alias("name"), F.upper("p_type").alias("city")).agg(F.min("p_partkey").alias("pos"))


@query("latest_state_per_entity", """select id, event_type, value, event_id from (select *, row_number() over (partition by id, event_type order by event_id desc) as rn from activity_log where value > 5) t where rn = 1""")
def _(v):
    best = v.activity_log.filter("value > 5").groupBy("id", "event_type").agg(F.max(F.struct("event_id", "value")).alias("e"))
    return best.select("id", "event_type", "e.value", "e.event_id")


def disambiguated(rows: DataFrame, group: list[str], labels: list[Column]) -> DataFrame:
    """In each group of more than one row, the first of the labels that makes the row distinct in it; else null."""
    size = F.count("*").over(Window.partitionBy(*group))
    d = rows.withColumns({f"l{i}": c for i, c in enumerate(labels)} | {"size": size})
    d = d.withColumns({f"n{i}": F.count("*").over(Window.partitionBy(*group, f"l{i}")) for i in range(len(labels))})
    pick = F.coalesce(*[F.when(F.col(f"l{i}").isNotNull() & (F.col(f"n{i}") == 1), F.col(f"l{i}")) for i in range(len(labels))])
    return d.withColumn("label", F.when(F.col("size") > 1, pick))


@query("name_disambiguator", """with d as (select s_suppkey as id, s_nationkey % 7 as grp, n_name as l0, n_name || ' ' || cast(s_suppkey % 3 as varchar) as l1, n_name || ' ' || cast(s_suppkey % 5 as varchar) as l2 from supplier join nation on n_nationkey = s_nationkey),
    c as (select *, count(*) over (partition by grp) as size, count(*) over (partition by grp, l0) as n0, count(*) over (partition by grp, l1) as n1, count(*) over (partition by grp, l2) as n2 from d)
    select id, grp, case when size > 1 then case when n0 = 1 then l0 when n1 = 1 then l1 when n2 = 1 then l2 end end as label from c""")  # fmt: skip
def _(v):
    d = v.supplier.join(v.nation, F.col("n_nationkey") == F.col("s_nationkey")).selectExpr("s_suppkey as id", "s_nationkey % 7 as grp", "n_name", "s_suppkey")
    by = lambda n: F.concat("n_name", F.lit(" "), (F.col("s_suppkey") % n).cast("string"))
    return disambiguated(d, ["grp"], [F.col("n_name"), by(3), by(5)]).select("id", "grp", "label")


@query("roster_file_rank", r"""with l as (select page_id, html, generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) as pos, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as href from pages),
    c as (select page_id, pos, href, case when starts_with(href, '/') and length(href) <= 4 then 0 when starts_with(href, '/') then 1 else 2 end as cls from l)
    select page_id, pos, href, cls from (select *, row_number() over (partition by page_id order by cls, pos) as rn from c) t where rn <= 3""")  # fmt: skip
def _(v):
    links = v.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("p", "href")).withColumn("pos", (F.col("p") + 1).cast("long"))
    cls = F.when(F.col("href").startswith("/") & (F.length("href") <= 4), 0).when(F.col("href").startswith("/"), 1).otherwise(2)
    return top_per_group(links.withColumn("cls", cls), ["page_id"], [F.asc("cls"), F.asc("pos")], 3).select("page_id", "pos", "href", "cls")


def page_budget(pages: DataFrame, entity: str, page: str, tier: str, size: str, most_pages: int = 8, most_chars: int = 50_000) -> DataFrame:
    """Pages by tier: one that would pass the budget is skipped, later smaller ones may still fit, the first always stays.

    What doesn't fit once never fits later, so the next page is the least one behind the last that fits. Each round finds
    it for all entities at once by partial aggregation; a site with very many pages is never gathered. Null sizes count as
    nothing, pages of a null entity belong together.
    """
    p = pages.select(F.col(entity).alias("e"), F.struct(F.col(tier).alias("tier"), F.col(page).alias("page"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size")).alias("p"))
    p = written(p, "pages")
    kept = written(p.groupBy("e").agg(F.min("p").alias("p")).withColumn("used", F.col("p.size")), "kept")
    all_kept = kept
    for _ in range(most_pages - 1):
        so_far = kept.select(F.col("e").alias("of"), F.col("p").alias("last"), "used")
        fits = p.join(so_far, F.col("e").eqNullSafe(F.col("of"))).filter((F.col("p") > F.col("last")) & (F.col("used") + F.col("p.size") <= most_chars))
        kept = fits.groupBy("e").agg(F.min("p").alias("p"), F.first("used").alias("used")).withColumn("used", F.col("used") + F.col("p.size"))
        kept = written(kept, "kept")
        if kept.isEmpty():
            break
        all_kept = all_kept.unionByName(kept)
    return all_kept.select(F.col("e").alias(entity), F.col("p.page").alias(page))


@query("page_budget", """with recursive p as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id % 3, doc_id) as i from documents),
    w(source, i, doc_id, n, used, took) as (select source, i, doc_id, 1, n_chars, true from p where i = 1
      union all select p.source, p.i, p.doc_id, w.n + case when w.n < 8 and w.used + p.n_chars <= 12000 then 1 else 0 end, w.used + case when w.n < 8 and w.used + p.n_chars <= 12000 then p.n_chars else 0 end,
      w.n < 8 and w.used + p.n_chars <= 12000 from w join p on p.source = w.source and p.i = w.i + 1)
    select source, doc_id from w where took""")  # fmt: skip
def _(v):
    return page_budget(v.documents.withColumn("tier", F.col("doc_id") % 3), "source", "doc_id", "tier", "n_chars", most_chars=12_000)


@query("same_content_pages", """select doc_id, source, min(doc_id) over (partition by source, md5(text)) as first_id, doc_id <> min(doc_id) over (partition by source, md5(text)) as repeated from documents""")
def _(v):
    return same_content(v.documents)


def same_content(pages: DataFrame) -> DataFrame:
    """Whether the same text was on another page of the site before. First pages come by partial aggregation and are
    joined back, so a text that a site repeats very often isn't gathered in one window."""
    hashed = pages.select("doc_id", "source", F.md5("text").alias("h"))
    first = hashed.groupBy("source", "h").agg(F.min("doc_id").alias("first_id"))
    return hashed.join(first, ["source", "h"]).select("doc_id", "source", "first_id", (F.col("doc_id") != F.col("first_id")).alias("repeated"))


@query("next_candidates", f"""select id, total from (select r.*, row_number() over (order by total desc nulls last, id) as n from scored r where {TARGET_SQL}
    and id not in (select id from activity_log where event_type in ('purchase', 'error'))) t where n <= 25""")  # fmt: skip
def _(v):
    return next_candidates(v.scored, v.activity_log.filter("event_type in ('purchase', 'error')"), 25).select("id", "total")


def next_candidates(scored: DataFrame, attempts: DataFrame, n: int) -> DataFrame:
    """The best-scored targets that no attempt was made on."""
    return scored.filter(target_population()).join(attempts.select("id"), "id", "left_anti").orderBy(F.desc_nulls_last("total"), "id").limit(n)
