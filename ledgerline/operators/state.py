"""State tables: snapshot in, snapshot out. Every transition returns the new state, and the log rows where it makes any.

Nothing is updated in place: a transition joins the state with its change set and its result is written as a new version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.addresses import BLOCKED_SQL, RULES, AddressRules, blocked
from ledgerline.functions.scoring import RUBRICS, SCORE_SQL, TOTAL_SQL, scorable, score
from ledgerline.operators.joins import STORED_SQL, membership_split, stored
from ledgerline.plans.registry import query
from ledgerline.plans.views import AS_OF


def newest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Repeats in one file: the last row wins."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def snapshot_upsert(current: DataFrame, snapshot: DataFrame, key: str, columns: list[str], protected: dict[str, Column] | None = None, order: str | None = None, usable: Column | None = None) -> DataFrame:
    """current joined with a full snapshot: new keys come in, known ones take the snapshot's columns (but those protected
    under their condition), keys that the snapshot lacks turn inactive and are never deleted.

    Of repeated keys the row with the greatest `order` counts. Rows without a key or that aren't `usable` are left out, as if
    the snapshot lacked them; `rejected` returns them."""
    good = snapshot.filter(F.col(key).isNotNull() if usable is None else F.col(key).isNotNull() & F.coalesce(usable, F.lit(False)))
    c, s = current.alias("c"), (newest_per_key(good, key, order) if order else good).alias("s")
    there, had = F.col(f"s.{key}").isNotNull(), F.col(f"c.{key}").isNotNull()
    keep = protected or {}

    def value(name: str) -> Column:
        new = F.when(there, F.col(f"s.{name}")).otherwise(F.col(f"c.{name}"))
        return F.when(had & keep[name], F.col(f"c.{name}")).otherwise(new) if name in keep else new

    change = F.when(~had, "inserted").when(there, "updated").otherwise("missing")
    return c.join(s, F.col(f"c.{key}") == F.col(f"s.{key}"), "full_outer").select(F.coalesce(f"c.{key}", f"s.{key}").alias(key), *[value(n).alias(n) for n in columns], there.alias("is_active"), change.alias("change"))


def rejected(snapshot: DataFrame, key: str, usable: Column) -> DataFrame:
    """The rows that an import can't take; it goes on without them."""
    return snapshot.filter(~F.coalesce(F.col(key).isNotNull() & usable, F.lit(False)))


#: A register, and a file in which every third key comes twice (the later row in capitals) and some rows can't be read.
UPSERT_SQL = """with c as (select c_custkey as id, c_name as name, 'http://old' || cast(c_custkey as varchar) as site, case when c_custkey % 4 = 0 then 'manual' else 'registry' end as src from customer where c_custkey % 5 <> 0),
    raw as (select c_custkey as id, c_name as name, 'http://first' || cast(c_custkey as varchar) as site, 'registry' as src, c_custkey as pos, c_acctbal as size_n from customer where c_custkey % 7 <> 0
      union all select c_custkey, upper(c_name), 'http://new' || cast(c_custkey as varchar), 'registry', c_custkey + 1000000000, c_acctbal from customer where c_custkey % 3 = 0),
    f as (select * from (select *, row_number() over (partition by id order by pos desc) as rn from raw where size_n >= -800) t where rn = 1),
    u as (select coalesce(c.id, f.id) as id, case when f.id is not null then f.name else c.name end as name, case when c.id is not null and c.src = 'manual' then c.site when f.id is not null then f.site else c.site end as site,
      case when c.id is not null and c.src = 'manual' then c.src when f.id is not null then f.src else c.src end as src, f.id is not null as is_active,
      case when c.id is null then 'inserted' when f.id is not null then 'updated' else 'missing' end as change from c full join f on c.id = f.id)"""


def import_file(v) -> DataFrame:
    first = v.customer.filter("c_custkey % 7 <> 0").selectExpr("c_custkey as id", "c_name as name", "'http://first' || cast(c_custkey as string) as site", "'registry' as src", "c_custkey as pos", "c_acctbal as size_n")
    again = v.customer.filter("c_custkey % 3 = 0").selectExpr("c_custkey", "upper(c_name)", "'http://new' || cast(c_custkey as string)", "'registry'", "c_custkey + 1000000000", "c_acctbal")
    return first.union(again)


def upserted(v) -> DataFrame:
    c = v.customer.filter("c_custkey % 5 <> 0").selectExpr("c_custkey as id", "c_name as name", "'http://old' || cast(c_custkey as string) as site", "case when c_custkey % 4 = 0 then 'manual' else 'registry' end as src")
    manual = F.col("c.src") == "manual"
    return snapshot_upsert(c, import_file(v), "id", ["name", "site", "src"], {"site": manual, "src": manual}, "pos", F.col("size_n") >= -800)


@query("snapshot_upsert", UPSERT_SQL + " select 'state' as part, id, name, is_active, change from u union all select 'error', id, name, false, 'rejected' from raw where not coalesce(size_n >= -800, false)")
def _(v):
    errors = rejected(import_file(v), "id", F.col("size_n") >= -800)
    state = upserted(v).select(F.lit("state").alias("part"), "id", "name", "is_active", "change")
    return state.union(errors.select(F.lit("error"), "id", "name", F.lit(False), F.lit("rejected")))


@query("protected_columns", UPSERT_SQL + " select id, site, src from u")
def _(v):
    return upserted(v).select("id", "site", "src")


@query("soft_delete_missing", UPSERT_SQL + " select is_active, change, count(*) as n from u group by 1, 2")
def _(v):
    return upserted(v).groupBy("is_active", "change").agg(F.count("*").alias("n"))


def append_scores(history: DataFrame, rows: DataFrame, rubrics: dict, computed_at: str) -> tuple[DataFrame, DataFrame]:
    """The history with a new row for each entity that a rubric scores (`rows` with a column rubric; null: none), and the
    pointers: the current row of each entity and rubric, the new one where there is one. Nothing that was stored changes.

    New numbers follow the greatest so far by the entity's id and the rubric's place, so no task numbers all rows."""
    names = sorted(rubrics)
    top = history.agg(F.coalesce(F.max("hist_id"), F.lit(0)).alias("top"))
    number = F.element_at(F.create_map(*[F.lit(x) for p in zip(names, range(len(names))) for x in p]), F.col("rubric"))
    new = score(rows.filter(F.col("rubric").isin(names)), rubrics).join(F.broadcast(top))
    new = new.select("id", "rubric", (F.col("top") + 1 + F.col("id") * len(names) + number).alias("hist_id"), "total", F.lit(computed_at).cast("timestamp_ntz").alias("computed_at"), F.lit(True).alias("new"))
    grown = history.select("id", "rubric", "hist_id", "total", "computed_at", F.lit(False).alias("new")).unionByName(new)
    current = grown.groupBy("id", "rubric").agg(F.count("*").alias("versions"), F.max_by(F.struct("hist_id", "total"), F.struct("new", "computed_at", "hist_id")).alias("c"))
    return grown.drop("new"), current.select("id", "rubric", "versions", F.col("c.hist_id").alias("current_id"), F.col("c.total").alias("total"))


@query("append_score_history", SCORE_SQL + f""", t as (select max(hist_id) as top from score_history),
    n as (select id, rubric, top + 1 + id * 2 + case rubric when 'primary' then 0 else 1 end as hist_id, {TOTAL_SQL} as total, timestamp '2030-01-01' as computed_at, true as new from p, t where not is_adult and level in ('AUTOMOBILE', 'BUILDING', 'FURNITURE')),
    g as (select id, rubric, hist_id, total, computed_at, false as new from score_history union all select * from n)
    select id, rubric, count(*) as versions, max_by(hist_id, (new, computed_at, hist_id)) as current_id, max_by(total, (new, computed_at, hist_id)) as total from g group by 1, 2""")  # fmt: skip
def _(v):
    rows = scorable(v).filter("not is_adult and level in ('AUTOMOBILE', 'BUILDING', 'FURNITURE')")
    return append_scores(v.score_history, rows, RUBRICS, "2030-01-01")[1]


def log_rows(ids: DataFrame, kind: str, old: Column | None = None, new: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return ids.select("id", F.lit(kind).alias("event_type"), (none if old is None else old).alias("from_stage"), (none if new is None else new).alias("to_stage"))


def pull_into_queue(queue: DataFrame, members: DataFrame, requested: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """New queue members (each id once, neither queued nor in a batch) and their log rows."""
    new = membership_split(requested, queue, members).filter("outcome = 'new'").select("id")
    rows = new.select("id", F.lit("not_contacted").alias("stage"), F.lit(as_of).cast("timestamp_ntz").alias("stage_updated_at"))
    return queue.select("id", "stage", "stage_updated_at").unionByName(rows), log_rows(new, "pulled", new=F.lit("not_contacted"))


REQ_SQL = "req as (select distinct o_custkey as id from orders where o_orderkey % 7 = 0)"


def requested(v) -> DataFrame:
    return v.orders.filter("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("id"))


@query("pull_into_queue", f"""with {REQ_SQL}, n as (select id from req where id not in (select id from queue) and id not in (select id from batch_member))
    select 'state' as part, id, stage as v from queue union all select 'state', id, 'not_contacted' from n union all select 'log', id, 'pulled' from n""")  # fmt: skip
def _(v):
    state, log = pull_into_queue(v.queue, v.batch_member, requested(v), AS_OF)
    return state.select(F.lit("state").alias("part"), "id", F.col("stage").alias("v")).union(log.select(F.lit("log"), "id", "event_type"))


@query("release_from_queue", f"""with {REQ_SQL} select 'state' as part, id, stage as v from queue where id not in (select id from req)
    union all select 'log', id, stage from queue where id in (select id from req)""")  # fmt: skip
def _(v):
    req = requested(v)
    log = log_rows(v.queue.join(req, "id", "left_semi"), "released", old=F.col("stage"))
    return v.queue.join(req, "id", "left_anti").select(F.lit("state").alias("part"), "id", F.col("stage").alias("v")).union(log.select(F.lit("log"), "id", "from_stage"))


def change_stage(queue: DataFrame, changes: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """New state and a log row for each change to a member, one that changes nothing included."""
    j = queue.join(changes.select("id", "new_stage"), "id", "left")
    changed = F.col("new_stage").isNotNull()
    state = j.select("id", F.coalesce("new_stage", "stage").alias("stage"), F.when(changed, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("stage_updated_at")).alias("stage_updated_at"))
    return state, log_rows(j.filter(changed), "stage_change", F.col("stage"), F.col("new_stage"))


@query("change_stage", f"""with c as (select o_custkey as id, case when max(o_orderkey) % 2 = 0 then 'won' else 'contacted' end as new_stage from orders where o_orderkey % 9 = 0 group by 1)
    select q.id, coalesce(c.new_stage, stage) as stage, case when c.id is not null then timestamp '{AS_OF}' else stage_updated_at end as stage_updated_at, case when c.id is not null then stage end as logged_from
    from queue q left join c on c.id = q.id""")  # fmt: skip
def _(v):
    c = v.orders.filter("o_orderkey % 9 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.when(F.max("o_orderkey") % 2 == 0, "won").otherwise("contacted").alias("new_stage"))
    state, log = change_stage(v.queue, c, AS_OF)
    return state.join(log.select("id", F.col("from_stage").alias("logged_from")), "id", "left")


def move_to_batch(queue: DataFrame, members: DataFrame, ids: DataFrame, batch_id: int, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Queue without the moved, members with them (their stage kept), log rows, and the outcome of every requested id. An id
    that is a member of a batch already isn't moved again."""
    req = ids.select("id").distinct()
    going = req.join(members.select("id"), "id", "left_anti")
    taken = queue.join(going, "id", "left_semi")
    moved = taken.select("id", F.lit(batch_id).cast("long").alias("batch_id"), F.lit(as_of).cast("timestamp_ntz").alias("added_at"), F.col("stage").alias("stage_at_move"))
    out = req.join(queue.select("id", F.lit(True).alias("q")), "id", "left").join(members.select("id", F.lit(True).alias("m")), "id", "left")
    outcome = out.select("id", F.when(F.col("m"), "already_in_campaign").when(F.col("q"), "moved").otherwise("not_in_pipeline").alias("outcome"))
    had = members.select("id", "batch_id", "added_at", (F.col("stage_at_move") if "stage_at_move" in members.columns else F.lit(None)).cast("string").alias("stage_at_move"))
    return queue.join(going, "id", "left_anti"), had.unionByName(moved), log_rows(taken, "moved_to_batch", old=F.col("stage")), outcome


@query("move_to_batch", f"""with {REQ_SQL}, go as (select id, stage from queue where id in (select id from req) and id not in (select id from batch_member)),
    had as (select id, batch_id, case id % 3 when 0 then 'responded' when 1 then 'won' end as s from batch_member)
    select 'queue' as part, id, stage as v from queue where id not in (select id from go)
    union all select 'member', id, batch_id || ':' || coalesce(s, '') from had union all select 'member', id, '99:' || stage from go
    union all select 'log', id, stage from go
    union all select 'outcome', id, case when id in (select id from batch_member) then 'already_in_campaign' when id in (select id from queue) then 'moved' else 'not_in_pipeline' end from req""")  # fmt: skip
def _(v):
    had = v.batch_member.withColumn("stage_at_move", F.expr("case id % 3 when 0 then 'responded' when 1 then 'won' end"))
    queue, members, log, outcome = move_to_batch(v.queue, had, requested(v), 99, AS_OF)
    rows = queue.select(F.lit("queue").alias("part"), "id", F.col("stage").alias("v")).union(members.select(F.lit("member"), "id", F.concat(F.col("batch_id").cast("string"), F.lit(":"), F.coalesce("stage_at_move", F.lit("")))))
    return rows.union(log.select(F.lit("log"), "id", "from_stage")).union(outcome.select(F.lit("outcome"), "id", "outcome"))


STAGES = ["not_contacted", "contacted", "responded", "won", "lost"]


def return_from_batch(queue: DataFrame, members: DataFrame, batch_id: int, as_of: str, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The queue with a batch's members back (or those among `ids`) in the stage they had, an unknown stage as the first; the
    members that are left; and a log row for each that came back. The batch itself stays."""
    back = F.when(F.col("stage_at_move").isin(STAGES), F.col("stage_at_move")).otherwise(F.lit(STAGES[0]))
    own = members.filter(F.col("batch_id") == batch_id)
    own = own if ids is None else own.join(ids.select("id").distinct(), "id", "left_semi")
    going = own.select("id", back.alias("stage"), F.lit(as_of).cast("timestamp_ntz").alias("stage_updated_at"))
    left = members.join(own.select("id", "batch_id"), ["id", "batch_id"], "left_anti")
    return queue.select("id", "stage", "stage_updated_at").unionByName(going), left, log_rows(going, "pulled", new=F.col("stage"))


RETURN_SQL = """m as (select id, batch_id, case id % 4 when 0 then 'contacted' when 1 then 'gone_stage' when 2 then 'won' end as stage_at_move from batch_member),
    g as (select id, batch_id, case when stage_at_move in ('not_contacted', 'contacted', 'responded', 'won', 'lost') then stage_at_move else 'not_contacted' end as stage from m where batch_id = 3 or (batch_id = 4 and id in (select id from req)))"""


@query("return_from_batch", f"""with {REQ_SQL}, {RETURN_SQL} select 'queue' as part, id, stage as v from queue union all select 'queue', id, stage from g union all select 'log', id, stage from g
    union all select 'member', id, cast(batch_id as varchar) from m where id not in (select id from g)""")  # fmt: skip
def _(v):
    m = v.batch_member.selectExpr("id", "batch_id", "case id % 4 when 0 then 'contacted' when 1 then 'gone_stage' when 2 then 'won' end as stage_at_move")
    queue, m, log = return_from_batch(v.queue, m, 3, AS_OF)  # a whole batch, then single ids of another
    queue, m, more = return_from_batch(queue, m, 4, AS_OF, requested(v))
    rows = queue.select(F.lit("queue").alias("part"), "id", F.col("stage").alias("v")).union(log.union(more).select(F.lit("log"), "id", "to_stage"))
    return rows.union(m.select(F.lit("member"), "id", F.col("batch_id").cast("string")))


@query("delete_batch", "select id, batch_id from batch_member where batch_id <> 3")
def _(v):
    return v.batch_member.join(v.spark.createDataFrame([(3,)], "batch_id long"), "batch_id", "left_anti").select("id", "batch_id")


#: Events of outreach, which go with the queue; all others tell of the entity itself and stay.
OUTREACH = ["pulled", "released", "stage_change", "note", "email_sent", "email_opened", "reminder"]


def clear_queue(queue: DataFrame, log: DataFrame, contacts: DataFrame, outreach: list[str] = OUTREACH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An empty queue, the log without outreach, and the counts of what went and what stayed. Batches aren't touched."""
    kept = log.filter(~F.coalesce(F.col("event_type").isin(outreach), F.lit(False)))
    counts = log.agg(F.count_if(F.col("event_type").isin(outreach)).alias("log_removed"), F.count("*").alias("n")).selectExpr("log_removed", "n - log_removed as log_kept")
    counts = counts.join(F.broadcast(queue.agg(F.count("*").alias("queue_removed")))).join(F.broadcast(contacts.agg(F.count("*").alias("contacts_kept"))))
    return queue.filter("false"), kept, counts


@query("clear_queue", """select 'log' as part, event_type as key, event_id as n from activity_log where event_type not in ('click', 'view')
    union all select 'count', 'log_removed', count(*) filter (event_type in ('click', 'view')) from activity_log union all select 'count', 'log_kept', count(*) filter (event_type not in ('click', 'view')) from activity_log
    union all select 'count', 'queue_removed', count(*) from queue union all select 'count', 'contacts_kept', count(*) from contact""")  # fmt: skip
def _(v):
    queue, log, counts = clear_queue(v.queue, v.activity_log, v.contact, ["click", "view"])
    rows = log.select(F.lit("log").alias("part"), F.col("event_type").alias("key"), F.col("event_id").alias("n")).union(queue.select(F.lit("queue"), "stage", "id"))
    return rows.union(counts.unpivot([], ["log_removed", "log_kept", "queue_removed", "contacts_kept"], "key", "n").select(F.lit("count"), "key", "n"))


def reset_workflow(tables: dict[str, DataFrame], emptied: list[str], cleared: dict[str, list[str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after a reset: those of `emptied` without rows, the columns of `cleared` null, the others as they are; and
    for each table how many rows went, stayed and were cleared of a value."""
    after, counts = {}, []
    for name, t in tables.items():
        columns = [] if name in emptied else cleared.get(name, [])
        held = reduce(lambda a, c: a | F.col(c).isNotNull(), columns, F.lit(False))
        n = t.agg(F.count("*").alias("n"), F.count_if(held).alias("cleared"))
        gone = F.lit(name in emptied)
        counts.append(n.select(F.lit(name).alias("tbl"), F.when(gone, F.col("n")).otherwise(0).alias("removed"), F.when(gone, 0).otherwise(F.col("n")).alias("kept"), "cleared"))
        after[name] = t.filter("false") if name in emptied else t.withColumns({c: F.lit(None).cast(t.schema[c].dataType) for c in columns})
    return after, reduce(DataFrame.union, counts)


#: Work tables that a reset empties, of those there are.
WORK_TABLES = ["contact", "queue", "batch_member", "activity_log"]


@query("reset_workflow", """select 'count:queue' as part, count(*) as removed, 0 as kept, 0 as cleared from queue union all select 'count:batch_member', count(*), 0, 0 from batch_member union all select 'count:contact', count(*), 0, 0 from contact
    union all select 'count:activity_log', count(*), 0, 0 from activity_log union all select 'count:register', 0, count(*), count(*) filter (is_private is not null or size_n is not null) from register union all select 'count:score_history', 0, count(*), 0 from score_history
    union all select 'after:' || t, 0, n, n from (select 'queue' as t, 0 as n union all select 'batch_member', 0 union all select 'contact', 0 union all select 'activity_log', 0 union all select 'score_history', count(*) from score_history union all select 'register', count(*) from register) x""")  # fmt: skip
def _(v):
    tables = {t: getattr(v, t) for t in [*WORK_TABLES, "register", "score_history"]}
    after, counts = reset_workflow(tables, WORK_TABLES, {"register": ["is_private", "size_n"]})
    empty = {"register": "is_private is null and size_n is null"}
    left = [t.agg(F.count("*").alias("n"), F.count_if(F.expr(empty.get(name, "true"))).alias("c")).select(F.lit(f"after:{name}").alias("part"), F.lit(0).cast("long").alias("removed"), "n", "c") for name, t in after.items()]
    return counts.select(F.concat(F.lit("count:"), "tbl").alias("part"), "removed", "kept", "cleared").union(reduce(DataFrame.union, left))


def retire_blocked(contacts: DataFrame, rules: AddressRules = RULES) -> DataFrame:
    """The contacts without those whose address reaches others than the entity; a contact without address stays."""
    return contacts.filter(~F.coalesce(blocked(F.col("addr"), rules), F.lit(False)))


@query("retire_blocked", f"""with {STORED_SQL}, l as (select id, addr, lower(split_part(addr, '@', 1)) as loc, lower(split_part(addr, '@', 2)) as dom from s) select id, addr from l where addr is null or not {BLOCKED_SQL}""")
def _(v):
    return retire_blocked(stored(v))


@query("hygiene_backfill", r"""with a as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9.-]+')) as old from documents), n as (select doc_id, old, case when regexp_matches(lower(old), '^[^@]+@[^@]+[.][a-z]{2,}$') then lower(old) end as new from a)
    select doc_id, old, new, case when new is null then 'cleared' else 'lowered' end as kind from n where old is distinct from new""")  # fmt: skip
def _(v):
    a = v.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9.-]+"), 0)).alias("old"))
    new = F.when(F.lower("old").rlike(r"^[^@]+@[^@]+[.][a-z]{2,}$"), F.lower("old"))
    return a.withColumn("new", new).filter(~F.col("old").eqNullSafe(F.col("new"))).withColumn("kind", F.when(F.col("new").isNull(), "cleared").otherwise("lowered"))


def bulk_tag(tagged: DataFrame, ids: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """The tags with one more for many entities, and those that didn't have it yet; each pair once."""
    new = ids.select("id", F.lit(tag).alias("tag")).distinct().join(tagged, ["id", "tag"], "left_anti")
    return tagged.select("id", "tag").union(new), new


@query("bulk_tag", """with t as (select distinct o_custkey as id, o_orderpriority as tag from orders where o_orderkey % 3 = 0), n as (select distinct o_custkey as id, '1-URGENT' as tag from orders where o_orderkey % 11 = 0),
    a as (select * from n where not exists (select 1 from t where t.id = n.id and t.tag = n.tag)) select id, tag, 'tag' as part from t union all select id, tag, 'tag' from a union all select id, tag, 'added' from a""")  # fmt: skip
def _(v):
    t = v.orders.filter("o_orderkey % 3 = 0").selectExpr("o_custkey as id", "o_orderpriority as tag").distinct()
    state, added = bulk_tag(t, v.orders.filter("o_orderkey % 11 = 0").selectExpr("o_custkey as id"), "1-URGENT")
    return state.withColumn("part", F.lit("tag")).union(added.withColumn("part", F.lit("added")))


def reaped(jobs: DataFrame, open_: list[str], as_of: str) -> DataFrame:
    """Jobs that were left open are cancelled; their time of finish is kept or set."""
    left = F.coalesce(F.col("status").isin(open_), F.lit(False))
    return jobs.withColumns({"status": F.when(left, "cancelled").otherwise(F.col("status")), "finished": F.when(left, F.coalesce("finished", F.lit(as_of).cast("timestamp_ntz"))).otherwise(F.col("finished"))})


@query("orphan_reap", f"""select event_id, case when event_type in ('view', 'click') then 'cancelled' else event_type end as status,
    case when event_type in ('view', 'click') then coalesce(case when value > 10 then ts end, timestamp '{AS_OF}') else case when value > 10 then ts end end as finished from events""")  # fmt: skip
def _(v):
    jobs = v.events.select("event_id", F.col("event_type").alias("status"), F.when(F.col("value") > 10, F.col("ts")).alias("finished"))
    return reaped(jobs, ["view", "click"], AS_OF)


def closed_to_lost(queue: DataFrame, closed: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Queue members that closed are lost, unless they were won or lost already; a log row for each that changed."""
    j = queue.join(closed.select("id", F.lit(True).alias("closed")).distinct(), "id", "left")
    closing = F.col("closed").isNotNull() & ~F.coalesce(F.col("stage").isin("won", "lost"), F.lit(False))
    state = j.select("id", F.when(closing, "lost").otherwise(F.col("stage")).alias("stage"), F.when(closing, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("stage_updated_at")).alias("stage_updated_at"))
    return state, log_rows(j.filter(closing), "stage_change", F.col("stage"), F.lit("lost"))


@query("closed_to_lost", f"""with j as (select q.*, not r.is_active and stage not in ('won', 'lost') as closing from queue q join register r on r.id = q.id)
    select 'state' as part, id, case when closing then 'lost' else stage end as stage, case when closing then timestamp '{AS_OF}' else stage_updated_at end as at from j union all select 'log', id, stage, null from j where closing""")  # fmt: skip
def _(v):
    state, log = closed_to_lost(v.queue, v.register.filter("not is_active"), AS_OF)
    return state.select(F.lit("state").alias("part"), "id", "stage", F.col("stage_updated_at").alias("at")).union(log.select(F.lit("log"), "id", "from_stage", F.lit(None).cast("timestamp_ntz")))


def with_scheme(url: Column) -> Column:
    """A website as it can be opened: with http:// where no scheme is given; a blank one is unknown."""
    url = F.nullif(F.trim(url), F.lit(""))
    return F.when(url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit("http://"), url))


def follow_up_set(queue: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queue members with the note and date of changes(id, note, date), both as they are given, and a log row with the note.
    Changes to others than members are left out; of several for one id that with the latest date counts."""
    one = changes.groupBy("id").agg(F.max(F.struct("date", "note")).alias("c"))
    j = queue.join(one, "id", "left")
    state = j.select("id", "stage", F.when(F.col("c").isNotNull(), F.col("c.date")).otherwise(F.col("next_action_date")).alias("next_action_date"), F.when(F.col("c").isNotNull(), F.col("c.note")).alias("note"))
    return state, j.filter("c is not null").select("id", F.lit("reminder").alias("event_type"), F.col("c.note").alias("note"))


def website_override(register: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """register(id, website, source) with the websites of changes(id, website) as manual ones, and log rows of what changed:
    from and to. A website that is the old one is confirmed without a log row."""
    j = register.join(changes.groupBy("id").agg(F.max("website").alias("raw")), "id", "left").withColumn("new", with_scheme(F.col("raw")))
    state = j.select("id", F.coalesce("new", "website").alias("website"), F.when(F.col("new").isNotNull(), "manual").otherwise(F.col("source")).alias("source"))
    return state, log_rows(j.filter(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("website"))), "website", F.col("website"), F.col("new"))


@query("follow_up_set", f"""with c as (select o_custkey as id, max(o_orderkey) as k from orders where o_orderkey % 13 = 0 group by 1), j as (select q.*, c.k from queue q left join c on c.id = q.id),
    r as (select j.id, case when j.id % 2 = 0 then 'http://site' || j.id || '.example.com' end as old, 'http://site' || case when k % 2 = 0 then j.id else k end || '.example.com' as new, k from j)
    select 'state' as part, id, case when k is not null then timestamp '{AS_OF}' + interval 7 days else next_action_date end as at, case when k is not null then 'call ' || k end as v from j
    union all select 'log', id, null, 'call ' || k from j where k is not null
    union all select 'site', id, null, case when k is not null then new else old end from r union all select 'site log', id, null, coalesce(old, '') || ' -> ' || new from r where k is not null and old is distinct from new""")  # fmt: skip
def _(v):
    c = v.orders.filter("o_orderkey % 13 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("k"))
    due, none = F.lit(AS_OF).cast("timestamp_ntz") + F.expr("interval 7 days"), F.lit(None).cast("timestamp_ntz")
    state, log = follow_up_set(v.queue, c.select("id", due.alias("date"), F.concat(F.lit("call "), F.col("k").cast("string")).alias("note")))
    site = lambda n: F.concat(F.lit("site"), n.cast("string"), F.lit(".example.com"))
    had = v.queue.select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("http://"), site(F.col("id")))).alias("website"), F.lit("registry").alias("source"))
    given = c.join(v.queue.select("id"), "id", "left_semi").select("id", F.when(F.col("k") % 2 == 0, F.concat(F.lit("http://"), site(F.col("id")))).otherwise(site(F.col("k"))).alias("website"))
    sites, changed = website_override(had, given)
    rows = state.select(F.lit("state").alias("part"), "id", F.col("next_action_date").alias("at"), F.col("note").alias("v")).union(log.select(F.lit("log"), "id", none, "note"))
    return rows.union(sites.select(F.lit("site"), "id", none, "website")).union(changed.select(F.lit("site log"), "id", none, F.concat(F.coalesce("from_stage", F.lit("")), F.lit(" -> "), F.col("to_stage"))))


@query("retryable_status", "select event_id, case when event_type = 'error' and value < 20 then 'cancelled' else 'success' end as status from events")
def _(v):
    throttled, found = F.col("event_type") == "error", F.col("value") >= 20
    return v.events.select("event_id", F.when(throttled & ~found, "cancelled").otherwise("success").alias("status"))


@query("registry_backfill", """select c_custkey as id, coalesce(case when c_custkey % 2 = 0 then c_name end, s_name) as name, c_custkey % 2 <> 0 and s_name is not null as filled from customer left join supplier on s_suppkey = c_custkey""")
def _(v):
    old = v.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"))
    new = v.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("detail"))
    return old.join(new, "id", "left").select("id", F.coalesce("name", "detail").alias("name"), (F.col("name").isNull() & F.col("detail").isNotNull()).alias("filled"))


@query("issue_backfill", """with l as (select * from (select *, row_number() over (partition by id order by event_id desc) as rn from activity_log) t where rn = 1)
    select id, coalesce(case when event_id % 2 = 0 then event_type end, case when value < 20 then 'site_unreachable' when value < 60 then 'no_contact_found' end) as issue from l""")  # fmt: skip
def _(v):
    last = v.activity_log.groupBy("id").agg(F.max(F.struct("event_id", "event_type", "value")).alias("e")).select("id", "e.*")
    derived = F.when(F.col("value") < 20, "site_unreachable").when(F.col("value") < 60, "no_contact_found")
    return last.select("id", F.coalesce(F.when(F.col("event_id") % 2 == 0, F.col("event_type")), derived).alias("issue"))
