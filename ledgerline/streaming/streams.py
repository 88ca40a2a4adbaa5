"""The append-only log as a stream, and what is kept up to date from it.

The registered queries run their streams: they write the log as files in order of time, read those a few at a time until
none is left, and return what the sink holds. A sink writes each micro-batch under its number, so a batch that is run again
after a failure replaces its rows; checkpoints and sinks are in the shared folder.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerline.operators.ranking import next_candidates
from ledgerline.operators.segments import TARGET_SQL
from ledgerline.plans.registry import query
from ledgerline.plans.shipping import ship
from ledgerline.plans.storage import folder, in_order, new_path
from ledgerline.streaming.slots import FIELDS, SCHEMA, STATE, folded, record, slot_rows, slot_state

# the driver's worker for state starts before code is shipped and needn't have this package: processors travel whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOG = "event_id long, id long, event_type string, ts timestamp, value double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Files that a registered query cuts its log into, and how many of them a micro-batch takes.
FILES, AT_ONCE = 6, 2


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started within keep their state in RocksDB, which processors with timers need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def log_stream(spark: SparkSession, path: str, schema: str = LOG, files: int | None = None) -> DataFrame:
    """New files of the log folder as a stream, by their times of change."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def log_files(log: DataFrame, name: str, files: int = FILES) -> str:
    """A log as files in order of time."""
    path = new_path(log.sparkSession, name)
    in_order(log.select("event_id", "id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")), ["ts", "event_id"], path, files)
    return path


def sink(path: str) -> Callable[[DataFrame, int], None]:
    """Rows of micro-batch n under batch=n; once more, they replace the earlier ones."""

    def write(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write


def sunk(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a sink holds, with `batch`; nothing yet is no rows."""
    where, fs = folder(spark, path)
    fs.mkdirs(where)
    return spark.read.schema(f"{schema}, batch int").parquet(path)


def start(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    with keyed_state(stream.sparkSession):
        return stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, mode: str, path: str) -> DataFrame:
    """Run a stream over all there is and return its sink at `path` (its checkpoint stands beside it)."""
    start(stream, mode, sink(f"{path}/rows"), f"{path}/checkpoint").awaitTermination()
    return sunk(stream.sparkSession, f"{path}/rows", ", ".join(f"`{c}` {t}" for c, t in stream.dtypes))


def newest(rows: DataFrame, *key: str) -> DataFrame:
    """Of rows that came again and again, those of the latest batch for each key."""
    rest = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*key, "s.*")


def activity_state(log: DataFrame) -> DataFrame:
    """Latest event and last activity per entity, in update mode; batch: latest_event and last_activity. An event that comes
    twice changes neither, so no event ids are kept: state is a row for each entity, and a late event counts like any other."""
    return log.groupBy("id").agg(F.max("ts").alias("last_ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


@query("activity_stream_state", """with l as (select id, event_type, ts, row_number() over (partition by id order by ts desc, event_id desc) as rn from activity_log) select id, event_type, ts as last_ts from l where rn = 1""")
def _(v):
    path = log_files(v.activity_log, "log")
    rows = drained(activity_state(log_stream(v.spark, path, files=AT_ONCE)), "update", new_path(v.spark, "activity"))
    return newest(rows, "id").select("id", "event_type", F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


class StaleTimer(StatefulProcessor):
    """A row for each time an entity had no event for `wait` milliseconds of event time: when the timer set by its last event
    runs out, or when the next event shows it, whichever comes first. Events older than the last one change nothing."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, us long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t for b in rows for t in b["us"].tolist())
        last = tuple(self.last.get()) if self.last.exists() else None
        idle = []
        for us in times:
            if last is None or us // 1000 >= last[0]:
                if last and us // 1000 - last[0] >= self.wait and not last[2]:
                    idle.append(last[1])
                last = (us // 1000, us, False)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.last.update(last)
        if not last[2]:
            self.handle.registerTimer(last[0] + self.wait)
        if idle:
            yield pd.DataFrame({"id": [key[0]] * len(idle), "last_us": idle})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms, us, told = self.last.get()
        self.last.update((ms, us, True))
        if not told:
            yield pd.DataFrame({"id": [key[0]], "last_us": [us]})

    def close(self) -> None:
        pass


def stale_stream(log: DataFrame, days: float = 14, late: str = "1 hour") -> DataFrame:
    """(id, last_us) whenever an entity has been idle for so many days of event time."""
    ship(log.sparkSession)
    timed = log.withWatermark("ts", late).select("id", "ts", F.unix_micros("ts").alias("us"))
    return timed.groupBy("id").transformWithStateInPandas(StaleTimer(int(days * 86_400_000)), "id long, last_us long", "Append", "EventTime")


@query("stale_timer", """with l as (select id, ts, lead(ts) over (partition by id order by ts, event_id) as nxt from activity_log), m as (select max(epoch_ms(ts)) - 3600000 as mark from activity_log)
    select id, ts as last_ts from l, m where case when nxt is not null then epoch_ms(nxt) - epoch_ms(ts) >= 86400000 else epoch_ms(ts) + 86400000 <= mark end""")  # fmt: skip
def _(v):
    path = log_files(v.activity_log, "log")
    rows = drained(stale_stream(log_stream(v.spark, path, files=AT_ONCE), 1), "append", new_path(v.spark, "stale"))
    return rows.select("id", F.timestamp_micros("last_us").cast("timestamp_ntz").alias("last_ts"))


def interval_batch(ticks: DataFrame, scored: DataFrame, attempts: DataFrame, path: str, n: int, enabled: Callable[[], bool] = lambda: True) -> StreamingQuery:
    """For each micro-batch of ticks the next n candidates that neither `attempts` nor an earlier batch had, in the sink at
    `path`, unless disabled. A batch that is run again sees the batches before it only, and chooses the same rows."""
    spark = ticks.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        if enabled() and not batch.isEmpty():
            tried = attempts.select("id").union(sunk(spark, f"{path}/rows", "id long, total int").filter(F.col("batch") < number).select("id"))
            sink(f"{path}/rows")(next_candidates(scored, tried, n).select(F.col("id").cast("long").alias("id"), F.col("total").cast("int").alias("total")), number)

    return start(ticks, "append", each, f"{path}/checkpoint")


@query("interval_batch", f"""select id, total, cast((n - 1) // 10 as int) as batch from (select r.*, row_number() over (order by total desc nulls last, id) as n from scored r
    where {TARGET_SQL} and id not in (select id from activity_log where event_type = 'purchase')) t where n <= 30""")  # fmt: skip
def _(v):
    path, out = log_files(v.activity_log, "log"), new_path(v.spark, "chosen")
    interval_batch(log_stream(v.spark, path, files=AT_ONCE), v.scored, v.activity_log.filter("event_type = 'purchase'"), out, 10).awaitTermination()
    return sunk(v.spark, f"{out}/rows", "id long, total int")


@query("host_throttle", """with g as (select *, lag(ts) over (partition by id order by ts, event_id) as prev, sum(case when event_type = 'error' then 1 else 0 end) over (partition by id order by ts, event_id rows unbounded preceding) as strikes from activity_log),
    e as (select *, case when event_type = 'error' then ts + to_seconds(cast(300 * power(2, least(strikes, 12) - 1) as bigint)) end as rest from g),
    r as (select *, max(rest) over (partition by id order by ts, event_id rows between unbounded preceding and 1 preceding) as rest_until from e)
    select event_id, id, coalesce(date_diff('second', prev, ts) < 60, false) as too_soon, strikes, coalesce(ts < rest_until, false) as suppressed from r""")  # fmt: skip
def _(v):
    return host_throttle(v.activity_log, 60)


def host_throttle(log: DataFrame, gap: int = 1, base: int = 300, span: str = "day") -> DataFrame:
    """Per host (id): whether a request came too soon after the last, how often it was blocked so far, and whether it fell
    into a rest, which is base * 2 ** (n - 1) seconds after the n-th block (from the 12th on as long as then).

    A host's log is cut into spans of time, and spans are dealt out, so a host with very many requests isn't one task's.
    What a span hands on to the next is small (last request, blocks, end of the rest) and is summed up over spans.
    """
    d = log.withColumn("span", F.date_trunc(span, F.col("ts"))).withColumn("hit", (F.col("event_type") == "error").cast("long"))
    own, within = Window.partitionBy("id", "span").orderBy("ts", "event_id"), Window.partitionBy("id").orderBy("span")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    spans = d.groupBy("id", "span").agg(F.max("ts").alias("last"), F.sum("hit").alias("hits"))
    carried = spans.select(F.col("id").alias("i"), F.col("span").alias("s"), F.lag("last").over(within).alias("last"), F.coalesce(F.sum("hits").over(earlier), F.lit(0)).alias("hits"))
    same = F.col("id").eqNullSafe(F.col("i")) & F.col("span").eqNullSafe(F.col("s"))
    d = d.join(carried, same).drop("i", "s")
    d = d.withColumn("strikes", F.col("hits") + F.sum("hit").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("prev", F.coalesce(F.lag("ts").over(own), "last"))
    d = d.withColumn("rest", F.when(F.col("hit") == 1, F.timestamp_add("SECOND", (base * F.pow(F.lit(2.0), F.least("strikes", F.lit(12)) - 1)).cast("int"), F.col("ts"))))
    rests = d.groupBy("id", "span").agg(F.max("rest").alias("rest"))
    before = rests.select(F.col("id").alias("i"), F.col("span").alias("s"), F.max("rest").over(earlier).alias("until"))
    d = d.join(before, same).drop("i", "s")
    until = F.greatest("until", F.max("rest").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    sec = lambda c: F.date_trunc("second", c).cast("timestamp_ntz")
    soon = F.timestamp_diff("SECOND", sec("prev"), sec("ts")) < gap
    return d.select("event_id", "id", F.coalesce(soon, F.lit(False)).alias("too_soon"), "strikes", F.coalesce(F.col("ts") < until, F.lit(False)).alias("suppressed"))


class HostThrottle(StatefulProcessor):
    """The same per host as a machine with three values: last request, blocks so far, end of the rest (microseconds)."""

    def __init__(self, gap: int, base: int):
        self.gap, self.base = gap, base

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("host", "last long, strikes long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, strikes, until = self.state.get() if self.state.exists() else (None, 0, None)
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"])
        out = []
        for event_id, us, hit in zip(batch["event_id"].tolist(), batch["us"].tolist(), batch["hit"].tolist()):
            soon = last is not None and us // 1_000_000 - last // 1_000_000 < self.gap
            rests = until is not None and us < until
            strikes += hit
            if hit:
                until = max(until or 0, us + self.base * 2 ** (min(strikes, 12) - 1) * 1_000_000)
            last = us
            out.append((event_id, key[0], soon, strikes, rests))
        self.state.update((last, strikes, until))
        yield pd.DataFrame(out, columns=["event_id", "id", "too_soon", "strikes", "suppressed"])

    def close(self) -> None:
        pass


def throttle_stream(log: DataFrame, gap: int = 1, base: int = 300) -> DataFrame:
    ship(log.sparkSession)
    d = log.select("id", "event_id", F.unix_micros("ts").alias("us"), (F.col("event_type") == "error").cast("long").alias("hit"))
    return d.groupBy("id").transformWithStateInPandas(HostThrottle(gap, base), "event_id long, id long, too_soon boolean, strikes long, suppressed boolean", "Append", "None")


def slot_stream(records: DataFrame, path: str) -> StreamingQuery:
    """The slots after each micro-batch, by the same fold as in batch: a batch takes what the batches before it left of the
    slots that it touches and writes these anew, under its number."""
    spark = records.sparkSession
    schema = f"id long, role string, s {STATE}"

    def each(batch: DataFrame, number: int) -> None:
        held = newest(sunk(spark, f"{path}/rows", schema).filter(F.col("batch") < number), "id", "role")
        sink(f"{path}/rows")(folded(batch.select("id", "role", record().alias("r")), held), number)

    return start(records, "append", each, f"{path}/checkpoint")


def slot_stream_rows(spark: SparkSession, path: str) -> DataFrame:
    return slot_rows(newest(sunk(spark, f"{path}/rows", f"id long, role string, s {STATE}"), "id", "role"))


def slot_records(v) -> DataFrame:
    """Records of contacts; names in two spellings, phone, confidence and method by the order's number."""
    k = F.col("l_orderkey")
    who = F.regexp_replace("person", "person", "P")
    person = F.when(k % 2 == 0, F.concat(F.lit("Ann "), who)).otherwise(F.concat(who, F.lit("  ann")))
    return v.contact.select(
        "id", "role", person.alias("person"), F.upper("addr").alias("addr"), F.when(k % 3 == 0, F.concat(F.lit("+1 "), k.cast("string"))).alias("phone"),
        F.element_at(F.array(*map(F.lit, ["high", "medium", "low", "other"])), (k % 4 + 1).cast("int")).alias("confidence"), F.when(k % 5 < 2, "llm_text").when(k % 5 == 2, "registry").alias("method"),
        F.unix_seconds(F.col("captured_at").cast("timestamp")).alias("seen"), (k * 10 + F.col("l_linenumber")).cast("long").alias("place"),
    )


SLOT_SQL = """with recursive c as (select id, role, case when l_orderkey % 2 = 0 then 'Ann ' || replace(person, 'person', 'P') else replace(person, 'person', 'P') || '  ann' end as person, lower(addr) as addr,
      case when l_orderkey % 3 = 0 then '+1 ' || cast(l_orderkey as varchar) end as phone, ['high', 'medium', 'low', 'other'][l_orderkey % 4 + 1] as confidence,
      case when l_orderkey % 5 < 2 then 'llm_text' when l_orderkey % 5 = 2 then 'registry' end as method, cast(epoch(captured_at) as bigint) as seen, l_orderkey * 10 + l_linenumber as place, lower(replace(person, 'person', 'P')) as who,
      coalesce(not starts_with(lower(addr), 'office'), false) as legit, l_orderkey % 4 as rank, coalesce(l_orderkey % 5 < 2, false) as quoted from contact),
    n as (select *, row_number() over (partition by id, role order by seen, place, person nulls first, addr nulls first, phone nulls first, confidence, method nulls first) as i from c),
    w as (select * from n where i = 1 union all
      select n.id, n.role, case when stays then w.person else n.person end, case when stays then w.addr when same or both_none then case when n.who is null or case when n.addr is not null then n.legit else w.legit end then coalesce(n.addr, w.addr) end else n.addr end,
        case when stays then w.phone when same or both_none then coalesce(n.phone, w.phone) else n.phone end, case when stays then w.confidence else n.confidence end, case when stays then w.method else n.method end,
        case when stays then w.seen else n.seen end, case when stays then w.place else n.place end, case when stays then w.who else n.who end,
        case when stays then w.legit when (same or both_none) and n.addr is null then w.legit else n.legit end, case when stays then w.rank else n.rank end, case when stays then w.quoted else n.quoted end, n.i
      from w join n on n.id = w.id and n.role = w.role and n.i = w.i + 1,
      lateral (select coalesce(w.who = n.who, false) as same, w.who is null and n.who is null as both_none) x,
      lateral (select w.who is not null and n.who is not null and not x.same and not case when n.addr is not null and w.addr is null then true when w.addr is not null and n.addr is null then false
        when (case when n.rank = 3 then 9 else n.rank end) <> (case when w.rank = 3 then 9 else w.rank end) then n.rank < w.rank else n.quoted and not w.quoted end as stays) y),
    slots as (select id, role, person, addr, phone, confidence, method, seen, place from (select *, row_number() over (partition by id, role order by i desc) as z from w) t where z = 1)"""


@query("slot_upsert", SLOT_SQL + " select * from slots")
def _(v):
    return slot_state(slot_records(v))


@query("slot_fold_stream", SLOT_SQL + " select * from slots")
def _(v):
    path, out = new_path(v.spark, "records"), new_path(v.spark, "slots")
    in_order(slot_records(v).select("id", "role", *FIELDS), ["seen", "place"], path, FILES)
    slot_stream(log_stream(v.spark, path, SCHEMA, AT_ONCE), out).awaitTermination()
    return slot_stream_rows(v.spark, out)
