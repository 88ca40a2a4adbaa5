"""Streams against batch and by hand, with out-of-order halves, hot keys and a restart in the middle."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.plans.storage import in_order, new_path
from ledgerline.streaming import slots, streams

RANK = {"high": 0, "medium": 1, "low": 2}
START = dt.datetime(2024, 1, 1)


def blank(x):
    return (x or "").strip() or None


def key(person):
    return None if not blank(person) else " ".join(sorted(person.lower().replace(" - ", "-").split()))


def own(addr, person):
    local = addr.split("@")[0]
    return local in {w[0] + v for w in person.lower().split() for v in person.lower().split() if w != v} or not local.startswith(("office", "info", "recruit", "iod"))


def by_hand(records):
    """The slot rule record by record."""
    held = {}
    for r in sorted(records, key=lambda r: (r["seen"], r["place"])):
        k, addr = (r["id"], r["role"]), blank(r["addr"])
        new = {**r, "addr": addr and addr.lower(), "person": blank(r["person"]), "phone": blank(r["phone"])}
        old = held.get(k)
        if old is None:
            held[k] = new
            continue
        a, b = key(old["person"]), key(new["person"])
        if a and b and a != b:
            if new["addr"] and not old["addr"]:
                held[k] = new
            elif old["addr"] and not new["addr"]:
                pass
            elif RANK.get(new["confidence"], 9) != RANK.get(old["confidence"], 9):
                held[k] = new if RANK.get(new["confidence"], 9) < RANK.get(old["confidence"], 9) else old
            elif new["method"] in slots.GROUNDED and old["method"] not in slots.GROUNDED:
                held[k] = new
        elif a == b:
            kept = new["addr"] or old["addr"]
            if kept and b and not (own(kept, new["person"]) and "." in kept.split("@")[1]):
                kept = None
            held[k] = {**new, "addr": kept, "phone": new["phone"] or old["phone"]}
        else:
            held[k] = new
    return {k: tuple(v[f] for f in slots.FIELDS) for k, v in held.items()}


def records():
    rng = random.Random(6)
    people = ["Ann Lee", "lee  ANN", "Bob Ray-Day", "Day-Ray bob", "Ray - Day Bob", None, "  ", "Cid Fox"]
    addrs = [None, "office@s.example.com", "ALee@s.example.com", "bob.rayday@s.example.com", "cid@s.example", "x@nodot", " ", "info7@s.example.com"]
    out = []
    for i in range(900):
        k = 1 if i % 3 == 0 else rng.randint(2, 40)
        out.append({"id": k, "role": rng.choice(["teacher", "head"]), "person": rng.choice(people), "addr": rng.choice(addrs), "phone": rng.choice([None, "1", "2", ""]), "confidence": rng.choice(["high", "medium", "low", "odd", None]), "method": rng.choice(["llm_text", "llm_vision", "registry", None]), "seen": rng.randint(0, 99), "place": i})
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in ["id", "role", *slots.FIELDS]) for r in rows], slots.SCHEMA)


def as_dict(df):
    return {(r["id"], r["role"]): tuple(r[f] for f in slots.FIELDS) for r in df.collect()}


def test_slot_rule_by_hand_and_in_rounds(spark):
    rows = records()
    assert as_dict(slots.slot_state(frame(spark, rows))) == by_hand(rows)
    assert as_dict(slots.slot_state(frame(spark, rows), most=40)) == by_hand(rows)
    nulls = [{**dict.fromkeys(["id", "role", *slots.FIELDS]), "seen": i, "phone": p} for i, p in enumerate(["5", None])]
    assert as_dict(slots.slot_state(frame(spark, nulls), most=1)) == {(None, None): (None, None, "5", None, None, 1, None)}
    assert slots.slot_state(frame(spark, [])).count() == 0


class Stop(Exception):
    pass


def failing_once(monkeypatch, at):
    """Sinks whose process ends after the batch `at` is written but before it is noted as done."""
    made, state = streams.sink, {"armed": True}

    def sink(path):
        write = made(path)

        def each(rows, n):
            write(rows, n)
            if state["armed"] and n == at:
                state["armed"] = False
                raise Stop("the driver is lost")

        return each

    monkeypatch.setattr(streams, "sink", sink)


def twice(run):
    with pytest.raises(Exception, match="driver is lost"):
        run()
    return run()


def test_slot_stream_goes_on_after_a_failure(spark, monkeypatch):
    rows = records()
    path, out = new_path(spark, "records"), new_path(spark, "slots")
    in_order(frame(spark, rows).coalesce(1), ["seen", "place"], path, 6)
    failing_once(monkeypatch, 1)
    twice(lambda: streams.slot_stream(streams.log_stream(spark, path, slots.SCHEMA, 2), out).awaitTermination())
    assert as_dict(streams.slot_stream_rows(spark, out)) == by_hand(rows)
    assert len([f for f in os.listdir(f"{out}/rows") if f.startswith("batch=")]) == 3


def log(spark, n=600, hot=True):
    rng = random.Random(9)
    rows = [(i, 1 if hot and i % 3 == 0 else rng.randint(2, 20), rng.choice(["view", "error", "click"]), START + dt.timedelta(seconds=rng.randint(0, 10 * 86_400)), float(i)) for i in range(n)]
    rows += rows[:40]  # events that come twice
    return spark.createDataFrame(rows, "event_id long, id long, event_type string, ts timestamp_ntz, value double"), rows[:n]


def test_activity_stream_goes_on_after_a_failure(spark, monkeypatch):
    df, rows = log(spark)
    path, out = streams.log_files(df, "log"), new_path(spark, "activity")
    failing_once(monkeypatch, 1)
    got = twice(lambda: streams.drained(streams.activity_state(streams.log_stream(spark, path, files=2)), "update", out))
    want = {}
    for e, i, kind, ts, _ in rows:
        want[i] = max(want.get(i, (START, -1, "")), (ts, e, kind))
    assert {r["id"]: (r["last_ts"], r["event_type"]) for r in streams.newest(got, "id").collect()} == {i: (w[0], w[2]) for i, w in want.items()}


def test_activity_counts_late_events(spark):
    day = lambda n: START + dt.timedelta(days=n)
    rows = [(1, 1, "view", day(60), 0.0), (2, 1, "click", day(61), 0.0), (3, 1, "view", day(1), 0.0), (4, 2, "error", day(2), 0.0), (4, 2, "error", day(2), 0.0)]
    path = new_path(spark, "log")
    # in the order in which they arrive: the last two files are two months late
    arrivals = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "event_id long, id long, event_type string, ts timestamp_ntz, value double, n int")
    in_order(arrivals.withColumn("ts", F.col("ts").cast("timestamp")), ["n"], path, 5)
    got = streams.drained(streams.activity_state(streams.log_stream(spark, path, files=1)), "update", new_path(spark, "activity"))
    assert {(r["id"], r["event_type"], r["last_ts"]) for r in streams.newest(got, "id").collect()} == {(1, "click", day(61)), (2, "error", day(2))}


def test_stale_timer_goes_on_after_a_failure(spark, monkeypatch):
    df, rows = log(spark, 300)
    path, out = streams.log_files(df, "log"), new_path(spark, "stale")
    failing_once(monkeypatch, 1)
    got = twice(lambda: streams.drained(streams.stale_stream(streams.log_stream(spark, path, files=2), 1), "append", out))
    mark, want = max(r[3] for r in rows) - dt.timedelta(hours=1), []
    for i in {r[1] for r in rows}:
        own = sorted(r[3] for r in rows if r[1] == i)
        want += [(i, a) for a, b in zip(own, [*own[1:], None]) if (b - a >= dt.timedelta(days=1) if b else a + dt.timedelta(days=1) <= mark)]
    found = [(r["id"], START + dt.timedelta(microseconds=r["last_us"] - int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6))) for r in got.collect()]
    assert sorted(found) == sorted(want) and len(want) > 20


def throttled_by_hand(rows, gap, base):
    out, state = {}, {}
    for e, i, kind, ts, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        last, strikes, until = state.get(i, (None, 0, None))
        soon, rests = last is not None and (ts - last).total_seconds() < gap, until is not None and ts < until
        if kind == "error":
            strikes += 1
            end = ts + dt.timedelta(seconds=base * 2 ** (min(strikes, 12) - 1))
            until = max(until, end) if until else end
        state[i] = (ts, strikes, until)
        out[e] = (i, soon, strikes, rests)
    return out


def test_host_throttle_in_spans_and_as_a_machine(spark):
    df, rows = log(spark)
    df, want = df.limit(600), throttled_by_hand(rows, 600, 60)
    for span in ("day", "hour", "year"):
        got = streams.host_throttle(df, 600, 60, span).collect()
        assert {r["event_id"]: (r["id"], r["too_soon"], r["strikes"], r["suppressed"]) for r in got} == want
    path = streams.log_files(df, "log")
    got = streams.drained(streams.throttle_stream(streams.log_stream(spark, path, files=2), 600, 60), "append", new_path(spark, "throttle")).collect()
    assert {r["event_id"]: (r["id"], r["too_soon"], r["strikes"], r["suppressed"]) for r in got} == want
    nobody = df.limit(5).withColumn("id", F.lit(None).cast("long"))
    assert streams.host_throttle(nobody).count() == 5 and streams.host_throttle(df.filter("false")).count() == 0


def test_interval_batch(spark, monkeypatch):
    df, _ = log(spark, 60)
    scored = spark.createDataFrame([(i, True, i == 7, None, i if i % 4 else None) for i in range(12)], "id long, is_active boolean, is_adult boolean, specialty string, total int")
    tried = spark.createDataFrame([(9,)], "id long")
    path, out = streams.log_files(df, "log"), new_path(spark, "chosen")
    failing_once(monkeypatch, 1)
    twice(lambda: streams.interval_batch(streams.log_stream(spark, path, files=2), scored, tried, out, 3).awaitTermination())
    got = streams.sunk(spark, f"{out}/rows", "id long, total int").collect()
    assert sorted((r["batch"], r["id"]) for r in got) == [(0, 6), (0, 10), (0, 11), (1, 2), (1, 3), (1, 5), (2, 0), (2, 1), (2, 4)]
    off = new_path(spark, "chosen")
    streams.interval_batch(streams.log_stream(spark, path), scored, tried, off, 3, enabled=lambda: False).awaitTermination()
    assert streams.sunk(spark, f"{off}/rows", "id long, total int").count() == 0
