"""State changes with all their outputs."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerline.operators import joins, reports, state

NOW = "2020-01-01"


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def queue(spark, *members):
    return spark.createDataFrame([(i, s, dt.datetime(2019, 1, 1)) for i, s in members], "id long, stage string, stage_updated_at timestamp_ntz")


def test_import_takes_the_last_of_repeats_and_goes_on_after_errors(spark):
    had = spark.createDataFrame([(1, "a", "http://m", "manual"), (2, "b", "http://r", "registry"), (3, "c", "http://c", "registry")], "id long, name string, site string, src string")
    file = spark.createDataFrame([(1, "A1", "x", "registry", 1, True), (1, "A2", "y", "registry", 5, True), (1, "A0", "z", "registry", 3, True), (2, "B", "n", "registry", 2, False), (4, "D", "d", "registry", 4, True), (None, "N", "n", "registry", 6, True), (5, "E", "e", "registry", 7, None)], "id long, name string, site string, src string, pos long, ok boolean")
    manual = F.col("c.src") == "manual"
    got = state.snapshot_upsert(had, file, "id", ["name", "site", "src"], {"site": manual, "src": manual}, "pos", F.col("ok"))
    assert rows(got, "id", "name", "site", "src", "is_active", "change") == {(1, "A2", "http://m", "manual", True, "updated"), (2, "b", "http://r", "registry", False, "missing"), (3, "c", "http://c", "registry", False, "missing"), (4, "D", "d", "registry", True, "inserted")}
    assert rows(state.rejected(file, "id", F.col("ok")), "name") == {("B",), ("N",), ("E",)}
    assert state.snapshot_upsert(had, file.filter("false"), "id", ["name"], None, "pos").filter("is_active").count() == 0


def test_rescoring_appends_and_repoints(spark):
    history = spark.createDataFrame([(1, "primary", 10, 5, dt.datetime(2019, 1, 1)), (1, "primary", 11, 7, dt.datetime(2018, 1, 1)), (2, "secondary", 12, 9, dt.datetime(2019, 1, 1))], "id long, rubric string, hist_id long, total int, computed_at timestamp_ntz")
    own = {"primary": [("size", "linear", 20, ("size_n", 100))], "secondary": [("private", "flag", 30, "is_private")]}
    rows_in = spark.createDataFrame([(1, "primary", 50, True), (3, "secondary", None, True), (4, None, 10, True)], "id long, rubric string, size_n int, is_private boolean")
    grown, current = state.append_scores(history, rows_in, own, NOW)
    assert grown.count() == 5 and rows(grown.filter("hist_id <= 12"), "hist_id", "total") == {(10, 5), (11, 7), (12, 9)}
    assert rows(current, "id", "rubric", "versions", "total") == {(1, "primary", 3, 10), (2, "secondary", 1, 9), (3, "secondary", 1, 30)}
    again, current = state.append_scores(grown, rows_in, own, NOW)
    assert again.select("hist_id").distinct().count() == again.count() == 7 and rows(current.filter("id = 1"), "versions", "total") == {(4, 10)}
    assert state.append_scores(history.filter("false"), rows_in, own, NOW)[0].count() == 2


def test_return_restores_stages_and_logs(spark):
    q = queue(spark, (1, "contacted"))
    m = spark.createDataFrame([(2, 7, "won"), (3, 7, "of another time"), (4, 7, None), (5, 8, "lost")], "id long, batch_id long, stage_at_move string")
    after, left, log = state.return_from_batch(q, m, 7, NOW)
    assert rows(after, "id", "stage") == {(1, "contacted"), (2, "won"), (3, "not_contacted"), (4, "not_contacted")} and rows(left, "id") == {(5,)}
    assert rows(log, "id", "event_type", "to_stage") == {(2, "pulled", "won"), (3, "pulled", "not_contacted"), (4, "pulled", "not_contacted")}
    after, left, log = state.return_from_batch(q, m, 7, NOW, spark.createDataFrame([(2,), (2,), (5,), (9,)], "id long"))
    assert rows(after, "id") == {(1,), (2,)} and rows(left, "id") == {(3,), (4,), (5,)} and log.count() == 1


def test_clear_keeps_what_tells_of_the_entity(spark):
    log = spark.createDataFrame([(1, 1, "pulled"), (2, 1, "enrichment"), (3, 2, None), (4, 2, "moved_to_batch")], "event_id long, id long, event_type string")
    contacts = spark.range(3)
    q, kept, counts = state.clear_queue(queue(spark, (1, "won"), (2, "lost")), log, contacts)
    assert q.count() == 0 and q.columns == ["id", "stage", "stage_updated_at"] and rows(kept, "event_id") == {(2,), (3,), (4,)}
    assert counts.first().asDict() == {"log_removed": 1, "log_kept": 3, "queue_removed": 2, "contacts_kept": 3}


def test_reset_empties_and_clears(spark):
    tables = {"queue": queue(spark, (1, "won")), "register": spark.createDataFrame([(1, "Ann", 5), (2, None, 6)], "id long, head string, size_n int")}
    after, counts = state.reset_workflow(tables, ["queue"], {"register": ["head"], "queue": ["stage"]})
    assert after["queue"].count() == 0 and rows(after["register"], "id", "head", "size_n") == {(1, None, 5), (2, None, 6)} and after["register"].schema == tables["register"].schema
    assert rows(counts, "tbl", "removed", "kept", "cleared") == {("queue", 1, 0, 0), ("register", 0, 2, 1)}


def test_tags_jobs_and_closings(spark):
    tagged = spark.createDataFrame([(1, "x"), (2, "y")], "id long, tag string")
    now, new = state.bulk_tag(tagged, spark.createDataFrame([(1,), (2,), (2,), (3,)], "id long"), "x")
    assert rows(new, "id") == {(2,), (3,)} and now.count() == 4
    t = dt.datetime(2019, 5, 5)
    jobs = spark.createDataFrame([(1, "running", None), (2, "pending", t), (3, "done", t), (4, None, None)], "id long, status string, finished timestamp_ntz")
    assert rows(state.reaped(jobs, ["running", "pending"], NOW), "id", "status", "finished") == {(1, "cancelled", dt.datetime(2020, 1, 1)), (2, "cancelled", t), (3, "done", t), (4, None, None)}
    after, log = state.closed_to_lost(queue(spark, (1, "won"), (2, "contacted"), (3, "contacted"), (4, None)), spark.createDataFrame([(1,), (2,), (2,), (4,)], "id long"), NOW)
    assert rows(after, "id", "stage") == {(1, "won"), (2, "lost"), (3, "contacted"), (4, "lost")} and rows(log, "id", "from_stage", "to_stage") == {(2, "contacted", "lost"), (4, None, "lost")}


def test_follow_ups_and_websites(spark):
    q = spark.createDataFrame([(1, "contacted", None), (2, "won", dt.datetime(2019, 1, 1))], "id long, stage string, next_action_date timestamp_ntz")
    changes = spark.createDataFrame([(1, "call", dt.datetime(2020, 2, 1)), (1, "old", dt.datetime(2020, 1, 1)), (9, "no member", None)], "id long, note string, date timestamp_ntz")
    after, log = state.follow_up_set(q, changes)
    assert rows(after, "id", "next_action_date", "note") == {(1, dt.datetime(2020, 2, 1), "call"), (2, dt.datetime(2019, 1, 1), None)} and rows(log, "id", "note") == {(1, "call")}
    register = spark.createDataFrame([(1, "http://a", "registry"), (2, None, None), (3, "https://c", "registry"), (4, "http://d", "registry")], "id long, website string, source string")
    after, log = state.website_override(register, spark.createDataFrame([(1, "a"), (2, " b.example.com "), (3, "HTTPS://c2"), (4, " ")], "id long, website string"))
    assert rows(after, "id", "website", "source") == {(1, "http://a", "manual"), (2, "http://b.example.com", "manual"), (3, "HTTPS://c2", "manual"), (4, "http://d", "registry")}
    assert rows(log, "id", "from_stage", "to_stage") == {(2, None, "http://b.example.com"), (3, "https://c", "HTTPS://c2")}


def test_reports_over_nothing(spark):
    register = spark.createDataFrame([], "id long, is_active boolean, is_adult boolean, specialty string, level string, total int")
    q, m = queue(spark).withColumn("next_action_date", F.lit(None).cast("timestamp_ntz")), spark.createDataFrame([], "id long")
    assert reports.dashboard_summary(register, q, m).first()["n_available"] == 0
    d = reports.data_quality_report(register, spark.createDataFrame([], "id long, quality string"), q, spark.createDataFrame([], "id long, ts timestamp_ntz"), spark.createDataFrame([], "status string"), NOW).first()
    assert len(d) == 16 and d["success_rate"] is None and d["q_total"] == 0
    assert joins.leak_audit(spark.createDataFrame([(1, None), (1, "x@a.v.example")], "id long, addr string"), spark.createDataFrame([("v.example",), ("w.example",)], "domain string")).orderBy("domain").collect() == [("v.example", 1, 1), ("w.example", 0, 0)]
    assert rows(reports.counted_by(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "x string"), "x", "n"), "n") == {("a=1,b=2",)}


def test_runs_find_lack_and_lose(spark):
    before = spark.createDataFrame([(1, True), (2, True), (3, False), (5, None)], "id long, found boolean")
    after = spark.createDataFrame([(1, True, False), (2, False, True), (3, True, False), (4, None, False)], "id long, found boolean, failed boolean")
    calls = spark.createDataFrame([(10.0, 1.0), (5.5, None)], "tokens double, seconds double")
    assert reports.run_cost_totals(before, after, calls).first().asDict() == {"found": 1, "missing": 2, "lost": 1, "errors": 1, "calls": 2, "tokens": 15.5, "mean_seconds": 1.0}
