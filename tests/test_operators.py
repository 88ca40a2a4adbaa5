"""Cases that the star tables don't hold."""

from pyspark.sql import functions as F

from ledgerline.functions.addresses import extract_addresses, personal
from ledgerline.functions.urls import sitemap_select
from ledgerline.operators import state
from ledgerline.operators.ranking import page_budget
from ledgerline.operators.segments import ownership, text_search
from ledgerline.sources.register import changed_files, csv_scan, portal_adapter, ranking_rows


def test_csv_scan_keeps_strings_and_blank_is_null(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("﻿rspo_id,name,pupils\n007,\"A, B\",12.0\n8,,\n".encode())
    got = csv_scan(spark, str(tmp_path / "r.csv"), ["rspo_id", "name", "pupils", "website"]).collect()
    assert [tuple(r) for r in got] == [("007", "A, B", "12.0", None), ("8", None, None, None)]


def test_portal_adapter(spark):
    raw = spark.createDataFrame([('="7"', "A", "M. X", "1012011", "", "P"), ("8", "B", "Y", "1012018", "", "Powiat"), ("9", "C", "Z", "1012012", "2020-01-01", "P")], ["Numer RSPO", "Nazwa", "Gmina", "Kod terytorialny gmina", "Data likwidacji", "Powiat"])
    got = {r["rspo_id"]: (r["commune"], r["commune_type"]) for r in portal_adapter(raw).collect()}
    assert got == {"7": ("M. X", "M"), "8": ("Powiat", "M")}


def test_portal_file_as_it_is(spark, tmp_path):
    lines = ['\ufeff"Numer RSPO";"Nazwa";"Województwo";"Miejscowość";"Gmina";"Powiat";"Kod terytorialny gmina";"Strona www"', '="12";"A; B";"ŁÓDZKIE";"Łódź";"M. Łódź";"Łódź";"1061011";"a.example.com"', '="13";"C";"";"Wieś";"Gmina";"P";"1061012";""']
    (tmp_path / "p.csv").write_text("\n".join(lines), encoding="utf-8")
    got = portal_adapter(spark.read.csv(str(tmp_path / "p.csv"), header=True, sep=";")).orderBy("rspo_id").collect()
    assert [(r["rspo_id"], r["name"], r["region"], r["locality"], r["commune"], r["commune_type"], r["website"], r["pupils"]) for r in got] == [
        ("12", "A; B", "ŁÓDZKIE", "Łódź", "M. Łódź", "M", "a.example.com", None), ("13", "C", None, "Wieś", "Gmina", None, None, None)]


def test_batch_moves_keep_stages(spark):
    queue = spark.createDataFrame([(1, "contacted"), (2, "responded"), (4, "won")], "id long, stage string")
    members = spark.createDataFrame([(9, 3, None, "responded"), (2, 3, None, "won")], "id long, batch_id long, added_at timestamp_ntz, stage_at_move string")
    left, after, log, outcome = state.move_to_batch(queue, members, spark.createDataFrame([(1,), (2,), (7,), (1,)], "id long"), 5, "2020-01-01")
    assert {tuple(r) for r in left.select("id", "stage").collect()} == {(2, "responded"), (4, "won")}
    assert {(r["id"], r["batch_id"], r["stage_at_move"]) for r in after.collect()} == {(9, 3, "responded"), (2, 3, "won"), (1, 5, "contacted")}
    assert [(r["id"], r["from_stage"]) for r in log.collect()] == [(1, "contacted")]
    assert {tuple(r) for r in outcome.collect()} == {(1, "moved"), (2, "already_in_campaign"), (7, "not_in_pipeline")}
    assert {tuple(r) for r in state.return_from_batch(left.withColumn("stage_updated_at", F.lit(None).cast("timestamp_ntz")), after, 3, "2020-01-01")[0].select("id", "stage").collect() if r["id"] != 4} >= {(9, "responded"), (2, "won")}


def test_ranking_rows(spark):
    cells = [(1, ["12", "A", "X", "north", "91,5"]), (2, ["*", "13=", "B", "Y", "south", "80"]), (3, ["14", "", "X", "north"]), (4, ["15", "C", "X", "nowhere", "1"]), (5, ["no", "rank"])]
    got = ranking_rows(spark.createDataFrame(cells, "k int, cells array<string>"), ["north", "south"]).orderBy("k").collect()
    assert [(r["rank"], r["tie"], r["name"], r["index"]) for r in got] == [(12, False, "A", 91.5), (13, True, "B", 80.0)]


def test_changed_files(spark, tmp_path):
    for n, t in (("a.bin", b"one"), ("b.bin", b"two")):
        (tmp_path / n).write_bytes(t)
    everything = changed_files(spark, str(tmp_path), spark.createDataFrame([], "sha string"))
    assert everything.count() == 2
    first = everything.filter(F.col("path").endswith("a.bin")).select("sha")
    assert [r["path"].endswith("b.bin") for r in changed_files(spark, str(tmp_path), first).collect()] == [True]


def test_ownership_keeps_unknown_only_with_both(spark):
    d = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, is_private boolean")
    ids = lambda *m: sorted(r["id"] for r in d.filter(ownership(*m)).collect())
    assert (ids(True, True), ids(True, False), ids(False, True), ids(False, False)) == ([1, 2, 3], [1], [2], [])


def test_text_search_needs_two_characters(spark):
    d = spark.createDataFrame([("Łódź",)], "name string")
    assert text_search(d, " x ", ["name"]).count() == 0 and text_search(d, "łód", ["name"]).count() == 1


def test_page_budget_skips_and_goes_on(spark):
    d = spark.createDataFrame([("s", 1, 0, 90), ("s", 2, 1, 50), ("s", 3, 2, 10), ("t", 4, 0, 500)], "site string, page long, tier int, size long")
    got = sorted(r["page"] for r in page_budget(d, "site", "page", "tier", "size", 8, 100).collect())
    assert got == [1, 3, 4]


def test_addresses_and_persons(spark):
    d = spark.createDataFrame([("A@x.example.com, a@X.example.com. b@y.example.com;",)], "t string")
    assert d.select(extract_addresses(F.col("t")).alias("a")).first()["a"] == ["A@x.example.com", "b@y.example.com"]
    rows = spark.createDataFrame([("j.smith@a.b", True), ("john.smith@a.b", True), ("jsmith@a.b", True), ("smith@a.b", False), ("smith.smith@a.b", False)], "a string, want boolean")
    assert all(r["got"] == r["want"] for r in rows.select("want", personal(F.col("a"), F.lit("john"), F.lit("smith")).alias("got")).collect())


def test_sitemap(spark):
    xml = "<loc>https://a.example.com/x</loc><loc>https://a.example.com/staff</loc><loc>https://other.org/staff</loc>"
    got = sitemap_select(spark.createDataFrame([("a.example.com", xml)], "site string, xml string"), "staff").orderBy("rn").collect()
    assert [r["url"][-5:] for r in got] == ["staff", "com/x"]
