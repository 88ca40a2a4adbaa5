from pyspark.sql import functions as F

from ledgerline.functions.display import display_names, names_city, short_name

SHOWN = {
    ("SZKOŁA PODSTAWOWA NR 5 W WARSZAWIE", "Warszawa"): "SP nr 5, Warszawa", ("SZKOŁA PODSTAWOWA IM. JANA PAWŁA II W NOWEJ WSI", "Nowa Wieś"): "SP im. Jana Pawła II w Nowej Wsi", ("I LICEUM OGÓLNOKSZTAŁCĄCE WE WROCŁAWIU", "Wrocław"): "I LO, Wrocław",
    ("Szkoła I Przedszkole", "Łódź"): "Szkoła I Przedszkole, Łódź", ("SZKOŁA NR 1 I PRZEDSZKOLE", None): "Szkoła nr 1 i Przedszkole", ("BRANŻOWA SZKOŁA I STOPNIA", None): "Szkoła Branżowa I", ("TECHNIKUM W RUCHU DLA GDAŃSKA", "Gdańsk"): "Technikum w Ruchu dla Gdańska", ("GIMNAZJUM GDAŃSK", "gdańsk"): "Gimnazjum Gdańsk",
    ('"pod dębem"', " "): '"Pod Dębem"', ("", "Łódź"): ", Łódź", ("ZESPÓŁ SZKÓŁ XIV", "Opole"): "Zespół Szkół XIV, Opole",
}


def test_short_names(spark):
    got = spark.createDataFrame(list(SHOWN), "n string, c string").select("n", "c", short_name(F.col("n"), F.col("c")).alias("s")).collect()
    assert {(r["n"], r["c"]): r["s"] for r in got} == SHOWN
    pairs = [("Warszawie", "Warszawa", True), ("Łodzi", "Łódź", True), ("Ełku", "Ełk", True), ("Krakowie", "Gdańsk", False), ("x", None, False)]
    got = spark.createDataFrame(pairs, "w string, c string, want boolean").select("want", names_city(F.col("w"), F.col("c")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_names_are_distinct_over_the_register(spark):
    rows = [(1, "SP nr 1", "Łódź", None), (2, "sp NR 1", "Łódź", "Zespół A"), (3, "SP NR 1", "Łódź", "Zespół B"), (4, "Sp Nr 1", "Łódź", "Zespół B"), (5, "LO", "Łódź", None), (6, "Sp nr 1, Łódź — RSPO 1", None, None), (7, None, None, None), (8, None, None, "P"), (9, "x", "y", None), (9, "x", "y", None)]
    got = display_names(spark.createDataFrame(rows, "id long, name string, city string, parent string")).collect()
    shown = {r["id"]: r["display"] for r in got if r["id"] != 9}
    assert len(got) == 10 and len(set(shown.values())) == 8 and not any(r["repeated"] for r in got if r["id"] != 9) and all(r["repeated"] for r in got if r["id"] == 9)
    assert shown[2] == "Sp nr 1, Łódź — Zespół A" and shown[3] == "Sp nr 1, Łódź — RSPO 3" and shown[5] == "Lo, Łódź" and shown[7] == " — RSPO 7"
    assert display_names(spark.createDataFrame([], "id long, name string, city string, parent string")).count() == 0


def test_names_are_dealt_over_all_cores(spark):
    rows = spark.range(4000).selectExpr("id", "'Szkoła ' || id as name", "'Łódź' as city", "null as parent").coalesce(1)
    got = display_names(rows)
    assert len(got.inputFiles()) > 1 and got.count() == 4000
