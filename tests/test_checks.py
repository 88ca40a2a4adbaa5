"""Checks of pages and runs on cases written for them."""

from pyspark.sql import functions as F

from ledgerline.functions import checks as C


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_matches_in_lists_of_prizes(spark):
    text = "Anglista: Jan Lis uczy. " + "x" * 150 + " Konkurs: Anna Nowak, Ewa Kot - III miejsce " + "y" * 200 + " Ola Mak"
    got = one(spark, C.guarded(F.col("t"), "[A-Z][a-z]+ [A-Z][a-z]+"), t=text)
    assert [(text[m["a"] : m["z"]], m["rejected"]) for m in got] == [("Jan Lis", False), ("Anna Nowak", True), ("Ewa Kot", True), ("Ola Mak", False)]
    assert one(spark, C.guarded(F.col("t"), "q"), t="none") == [] and one(spark, C.match_places(F.col("t"), "a+"), t="aabaa") == [(0, 2), (3, 5)]


def test_whose_site(spark):
    pages = {
        "<title>Szkoła Podstawowa nr 1</title> Urząd Miejski": True, "<title>Urząd Miejski</title><p>nasza szkoła</p>": False, "<title>Strona</title><meta name='keywords' content='Liceum, klasa'><p>" + "x " * 300: True, "<title>Sklep</title>" + "x " * 300: False,
        "<title>Strona</title><p>x</p><img alt='LICEUM'>": True, "<title>Strona</title>" + "x " * 900 + "liceum": False, "<title>Strona</title><script>liceum</script>" + "x " * 300: False, "": False,
    }
    got = spark.createDataFrame([(p,) for p in pages], "h string").select("h", C.own_site(F.col("h")).alias("ok")).collect()
    assert {r["h"]: r["ok"] for r in got} == pages


def test_patrons_and_pages_of_an_entity(spark):
    name = "SZKOŁA PODSTAWOWA NR 4 IM. MARII SKŁODOWSKIEJ-CURIE W OPOLU"
    assert one(spark, C.patron_words(F.col("n")), n=name) == ["curie", "marii", "skłodowskiej"] and one(spark, C.patron_words(F.col("n")), n="LO nr 2") == []
    people = {"Maria Skłodowska-Curie": True, "Maria Nowak": False, "Curie": True, "": False, "Ma": False}
    got = spark.createDataFrame([(p, name) for p in people], "p string, n string").select("p", C.is_patron(F.col("p"), C.patron_words(F.col("n"))).alias("x")).collect()
    assert {r["p"]: r["x"] for r in got} == people
    texts = {"szkoła podstawowa nr 4 w opolu": True, "patronka marii skłodowskiej": True, "zespół nr 4, podstawa programowa": False, "szkoła podstawowa nr 44": False, "szkoła podstawowa nr. 4": True, "": False}
    got = spark.createDataFrame([(t, name) for t in texts], "t string, n string").select("t", C.of_entity(F.col("t"), F.col("n")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in got} == texts
    assert one(spark, C.of_entity(F.col("t"), F.col("n")), t="szkoła", n="Szkoła") is False


def test_first_phone(spark):
    cases = {"Tel.: +48 22  123-45-67, fax 1": "+48 22 123-45-67", "telefon 123456": None, "TELEFON: (22) 1": None, "call 22 123 45 67": None, "tel 22 123 45\n67 ext": "22 123 45 67", "": None}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", C.phone(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in got} == cases


def test_issue_of_each_kind(spark):
    site = lambda status: [("https://rspo.gov.pl/1", "ok"), ("https://s.example.com", status)]
    rows = [
        (site("ok"), 3, "A", "a@s.example.com", "w", None), (site("ok"), 3, "A", None, "w", "teacher_email_not_published"), (site("ok"), 3, None, None, "w", "teacher_not_published"), (site("ok"), 0, None, None, "w", "no_staff_page_found"), (site("ok"), None, None, "", "w", "no_staff_page_found"),
        (site("not_a_school_site"), 0, None, None, "w", "website_rejected"), (site("timeout"), 0, None, None, None, "website_unreachable"), (site("ok")[:1], 0, None, None, "w", "website_unreachable"), (site("ok")[:1], 0, None, None, None, "website_missing"), (None, None, None, None, None, "website_missing"),
    ]
    d = spark.createDataFrame(rows, "s array<struct<url:string,status:string>>, n int, p string, a string, w string, want string")
    got = d.select("want", C.issue_ladder(F.col("s"), F.col("n"), F.col("p"), F.col("a"), F.col("w")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_second_pass_only_where_it_may_pay(spark):
    page, other = [("Nasz Dyrektor: x", 1)], [("nothing", 1)]
    rows = [
        (["director"], page, None, True), ([], page, [], False), (["director"], other, [], False), (["director"], [("dyrektor", 3)], [], False), (["director"], page, [], True), (["director"], page, [("director", "low")], True), (["director"], page, [("director", "high")], False),
        (["director"], page, [("english_teacher", "high")], True), (["director", "english_teacher"], page, [("director", "medium")], False), (None, page, [], False), (["director"], None, [], False), (["director"], page, [("director", None)], False),
    ]
    d = spark.createDataFrame(rows, "n array<string>, p array<struct<text:string,tier:int>>, s array<struct<role:string,confidence:string>>, want boolean")
    got = d.select("want", C.second_pass(F.col("n"), F.col("p"), F.col("s")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    assert one(spark, C.provable(F.col("t"), ["director"]), t="SCHULLEITUNG") and not one(spark, C.provable(F.col("t"), ["director"]), t="english") and one(spark, C.provable(F.col("t"), ["other"]), t="x")


def test_stage_of_each_kind(spark):
    rows = [([("ok",)], True, "a", "b", "closed"), ([("bad",)], False, "a", "b", "discovery"), (None, None, None, None, "discovery"), ([("bad",), ("ok",)], None, "a", "b", "pass"), ([("ok",)], False, None, "b", "partial"), ([("ok",)], False, None, None, "gap")]
    d = spark.createDataFrame(rows, "s array<struct<status:string>>, c boolean, d string, t string, want string")
    got = d.select("want", C.stage_label(F.col("s"), F.col("c"), F.col("d"), F.col("t")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)
