"""Address rules with their own words, and the choice of an office address."""

from pyspark.sql import functions as F

from ledgerline.functions import addresses as A
from ledgerline.operators.ranking import best_office_address, best_record_per_role

CASES = {
    # address: blocked, priority, tier, level
    "sekretariat@s.example.com": (False, 1, 0, None), "Info2@s.example.com": (False, 1, 0, None), "rekrutacja2024@s.example.com": (False, 2, 2, None), "ann@s.example.com": (False, 0, 1, None),
    "iod@s.example.com": (True, 3, 3, None), "dane.osobowe@s.example.com": (True, 3, 3, None), "rz.iod@s.example.com": (True, 3, 3, None), "wiodek@s.example.com": (False, 0, 1, None), "sekretariat@librus.pl": (True, 3, 3, None), "x@sub.LIBRUS.pl": (True, 3, 3, None),
    "x@notlibrus.pl": (False, 0, 1, None), "ssp11@s.example.com": (False, 0, 1, "primary"), "1slo@s.example.com": (False, 0, 1, "liceum"), "tech-2@s.example.com": (False, 0, 1, "technikum"), "spiewak@s.example.com": (False, 0, 1, None),
}


def test_rules(spark):
    d = spark.createDataFrame([(a,) for a in CASES], "a string")
    a = F.col("a")
    got = d.select("a", A.blocked(a).alias("b"), A.priority(a).alias("p"), A.campaign_tier(a).alias("t"), A.level_hint(a).alias("l")).collect()
    assert {r["a"]: (r["b"], r["p"], r["t"], r["l"]) for r in got} == CASES
    own = A.AddressRules(vendors=("v.example",), office=("desk",), forenames=("ela",))
    rows = spark.createDataFrame([("desk@x.example",), ("a@w.v.example",), ("e.nowak@x.example",), ("ela.ryznar@x.example",), ("ksp.mlociny@x.example",), ("desk.a@x.example",), (None,), ("noat",)], "a string")
    got = rows.select("a", A.priority(a, own).alias("p"), A.one_person(a, own).alias("one"), A.campaign_tier(a, own).alias("t")).collect()
    assert {r["a"]: (r["p"], r["one"], r["t"]) for r in got if r["a"]} == {"desk@x.example": (1, False, 0), "a@w.v.example": (3, False, 3), "e.nowak@x.example": (0, True, 1), "ela.ryznar@x.example": (0, True, 1), "ksp.mlociny@x.example": (0, False, 1), "desk.a@x.example": (1, False, 0), "noat": (0, False, 1)}
    assert [r["t"] for r in got if r["a"] is None] == [3]


def pick(spark, addrs, name="Szkoła", level="primary", registered=None, places=None, site=None):
    d = spark.createDataFrame([(1, a, i, name, level, registered, places, site) for i, a in enumerate(addrs)], "id long, addr string, pos int, name string, level string, registered string, places array<string>, site string")
    got = best_office_address(d).collect()
    return got[0]["addr"] if got else None


def test_choice_of_an_office_address(spark):
    p = lambda *a, **k: pick(spark, list(a), **k)
    assert p("1slo@s.example.com", "slosto@s.example.com", "ssp11@s.example.com") == "ssp11@s.example.com"  # its own level, then none, then a sibling's
    assert p("sp84@s.example.com", "x@s.example.com", name="SP nr 350") == "x@s.example.com"  # a contradicting number
    assert p("AKol@s.example.com", "sekretariat.zsp7@s.example.com", name="SP NR 321") == "sekretariat.zsp7@s.example.com"  # a complex's number isn't one
    assert p("sp005@s.example.com", "sp6@s.example.com", name="SP nr 5") == "sp005@s.example.com"
    assert p("i.kurowska@s.example.com", "zsp1mm@s.example.com") == "zsp1mm@s.example.com"  # one person's mailbox
    assert p("biuro@s.example.p", "x@s.example.com") == "x@s.example.com" and p("biuro@s.example.p") == "biuro@s.example.p"  # undeliverable, unless alone
    assert p("mokotow@s.example.com", "centrum@s.example.com", "wawer@s.example.com", places=["wawer"]) == "wawer@s.example.com"
    assert p("mokotow@s.example.com", "centrum@s.example.com", places=["wola"]) == "centrum@s.example.com"
    assert p("info@other.example.org", "biuro@s.example.com", site="example.com") == "biuro@s.example.com"
    assert p("biuro@a.example.com", "info@b.example.com", registered="info@b.example.com") == "info@b.example.com" and p("biuro@a.example.com", "info@b.example.com") == "biuro@a.example.com"
    assert p(None, "") is None


def test_best_record_per_role(spark):
    claims = [(1, "deputy", "high", "A", "u"), (1, "director", "low", "B", "u"), (1, "director", "medium", "C", "far"), (1, "director", "medium", "D", "u"), (2, "teacher", "high", "E", "u"), (3, "deputy", None, "G", "u"), (3, "deputy", "odd", "F", None), (3, "deputy", "odd", "F", None)]
    tiers = spark.createDataFrame([(1, "u", 3), (1, "u", 2), (1, "far", 4)], "id long, url string, tier int")
    got = best_record_per_role(spark.createDataFrame(claims, "id long, role string, confidence string, name string, url string"), tiers, ["director", "deputy"]).collect()
    assert {(r["id"], r["role"], r["name"], r["tier"]) for r in got} == {(1, "director", "D", 2), (3, "deputy", "F", 99)}
