from ledgerline.functions.grounding import contained_quotes, grounded, picture_claims

STAFF = "Staff\n Dyrektor:  Anna Nowak  (anna.nowak@s.example.com)\nWicedyrektor: Jan Lis\nJEZYK ANGIELSKI | EWA KOT\nKot Piotr - język angielski, kot@s.example.com. Office: office@s.example.com. Marian Patron, dyrektor"
PAGES = [("u1", STAFF, False), ("u2", STAFF, True), ("u3", None, None), ("u4", "", False)]
CLAIMS = [
    # name, role, evidence, email, quote of the email, url, patron -> email if it stays
    ("Anna Nowak", "director", "Dyrektor: Anna Nowak", "anna.nowak@s.example.com", "Anna Nowak (anna.nowak@s.example.com)", "u1", None, "anna.nowak@s.example.com"),
    ("Nowak Anna", "director", "dyrektor: ANNA NOWAK", "anna.nowak@s.example.com", "anna.nowak@s.example.com", "u1", None, "anna.nowak@s.example.com"),
    ("Ewa Kot", "english_teacher", "JEZYK ANGIELSKI | EWA KOT", "office@s.example.com", "Office: office@s.example.com", "u1", None, None),
    ("Piotr Kot", "english_teacher", "Kot Piotr - język angielski", "ghost@s.example.com", "Kot Piotr ghost@s.example.com", "u1", None, None),
    ("Jan Lis", "deputy_director", "Wicedyrektor: Jan Lis", None, None, "u1", None, None),
    ("Jan Lis", "director", "Wicedyrektor: Jan Lis", None, None, "u1", None, "gone"),
    ("Anna Nowak", "director", "Dyrektor: Anna Nowak", None, None, "u2", None, "gone"),
    ("Anna Nowak", "director", "Dyrektor: Anna Nowak", None, None, "u9", None, "gone"),
    ("Anna Nowak", "director", "Pani dyrektor Anna Nowak", None, None, "u1", None, "gone"),
    ("Ewa Kot", "director", "Dyrektor: Anna Nowak", None, None, "u1", None, "gone"),
    ("Anna Nowak", "director", "Anna Nowak (anna.nowak@s.example.com)", None, None, "u1", None, "gone"),
    ("Marian Patron", "director", "Marian Patron, dyrektor", None, None, "u1", ["Marian", "Patron"], "gone"),
    ("Anna Nowak", "other_staff", "Dyrektor: Anna Nowak", None, None, "u1", None, "gone"),
    ("", "director", "Dyrektor: Anna Nowak", None, None, "u1", None, "gone"), ("Anna Nowak", "director", "  ", None, None, "u1", None, "gone"), ("Anna Nowak", None, None, None, None, None, None, "gone"), ("Anna Nowak", "director", "Dyrektor: Anna Nowak", None, None, "u3", None, "gone"),
]


def test_claims_stay_only_where_the_page_proves_them(spark):
    claims = spark.createDataFrame([(i, *c[:7]) for i, c in enumerate(CLAIMS)], "claim_id long, name string, role string, evidence string, email string, email_evidence string, url string, patron array<string>")
    pages = spark.createDataFrame(PAGES, "url string, text string, third_party boolean")
    got = {r["claim_id"]: r for r in grounded(claims, pages).collect()}
    assert {i: r["email"] for i, r in got.items()} == {i: c[7] for i, c in enumerate(CLAIMS) if c[7] != "gone"}
    assert {i: r["unattributed"] for i, r in got.items() if r["unattributed"]} == {2: "office@s.example.com", 3: "ghost@s.example.com"}
    page = " ".join(STAFF.split()).lower()
    for i, r in got.items():
        quote = " ".join(CLAIMS[i][2].replace(" ", " ").split()).lower()
        assert page[r["quote_at"] - 1 :].startswith(quote)
        names = {CLAIMS[i][0].lower(), " ".join(reversed(CLAIMS[i][0].lower().split()))}
        assert any(page[r["name_at"] - 1 :].startswith(n) for n in names) and r["quote_at"] <= min(r["name_at"], r["role_at"]) < r["quote_at"] + len(quote)
    assert grounded(claims.filter("false"), pages).count() == 0 and grounded(claims, pages.filter("false")).count() == 0


def test_quotes_without_a_page(spark):
    quotes = [(1, "one two three four five six seven eight nine"), (2, "THREE  four"), (3, "nine ten"), (4, ""), (5, None), (6, "a b")]
    pages = [(10, "zero one two three four five six seven eight nine end"), (11, "one two three four five six seven eight ten"), (12, "three four, nine"), (13, None), (14, "three four three four")]
    frames = spark.createDataFrame(quotes, "item_id long, text string"), spark.createDataFrame(pages, "doc_id long, text string")
    got = {(r["item_id"], r["doc_id"]) for r in contained_quotes(*frames).collect()}
    assert got == {(1, 10), (2, 10), (2, 11), (2, 14)}  # (12) has a comma in its last word: no word of the quote
    import ledgerline.functions.grounding as g

    before, g.BROADCAST_QUOTES = g.BROADCAST_QUOTES, 0
    try:
        assert {(r["item_id"], r["doc_id"]) for r in contained_quotes(*frames).collect()} == got
    finally:
        g.BROADCAST_QUOTES = before
    assert contained_quotes(frames[0].filter("false"), frames[1]).count() == 0


def test_picture_claims(spark):
    rows = [("e", "a@s.example.com", "high", "www.s.example.com", "a@s.example.com", "high"), ("e", "a@other.example.com", "high", "s.example.com", "a@other.example.com", "medium"), ("e", "not an address", "high", "s.example.com", None, "medium"), ("e", None, "low", None, None, "low"), (" ", "a@s.example.com", "high", "s.example.com", "gone", "")]
    d = spark.createDataFrame(rows, "evidence string, email string, confidence string, site string, want string, level string")
    got = picture_claims(d).select("email", "want", "confidence", "level").collect()
    assert len(got) == 4 and all(r["email"] == r["want"] and r["confidence"] == r["level"] for r in got)
