"""People's names through the cases of Polish, for letters: a dictionary first, then rules by the longest suffix, else the
name as it is, or the role's phrase. Never a guess.

A rule is a row (kind, suffix, cut, endings): words of the kind that end with the suffix lose so many letters and take the
case's ending. Words meet rules by an equi-join on their exploded suffixes; of several the longest counts. The rules are
made from the sounds that stems end with; a suffix without a rule leaves a word undeclined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.plans.registry import query

CASES = ["gen", "dat", "acc", "inst", "loc", "voc"]
#: How a stem's last sounds soften before -e; hardened and soft ones; endings of diminutives; shapes of surnames (fixed values).
SOFTENED = {
    "ch": "sze", "st": "ście", "sł": "śle", "zd": "ździe", "t": "cie", "d": "dzie", "r": "rze", "ł": "le", "k": "ce", "g": "dze", "b": "bie", "p": "pie", "w": "wie", "f": "fie", "m": "mie", "n": "nie", "s": "sie", "z": "zie",
}
HARDENED, SOFT = ["ż", "sz", "cz", "rz", "c", "dz"], ["l", "j"]
DIMINUTIVE = ["sia", "cia", "nia", "zia", "dzia"]
#: Last sounds of surnames whose locative ends in -u.
LOCATIVE_U = ["k", "g", "ch", "h", "j", "l", "ń", "ś", "ć", "ź", "sz", "cz", "ż", "rz", "b", "p", "w", "m", "n", "s", "z", "c", "dz"]
SURNAME = "(?i)(ska|cka|dzka|ski|cki|dzki|owicz|ewicz|ów)$"
RISKY = "(?i)([ąó][^aeiouyąęó]{0,2}|eń|oł|eł|ól|ódź)$"
#: Mr and Mrs, and roles, through the five referring cases (fixed values).
MR, MRS = ["Pana", "Panu", "Pana", "Panem", "Panu"], ["Pani", "Pani", "Panią", "Panią", "Pani"]
ROLES = {
    "teacher": ["nauczyciela języka angielskiego", "nauczycielowi języka angielskiego", "nauczyciela języka angielskiego", "nauczycielem języka angielskiego", "nauczycielu języka angielskiego"],
    "director": ["dyrekcji szkoły", "dyrekcji szkoły", "dyrekcję szkoły", "dyrekcją szkoły", "dyrekcji szkoły"],
}
COLUMNS = ["gender", "first_name", "last_name", "salutation", "salutation_casual", "ref_nom", *(f"ref_{c}" for c in CASES[:5]), "subject_ref", "ref_quality"]
TITLES = "(?i)(?<![\\p{L}])(mgr|dr|hab|inż|inz|prof|lic|ks)(\\.|(?=\\s))\\s*"


def noun_rules(kind: str) -> list[tuple]:
    """Nouns in -a (and men's surnames in -o): genitive, dative, accusative, instrumental, locative, vocative."""
    out = []
    for last in ["a"] if kind == "female first" else ["a", "o"]:
        for sound in [*SOFTENED, *HARDENED, *SOFT]:
            genitive = "i" if sound in ("k", "g", *SOFT) else "y"
            dative = sound + ("i" if sound in SOFT else "y") if sound in [*SOFT, *HARDENED] else SOFTENED[sound]
            out.append((kind, sound + last, len(sound) + 1, sound + genitive, dative, sound + "ę", sound + "ą", dative, sound + "o"))
    return out


def rules() -> list[tuple]:
    """All suffix rules: kind, suffix, cut, and the six endings (no vocative for surnames)."""
    out = noun_rules("female first")
    out.append(("female first", "ia", 1, "i", "i", "ę", "ą", "i", "o"))
    out += [("female first", s, 2, "i", "i", "ię", "ią", "i", "iu") for s in DIMINUTIVE]
    surnames = [r[:8] + (None,) for r in noun_rules("male surname")]
    surnames += [("male surname", s, 1, "iego", "iemu", "iego", "im", "im", None) for s in ("ski", "cki", "dzki")]
    surnames += [("male surname", "ek", 2, "ka", "kowi", "ka", "kiem", "ku", None), ("male surname", "ec", 2, "ca", "cowi", "ca", "cem", "cu", None)]
    for sound in dict.fromkeys([*LOCATIVE_U, *SOFTENED]):
        inst = sound + ("iem" if sound in ("k", "g") else "em")
        surnames.append(("male surname", sound, len(sound), sound + "a", sound + "owi", sound + "a", inst, sound + "u" if sound in LOCATIVE_U else SOFTENED[sound], None))
    surnames += [("female surname", s, 1, "iej", "iej", "ą", "ą", "iej", None) for s in ("ska", "cka", "dzka")]
    return [*out, *surnames, ("female surname", "", 0, "", "", "", "", "", None)]


RULE_TYPES = "kind string, suffix string, cut int, " + ", ".join(f"{c} string" for c in CASES)
LONGEST = max(len(r[1]) for r in rules())


def declined(words: DataFrame, rule_rows: DataFrame, exceptions: DataFrame) -> DataFrame:
    """kind, word, forms (five or six; null: none) of words(kind, word), each once. exceptions: kind, word and forms, which may
    be null for words that stay as they are."""
    w = words.filter("word is not null and word <> ''").distinct().withColumn("low", F.lower("word"))
    tails = F.transform(F.sequence(F.lit(0), F.least(F.length("low"), F.lit(LONGEST))), lambda n: F.right(F.col("low"), n))
    met = w.withColumn("suffix", F.explode(tails)).join(rule_rows, ["kind", "suffix"])
    met = met.filter(~(F.col("suffix").isin("ek", "ec") & (F.length("word") <= 3)))
    best = met.groupBy("kind", "word").agg(F.max_by(F.struct("cut", *CASES), F.length("suffix")).alias("r"))
    stem = F.substring("word", F.lit(1), F.length("word") - F.col("r.cut"))
    forms = F.array(*[F.concat(stem, F.col(f"r.{c}")) for c in CASES])
    barred = (F.col("kind") == "male surname") & (F.col("word").rlike(RISKY) & ~F.col("word").rlike("(?i)(ski|cki|dzki)$") | (F.lower("word").rlike("[ao]$") & (F.length("word") <= 3)))
    by_rule = best.select("kind", "word", F.when(~barred, forms).alias("ruled"))
    own = exceptions.select("kind", "word", F.struct("forms").alias("own"))
    both = w.select("kind", "word").join(by_rule, ["kind", "word"], "left").join(own, ["kind", "word"], "left")
    return both.select("kind", "word", F.when(F.col("own").isNotNull(), F.col("own.forms")).otherwise(F.col("ruled")).alias("forms"))


def morphology(people: DataFrame, forenames: DataFrame, surnames: DataFrame, rule_rows: DataFrame | None = None, key: str = "id", name: str = "full_name", role: str = "role") -> DataFrame:
    """key and 13 columns for each person: gender, names, two salutations, the name through six cases, a subject, and how much
    of it could be declined (full, first_name_only, undeclined, role_only).

    forenames: word, gender, forms (six, or null: known but left as it is); surnames: word, forms (five) of irregular ones.
    Women's first names are also known by their -a. Two words with the surname first are turned, if only the second is a
    known first name or the first has a surname's shape. Unknown names get the role's phrase.
    """
    spark: SparkSession = people.sparkSession
    rule_rows = spark.createDataFrame(rules(), RULE_TYPES) if rule_rows is None else rule_rows
    canonical = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
    words = F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), TITLES, "")), r"\s+"), lambda w: w != "")
    p = people.select(F.col(key), F.coalesce(F.col(role), F.lit("")).alias("role"), words.alias("w")).withColumns({"one": canonical(F.get("w", F.lit(0))), "two": canonical(F.get("w", F.lit(1)))})
    known = forenames.select(F.col("word").alias("known"), F.col("gender").alias("known_gender"))
    p = p.join(known.toDF("known1", "gender1"), F.col("one") == F.col("known1"), "left").join(known.toDF("known2", "gender2"), F.col("two") == F.col("known2"), "left")
    shaped = lambda c: c.rlike(SURNAME)
    female = lambda c: c.endswith("a") & (F.length(c) >= 3) & ~shaped(c)
    gender = lambda c, g: F.coalesce(F.col(g), F.when(female(F.col(c)), "female"))
    p = p.withColumns({"g1": gender("one", "gender1"), "g2": gender("two", "gender2")})
    turned = (F.size("w") == 2) & F.col("g2").isNotNull() & (shaped(F.col("w")[0]) | F.col("g1").isNull())
    p = p.withColumns({"w": F.when(turned, F.reverse("w")).otherwise(F.col("w")), "g": F.when(turned, F.col("g2")).otherwise(F.col("g1"))})
    plain = (F.size("w") > 0) & ~shaped(F.get("w", F.lit(0))) & ~F.contains(F.get("w", F.lit(0)), F.lit("-"))
    p = p.select(key, "role", F.when(plain, F.get("w", F.lit(0))).alias("first"), F.when(plain & (F.size("w") > 1), F.element_at("w", -1)).alias("last"), F.when(plain, F.col("g")).alias("gender"))
    p = p.withColumns({"first_key": canonical(F.col("first")), "parts": F.filter(F.split("last", "-"), lambda x: x != "")})

    first = p.filter("gender = 'female'").select(F.lit("female first").alias("kind"), F.col("first_key").alias("word"))
    first = first.union(p.filter("gender = 'male'").select(F.lit("male first"), "first_key"))
    own = forenames.select(F.concat("gender", F.lit(" first")).alias("kind"), "word", "forms")
    last = p.filter("gender is not null").select(F.concat("gender", F.lit(" surname")).alias("kind"), F.explode("parts").alias("word"))
    odd = surnames.select(F.lit("male surname").alias("kind"), "word", "forms")
    forms = declined(first.union(last), rule_rows, own.union(odd))
    firsts = forms.select(F.col("kind").alias("fk"), F.col("word").alias("fw"), F.col("forms").alias("f"))
    p = p.join(firsts, (F.col("fk") == F.concat("gender", F.lit(" first"))) & (F.col("fw") == F.col("first_key")), "left")
    # the forms of a surname's parts, put together in their order
    pieces = p.filter("gender is not null").select("gender", "last", F.posexplode("parts").alias("at", "part")).distinct()
    pieces = pieces.join(forms, (forms["kind"] == F.concat("gender", F.lit(" surname"))) & (forms["word"] == F.col("part")), "left")
    whole = pieces.groupBy(F.col("gender").alias("lg"), F.col("last").alias("ll")).agg(F.array_sort(F.collect_list(F.struct("at", "forms"))).alias("s"))

    def case(i: int) -> Column:
        return F.array_join(F.transform("s", lambda x: x["forms"][i]), "-")

    joined = F.array(*map(case, range(5)))
    whole = whole.select("lg", "ll", F.when(F.forall("s", lambda x: x["forms"].isNotNull()), joined).alias("l"))
    p = p.join(whole, (F.col("lg") == F.col("gender")) & (F.col("ll") == F.col("last")), "left")

    woman, man = F.col("gender") == "female", F.col("gender") == "male"
    pan = F.when(woman, F.array(*map(F.lit, MRS))).otherwise(F.array(*map(F.lit, MR)))
    quality = F.when(F.col("gender").isNull(), "role_only").when(F.col("f").isNull(), "undeclined").when(F.col("l").isNull(), "first_name_only").otherwise("full")
    p = p.withColumns({"pan": pan, "ref_quality": quality, "frozen": F.concat_ws(" ", "first", "last"), "vocative": F.get("f", F.lit(5))})
    phrase = F.when(F.col("role") == "director", F.array(*map(F.lit, ROLES["director"]))).otherwise(F.array(*map(F.lit, ROLES["teacher"])))

    def ref(i: int) -> Column:
        at = lambda c: F.get(c, F.lit(i))
        q = F.col("ref_quality")
        return F.when(q == "full", F.concat_ws(" ", at("pan"), at("f"), at("l"))).when(q == "first_name_only", F.concat_ws(" ", at("pan"), at("f"), "last")).when(q == "undeclined", F.concat_ws(" ", at("pan"), "frozen")).otherwise(at(phrase))

    q, title = F.col("ref_quality"), (F.col("role") == "director") & F.col("vocative").isNull()
    greet = lambda a, b: F.when(title & woman, f"{a} Pani Dyrektor,").when(title & man, f"{b} Panie Dyrektorze,")
    called = lambda a, b: F.when(woman, F.concat(F.lit(f"{a} Pani "), "vocative", F.lit(","))).when(man, F.concat(F.lit(f"{b} Panie "), "vocative", F.lit(",")))
    formal = greet("Szanowna", "Szanowny").when(title, "Szanowni Państwo,").when(F.col("vocative").isNotNull(), called("Szanowna", "Szanowny")).when(woman, "Szanowna Pani,").when(man, "Szanowny Panie,").otherwise("Dzień dobry,")
    casual = greet("Dzień dobry", "Dzień dobry").when(F.col("vocative").isNotNull(), called("Dzień dobry", "Dzień dobry")).otherwise("Dzień dobry,")
    subject = F.when(q == "full", F.concat_ws(" ", F.lit("dla"), F.get("pan", F.lit(0)), F.get("l", F.lit(0)))).when(q == "first_name_only", F.concat_ws(" ", F.lit("dla"), F.get("pan", F.lit(0)), F.get("f", F.lit(0))))
    subject = subject.when(q == "undeclined", F.concat_ws(" ", F.lit("dla"), F.get("pan", F.lit(0)), F.coalesce("last", "first"))).otherwise(F.concat(F.lit("dla "), F.get(phrase, F.lit(0))))
    shown = lambda c: F.when(q == "role_only", "").otherwise(F.coalesce(c, F.lit("")))
    nominative = F.when(q == "role_only", "").otherwise(F.concat_ws(" ", F.when(woman, "Pani").otherwise("Pan"), "frozen"))
    return p.select(key, F.coalesce("gender", F.lit("")).alias("gender"), shown(F.col("first")).alias("first_name"), shown(F.col("last")).alias("last_name"), formal.alias("salutation"), casual.alias("salutation_casual"), nominative.alias("ref_nom"),
                    *[ref(i).alias(f"ref_{c}") for i, c in enumerate(CASES[:5])], subject.alias("subject_ref"), "ref_quality")


FIRST = ["Anna", "Kasia", "MARIA", "Alicja", "Marta", "jan", "Adam", "Kirk", "Zenobiusz", "Weronika", "Kuba"]
LAST = ["Kowalska", "Nowak", "Kowalski", "Zaręba", "Gołąb", "Dudek", "Malec", "Wiśniewska-Nowak", "Mickiewicz", "Bakiera", "Mróz-Wójt", "Kot", "Lek"]
#: The dictionaries of the test: those of a deployment are tables of their own.
FORENAMES = [("Jan", "male", ["Jana", "Janowi", "Jana", "Janem", "Janie", "Janie"]), ("Adam", "male", ["Adama", "Adamowi", "Adama", "Adamem", "Adamie", "Adamie"]), ("Kuba", "male", None), ("Kirk", "male", None)]
ODD_SURNAMES = [("Gołąb", ["Gołębia", "Gołębiowi", "Gołębia", "Gołębiem", "Gołębiu"]), ("Dudek", ["Dudka", "Dudkowi", "Dudka", "Dudkiem", "Dudku"])]
PERSON = "case when c_custkey % 5 = 0 then 'mgr inż. ' else '' end || case when c_custkey % 17 = 0 then '' when c_custkey % 4 = 0 then {last} || ' ' || {first} else {first} || case when c_custkey % 7 = 0 then '' else ' ' || {last} end end"


def _person(pick) -> str:
    return PERSON.format(first=pick(FIRST, "c_custkey"), last=pick(LAST, "c_custkey"))


def _sql() -> str:
    text = lambda x: "null" if x is None else f"'{x}'"
    listed = lambda x: "cast(null as varchar[])" if x is None else "[" + ", ".join(map(text, x)) + "]"
    values = lambda rows: ", ".join(f"({', '.join(r)})" for r in rows)
    rule = values([text(k), text(x), str(cut), listed(e)] for k, x, cut, *e in rules())
    person = _person(lambda words, n: f"{listed(words)}[{n} % {len(words)} + 1]")
    canon = lambda c: f"(upper(substr({c}, 1, 1)) || lower(substr({c}, 2)))"
    female = lambda c: f"(ends_with({c}, 'a') and length({c}) >= 3 and not regexp_matches({c}, '{SURNAME}'))"
    pan = f"(case when gender = 'female' then {listed(MRS)} else {listed(MR)} end)"
    phrase = f"(case when role = 'director' then {listed(ROLES['director'])} else {listed(ROLES['teacher'])} end)"
    ref = lambda i: f"case q when 'full' then {pan}[{i}] || ' ' || f[{i}] || ' ' || l[{i}] when 'first_name_only' then {pan}[{i}] || ' ' || f[{i}] || coalesce(' ' || last, '') when 'undeclined' then {pan}[{i}] || ' ' || first || coalesce(' ' || last, '') else {phrase}[{i}] end as ref_{CASES[i - 1]}"
    title = "(role = 'director' and f is null)"
    return f"""with raw as (select c_custkey as id, {person} as name, case when c_custkey % 2 = 0 then 'director' else 'teacher' end as role from customer),
        w0 as (select *, list_filter(regexp_split_to_array(trim(regexp_replace(name, '(?i)(^|[^\\p{{L}}])(mgr|dr|hab|inż|inz|prof|lic|ks)[.]?\\s+', '\\1', 'g')), '\\s+'), lambda x: x <> '' and x <> 'inż.') as w from raw),
        kn(word, gender, forms) as (values {values([text(a), text(b), listed(c)] for a, b, c in FORENAMES)}), odd(word, forms) as (values {values([text(a), listed(b)] for a, b in ODD_SURNAMES)}), rule(kind, suffix, cut, e) as (values {rule}),
        g as (select w0.*, coalesce(a.gender, case when {female(canon("w[1]"))} then 'female' end) as g1, coalesce(b.gender, case when {female(canon("w[2]"))} then 'female' end) as g2 from w0 left join kn a on a.word = {canon("w[1]")} left join kn b on b.word = {canon("w[2]")}),
        t as (select id, role, case when turned then [w[2], w[1]] else w end as w, case when turned then g2 else g1 end as g from (select *, coalesce(len(w) = 2 and g2 is not null and (regexp_matches(w[1], '{SURNAME}') or g1 is null), false) as turned from g) x),
        p as (select id, role, case when plain then w[1] end as first, case when plain and len(w) > 1 then w[-1] end as last, case when plain then g end as gender from (select *, coalesce(len(w) > 0 and not regexp_matches(w[1], '{SURNAME}') and not contains(w[1], '-'), false) as plain from t) x),
        words as (select distinct gender || ' first' as kind, {canon("first")} as word from p where gender is not null union select distinct gender || ' surname', unnest(list_filter(string_split(last, '-'), lambda x: x <> '')) from p where gender is not null),
        ruled as (select * from (select words.kind, word, list_transform(e, lambda x: substr(word, 1, length(word) - cut) || x) as forms, row_number() over (partition by words.kind, word order by length(suffix) desc) as n
          from words join rule on rule.kind = words.kind and ends_with(lower(word), suffix) and not (suffix in ('ek', 'ec') and length(word) <= 3)) x where n = 1
          and not (kind = 'male surname' and ((regexp_matches(word, '{RISKY}') and not regexp_matches(word, '(?i)(ski|cki|dzki)$')) or (regexp_matches(lower(word), '[ao]$') and length(word) <= 3)))),
        forms as (select words.kind, words.word, case when kn.word is not null then kn.forms when odd.word is not null then odd.forms else ruled.forms end as forms from words left join ruled on ruled.kind = words.kind and ruled.word = words.word
          left join kn on words.kind = kn.gender || ' first' and kn.word = words.word left join odd on words.kind = 'male surname' and odd.word = words.word),
        parts as (select distinct gender, last, unnest(list_filter(string_split(last, '-'), lambda x: x <> '')) as part, generate_subscripts(list_filter(string_split(last, '-'), lambda x: x <> ''), 1) as pos from p where gender is not null),
        whole as (select gender, last, case when bool_and(forms is not null) then [{", ".join(f"string_agg(forms[{i}], '-' order by pos)" for i in range(1, 6))}] end as l from parts left join forms on kind = gender || ' surname' and word = part group by 1, 2),
        j as (select p.*, forms.forms as f, whole.l, case when p.gender is null then 'role_only' when forms.forms is null then 'undeclined' when whole.l is null then 'first_name_only' else 'full' end as q
          from p left join forms on forms.kind = p.gender || ' first' and forms.word = {canon("first")} left join whole on whole.gender = p.gender and whole.last = p.last)
        select id, coalesce(gender, '') as gender, case when q = 'role_only' then '' else coalesce(first, '') end as first_name, case when q = 'role_only' then '' else coalesce(last, '') end as last_name,
          case when {title} then case gender when 'female' then 'Szanowna Pani Dyrektor,' when 'male' then 'Szanowny Panie Dyrektorze,' else 'Szanowni Państwo,' end when f is not null then case gender when 'female' then 'Szanowna Pani ' || f[6] || ',' else 'Szanowny Panie ' || f[6] || ',' end
            when gender = 'female' then 'Szanowna Pani,' when gender = 'male' then 'Szanowny Panie,' else 'Dzień dobry,' end as salutation,
          case when {title} and gender = 'female' then 'Dzień dobry Pani Dyrektor,' when {title} and gender = 'male' then 'Dzień dobry Panie Dyrektorze,' when f is not null then case gender when 'female' then 'Dzień dobry Pani ' || f[6] || ',' else 'Dzień dobry Panie ' || f[6] || ',' end else 'Dzień dobry,' end as salutation_casual,
          case when q = 'role_only' then '' else case gender when 'female' then 'Pani ' else 'Pan ' end || first || coalesce(' ' || last, '') end as ref_nom, {", ".join(ref(i) for i in range(1, 6))},
          'dla ' || case q when 'full' then {pan}[1] || ' ' || l[1] when 'first_name_only' then {pan}[1] || ' ' || f[1] when 'undeclined' then {pan}[1] || ' ' || coalesce(last, first) else {phrase}[1] end as subject_ref, q as ref_quality from j"""


@query("morphology_export", _sql().replace("\\\\", "\\"))
def _(v):
    person = _person(lambda words, n: "element_at(array({}), cast({} % {} + 1 as int))".format(", ".join(f"'{w}'" for w in words), n, len(words)))
    people = v.customer.selectExpr("c_custkey as id", f"{person} as full_name", "case when c_custkey % 2 = 0 then 'director' else 'teacher' end as role")
    forenames = v.spark.createDataFrame(FORENAMES, "word string, gender string, forms array<string>")
    return morphology(people, forenames, v.spark.createDataFrame(ODD_SURNAMES, "word string, forms array<string>"))
