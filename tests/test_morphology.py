from pyspark.sql import functions as F

from ledgerline.functions.morphology import COLUMNS, FORENAMES, ODD_SURNAMES, morphology

#: name, role: quality, dative, instrumental, salutation, subject
CASES = {
    ("mgr Anna Kowalska", "teacher"): ("full", "Pani Annie Kowalskiej", "Panią Anną Kowalską", "Szanowna Pani Anno,", "dla Pani Kowalskiej"), ("Nowak Kasia", "teacher"): ("full", "Pani Kasi Nowak", "Panią Kasią Nowak", "Szanowna Pani Kasiu,", "dla Pani Nowak"),
    ("Jan Malec", "director"): ("full", "Panu Janowi Malcowi", "Panem Janem Malcem", "Szanowny Panie Janie,", "dla Pana Malca"), ("Jan Zaręba", "teacher"): ("full", "Panu Janowi Zarębie", "Panem Janem Zarębą", "Szanowny Panie Janie,", "dla Pana Zaręby"),
    ("Jan Gołąb", "teacher"): ("full", "Panu Janowi Gołębiowi", "Panem Janem Gołębiem", "Szanowny Panie Janie,", "dla Pana Gołębia"), ("Jan Jastrząb", "teacher"): ("first_name_only", "Panu Janowi Jastrząb", "Panem Janem Jastrząb", "Szanowny Panie Janie,", "dla Pana Jana"),
    ("Adam Nowak-Kot", "teacher"): ("full", "Panu Adamowi Nowakowi-Kotowi", "Panem Adamem Nowakiem-Kotem", "Szanowny Panie Adamie,", "dla Pana Nowaka-Kota"), ("Adam Nowak-Wójt", "teacher"): ("first_name_only", "Panu Adamowi Nowak-Wójt", "Panem Adamem Nowak-Wójt", "Szanowny Panie Adamie,", "dla Pana Adama"), ("Maria Wiśniewska-Nowak", "teacher"): ("full", "Pani Marii Wiśniewskiej-Nowak", "Panią Marią Wiśniewską-Nowak", "Szanowna Pani Mario,", "dla Pani Wiśniewskiej-Nowak"),
    ("Kirk Palmer", "director"): ("undeclined", "Panu Kirk Palmer", "Panem Kirk Palmer", "Szanowny Panie Dyrektorze,", "dla Pana Palmer"), ("Anna", "director"): ("first_name_only", "Pani Annie", "Panią Anną", "Szanowna Pani Anno,", "dla Pani Anny"),
    ("Zenobiusz Kot", "director"): ("role_only", "dyrekcji szkoły", "dyrekcją szkoły", "Szanowni Państwo,", "dla dyrekcji szkoły"), ("Kowalska", "teacher"): ("role_only", "nauczycielowi języka angielskiego", "nauczycielem języka angielskiego", "Dzień dobry,", "dla nauczyciela języka angielskiego"),
    (None, "teacher"): ("role_only", "nauczycielowi języka angielskiego", "nauczycielem języka angielskiego", "Dzień dobry,", "dla nauczyciela języka angielskiego"), ("  ", None): ("role_only", "nauczycielowi języka angielskiego", "nauczycielem języka angielskiego", "Dzień dobry,", "dla nauczyciela języka angielskiego"),
    ("Jan Lek", "teacher"): ("full", "Panu Janowi Lekowi", "Panem Janem Lekiem", "Szanowny Panie Janie,", "dla Pana Leka"), ("Jan Fredro", "teacher"): ("full", "Panu Janowi Fredrze", "Panem Janem Fredrą", "Szanowny Panie Janie,", "dla Pana Fredry"), ("Alicja Boa", "teacher"): ("full", "Pani Alicji Boa", "Panią Alicją Boa", "Szanowna Pani Alicjo,", "dla Pani Boa"),
}


def test_names_in_letters(spark):
    people = spark.createDataFrame([(i, n, r) for i, (n, r) in enumerate(CASES)] * 2, "id long, full_name string, role string")
    forenames, odd = spark.createDataFrame(FORENAMES, "word string, gender string, forms array<string>"), spark.createDataFrame(ODD_SURNAMES, "word string, forms array<string>")
    df = morphology(people, forenames, odd)
    assert df.columns == ["id", *COLUMNS] and len(COLUMNS) == 13
    got = df.collect()
    assert len(got) == 2 * len(CASES)
    assert {r["id"]: (r["ref_quality"], r["ref_dat"], r["ref_inst"], r["salutation"], r["subject_ref"]) for r in got} == dict(enumerate(CASES.values()))
    assert morphology(people.filter(F.lit(False)), forenames, odd).count() == 0
