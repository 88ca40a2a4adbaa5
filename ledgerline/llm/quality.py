"""Quality rules with distribution divergence, in DataFrame functions only.

A document's histogram over character classes and its histogram over the frequent words of a language are compared with
that language's references by Jensen-Shannon distance (the square root of the divergence to base 2, between 0 and 1).
A histogram says little about a short text, so each comparison begins at a minimum length; shorter texts are judged by
the base rules alone. The language is the one whose frequent words are nearest; the table's own label isn't trusted.

References: frequent words follow a rank law, first / rank ** slope, which is near the published counts of these
languages; character classes are those of running prose. Both are parameters of QualityRules. A long text in a language
that has no list there is far from all references and goes; hand in the list of any other language of the corpus.

Defined results: a null, empty or wordless text has zeros and fails the base rules; repeated rows are judged each on
their own; other columns stay (keep_good) or aren't read (quality).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most frequent words by rank (fixed values).
FREQUENT = {
    "en": "the of and to in is that it for was on with as at by be this from are or",
    "fr": "de la le et les des en un du une que pour est dans qui par sur au pas plus",
    "de": "der die und in den von zu das sich mit des auf ist im dem nicht ein eine als für",
    "es": "de la que el en y los se las del un por con no una su para es al lo",
    "it": "di e il la che in a per un è del non si da i una le con della sono",
    "pt": "de a o que e do da em um para com não uma os no se na por mais as",
    "nl": "de van een het en in is dat op te zijn met voor niet aan er om ook als dan",
    "ru": "и в не на что с он как по это но из у за от к его для так все",
}
#: Shares of prose: white space, upper case, other letters and marks, digits, sentence marks, anything else (fixed values).
CLASSES = (0.16, 0.03, 0.775, 0.005, 0.025, 0.005)


@dataclass(frozen=True)
class QualityRules:
    least_words: int = 20
    #: Per cent of words in repeated windows of `window` words.
    most_repeated: int = 30
    window: int = 8
    #: Character classes: from so many words on, so much distance at most, and class_slack / n_words more (chance and
    #: single numbers weigh more in a short text).
    class_words: int = 50
    class_distance: float = 0.155
    class_slack: float = 4.0
    #: Frequent words: likewise.
    frequent_words: int = 120
    frequent_distance: float = 0.28
    frequent_slack: float = 5.0
    #: Frequency of the first word, and how it falls with the rank.
    first: float = 0.06
    slope: float = 0.75
    frequent: dict[str, str] = field(default_factory=lambda: dict(FREQUENT))
    classes: tuple[float, ...] = CLASSES


def _half(p: Column, q: Column) -> Column:
    """p * log2(p / m) for m the mean of p and q; 0 where p is 0."""
    return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def quality(docs: DataFrame, rules: QualityRules | None = None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    frequent_distance (null below the minimum lengths) and kept. With keep, docs' own columns and `kept` only."""
    r = rules or QualityRules()
    own = F.struct(*[docs[c] for c in docs.columns]) if keep else F.lit(None)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    d = docs.select(docs[id_col].alias("doc_id"), own.alias("own"), text.alias("text"))
    d = d.withColumn("inner", F.btrim("text", F.lit(" \t\n\x0b\x0c\r")))
    d = d.withColumn("words", F.when(F.col("inner") == "", F.array().cast("array<string>")).otherwise(F.split("inner", r"[\x20\x09-\x0D]+"))).drop("inner")
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("words")
    # a window is the hash of its words' hashes; only texts in which one comes twice are looked at closer
    window = lambda i: F.xxhash64(*[F.get(F.col("hashes"), i + k) for k in range(r.window)])
    d = d.withColumn("windows", F.when(n >= r.window, F.transform(F.sequence(F.lit(0), n - r.window), window)).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("twice", F.size(F.array_distinct("windows")) < F.size("windows"))
    placed = F.when(F.col("twice"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("placed", placed)
    at = lambda i: F.get(F.col("placed"), i)["h"]
    same = F.filter("placed", lambda x, i: F.coalesce(x["h"] == at(i - 1), F.lit(False)) | F.coalesce(x["h"] == at(i + 1), F.lit(False)))
    d = d.withColumn("repeats", F.array_sort(F.transform(same, lambda x: x["i"])))
    covered = F.transform("repeats", lambda i, k: F.least(F.lit(r.window), F.coalesce(F.get(F.col("repeats"), k + 1) - i, F.lit(r.window))))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("n_repeat_words", F.when(F.col("twice"), F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0)).cast("long"))
    d = d.drop("hashes", "windows", "placed", "repeats", "twice").withColumn("lines", lines)
    # classes are counted on what is left of a text without its plain letters
    d = d.withColumn("rest", F.regexp_replace("text", r"[\p{Ll}\p{Lo}\p{M}]+", ""))
    # a frequent word may have two bytes of marks around it; longer words needn't be looked at
    short = F.filter("words", lambda w: F.octet_length(w) <= max(len(w.encode()) for w in _all(r)) + 2)
    d = d.withColumn("common", F.array_sort(F.filter(F.transform(short, lambda w: F.lower(F.btrim(w, F.lit(".,;:!?")))), lambda w: w.isin(*_all(r)))))
    m = F.size("common")
    ends = F.when(m > 0, F.filter(F.sequence(F.lit(1), m), lambda i: ~F.coalesce(F.get(F.col("common"), i - 1) == F.get(F.col("common"), i), F.lit(False))))
    count = lambda pattern: (F.length("rest") - F.length(F.regexp_replace("rest", pattern, ""))).cast("double")
    d = d.select(
        "doc_id", "own", n.cast("long").alias("n_words"), F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"), F.regexp_count("rest", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.length("text").cast("double").alias("chars"), F.length("rest").cast("double").alias("other"),
        count(r"\s+").alias("white"), count(r"\p{Lu}+").alias("upper"), count(r"\p{Nd}+").alias("digits"), count(r"""[.,;:!?'"()\-]+""").alias("marks"), "common", ends.alias("ends"),
    )
    d = d.withColumn("base_failed", (F.col("n_words") < r.least_words) | (100 * F.col("n_repeat_words") > r.most_repeated * F.col("n_words")))
    shares = [F.col("white"), F.col("upper"), F.col("chars") - F.col("other"), F.col("digits"), F.col("marks"), F.col("other") - F.col("white") - F.col("upper") - F.col("digits") - F.col("marks")]
    parts = [(_half(s / F.col("chars"), F.lit(q)) + _half(F.lit(q), s / F.col("chars"))) / 2 for s, q in zip(shares, r.classes)]
    d = d.withColumn("class_distance", F.when(F.col("n_words") >= r.class_words, _distance(sum(parts[1:], parts[0]))))
    runs = F.transform("ends", lambda e, i: F.struct(F.get(F.col("common"), e - 1).alias("w"), (e - F.coalesce(F.get(F.col("ends"), i - 1), F.lit(0))).cast("double").alias("c")))
    d = d.withColumn("runs", F.coalesce(F.when(F.col("n_words") >= r.frequent_words, runs), F.array().cast("array<struct<w:string,c:double>>")))
    nearest = F.least(*[_frequent_distance(words, r) for words in r.frequent.values()], F.lit(1.0))
    d = d.withColumn("frequent_distance", F.when(F.col("n_words") >= r.frequent_words, nearest))
    most = lambda limit, slack: limit + slack / F.col("n_words")
    bad = F.coalesce(F.col("class_distance") > most(r.class_distance, r.class_slack), F.lit(False))
    bad = bad | F.coalesce(F.col("frequent_distance") > most(r.frequent_distance, r.frequent_slack), F.lit(False))
    d = d.withColumn("kept", ~F.col("base_failed") & ~bad)
    if keep:
        return d.select("own.*", F.col("kept").alias("__kept"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "frequent_distance", "kept")


def _all(r: QualityRules) -> list[str]:
    return sorted({w for words in r.frequent.values() for w in words.split()})


def _frequent_distance(words: str, r: QualityRules) -> Column:
    """Distance between the document's shares of these words (and of all others) and the reference's. A reference word
    that the document lacks adds half its share; so only the words it has are gone through."""
    q = {w: r.first / (k + 1) ** r.slope for k, w in enumerate(words.split())}
    reference = F.create_map(*[F.lit(x) for pair in q.items() for x in pair])
    rest = 1 - sum(q.values())
    n = F.col("n_words").cast("double")

    def add(a: Column, x: Column) -> Column:
        share, own = x["c"] / n, F.element_at(reference, x["w"])
        step = _half(share, own) + _half(own, share) - own
        return F.when(own.isNull(), a).otherwise(F.struct((a["d"] + step).alias("d"), (a["s"] + share).alias("s")))

    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("s"))

    def end(a: Column) -> Column:
        other = 1 - a["s"]
        return _distance((a["d"] + F.lit(sum(q.values())) + _half(other, F.lit(rest)) + _half(F.lit(rest), other)) / 2)

    return F.aggregate("runs", zero, add, end)


def keep_good(docs: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """The documents that pass, with all their columns.

    A filter on the verdict would be pushed down, and the verdict's long chain of columns written out anew at each of its
    uses. The row number beside it, which mustn't be made twice, holds the filter where it is.
    """
    judged = quality(docs, rules, keep=True).withColumn("__row", F.monotonically_increasing_id())
    return judged.filter("__kept and __row >= 0").drop("__kept", "__row")
