"""Secrets in texts: three patterns, and a battery of randomness tests for strings that no pattern knows.

A candidate is a run of at least `least` characters of base64 or its URL form. Its encoding is inferred as the smallest
alphabet that holds it: hexadecimal (one case), base32, base36 (one case), base62, base64, base64url; strings of letters
of one case or of digits alone have none, as words and numbers are such. Three tests, each against the hypothesis that
the string is ordinary (words, names, paths joined together), whose statistics move with the length:

    uniformity      chi-squared of the characters' counts over the alphabet. Ordinary strings use few characters often, so
                    theirs is noncentral with `skew` for each character; a random string's is far below.
    runs            changes of kind (lower, upper, digit, mark). Ordinary strings change half as often at most as random ones.
    correlation     lag-1 correlation of code values. Ordinary neighbours are alike (`alike`), random ones aren't.

Each gives a normal score that grows with the length; their sum over the root of three is one p-value, so a short string
has to be more clearly random than it can be, and a long one passes. A string that a test finds too even or too uneven to be
random (the same three statistics against the uniform hypothesis, beyond `odd` standard deviations) is out. Over all
candidates of the corpus the step-up rule of Benjamini and Hochberg keeps the false ones among the finds at `rate`: p-values
are rounded up to a grid, and only the grid's counts, a bounded number, come to the driver.

Defined results: a null text is an empty text, without finds; rows with the same or no id are scanned each on their own;
other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, lean, ship, steps, strings, written

#: Kinds in the order in which spans with one start stand.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
LEAST_ASSIGNED, LEAST_ACCESS = 12, 18
RUN = re.compile(rb"[A-Za-z0-9+/_-]{20,}")

DIGITS, LOWER, UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by size: name, alphabet in the order of its values.
ENCODINGS = (
    ("hex", DIGITS + LOWER[:6]), ("HEX", DIGITS + UPPER[:6]), ("base32", UPPER + DIGITS[2:8]), ("base36", DIGITS + LOWER), ("BASE36", DIGITS + UPPER),
    ("base62", UPPER + LOWER + DIGITS), ("base64", UPPER + LOWER + DIGITS + b"+/"), ("base64url", UPPER + LOWER + DIGITS + b"-_"),
)


@dataclass(frozen=True)
class Battery:
    least: int = 20
    #: Ordinary strings: noncentrality of chi-squared for each character, share of a random string's changes of kind, correlation.
    skew: float = 2.0
    changes: float = 0.5
    alike: float = 0.4
    #: Standard deviations beyond which a string isn't random.
    odd: float = 3.5
    #: Share of false ones among the finds.
    rate: float = 0.001
    #: Steps of the grid for each power of ten, and its end.
    grid: int = 20
    deepest: int = 300


def kind_of(c: int) -> int:
    return 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3


KIND = np.array([kind_of(c) for c in range(256)])


def inferred(s: bytes) -> tuple[str, bytes] | None:
    """The smallest encoding that holds the string, if it has two kinds of characters at least."""
    if s.isdigit() or (s.isalpha() and (s.islower() or s.isupper())):
        return None
    return next(((name, alphabet) for name, alphabet in ENCODINGS if not s.translate(None, alphabet)), None)


def scores(s: bytes, alphabet: bytes, b: Battery) -> tuple[list[float], list[float]]:
    """Normal scores of the three tests: how far from an ordinary string on the random side, and how far from a random one
    on either side."""
    n, k = len(s), len(alphabet)
    codes = np.frombuffer(s, np.uint8)
    counts = np.bincount(codes, minlength=256)[np.frombuffer(alphabet, np.uint8)]
    chi = float(k / n * (counts.astype(np.float64) ** 2).sum() - n)
    shift = n * b.skew
    ordinary = [(k - 1 + shift - chi) / math.sqrt(2 * (k - 1 + 2 * shift))]
    random = [(chi - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n))]
    shares = np.bincount(KIND[list(alphabet)], minlength=4) / k
    tau = 1 - float((shares**2).sum())
    kinds = KIND[codes]
    changed = int(np.count_nonzero(kinds[1:] != kinds[:-1]))
    low = b.changes * tau
    ordinary.append((changed - (n - 1) * low) / math.sqrt((n - 1) * low * (1 - low)))
    random.append((changed - (n - 1) * tau) / math.sqrt((n - 1) * tau * (1 - tau)))
    x = codes.astype(np.float64) - codes.mean()
    r = float((x[1:] * x[:-1]).sum() / max((x * x).sum(), 1e-9))
    r = max(-0.999, min(0.999, r))
    ordinary.append((math.atanh(b.alike) - math.atanh(r)) * math.sqrt(n - 3))
    random.append(math.atanh(r) * math.sqrt(n - 3))
    return ordinary, random


def p_step(s: bytes, b: Battery) -> int | None:
    """The grid step of a candidate's p-value (step / grid powers of ten below 1, rounded up), or None if no test is due."""
    found = inferred(s)
    if not found:
        return None
    ordinary, random = scores(s, found[1], b)
    if max(map(abs, random)) > b.odd:
        return 0
    p = 0.5 * math.erfc(sum(ordinary) / math.sqrt(3) / math.sqrt(2))
    return min(b.deepest * b.grid, int(-math.log10(max(p, 1e-320)) * b.grid)) if p < 1 else 0


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """start, kind, end (bytes) of what the three patterns find."""
    low = text.lower()
    spans = []
    if any(w in low for w in WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if b"AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def candidates(text: bytes, base: list[tuple[int, int, int]], b: Battery) -> list[tuple[int, int, int]]:
    """start, end, grid step of the strings that the battery tests: runs that no base span touches."""
    out = []
    for m in RUN.finditer(text):
        if m.end() - m.start() >= b.least and not any(s < m.end() and m.start() < e for s, _, e in base):
            step = p_step(m[0], b)
            if step is not None:
                out.append((m.start(), m.end(), step))
    return out


class Points:
    """Byte places of one text as code points, in ascending order of the places."""

    def __init__(self, text: bytes):
        self.text, self.ascii, self.marks = text, text.isascii(), None

    def __call__(self, at: int) -> int:
        if self.ascii:
            return at
        if self.marks is None:
            self.marks = np.flatnonzero(np.frombuffer(self.text, np.uint8) & 0xC0 == 0x80)
        return at - int(np.searchsorted(self.marks, at))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scanned(docs: DataFrame, battery: Battery | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (array of start, kind, end), tested (array of start, end, step): one pass over the texts, places in code
    points. Rows without finds have empty arrays."""
    b = battery or Battery()
    ship(docs.sparkSession)
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    test = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("step", pa.int32())]))
    out = pa.schema([("doc_id", pa.int64()), ("base", span), ("tested", test)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            base, tested = [], []
            for text in strings(part.column(1)).cast(pa.large_binary()).to_pylist():
                own = base_spans(text)
                more = candidates(text, own, b)
                p = Points(text)
                base.append([{"start": p(s), "kind": k, "end": p(e)} for s, k, e in own])
                tested.append([{"start": p(s), "end": p(e), "step": x} for s, e, x in more])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, span), pa.array(tested, test)], schema=out)

    schema = "doc_id long, base array<struct<start:long,kind:int,end:long>>, tested array<struct<start:long,end:long,step:int>>"
    return id_and_text(docs, id_col, text_col).mapInArrow(lean(scan), schema)


def least_step(counts: dict[int, int], b: Battery) -> int:
    """The smallest grid step that the step-up rule finds: the k candidates at it or beyond have p <= rate * k / m."""
    m, k = sum(counts.values()), 0
    best = b.deepest * b.grid + 1
    for step in sorted(counts, reverse=True):
        k += counts[step]
        if step > 0 and -step / b.grid <= math.log10(b.rate * k / m):
            best = step
    return best


def find_secrets(docs: DataFrame, battery: Battery | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (array of start, kind, end) and found (those of kind 3): places in code points, ends exclusive."""
    b = battery or Battery()
    seen = written(scanned(docs, b, id_col, text_col), "secrets")
    counts = seen.select(F.explode("tested").alias("t")).groupBy("t.step").count()
    least = least_step({r["step"]: r["count"] for r in counts.collect()}, b)  # one row for each step of the grid at most
    found = F.transform(F.filter("tested", lambda t: t["step"] >= least), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return seen.select("doc_id", "base", found.alias("found"))


def secret_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    text = lambda col: F.array_join(F.transform(F.array_sort(col), lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(text("base"), 256).alias("base_sha256"), text(F.concat("base", "found")).alias("spans"))
