"""Personal data by patterns, checksum validators and context, in Spark's own functions.

Patterns propose spans, validators (address parts, digit counts, Luhn, mod-97) confirm
or drop them, and words before a span raise its score. Spans come out of matches and
of the text between them, so offsets are those of the original text in code points.
Patterns use possessive repetition and start at the beginning of a run, which finds
the same leftmost matches without trying every position of a long run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import let

LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"


BLOCK = 64


def running(values: Column, levels: int = 2) -> Column:
    """Of an array of integers the sum of those before each, by blocks of blocks, so that long arrays take no quadratic time."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda acc, x: acc + x)

    if not levels:
        return F.transform(values, lambda x, i: total(F.slice(values, 1, i)))
    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
    sums = F.when(F.size(values) > 0, F.transform(blocks, lambda b: total(F.slice(values, b * BLOCK + 1, BLOCK)))).otherwise(F.expr("cast(array() as array<int>)"))

    def placed(before: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            return F.get(before, block) + total(F.slice(values, block * BLOCK + 1, i - block * BLOCK))

        return F.transform(values, at)

    return let(let(sums, lambda v: running(v, levels - 1)), placed)


def each_match(text: Column, pattern: str, body: Callable[[Column, Column, Column], Column]) -> Column:
    """Array of body(start, hit, context) of the leftmost non-overlapping matches, in order; context is the text before, two matches back at most."""
    pieces = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.split(text, pattern, -1).alias("before"))

    def placed(found: Column) -> Column:
        def one(at: Column) -> Column:
            def told(p: Column, i: Column) -> Column:
                back = [F.get(found, i - k) for k in (2, 1)]
                context = F.concat_ws("", *(b[c] for b in back for c in ("before", "hit")), p["before"])
                return body(F.get(at, i) + F.length(p["before"]), p["hit"], context)

            return F.transform(found, told)

        lengths = F.transform(found, lambda p: F.length(p["before"]) + F.length(p["hit"]))
        return let(let(lengths, lambda v: running(v)), one)

    return let(F.filter(pieces, lambda p: p["hit"].isNotNull()), placed)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""

    def checked(number: Column) -> Column:
        each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(d.try_cast("int") * 2 - F.when(d.try_cast("int") > 4, 9).otherwise(0)))
        total = F.aggregate(each, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0)))
        return F.length(number).between(13, 19) & (total % 10 == 0)

    return F.when(F.length(hit).between(13, 37), let(digits(hit), checked)).otherwise(False)


def mod97(hit: Column) -> Column:
    """ISO 7064: the first four characters go last, letters count from 10, the remainder is 1."""

    def checked(code: Column) -> Column:
        turned = F.split(F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4)), "")

        def step(acc: Column, c: Column) -> Column:
            value = F.ascii(c) - 48
            return F.when(c == "", acc).when(value < 10, (acc * 10 + value) % 97).otherwise((acc * 100 + value + 48 - 55) % 97)

        return F.length(code).between(15, 34) & (F.aggregate(turned, F.lit(0), step) == 1)

    return let(F.translate(hit, " ", ""), checked)


@dataclass(frozen=True)
class Kind:
    """A kind of span: a cheap test of the text, the pattern, the validator, and how it scores."""

    name: str
    hint: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str


#: In the order of the result. The first four always pass; others need a score of `accept`.
BASE_KINDS = (
    Kind("email", "@", EMAIL, lambda h: F.lit(True), 0.8, "mail|contact|correo|courriel|kontakt"),
    Kind("ip", r"[0-9]\.[0-9]", IP, lambda h: h.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), 0.6, r"\bip\b|server|host|address"),
    Kind("card", "[0-9]", CARD, luhn, 0.7, "card|visa|credit|tarjeta|carte|karte"),
    Kind("phone", r"\+[0-9]", PHONE, lambda h: F.length(digits(h)).between(9, 15), 0.7, "phone|tel|call|mobile|fono|handy"),
)
ADDED_KINDS = (
    Kind("iban", "[A-Z]{2}[0-9]{2}", IBAN, mod97, 0.8, "iban|account|konto|cuenta|compte"),
    Kind("national_id", "[0-9]{3}-[0-9]{2}-", NATIONAL_ID, lambda h: ~h.rlike("^(?:000|666|9)|-00-|-0000$"), 0.4, "ssn|social|security|identity"),
)
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.2


def spans(text: Column, kind: Kind, accept: float | None = None) -> Column:
    """Array of (start, end, score) of a kind: valid matches, with a score of accept at least where that is given."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,score:double>>)")

    def scored(start: Column, hit: Column, context: Column) -> Column:
        near = F.lower(F.right(context, F.lit(CONTEXT_CHARS)))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), CONTEXT_BONUS).otherwise(0.0)
        return F.when(kind.valid(hit), F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), score.alias("score")))

    found = F.filter(each_match(text, kind.pattern, scored), lambda s: s.isNotNull())
    if accept is not None:
        found = F.filter(found, lambda s: s["score"] >= accept)
    return F.when(text.rlike(kind.hint), found).otherwise(none)


def _listed(found: Column, kind: Kind) -> Column:
    return F.transform(found, lambda s: F.concat_ws(":", F.lit(kind.name), s["start"].cast("string"), s["end"].cast("string")))


def find_personal_data(docs: DataFrame, accept: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, email, ip, card, phone, iban, national_id): arrays of (start, end, score) for every row.

    Offsets are code points, end exclusive. Null and empty texts have no spans; rows
    with null or repeated ids are each searched. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    base = [spans(F.col("text"), k).alias(k.name) for k in BASE_KINDS]
    added = [spans(F.col("text"), k, accept).alias(k.name) for k in ADDED_KINDS]
    return rows.select("doc_id", "text", *base, *added)


def redact(docs: DataFrame, accept: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): every span replaced by its kind in angle brackets, for every row.

    Of overlapping spans the one that starts first is replaced; of those that start
    together the one that ends first, then the first kind by name. Null texts become
    empty; rows with null or repeated ids are each redacted.
    """
    found = find_personal_data(docs, accept, id_col, text_col)

    def tagged(kind: Kind) -> Column:
        return F.transform(F.col(kind.name), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{kind.name}>").alias("tag")))

    every = F.concat(*map(tagged, (*BASE_KINDS, *ADDED_KINDS)))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        goes_on = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"]), s["tag"]).alias("out"))
        return F.when(s["start"] >= acc["at"], goes_on).otherwise(acc)

    whole = F.aggregate(F.array_sort(every), begin, step, lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text"))))
    return found.select("doc_id", whole.alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of their list, and the list of all spans."""
    base = F.concat(*(_listed(F.col(k.name), k) for k in BASE_KINDS))
    every = F.concat(base, *(_listed(F.col(k.name), k) for k in ADDED_KINDS))
    counts = [F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"), F.concat_ws(",", every).alias("spans"))
