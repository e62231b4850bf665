"""Text folding, search keys and tolerant parsers, all as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points whose accents folding drops; and combining marks, which go altogether.
FOLDED_RANGES = ((0xC0, 0x24F), (0x1E00, 0x1EFF))
COMBINING_RANGE = (0x300, 0x36F)
WHITE = r"[\s\p{Z}]+"


@cache
def accent_table() -> tuple[str, str]:
    """Letters with accents and what they fold to, out of their canonical decomposition."""
    pairs = []
    for low, high in FOLDED_RANGES:
        for cp in range(low, high + 1):
            base = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(c))
            if len(base) == 1 and base != chr(cp):
                pairs.append((chr(cp), base))
    marks = "".join(map(chr, range(COMBINING_RANGE[0], COMBINING_RANGE[1] + 1)))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, WHITE, " "))


def strip_accents(c: Column) -> Column:
    return F.translate(c, *accent_table())


def fold(c: Column) -> Column:
    """Lower case without accents and needless white space; null is empty. Idempotent."""
    return collapse(strip_accents(F.lower(F.coalesce(c, F.lit("")))))


def key_upper(c: Column) -> Column:
    """A name as an upper-case key; sharp s counts as two letters."""
    return F.upper(F.replace(fold(c), F.lit("ß"), F.lit("ss")))


def key_strict(c: Column) -> Column:
    """A name as a lower-case key of ASCII letters, digits and hyphens."""
    return collapse(F.regexp_replace(fold(c), "[^a-z0-9-]+", " "))


def key_or_null(c: Column) -> Column:
    return F.when(c.isNotNull(), key_upper(c))


def contains_folded(c: Column, pattern: str) -> Column:
    """LIKE on folded text; % and _ of the pattern stay wildcards."""
    return F.like(fold(c), F.concat(F.lit("%"), fold(F.lit(pattern)), F.lit("%")))


def equals_folded(c: Column, value: str) -> Column:
    return fold(c) == fold(F.lit(value))


def any_contains_folded(cols: list[Column], pattern: str) -> Column:
    """Whether one of several columns contains the pattern; nulls contain nothing."""
    found = F.lit(False)
    for c in cols:
        found = found | contains_folded(c, pattern)
    return found


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def digits_and_slash(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9/]", "")


def null_if_blank(c: Column, *also: str) -> Column:
    """Trimmed text; null where nothing is left or it spells a missing value."""
    plain = F.trim(c)
    return F.when(~F.lower(plain).isin("", "nan", "none", "<na>", *also), plain)


def zero_padded(c: Column, width: int) -> Column:
    """The digits of a code, padded to width and never cut; a trailing '.0' isn't part of it."""
    number = digits(F.regexp_replace(F.trim(c), r"\.0$", ""))
    return F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)


def decimal_comma(c: Column) -> Column:
    """A number with a decimal comma or point; null if it isn't one."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def day_first_date(c: Column) -> Column:
    """dd/MM/yyyy as an ISO date text; null if there is no such day."""
    return F.try_to_date(F.trim(c), "dd/MM/yyyy").cast("string")


def first_date(c: Column) -> Column:
    """The first ISO date in a text, or null."""
    return F.nullif(F.regexp_extract(c, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit(""))


def address(street: list[Column], place: list[Column]) -> Column:
    """Parts joined by blanks, the two halves by a comma; nulls leave no trace."""
    halves = [F.nullif(F.concat_ws(" ", *half), F.lit("")) for half in (street, place)]
    return F.nullif(F.concat_ws(", ", *halves), F.lit(""))


def label(code: Column, name: Column) -> Column:
    """'code - name', or whichever is there."""
    return F.nullif(F.concat_ws(" - ", F.nullif(code, F.lit("")), F.nullif(name, F.lit(""))), F.lit(""))


def code_label(code: Column, labels: dict[str, str]) -> Column:
    """A code's label; an unknown code is made readable: blanks for underscores, the first letter in upper case."""
    plain = F.replace(F.lower(code), F.lit("_"), F.lit(" "))
    pretty = F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 1 << 20))
    out = F.when(F.lit(False), pretty)
    for key, value in labels.items():
        out = out.when(code == key, value)
    return out.otherwise(pretty)


def name_parts(c: Column) -> tuple[Column, Column, Column]:
    """(first, middle, last) of a blank-separated name; of one token all but first are null."""
    parts = F.split(collapse(c), " ")
    n = F.size(parts)
    middle = F.array_join(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), " ")
    return F.get(parts, F.lit(0)), F.when(n > 2, middle), F.when(n > 1, F.element_at(parts, -1))


def last_parenthesised(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"\(([^()]*)\)"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def right_split(c: Column, separator: str) -> tuple[Column, Column]:
    """What stands before and after the last separator; without one, the whole and null."""
    after = F.substring_index(c, separator, -1)
    there = F.contains(c, F.lit(separator))
    before = F.substring(c, 1, 1 << 20).substr(F.lit(1), F.length(c) - F.length(after) - len(separator))
    return F.when(there, before).otherwise(c), F.when(there, after)


def cut_at_first(c: Column, patterns: list[str]) -> Column:
    """The text before the earliest match of any of the patterns."""
    return F.trim(F.get(F.split(c, "|".join(f"(?:{p})" for p in patterns), 2), F.lit(0)))


def quoted_number(c: Column) -> Column:
    """Whether a token is a number, quotes aside."""
    return F.regexp_replace(c, "^[\"']+|[\"']+$", "").rlike(r"^[0-9]+(?:[.,][0-9]+)?$")


def tally_label(n: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many))


def natural_key(c: Column) -> Column:
    """A key that sorts numbers within a text by their value: each run of digits without leading zeros, behind its length in four digits.

    Equal but for leading zeros are equal keys; null is null.
    """
    runs = F.regexp_extract_all(c, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def padded(x: Column) -> Column:
        bare = F.regexp_replace(x, "^0+(?=.)", "")
        return F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare).cast("string"), 4, "0"), bare)).otherwise(x)

    return F.when(c.isNotNull(), F.array_join(F.transform(runs, padded), ""))


#: Spark's root collation, with no regard to case and accents.
ALIKE = "UNICODE_CI_AI"


def alike(c: Column) -> Column:
    """The text as a key that is equal to others but for case and accents, in joins, groups and sorts; its letters stay.

    Sharp s equals ss. Wildcard patterns don't work on it: fold and LIKE do.
    """
    return F.collate(c, ALIKE)


def first_day_first(c: Column) -> Column:
    """The first day/month/year in a text as it stands there, whether there is such a day or not; empty if there is none."""
    return F.regexp_extract(c, r"(?<![0-9])([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9])", 1)


def padded_day_first(c: Column) -> Column:
    """d/m/yyyy as an ISO date text; null if there is no such day."""
    return F.try_to_date(c, "d/M/yyyy").cast("string")


def month_in_name(c: Column) -> Column:
    """The first year and month of a name like list_2024_03 as they stand there; empty if there is none."""
    return F.regexp_extract(c, r"(?<![0-9])((?:19|20)[0-9]{2}[-_](?:0[1-9]|1[0-2]))(?![0-9])", 1)
