"""Column expressions used across operators."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-case Latin letters that are a letter and marks, and those letters.
_MARKED = [chr(c) for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in block if chr(c).islower() and unicodedata.normalize("NFD", chr(c))[0] != chr(c)]
_ACCENTED, _PLAIN = "".join(_MARKED), "".join(unicodedata.normalize("NFD", ch)[0] for ch in _MARKED)
# Age bands; recency bands in days.
AGE_BANDS = [(18, "<18"), (25, "18-24"), (35, "25-34"), (45, "35-44"), (55, "45-54"), (65, "55-64")]
RECENCY_BANDS = [(30, "hasta_30_dias"), (90, "31_a_90_dias"), (180, "91_a_180_dias")]


def fold(text: Column) -> Column:
    """Lower case without accents, whether they are part of the letter or marks behind it, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), r"\p{M}+", ""))


def completed_years(born: Column, at: Column) -> Column:
    """Completed years at a date; a birthday on 29 February is reached on 1 March of common years."""
    before = F.date_format(at, "MMdd") < F.date_format(born, "MMdd")
    return F.year(at) - F.year(born) - F.when(before, 1).otherwise(0)


def age_band(age: Column) -> Column:
    band = F.when(age < AGE_BANDS[0][0], AGE_BANDS[0][1])
    for below, name in AGE_BANDS[1:]:
        band = band.when(age < below, name)
    return band.when(age.isNotNull(), "65+")


def whole_days(later: Column, earlier: Column) -> Column:
    """Floor of the elapsed 24-hour spans between two times without zone."""
    return F.floor(F.timestamp_diff("SECOND", earlier, later) / 86400)


def recency_band(days: Column) -> Column:
    band = F.when(days.isNull(), "nunca")
    for most, name in RECENCY_BANDS:
        band = band.when(days <= most, name)
    return band.otherwise("mas_de_180_dias")


def phone_key(raw: Column, country: str = "598") -> Column:
    """International form of a phone, + and 8 to 15 digits, or null: 00 stands for +; without either, a number that doesn't
    begin with the country's code gets it in place of its leading zeros."""
    marked = F.regexp_replace(F.trim(raw), "^00", "+")
    digits = F.regexp_replace(marked, "[^0-9]", "")
    coded = digits.startswith(country) & (F.length(digits) > len(country))
    whole = F.when(marked.startswith("+") | coded, digits).otherwise(F.concat(F.lit(country), F.ltrim(digits, F.lit("0"))))
    return F.when((F.length(digits) > 0) & F.length(whole).between(8, 15), F.concat(F.lit("+"), whole))


def call_band(calls: Column) -> Column:
    return F.when(calls >= 5, "5_o_mas").otherwise(calls.cast("string"))


def lacks_letters_and_digits(text: Column) -> Column:
    """A value that isn't blank but has neither letter nor digit."""
    return (F.trim(text) != "") & ~text.rlike("[0-9A-Za-zÀ-ÖØ-öø-ÿ]")


def lacks_letters(text: Column) -> Column:
    """A value that isn't blank but has no letter, as no name may."""
    return (F.trim(text) != "") & ~text.rlike("[A-Za-zÀ-ÖØ-öø-ÿ]")


def check_digit_valid(number: Column) -> Column:
    """Whether the last digit of an eight-digit national number is the check digit of the other seven (weights 2987634)."""
    digits = F.lpad(F.regexp_replace(number, "[^0-9]", ""), 8, "0")
    total = sum((F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate([2, 9, 8, 7, 6, 3, 4])), F.lit(0))
    return F.substring(digits, 8, 1).cast("int") == F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double arithmetic; null for vectors of different or no length."""
    return F.when(F.size(a) == F.size(b), 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """Rounded part / whole, null for a whole of 0."""
    return F.round(part / F.nullif(whole, F.lit(0)), digits)
