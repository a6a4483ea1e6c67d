"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def fold_ligatures(s: Column) -> Column:
    for a, b in LIGATURES.items():
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def has_letter(s: Column) -> Column:
    return s.rlike(r"\p{L}")


def has_indic(s: Column) -> Column:
    return s.rlike("[ऀ-෿]")


def has_latin(s: Column) -> Column:
    return s.rlike(r"\p{IsLatin}")


def has_bad_halant(s: Column) -> Column:
    """A vowel sign right after a halant, which no Devanagari text has."""
    return s.rlike("्[ा-ौ]")


def is_spaceless(s: Column) -> Column:
    return s.rlike(r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")


def is_blank(s: Column) -> Column:
    return ~s.rlike(r"[^\s\u0085   -     　]")


def is_all_digits(s: Column) -> Column:
    return s.rlike(r"^\p{Nd}+$")


def is_dot_leader(s: Column) -> Column:
    return s.rlike(r"^\.{4,}$")


def strip_leaders(s: Column) -> Column:
    """Text without the dots of a leader that letters are fused with; decimal points between digits stay."""
    return F.when(s.rlike(r"\p{L}\.{3,}\p{L}"), F.regexp_replace(s, r"(?<![0-9])\.|\.(?![0-9])", "")).otherwise(s)


def is_furniture(s: Column) -> Column:
    """A token of a page number: four digits or their punctuation at most."""
    return s.rlike(r"^[\p{Nd}.\-/()\[\]–—]{1,4}$")


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


_ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def roman(n: Column) -> Column:
    """Upper-case Roman numeral of a positive number."""
    rest, out = n, []
    for value, sign in _ROMAN:
        out.append(F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.concat(*out)


def letters(n: Column) -> Column:
    """A to Z, then AA to ZZ, and so on: one letter repeated."""
    return F.repeat(F.char(65 + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int"))


def page_label(style: Column, prefix: Column, n: Column) -> Column:
    """A page's label from its range's style (D, R, r, A, a or none), prefix and running number."""
    num = F.when(style == "D", n.cast("string")).when(style == "R", roman(n)).when(style == "r", F.lower(roman(n))).when(style == "A", letters(n)).when(style == "a", F.lower(letters(n))).otherwise("")
    return F.concat(F.coalesce(prefix, F.lit("")), num)


_DATE = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:(Z)|([+\-])(\d{2})'?(?:(\d{2})'?)?)?"


def pdf_date(s: Column) -> Column:
    """The instant that a date string D:YYYYMMDDHHmmSSOHH'mm' names: what is left out is the least, without an offset UTC; null if malformed."""
    part = lambda i, least: F.coalesce(F.nullif(F.regexp_extract(s, _DATE, i), F.lit("")).cast("int"), F.lit(least))
    local = F.try_make_timestamp(years=part(1, 0), months=part(2, 1), days=part(3, 1), hours=part(4, 0), mins=part(5, 0), secs=part(6, 0).cast("decimal(16,6)"), timezone=F.lit("UTC"))
    sign = F.when(F.regexp_extract(s, _DATE, 8) == "-", -1).otherwise(1)
    offset = sign * (part(9, 0) * 60 + part(10, 0))
    return F.when(s.rlike(_DATE), F.timestamp_add("MINUTE", -offset, local))
