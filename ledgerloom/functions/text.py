"""Text expressions shared by the operators; everything stays in built-in functions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]+"

#: Spoken digits zero to ten.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


@cache
def _accent_table() -> tuple[str, str]:
    """Accented small Latin letters and their base letters, by canonical decomposition."""
    found = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xE0, 0x250), *range(0x1E00, 0x1F00)) if chr(c).islower()]
    found = [(a, b) for a, b in found if a != b and "a" <= b <= "z"]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


#: Arabic letter forms that are typed for one another, and the digits of both Arabic scripts.
ARABIC_FORMS = ("أإآٱىةؤئ", "اااايهوي")
ARABIC_DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def normalize_text(x: Column) -> Column:
    """Lower case, every character but letters, numbers and ``_`` to one space, trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def simple_normalize(x: Column) -> Column:
    """Lower case with white space folded; punctuation stays; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), SPACE, " "))


def clean_token(x: Column) -> Column:
    """Trimmed text; null and the word nan in any case give ''."""
    trimmed = F.regexp_replace(F.coalesce(x, F.lit("")), r"^[\s\x1c-\x1f\x{85}\p{Z}]+|[\s\x1c-\x1f\x{85}\p{Z}]+$", "")
    return F.when(F.lower(trimmed) == "nan", F.lit("")).otherwise(trimmed)


def fold(x: Column) -> Column:
    """Lower case without accents, marks, stretching or invisible characters; Arabic letter forms and digits made one."""
    bare = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[\p{Cf}\p{M}\x{0640}]", "")
    for table in (_accent_table(), ARABIC_FORMS, ARABIC_DIGITS):
        bare = F.translate(bare, *table)
    return bare


def words(x: Column) -> Column:
    """Letters and digits of a folded text as words; of a text in both scripts, the Latin words."""
    folded = fold(x)
    one_script = F.when(folded.rlike("[a-z]"), F.regexp_replace(folded, r"[\p{IsArabic}]+", " ")).otherwise(folded)
    return F.filter(F.split(F.regexp_replace(one_script, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def arabic_sound(x: Column) -> Column:
    """A Latin name in plain Arabic transliteration without the sounds that are left out in writing."""
    out = F.regexp_replace(x, "[^a-z]", "")
    for sound, letter in (("ch", "تش"), ("sh", "ش"), ("th", "ث"), ("kh", "خ"), ("gh", "غ"), ("ph", "ف")):
        out = F.replace(out, F.lit(sound), F.lit(letter))
    return F.translate(out, "abcdfghijklmnopqrstuvwxyze", "ابكدفجهيجكلمنوبقرستوفوكيز")


def number_word(word: Column) -> Column:
    """The digit form of a spoken number zero to ten, else the word."""
    table = F.create_map(*[F.lit(x) for i, w in enumerate(NUMBER_WORDS) for x in (w, str(i))])
    return F.coalesce(F.try_element_at(table, word), word)
