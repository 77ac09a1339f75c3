"""String functions: width and script folding, the three normal forms, cutting, character classes."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF = "".join(chr(c) for c in range(0x21, 0x7F))
WORD_UNITS = r"[一-龥]|[0-9]+|[A-Za-z]+"


def half_width(c: Column) -> Column:
    """Full-width ASCII to ASCII; the ideographic space stays, and null becomes ''."""
    return F.translate(F.coalesce(c, F.lit("")), FULL, HALF)


def half_width_or_null(c: Column) -> Column:
    return F.translate(c, FULL, HALF)


@lru_cache(maxsize=1)
def script_map() -> tuple[str, str]:
    """Traditional characters and their simplified ones, character by character, from ICU."""
    icu = SparkSession.getActiveSession()._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    every = [chr(c) for c in range(0x4E00, 0x9FA6)]
    folded = icu.transliterate("\n".join(every)).split("\n")
    pairs = [(a, b) for a, b in zip(every, folded, strict=True) if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def simplified(c: Column, pairs: tuple[str, str] | None = None) -> Column:
    """Traditional to simplified Han, by the given map or ICU's."""
    return F.translate(c, *(pairs or script_map()))


def keep_form(c: Column, pairs: tuple[str, str] | None = None) -> Column:
    """Half width, simplified, lower case; punctuation stays."""
    return F.lower(simplified(half_width(c), pairs))


def space_form(c: Column, pairs: tuple[str, str] | None = None) -> Column:
    """The kept form with each character that is no letter, digit, hyphen, dot or space replaced by a space."""
    return F.regexp_replace(keep_form(c, pairs), r"[^\p{L}\p{Nd}\-.\s]", " ")


def strip_form(c: Column, pairs: tuple[str, str] | None = None) -> Column:
    """The kept form without anything but letters and digits."""
    return F.regexp_replace(keep_form(c, pairs), r"[^\p{L}\p{Nd}]", "")


def cut(c: Column, limit: int, words: bool = False) -> Column:
    """The trimmed text's first `limit` characters, or words: a Han character, a run of digits or of Latin letters is one, spacing is kept between them."""
    t = F.trim(c)
    if not words:
        return F.substring(t, 1, limit)
    if limit < 1:
        return F.when(c.isNotNull(), F.lit(""))
    return F.regexp_extract(t, rf"^(?:[^一-龥0-9A-Za-z]*(?:{WORD_UNITS})){{0,{limit}}}", 0)


def is_chinese(c: Column) -> Column:
    return c.rlike(r"^[一-龥]$")


def is_digit(c: Column) -> Column:
    return c.rlike(r"^\p{Nd}$")


def is_alphabet(c: Column) -> Column:
    return c.rlike(r"^[A-Za-zＡ-Ｚａ-ｚ]$")


def is_space(c: Column) -> Column:
    return c.rlike(r"^[\s　]$")
