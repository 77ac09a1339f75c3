"""Romanisation: readings, initials, and splitting romanised text into syllables."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The initials and finals that make up Mandarin syllables, and those written without an initial.
INITIALS = "b p m f d t n l g k h j q x zh ch sh r z c s".split()
FINALS = {
    "a": "b p m f d t n l g k h zh ch sh z c s", "o": "b p m f l", "e": "m d t n l g k h zh ch sh r z c s", "i": "b p m d t n l j q x zh ch sh r z c s", "u": "b p m f d t n l g k h j q x zh ch sh r z c s", "v": "n l",
    "ai": "b p m d t n l g k h zh ch sh z c s", "ei": "b p m f d t n l g k h zh sh z", "ui": "d t g k h zh ch sh r z c s", "ao": "b p m d t n l g k h zh ch sh r z c s", "ou": "p m f d t n l g k h zh ch sh r z c s", "iu": "m d n l j q x", "ie": "b p m d t n l j q x", "ue": "n l j q x", "ve": "n l",
    "an": "b p m f d t n l g k h zh ch sh r z c s", "en": "b p m f d n g k h zh ch sh r z c s", "in": "b p m n l j q x", "un": "d t n l g k h j q x zh ch sh r z c s", "ang": "b p m f d t n l g k h zh ch sh r z c s", "eng": "b p m f d t n l g k h zh ch sh r z c s", "ing": "b p m d t n l j q x", "ong": "d t n l g k h zh ch r z c s",
    "ia": "d l j q x", "iao": "b p m d t n l j q x", "ian": "b p m d t n l j q x", "iang": "n l j q x", "iong": "j q x", "ua": "g k h zh ch sh r", "uo": "d t n l g k h zh ch sh r z c s", "uai": "g k h zh ch sh", "uan": "d t n l g k h j q x zh ch sh r z c s", "uang": "g k h zh ch sh",
}
BARE = "a o e ai ei ao ou an en ang eng er yi ya yo ye yai yao you yan yin yang ying yong yu yue yuan yun wu wa wo wai wei wan wen wang weng".split()
LONGEST = 6


@lru_cache(maxsize=1)
def syllables() -> frozenset[str]:
    """All syllables, and each letter alone, so that any run of letters can be split."""
    made = {i + f for f, inits in FINALS.items() for i in inits.split() if i in INITIALS}
    return frozenset(made | set(BARE) | {chr(c) for c in range(97, 123)})


@lru_cache(maxsize=1)
def readings() -> dict[str, str]:
    """First reading without tone of each Han character in U+4E00..U+9FA5, ü as v, from ICU."""
    icu = SparkSession.getActiveSession()._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin")
    every = [chr(c) for c in range(0x4E00, 0x9FA6)]
    latin = icu.transliterate("\n".join(every)).split("\n")
    out = {}
    for han, r in zip(every, latin, strict=True):
        plain = unicodedata.normalize("NFD", unicodedata.normalize("NFC", r.strip()).replace("ü", "v").translate(str.maketrans("ǖǘǚǜ", "vvvv")))
        plain = re.sub("[^a-z]", "", plain)
        if plain and r != han:
            out[han] = plain
    return out


def _replaced(c: Column, table: dict[str, str]) -> Column:
    """The text with a-z kept, Han characters as in the table, and all else dropped."""
    chars = F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != "")
    # a literal, folded once when the plan is made; large ones as JSON, which keeps the expression small
    pairs = F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*map(F.lit, table.values()))) if len(table) < 2000 else F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), "map<string,string>")
    return F.array_join(F.transform(chars, lambda x: F.when(x.rlike("^[a-z]$"), x).otherwise(F.coalesce(F.try_element_at(pairs, x), F.lit("")))), "")


def full_pinyin(c: Column, table: dict[str, str] | None = None) -> Column:
    return _replaced(c, table or readings())


def initials(c: Column, table: dict[str, str] | None = None) -> Column:
    """The first letters; one translate after all other characters are removed."""
    t = table or readings()
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^a-z一-龥]", "")
    return F.regexp_replace(F.translate(kept, "".join(t), "".join(v[0] for v in t.values())), "[^a-z]", "")


def split_run(run: str, forward: bool) -> list[str]:
    """Greedy longest matches from one end; single letters always match."""
    known, out = syllables(), []
    while run:
        for n in range(min(LONGEST, len(run)), 0, -1):
            piece = run[:n] if forward else run[-n:]
            if n == 1 or piece in known:
                break
        out.append(piece)
        run = run[len(piece) :] if forward else run[: -len(piece)]
    return out if forward else out[::-1]


def split_syllables(text: str | None) -> list[str]:
    """Letter runs split into syllables, from the end with fewer pieces (the front on a tie); other runs stay whole."""
    out: list[str] = []
    for run in re.findall(r"[a-z]+|[^a-z]+", (text or "").lower()):
        if "a" <= run[0] <= "z":
            ahead, behind = split_run(run, True), split_run(run, False)
            out += behind if len(behind) < len(ahead) else ahead
        else:
            out.append(run)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def syllable_tokens(s: pd.Series) -> pd.Series:
    """Greedy splitting has no SQL form; apply it to distinct tokens."""
    return s.map(split_syllables)


def pinyin_of(text: str, table: dict[str, str]) -> str:
    """full_pinyin of a plain string, for query analysis on the driver."""
    return "".join(c if "a" <= c <= "z" else table.get(c, "") for c in text)


def pinyin_all(texts: Iterable[str], table: dict[str, str]) -> list[str]:
    return [p for p in (pinyin_of(t, table) for t in texts) if p]
