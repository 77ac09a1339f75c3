"""Analyzers: text columns to arrays of tokens. Positions are places in the array; dropped tokens leave no gap."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import pinyin, text

SINGLE = r"\p{IsHan}|[\p{L}\p{Nd}&&[^\p{IsHan}]]+"
PROTECTED = r"[a-zA-z]"  # the range runs over [ \ ] ^ _ and the backtick as well, and tokens that hold them go too


def non_empty(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != "")


def whole_keep(c: Column) -> Column:
    return F.array(text.keep_form(c))


def whole_strip(c: Column) -> Column:
    return F.array(text.strip_form(c))


def ngrams(c: Column, least: int = 1, most: int = 3) -> Column:
    """N-grams of the stripped text by start and then size, without those that hold Latin letters; the whole text is kept under the same rule where it is longer."""
    s = text.strip_form(c)
    n = F.length(s)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    grams = F.flatten(F.transform(starts, lambda i: F.filter(F.transform(F.sequence(F.lit(least), F.lit(most)), lambda k: F.when(i + k - 1 <= n, F.substr(s, i, k))), lambda g: g.isNotNull())))
    whole = F.when(n > most, F.array(s)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.concat(grams, whole), lambda g: ~g.rlike(PROTECTED))


def delimited(c: Column, delimiter: str = ";", normalize: bool = True) -> Column:
    parts = F.split(F.coalesce(c, F.lit("")), re.escape(delimiter))
    return non_empty(F.transform(parts, lambda t: text.strip_form(t)) if normalize else parts)


def single(c: Column) -> Column:
    """Han characters one by one, other words whole, in stripped form."""
    return non_empty(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(SINGLE), 0), lambda t: text.strip_form(t)))


def words(c: Column) -> Column:
    """`single` for text without full-width or traditional characters: one regular expression over the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(SINGLE), 0)


def single_pinyin(c: Column, table: dict[str, str] | None = None) -> Column:
    return non_empty(F.transform(single(c), lambda t: pinyin.full_pinyin(t, table)))


def characters(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != "")


def full_pinyin_token(c: Column, table: dict[str, str] | None = None) -> Column:
    return F.array(pinyin.full_pinyin(c, table))


def initials_token(c: Column, table: dict[str, str] | None = None) -> Column:
    return F.array(pinyin.initials(c, table))


class Segmenter:
    """Longest matches over a dictionary; Latin words and digit runs stay whole, other Han characters stand alone.

    smart=False adds the dictionary words inside each match, after it. Any function from text to tokens can take its place.
    """

    def __init__(self, dictionary: Iterable[str] = ()):
        self.words = frozenset(dictionary)
        self.longest = max(map(len, self.words), default=1)

    def cut(self, s: str | None, smart: bool = True) -> list[str]:
        out: list[str] = []
        for run in re.findall(r"[一-龥]+|(?:(?![一-龥])[^\W_])+", s or ""):
            if not "一" <= run[0] <= "龥":
                out.append(run)
                continue
            i = 0
            while i < len(run):
                n = next((k for k in range(min(self.longest, len(run) - i), 1, -1) if run[i : i + k] in self.words), 1)
                out.append(run[i : i + n])
                if not smart:
                    out += [run[a:b] for a in range(i, i + n) for b in range(a + 2, i + n + 1) if b - a < n and run[a:b] in self.words]
                i += n
        return out

    def column(self, c: Column, smart: bool = True) -> Column:
        cut = self.cut

        @F.pandas_udf("array<string>")
        def segment(s: pd.Series) -> pd.Series:
            return s.map(lambda t: cut(t, smart))

        return segment(c)


def segment(c: Column, segmenter: Segmenter, smart: bool = False) -> Column:
    """Segments in spaced form, empties dropped."""
    return non_empty(F.transform(segmenter.column(c, smart), lambda t: F.trim(text.space_form(t))))


def with_pinyin(tokens: Column, table: dict[str, str] | None = None) -> Column:
    """Each token; its reading; if longer than one, each character and its reading. A token that begins with a-z stands alone; empty readings are skipped."""

    def parts(t: Column) -> Column:
        chars = F.flatten(F.transform(characters(t), lambda ch: F.array(ch, pinyin.full_pinyin(ch, table))))
        more = F.when(F.length(t) > 1, chars).otherwise(F.array().cast("array<string>"))
        return F.when(t.rlike("^[a-z]"), F.array(t)).otherwise(F.concat(F.array(t, pinyin.full_pinyin(t, table)), more))

    return non_empty(F.flatten(F.transform(tokens, parts)))


def then_pinyin(tokens: Column, table: dict[str, str] | None = None) -> Column:
    """Each token and its reading, up to the first token without a reading."""
    pairs = F.transform(tokens, lambda t: F.struct(t.alias("t"), pinyin.full_pinyin(t, table).alias("p")))
    stop = F.array_position(F.transform(pairs, lambda x: x.p == ""), True)
    kept = F.when(stop > 0, F.slice(pairs, F.lit(1), (stop - 1).cast("int"))).otherwise(pairs)
    return F.flatten(F.transform(kept, lambda x: F.array(x.t, x.p)))


def only_pinyin(tokens: Column, table: dict[str, str] | None = None) -> Column:
    """The reading of each token, and of each of its characters if there are several and it does not begin with a-z."""

    def parts(t: Column) -> Column:
        each = F.transform(characters(t), lambda ch: pinyin.full_pinyin(ch, table))
        return F.concat(F.array(pinyin.full_pinyin(t, table)), F.when((F.length(t) > 1) & ~t.rlike("^[a-z]"), each).otherwise(F.array().cast("array<string>")))

    return non_empty(F.flatten(F.transform(tokens, parts)))


#: Analyzers by name; each takes a column, the field's definition and the index's.
ANALYZERS: dict[str, Callable] = {}


def register(name: str, make: Callable) -> None:
    """Adds an analyzer: make(column, field, index) to an array column."""
    ANALYZERS[name] = make


#: Segmenters by name; the unnamed one has no dictionary.
SEGMENTERS: dict[str, Segmenter] = {"": Segmenter()}


def add_segmenter(name: str, dictionary: Iterable[str] | str) -> Segmenter:
    """Adds a segmenter for indexes to name: from words, or from a file of one word a line (more columns are passed over)."""
    if isinstance(dictionary, str):
        with open(dictionary, encoding="utf-8") as lines:
            dictionary = [line.split()[0] for line in lines if line.strip() and not line.startswith("#")]
    SEGMENTERS[name] = Segmenter(dictionary)
    return SEGMENTERS[name]


def segmenter_of(index) -> Segmenter:
    return SEGMENTERS[index.segmenter if index is not None else ""]


register("segment", lambda c, f, i: segment(c, segmenter_of(i)))
register("segment_pinyin", lambda c, f, i: with_pinyin(segment(c, segmenter_of(i))))
register("ngram", lambda c, f, i: ngrams(c))
register("initials", lambda c, f, i: initials_token(c))
register("full_pinyin", lambda c, f, i: full_pinyin_token(c))
register("delimited", lambda c, f, i: delimited(c, f.delimiter or ";", f.normalize))
register("keep", lambda c, f, i: whole_keep(c))
register("strip", lambda c, f, i: whole_strip(c))
register("single", lambda c, f, i: single(c))
register("words", lambda c, f, i: words(c))
register("single_pinyin", lambda c, f, i: single_pinyin(c))


def rendered(tokens: Column, source: Column) -> Column:
    """term:start/end==>1 for each token, offsets being those of the next occurrence in the source (0/length if it is not there verbatim)."""
    at = F.aggregate(
        tokens,
        F.struct(F.lit(0).alias("from"), F.array().cast("array<string>").alias("out")),
        lambda acc, t: F.struct(
            F.when(_locate_from(t, source, acc["from"]) > 0, _locate_from(t, source, acc["from"]) - 1 + F.length(t)).otherwise(acc["from"]).alias("from"),
            F.concat(acc["out"], F.array(F.concat(t, F.lit(":"), F.greatest(_locate_from(t, source, acc["from"]) - 1, F.lit(0)).cast("string"), F.lit("/"), (F.greatest(_locate_from(t, source, acc["from"]) - 1, F.lit(0)) + F.length(t)).cast("string"), F.lit("==>1")))).alias("out"),
        ),
    )
    return at["out"]


def _locate_from(t: Column, source: Column, start: Column) -> Column:
    """1-based place of t in source behind `start` characters; 0 if none."""
    inside = F.instr(F.substr(source, start + 1), t)
    return F.when(inside > 0, inside + start).otherwise(F.lit(0))


PLAIN_SINGLE = regex.compile(r"(?V1)\p{Script=Han}|[[\p{L}\p{Nd}]--\p{Script=Han}]+")


def plain_single(s: str) -> list[str]:
    """`single` of a plain string that is already in kept form, for query analysis on the driver; SINGLE in this library's syntax."""
    return PLAIN_SINGLE.findall(s.lower())
