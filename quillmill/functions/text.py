"""Column functions over prose: normal forms, words, sentences, numbers, positions.

All are built-in expressions and take text in Unicode normal form C; ``composed`` brings a DataFrame's
text there, and only rows that may need it go through Python.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.packs import EMOJI, NUMBER, WORD

LINE = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
#: Characters that a composed text doesn't hold or may hold only in some places: marks, jamo, compatibility and Greek singletons.
MAYBE_DECOMPOSED = r"(?U)[\p{M}\x{340}-\x{341}\x{374}\x{37E}\x{387}\x{1100}-\x{11FF}\x{1F71}-\x{1FFD}\x{2000}-\x{2001}\x{2126}\x{212A}-\x{212B}\x{2329}-\x{232A}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]"
#: Characters that a compatibility form may change: everything beyond Latin-1 letters, Cyrillic and common punctuation.
MAYBE_COMPATIBLE = r"[^\x{0}-\x{9F}\x{A1}\x{A7}\x{AB}\x{B0}\x{B6}\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{400}-\x{4FF}\x{2010}\x{2013}-\x{2016}\x{2018}-\x{2022}\x{20AC}]"


def normal(col: Column, form: str = "NFC") -> Column:
    """A Unicode normal form; null stays null."""

    @F.pandas_udf("string")
    def change(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return change(col)


def composed(df: DataFrame, text: str = "text", form: str = "NFC") -> DataFrame:
    """``df`` with its text in a normal form. Rows that hold no character the form could change stay in the JVM."""
    suspect = F.coalesce(F.col(text).rlike(MAYBE_DECOMPOSED if form == "NFC" else MAYBE_COMPATIBLE), F.lit(False))
    return df.where(~suspect).unionByName(df.where(suspect).withColumn(text, normal(F.col(text), form)))


def norm(col: Column) -> Column:
    """Lower case, with the letter io as ie."""
    return F.translate(F.lower(col), "ё", "е")


def joined(normed: Column) -> Column:
    """A normal form with the spaces inside grouped thousands taken out."""
    return F.when(normed.rlike(r"(?U)\d[ \x{A0}]\d"), F.regexp_replace(normed, r"(?U)(?<=\d)[ \x{A0}](?=\d{3}\b)", "")).otherwise(normed)


def words(col: Column) -> Column:
    """Runs of Cyrillic, Latin a-z and digits, with inner hyphens, points and commas; grouped thousands are one word."""
    return F.regexp_extract_all(joined(norm(col)), F.lit(WORD), F.lit(0))


def word_count(col: Column) -> Column:
    return F.size(words(col))


def latin_count(col: Column) -> Column:
    """The number of words that are four or more Latin letters and nothing else."""
    return F.regexp_count(joined(norm(col)), F.lit(r"(?<![а-яa-z0-9])(?<![а-яa-z0-9][-.,])[a-z]{4,}(?![а-яa-z0-9])(?![-.,][а-яa-z0-9])"))


def lines(col: Column) -> Column:
    return F.split(col, LINE)


def parts(col: Column) -> Column:
    """Pieces of each line, bullets and list numbers taken off, cut where a sentence ends; pieces without a word are still there."""
    bare = F.transform(lines(F.trim(col)), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), r"(?U)^\s*(?:[•\-*]|\d+[.)])\s*", ""))
    return F.flatten(F.transform(bare, lambda x: F.split(x, r"(?U)(?<=[.!?…])\s+(?=[«\"A-ZА-ЯЁ0-9])")))


def sentences(col: Column) -> Column:
    """Sentences of each line; those without a word are left out."""
    return F.filter(parts(col), lambda s: word_count(s) > 0)


def sentence_sizes(col: Column) -> Column:
    """The number of words of each sentence; each piece is read once."""
    return F.filter(F.transform(parts(col), word_count), lambda n: n > 0)


def paragraphs(col: Column) -> Column:
    """The number of blocks between blank lines that hold more than white space."""
    return F.size(F.filter(F.split(F.trim(col), r"(?U)\n\s*\n"), lambda p: F.regexp_replace(p, r"(?U)\s+", "") != ""))


def variants(number: Column) -> Column:
    """The forms in which a number may be written: without group spaces, with a point for a comma, without separators."""
    clean = F.regexp_replace(F.regexp_replace(number, r"[ \x{A0}]", ""), r"[.,]+$", "")
    return F.array(clean, F.replace(clean, F.lit(","), F.lit(".")), F.regexp_replace(clean, "[.,]", ""))


def numbers(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(NUMBER), F.lit(0))


def number_variants(col: Column) -> Column:
    """All forms of all numbers of a text, each once."""
    return F.array_distinct(F.flatten(F.transform(numbers(col), variants)))


def running(lengths: Column, block: int = 256) -> Column:
    """The sum of the elements before each element of an array of integers, in blocks, so that long arrays aren't copied at every step."""
    none = F.array().cast("array<int>")

    def sums(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), none.alias("out"))
        return F.aggregate(part, first, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(lengths), F.lit(1)) - 1) / block).cast("int")), lambda b: F.slice(lengths, b * block + 1, F.lit(block)))
    starts = sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n)), F.lit(0))
    return F.flatten(F.zip_with(blocks, starts, sums))


def positions(col: Column, pattern: str | Column, first: int | None = None) -> Column:
    """``array<struct<pos, hit>>``: each match, or the ``first`` ones, and the code points before it."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    hits = F.regexp_extract_all(col, pattern, F.lit(0))
    hits = hits if first is None else F.slice(hits, 1, first)
    gaps = F.slice(F.split(col, pattern, -1), F.lit(1), F.size(hits))
    before = running(F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h)))
    place = F.zip_with(F.zip_with(before, gaps, lambda n, g: n + F.length(g)), hits, lambda n, h: F.struct(n.alias("pos"), h.alias("hit")))
    return F.when(F.size(hits) > 0, place).otherwise(F.array().cast("array<struct<pos:int,hit:string>>"))


def line_of(col: Column, pos: Column) -> Column:
    """The line of a position, the first being 1."""
    return F.regexp_count(F.substring(col, F.lit(1), pos), F.lit("\n")) + 1


def context(col: Column, pos: Column, width: int = 60) -> Column:
    """The text around a position on one line, with dots where it is cut."""
    half, n = width // 2, F.length(col)
    start, end = F.greatest(F.lit(0), pos - half), F.least(n, pos + half)
    cut = F.replace(F.substring(col, start + 1, end - start), F.lit("\n"), F.lit(" "))
    return F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(end < n, "…").otherwise(""))


def flat(col: Column) -> Column:
    """Letter case, io and hard spaces aside."""
    return F.translate(F.lower(col), "ё\u00a0", "е ")


def holds(col: Column, phrase: str) -> Column:
    """Whether a text holds a phrase, letter case, io and hard spaces aside."""
    return F.contains(flat(col), flat(F.lit(phrase)))


__all__ = ["EMOJI", "NUMBER", "WORD", "composed", "context", "flat", "holds", "joined", "latin_count", "line_of", "lines", "norm", "normal", "number_variants", "numbers", "paragraphs", "parts", "positions", "running", "sentence_sizes", "sentences", "variants", "word_count", "words"]
