"""Column functions over catalogue fields: keys, buckets, human numbers, durations, page fields."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions import packs


def falsy(col: Column, kind: str = "string") -> Column:
    """Null for what counts as missing: the empty text, zero, the empty array."""
    if kind.startswith("array"):
        return F.when(F.size(col) > 0, col)
    return F.nullif(col, F.lit("" if kind == "string" else 0).cast(kind))


def norm_key(col: Column) -> Column:
    """Digits, a-z and letters up to U+FFFF beyond ASCII, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^0-9a-z\x{80}-\x{FFFF}]+", "")


def norm_text(col: Column) -> Column:
    """Lower case without links and without anything but word characters."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)https?://\S+", ""), r"(?U)\W+", ""))


def status_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"/status(?:es)?/(\d+)", 1), F.lit(""))


def aspect(width: Column, height: Column) -> Column:
    """The bucket of a width to height ratio; null without both."""
    r = width / F.nullif(height, F.lit(0))
    return F.when(F.coalesce(width, F.lit(0)) == 0, None).when(r >= 1.5, "16:9").when(r >= 1.15, "4:3").when(r > 0.87, "1:1").when(r >= 0.7, "4:5").when(r.isNotNull(), "9:16")


def rate(part: Column, whole: Column) -> Column:
    """A share to five places; null where the whole is missing or below one."""
    return F.when(whole >= 1, F.bround(part / F.nullif(whole, F.lit(0)), 5))


def human(n: Column) -> Column:
    """A number as 1.2M, 15k or 1.5k; a question mark for null."""
    short = lambda x, places, unit: F.concat(F.format_string(f"%.{places}f", F.bround(x, places)), F.lit(unit))
    return F.when(n.isNull(), "?").when(n >= 1_000_000, short(n / 1e6, 1, "M")).when(n >= 10_000, short(n / 1e3, 0, "k")).when(n >= 1000, short(n / 1e3, 1, "k")).otherwise(n.cast("long").cast("string"))


def first_line(col: Column, width: int) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.substring(flat, 1, width - 1), F.lit("…")))


def duration(col: Column) -> Column:
    """Seconds of m:ss or h:mm:ss; 0 for anything else."""
    parts = F.transform(F.split(col, ":"), lambda x: F.try_to_number(F.trim(x), F.lit("999999")).cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)
    return F.when(F.coalesce(col, F.lit("")).rlike(r"^\s*\d{1,6}(:\s*\d{1,6}\s*)*$"), total).otherwise(0.0)


def slug(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def unescape(col: Column) -> Column:
    """HTML entities replaced, as the standard library does it; only values with an ampersand go through Python."""

    @F.pandas_udf("string")
    def change(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else html.unescape(x))

    return F.coalesce(change(F.when(F.contains(col, F.lit("&")), col)), col)


def unescape_common(col: Column) -> Column:
    """The entities of ``packs.ENTITIES`` replaced, with their semicolons; the ampersand last, so that nothing is replaced twice."""
    for entity, char in packs.ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def field(page: Column, pattern: str) -> Column:
    """The first group of the first match, unescaped; null without a match."""
    return F.nullif(unescape(F.regexp_extract(page, pattern, 1)), F.lit(""))


def categories(name: Column) -> Column:
    """The common names of a category; an unknown one is its own, a missing one none."""
    known = F.create_map(*(x for k, v in packs.CATEGORY_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    there = F.nullif(name, F.lit(""))
    return F.when(there.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(F.element_at(known, there), F.array(there)))


def same_text(a: Column, b: Column) -> Column:
    """Whether one of two texts holds the other, links and everything but word characters aside; null where ``b`` has none."""
    x, y = norm_text(a), norm_text(b)
    return F.when(y != "", (x != "") & (F.contains(y, x) | F.contains(x, y)))


def haystack(shallow: list[Column], deep: list[Column] = ()) -> Column:
    """Lower-case text of all fields that are there; arrays count with their elements. ``deep`` fields go last."""
    return F.lower(F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in [*shallow, *deep])))


#: Spaces, hyphens and underscores count as one another; letters that begin words are Latin, Cyrillic or digits.
JOINTS, LETTERS = r"[\s\-_]", "0-9a-zÀ-ɏЀ-ӿ"


def word_pattern(word: str) -> str:
    """A pattern for a search word: Latin and Cyrillic at a word's start, other scripts anywhere; spaces, hyphens and underscores are one."""
    pieces = [x for x in re.split(JOINTS + "+", word.lower()) if x]
    quoted = (JOINTS + "*").join(re.sub(r"([^\w\s])", r"\\\1", x) for x in pieces)
    bounded = re.match(f"[{LETTERS}]", word.lower()) is not None
    return f"(?<![{LETTERS}]){quoted}" if bounded else quoted


def asset(uri: Column) -> Column:
    """The scheme, reference and ordinal of an asset: ``name:ref@n``, an address, or a path."""
    named = uri.rlike(r"^[a-z][a-z0-9-]+:(?!//)")
    whole = F.regexp_extract(uri, "^[a-z][a-z0-9-]+:(.*)$", 1)
    return F.struct(
        F.when(uri.rlike("^http"), "http").when(named, F.regexp_extract(uri, "^([a-z][a-z0-9-]+):", 1)).otherwise("path").alias("scheme"),
        F.when(uri.rlike("^http"), uri).when(named, F.regexp_replace(whole, "@[0-9]+$", "")).otherwise(uri).alias("ref"),
        F.when(named, F.coalesce(F.nullif(F.regexp_extract(uri, "@([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(1))).alias("nth"),
    )


def parsed(value: Column) -> Column:
    """An option with its kind and its value in a field of that type: true or false, none, whole numbers, numbers, else text."""
    low = F.lower(value)
    number = F.when(value.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(value).try_cast("double"))
    whole = F.when(value.rlike(r"^\s*[+-]?\d{1,18}\s*$"), F.trim(value).try_cast("long"))
    kind = F.when(low.isin("true", "false"), "bool").when(low == "none", "none").when(whole.isNotNull(), "int").when(number.isNotNull(), "float").otherwise("text")
    is_ = lambda k, v: F.when(kind == k, v)
    return F.struct(kind.alias("kind"), is_("bool", low == "true").alias("bool"), is_("int", whole).alias("int"), is_("float", number).alias("float"), is_("text", value).alias("text"))


# ---- predicates


def all_of(values: Column, wanted: list[str]) -> Column:
    """Whether an array holds all wanted values, compared by their keys."""
    keys = F.transform(values, norm_key)
    return F.forall(F.array(*(norm_key(F.lit(w)) for w in wanted)).cast("array<string>"), lambda w: F.coalesce(F.array_contains(keys, w), F.lit(False)))


def by_author(author: Column, name: str) -> Column:
    return norm_key(F.lit(name.lstrip("@"))) == norm_key(author)


def in_format(aspect_: Column, wanted: str) -> Column:
    """A format by its name, or any of an orientation's."""
    return F.coalesce(aspect_.isin(*packs.ORIENTATIONS.get(wanted.lower(), (wanted.lower(),))), F.lit(False))


def real_prompt(quality: Column) -> Column:
    return F.coalesce(quality.isin("full", "brief"), F.lit(False))


def seen(views: Column, least: int) -> Column:
    """At least so many views; a missing number is 0."""
    return F.coalesce(views, F.lit(0)) >= least


def grep(fields: list[Column], words: list[str], length: Column | None = None, longest: float | None = None) -> Column:
    """Whether all words are somewhere in the fields, and the length in seconds is at most ``longest``."""
    blob = F.lower(F.concat_ws(" ", *fields))
    test = F.lit(True)
    for w in words:
        test = test & F.contains(blob, F.lit(w.lower()))
    return test & (length <= longest) if longest else test


def fresh(fetched: Column, now: Column, days: int = packs.FRESH_DAYS) -> Column:
    """Whether a copy is younger than so many days."""
    return F.coalesce(now.cast("timestamp").cast("double") - fetched.cast("timestamp").cast("double") < days * 86_400, F.lit(False))
