"""Keyed merging with survivorship, prompts, ranked search, views of records, facets, cards, files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as _field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.functions import catalog as cat, packs


def merge(sources: list[tuple[str, DataFrame]], key: str, rules: dict[str, str], order: str) -> DataFrame:
    """Full outer merge of sources on ``key`` into one record for each id.

    Sources count in the order of the list, rows of one source by ``order``. Rules: ``first`` and
    ``last`` take the first or last value that is not missing (null, empty, zero); ``max`` the largest;
    ``union`` the distinct elements of arrays in order. ``sources`` lists the sources, once for each
    row. One grouping by key, whatever the number of sources; rows without a key are left out.
    """
    both = None
    for n, (name, df) in enumerate(sources):
        df = df.where(F.col(key).isNotNull()).withColumn("_source", F.lit(name)).withColumn("_ord", F.struct(F.lit(n).alias("n"), F.col(order).cast("long").alias("o")))
        both = df if both is None else both.unionByName(df, allowMissingColumns=True)
    kinds = dict(both.dtypes)
    aggs = [F.transform(F.array_sort(F.collect_list(F.struct("_ord", "_source"))), lambda x: x["_source"]).alias("sources")]
    for c, rule in rules.items():
        there = cat.falsy(F.col(c), kinds[c])
        at = F.when(there.isNotNull(), F.col("_ord"))
        if rule == "first":
            aggs.append(F.min_by(there, at).alias(c))
        elif rule == "last":
            aggs.append(F.max_by(there, at).alias(c))
        elif rule == "max":
            aggs.append(F.max(c).alias(c))
        elif rule == "union":
            lists = F.transform(F.array_sort(F.collect_list(F.struct("_ord", F.coalesce(F.col(c), F.array().cast(kinds[c])).alias("v")))), lambda x: x["v"])
            aggs.append(F.array_distinct(F.filter(F.flatten(lists), lambda v: v != "")).alias(c))
        else:
            raise ValueError(rule)
    return both.groupBy(key).agg(*aggs)


def merge_counts(merged: DataFrame, quality: str | None = None) -> DataFrame:
    """Records, those of several source rows, and those with a real prompt."""
    real = cat.real_prompt(F.col(quality)) if quality else F.lit(False)
    return merged.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.size("sources") > 1).alias("in_several"), F.count_if(real).alias("with_prompt"))


# ---- prompts


def best(prompts: Column, rank: dict[str, int]) -> Column:
    """The element with the best quality, the longest text on ties, the first then."""
    order = F.create_map(*(F.lit(x) for kv in rank.items() for x in kv))
    keyed = F.transform(prompts, lambda p, i: F.struct((-F.element_at(order, p["quality"])).alias("q"), (-F.length(p["text"])).alias("l"), i.alias("i"), p.alias("p")))
    return F.get(F.array_sort(keyed), 0)["p"]


PROMPT = "array<struct<source:string,quality:string,text:string,url:string>>"


def with_pages(records: DataFrame, pages: DataFrame, slug: str = "slug", source: str = "pages") -> DataFrame:
    """Records with the prompt of their page (``slug``, ``text``, ``url``) after their own ``prompts``; empty pages add none."""
    found = pages.where(F.length("text") > 0).groupBy("slug").agg(F.min(F.struct("text", "url")).alias("_p")).withColumnRenamed("slug", "_slug")
    own = F.coalesce(F.col("prompts").cast(PROMPT), F.array().cast(PROMPT))
    more = F.array(F.struct(F.lit(source).alias("source"), F.lit("full").alias("quality"), F.col("_p.text").alias("text"), F.col("_p.url").alias("url"))).cast(PROMPT)
    joined = records.join(found, F.nullif(F.col(slug), F.lit("")) == F.col("_slug"), "left")
    return joined.withColumn("prompts", F.when(F.col("_p").isNotNull(), F.concat(own, more)).otherwise(own)).drop("_slug", "_p")


def finished(records: DataFrame, reposting: str = "", rank: dict[str, int] = packs.QUALITY_RANK) -> DataFrame:
    """Records with their flagged and ranked ``prompts``, the best one in columns, the format and the share of saves.

    A prompt is the post's own text if one holds the other; a full one of the source ``reposting`` is then a brief one.
    """
    same = lambda p: cat.same_text(p["text"], F.col("post_text"))
    brief = lambda p: (p["source"] == reposting) & F.coalesce(same(p), F.lit(False)) & (p["quality"] == "full")
    flagged = F.transform("prompts", lambda p: F.struct(p["source"].alias("source"), F.when(brief(p), "brief").otherwise(p["quality"]).alias("quality"), p["text"].alias("text"), p["url"].alias("url"), same(p).alias("is_post_text")))
    order = F.create_map(*(F.lit(x) for kv in rank.items() for x in kv))
    ranked = F.transform(F.array_sort(F.transform("prompts", lambda p, i: F.struct((-F.element_at(order, p["quality"])).alias("q"), (-F.length(p["text"])).alias("l"), i.alias("i"), p.alias("p")))), lambda x: x["p"])
    out = records.withColumn("prompts", flagged).withColumn("prompts", ranked).withColumn("_b", F.get("prompts", 0))
    upright = F.when(F.coalesce(F.array_contains("tags", "vertical"), F.lit(False)), "9:16")
    out = out.withColumn("prompt", F.col("_b.text")).withColumn("prompt_quality", F.col("_b.quality")).withColumn("prompt_source", F.col("_b.source")).withColumn("prompt_is_post_text", F.col("_b.is_post_text"))
    return out.withColumn("aspect", F.coalesce(cat.aspect(F.col("width"), F.col("height")), upright)).withColumn("saves_per_view", cat.rate(F.col("bookmarks"), F.col("views"))).drop("_b")


def to_enrich(records: DataFrame, have: DataFrame, n: int, rank: dict[str, int] = packs.QUALITY_RANK) -> DataFrame:
    """The ``n`` most viewed records whose page holds a prompt that isn't here: a slug, less than a brief one, and no page at hand."""
    order = F.create_map(*(F.lit(x) for kv in rank.items() for x in kv))
    poor = F.coalesce(F.element_at(order, F.coalesce("prompt_quality", F.lit(""))), F.lit(0)) < rank["brief"]
    rows = records.where((F.length("slug") > 0) & F.coalesce(F.col("has_prompt"), F.lit(False)) & poor)
    return rows.join(have.select("slug").distinct(), "slug", "left_anti").orderBy(F.desc(F.coalesce("views", F.lit(0))), "id").limit(n)


# ---- search


@dataclass
class Wanted:
    """What a search keeps. Lists must all be met; the least views of a sort by saves a view are 5000 if none are given."""

    tags: list[str] = _field(default_factory=list)
    categories: list[str] = _field(default_factory=list)
    tech: list[str] = _field(default_factory=list)
    author: str | None = None
    aspect: str | None = None
    has_prompt: bool = False
    min_views: int = 0
    sort: str = "views"

    def test(self) -> Column:
        """All conditions as one column; the cheap ones stand first."""
        least = self.min_views or (packs.RATIO_FLOOR if self.sort == "saves-per-view" else 0)
        test = cat.seen(F.col("views"), least)
        if self.has_prompt:
            test = test & cat.real_prompt(F.col("prompt_quality"))
        if self.aspect:
            test = test & cat.in_format(F.col("aspect"), self.aspect)
        if self.author:
            test = test & cat.by_author(F.col("author"), self.author)
        for name in ("tags", "categories", "tech"):
            if getattr(self, name):
                test = test & cat.all_of(F.col(name), getattr(self, name))
        return test

    def key(self) -> Column:
        """What rows are sorted by, downwards; missing numbers are 0, missing times the empty text."""
        names = {"views": "views", "saves": "bookmarks", "saves-per-view": "saves_per_view", "recent": "posted"}
        return F.coalesce(F.col(names[self.sort]), F.lit("" if self.sort == "recent" else 0))


def described(records: DataFrame) -> Column:
    """What a record is about: titles, summary, author, tags, categories, tools."""
    there = [F.col(c) if not kind.startswith("array") else F.array_join(c, " ") for c, kind in records.dtypes if c in ("title", "title_zh", "summary", "author", "author_name", "tags", "categories", "tech")]
    return cat.haystack(there)


def deep(records: DataFrame) -> Column:
    """``described`` and the texts of the post and all prompts."""
    texts = [F.col("post_text")] if "post_text" in records.columns else []
    if "prompts" in records.columns:
        texts.append(F.array_join(F.transform("prompts", lambda p: F.coalesce(p["text"], F.lit(""))), " "))
    return F.concat_ws(" ", F.nullif(described(records), F.lit("")), F.nullif(cat.haystack(texts), F.lit("")))


def search(df: DataFrame, words: list[str], described: Column, deep: Column, sort: Column, order: str, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Rows that hold all words, ranked: adds ``tier`` and ``rank``.

    Tier 0: the phrase is in the description (or, with one word, the word); 1: the phrase is in the
    deep text (one word: the word); 2: all words are in the description; 3: all are somewhere. Within a tier larger
    ``sort`` first, missing as zero, then by ``order``. Cheap tests (``where``) go before patterns.
    """
    rows = df if where is None else df.where(where)
    patterns = [cat.word_pattern(w) for w in words if w.strip()]
    both = lambda text: [text.rlike(p) for p in patterns]
    d, e = F.lower(F.coalesce(described, F.lit(""))), F.lower(F.coalesce(deep, F.lit("")))
    rows = rows.withColumn("_d", d).withColumn("_e", e)
    for test in both(F.col("_e")):
        rows = rows.where(test)
    all_described = F.lit(True)
    for test in both(F.col("_d")):
        all_described = all_described & test
    if len(patterns) > 1:
        phrase = cat.word_pattern(" ".join(words))
        tier = F.when(F.col("_d").rlike(phrase), 0).when(F.col("_e").rlike(phrase), 1).when(all_described, 2).otherwise(3)
    else:
        tier = F.when(all_described, 0).otherwise(1)
    ranked = rows.withColumn("tier", tier).withColumn("_sort", F.coalesce(sort, F.lit("" if dict(rows.select(sort.alias("s")).dtypes)["s"] == "string" else 0))).orderBy("tier", F.desc("_sort"), order)
    ranked = ranked.limit(limit) if limit else ranked
    return ranked.drop("_d", "_e", "_sort")


def search_records(records: DataFrame, words: list[str], wanted: Wanted, order: str = "id", limit: int | None = None) -> DataFrame:
    """``search`` over finished records, with the filters and the sort of ``wanted``."""
    return search(records, words, described(records), deep(records), wanted.key(), order, wanted.test(), limit)


def listing(records: DataFrame, words: list[str], wanted: Wanted, top: int, order: str = "id") -> DataFrame:
    """The ranked list as shown: the first ``top`` rows with their place, whether a tier begins there, and the counts of all matches and of the tier."""
    found = search_records(records, words, wanted, order)
    tiers = found.groupBy("tier").agg(F.count(F.lit(1)).alias("in_tier"))
    sizes = tiers.select("tier", "in_tier", F.sum("in_tier").over(W.partitionBy(F.lit(1))).alias("matches"))  # four rows at most
    place = W.partitionBy(F.lit(1)).orderBy("tier", F.desc("_k"), order)
    shown = found.withColumn("_k", wanted.key()).orderBy("tier", F.desc("_k"), order).limit(top)  # only these rows are numbered
    shown = shown.withColumn("place", F.row_number().over(place)).withColumn("begins", F.coalesce(F.lag("tier").over(place) != F.col("tier"), F.lit(True)))
    return shown.join(F.broadcast(sizes), "tier").drop("_k")


def lookup(records: DataFrame, key: str) -> DataFrame:
    """The first record that a key names: an id, an address with one, a slug, or the end of an address."""
    key = key.strip()
    slug = key.rstrip("/").rsplit("/", 1)[-1]
    number = F.coalesce(cat.status_id(F.lit(key)), F.lit(key if key.isdigit() else None))
    test = (F.col("id").cast("string") == number) | (F.col("slug") == slug) | F.coalesce(F.rtrim(F.col("url"), F.lit("/")).endswith("/" + slug), F.lit(False))
    return records.where(F.coalesce(test, F.lit(False))).orderBy("id").limit(1)


def view(records: DataFrame, key: str = "id") -> DataFrame:
    """Each record as rows of field and value; fields that are missing or empty are left out."""
    def shown(name: str, kind: str) -> Column:
        c = F.col(name)
        return F.array_join(c, ", ") if kind == "array<string>" else F.to_json(c) if kind.startswith(("array", "struct", "map")) else c.cast("string")

    fields = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("field"), shown(c, kind).alias("value")) for i, (c, kind) in enumerate(records.dtypes) if c != key]
    rows = records.select(key, F.explode(F.array(*fields)).alias("f")).select(key, "f.*")
    return rows.where((F.col("value") != "") & (F.col("value") != "[]"))


def facet(df: DataFrame, values: Column, top: int = 40, none: str = "unknown") -> DataFrame:
    """The most frequent values of a scalar or exploded array column, missing ones under ``none``."""
    return df.select(F.coalesce(F.nullif(values.cast("string"), F.lit("")), F.lit(none)).alias("value")).groupBy("value").count().orderBy(F.desc("count"), "value").limit(top)


# ---- pages and files


def cards(pages: DataFrame, html: str = "html", unescape: Callable[[Column], Column] = cat.unescape) -> DataFrame:
    """Adds title, heading, number of links and distinct link targets of a page; missing fields are null."""
    h = F.coalesce(F.col(html), F.lit(""))
    links = F.regexp_extract_all(h, F.lit(r'<a href="([^"]*)"'), F.lit(1))
    raw = {"title": r"(?s)<title>(.*?)</title>", "heading": r"(?s)<h1>(.*?)</h1>"}
    # the fields are cut out first, so that no page goes to Python with its title
    out = pages.withColumns({name: F.regexp_extract(h, pattern, 1) for name, pattern in raw.items()} | {"links": F.size(links).cast("long"), "targets": F.size(F.array_distinct(links)).cast("long")})
    return out.withColumns({name: F.nullif(unescape(F.col(name)), F.lit("")) for name in raw})


def link_names(html: Column, prefix: str, without: list[str] = ()) -> Column:
    """The sorted distinct names that a page links to below ``prefix``, but those in ``without``."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf'href="\Q{prefix}\E([^/"]+)/?"'), F.lit(1))
    return F.array_except(F.array_sort(F.array_distinct(found)), F.array(*map(F.lit, without)).cast("array<string>"))


def keep_last_good(fresh: DataFrame | None, last: DataFrame) -> DataFrame:
    """The fresh rows of a source, or those of its last good load where it failed or came empty."""
    return last if fresh is None or fresh.isEmpty() else fresh


def cue_update(old: DataFrame, new: DataFrame, name: str, value: str) -> DataFrame:
    """New values win, others stay."""
    n = new.select(name, F.col(value).alias("_new"))
    return old.join(n, name, "full").select(name, F.coalesce("_new", value).alias(value))


SOUND = r"\.(wav|flac|ogg|mp3)$"


def tree(files: DataFrame, path: str = "path", extension: str = SOUND) -> DataFrame:
    """The files of a listing with a wanted extension, by path."""
    return files.where(F.lower(path).rlike(extension)).orderBy(path)


def matching_files(files: DataFrame, folder: str, words: str, path: str = "path") -> DataFrame:
    """Sound files whose path holds a folder and whose name holds all words as whole tokens, those marked as legacy last."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    rows = files.where(F.lower(path).rlike(SOUND) & F.contains(F.lower(path), F.lit(folder.lower())))
    for w in words.lower().split():
        rows = rows.where(name.rlike(rf"(?<![a-z0-9#])\Q{w}\E(?![a-z0-9#])"))
    return rows.orderBy(F.contains(F.lower(path), F.lit("legacy")), path)


def listed(index: DataFrame, files: DataFrame, on: str = "path") -> DataFrame:
    """Index rows whose file is there."""
    return index.join(files.select(on), on, "left_semi")


def paged(pages: list[DataFrame], key: str) -> DataFrame:
    """Rows of pages until one brings no key that was not seen, each key once."""
    out = None
    for page in pages:
        new = page if out is None else page.join(out.select(key), key, "left_anti")
        if out is not None and new.isEmpty():
            break
        out = new.dropDuplicates([key]) if out is None else out.unionByName(new.dropDuplicates([key]))
    return out
