"""Rule-based linting of prose: findings by category, a weighted score, reports, and graded expectations.

Every document is linted by itself, so all of this is projections, without a shuffle. Null texts count
as empty; an empty text has no words and the full score. Texts are brought to normal form C first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import packs, text as tx

_HITS = "array<struct<pos:int,hit:string,note:string>>"


def java(pattern: str) -> str:
    """A pattern with Unicode classes and line anchors that know the line feed alone."""
    return "(?Udm)" + pattern


def pattern_table(spark: SparkSession, which: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The packs as data: category, pattern_id, regex."""
    rows = [(c, i, p) for c, patterns in (packs.PACKS if which is None else which).items() for i, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "category string, pattern_id int, regex string")


def packs_of(patterns: DataFrame) -> dict[str, tuple[str, ...]]:
    """Packs from a table of patterns (category, pattern_id, regex), which is small by nature."""
    out: dict[str, list[str]] = {}
    for r in patterns.orderBy("category", "pattern_id").collect():
        out.setdefault(r["category"], []).append(r["regex"])
    return {c: tuple(p) for c, p in out.items()}


def penalty_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(packs.PENALTY.items()), "category string, points int")


def _raw(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def structure(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the structural counts: words, sentences, paragraphs, dashes, bold, emoji, headers, brackets, Latin words."""
    raw, names = _raw(text), df.columns
    if "norm__" not in names:
        df = df.withColumn("norm__", tx.norm(raw))
    n = F.col("norm__")
    df = df.withColumn("words__", F.size(F.regexp_extract_all(tx.joined(n), F.lit(packs.WORD), F.lit(0)))).withColumn("sizes__", tx.sentence_sizes(raw))
    return df.select(
        *names,
        F.col("words__").cast("long").alias("words"),
        F.size("sizes__").cast("long").alias("sentences"),
        F.coalesce(F.array_max("sizes__"), F.lit(0)).cast("long").alias("longest_sentence"),
        F.bround(F.col("words__") / F.greatest(F.size("sizes__"), F.lit(1)), 1).alias("avg_sentence_words"),
        F.size(F.filter("sizes__", lambda k: k > packs.LONG_SENTENCE)).cast("long").alias("long_sentences"),
        tx.paragraphs(raw).cast("long").alias("paragraphs"),
        F.regexp_count(raw, F.lit(r"(?U)\s[—–]\s")).cast("long").alias("dashes"),
        F.regexp_count(raw, F.lit(r"\*\*[^*]+\*\*")).cast("long").alias("bolds"),
        F.regexp_count(raw, F.lit(packs.EMOJI)).cast("long").alias("emojis"),
        F.regexp_count(raw, F.lit(r"(?Udm)^#{1,6}\s")).cast("long").alias("headers"),
        (F.length(raw) - F.length(F.replace(raw, F.lit("("), F.lit("")))).cast("long").alias("parens"),
        # a plain search goes before the two patterns that most texts can't match
        F.when(F.contains(n, F.lit(" и ")), F.regexp_count(n, F.lit("(?U)" + packs.TRIAD))).otherwise(0).cast("long").alias("triads"),
        F.when(F.contains(n, F.lit("не только")), F.regexp_count(n, F.lit(packs.NOT_ONLY))).otherwise(0).cast("long").alias("not_only"),
        F.regexp_count(tx.joined(n), F.lit(r"(?<![а-яa-z0-9])(?<![а-яa-z0-9][-.,])[a-z]{4,}(?![а-яa-z0-9])(?![-.,][а-яa-z0-9])")).cast("long").alias("latin_words"),
    )


def _rules() -> dict[str, tuple[Column, Column, str]]:
    """The structural rules that make one finding at most: the test, what is shown, and the note."""
    nw = F.greatest(F.col("words"), F.lit(1))
    shown = lambda template, *c: F.format_string(template, *c)
    return {
        "dash_excess": (F.col("dashes") * 100 / nw > packs.DASH_RATE, shown("%d тире на %d слов (%.1f/100)", F.col("dashes"), nw, F.col("dashes") * 100.0 / nw), "норма ≤ 4 на 100 слов"),
        "triad_excess": (F.col("triads") > F.greatest(F.lit(2), F.floor(nw / packs.TRIAD_WORDS)), shown("%d тройки «X, Y и Z»", F.col("triads")), "правило трёх — след нейросети, если везде"),
        "bold_excess": ((F.col("bolds") > packs.MOST_BOLD) & (nw < packs.BOLD_UNDER), shown("%d жирных выделений на %d слов", F.col("bolds"), nw), ""),
        "emoji_excess": (F.col("emojis") > packs.MOST_EMOJI, shown("%d эмодзи", F.col("emojis")), ""),
        "header_in_short": ((F.col("headers") > 0) & (nw < packs.HEADER_UNDER), shown("%d markdown-заголовков в тексте на %d слов", F.col("headers"), nw), "короткому сообщению заголовки не нужны"),
        "paren_excess": (F.col("parens") > F.greatest(F.lit(2), F.floor(nw / packs.PAREN_WORDS)), shown("%d скобок на %d слов", F.col("parens"), nw), "скобки = «это неважно». Убрать или вытащить"),
        "not_only": (F.col("not_only") > 1, shown("%d× «не только…, но и»", F.col("not_only")), ""),
        "english_prose": (F.col("latin_words") > nw * packs.LATIN_SHARE, shown("%d/%d латинских слов", F.col("latin_words"), nw), "английская проза в русском тексте?"),
    }


def structural_findings() -> dict[str, Column]:
    """How many findings each structural rule makes from the counts of ``structure``: one at most but for long sentences."""
    return {"long_sentence": F.col("long_sentences")} | {name: F.when(test, 1).otherwise(0) for name, (test, _, _) in _rules().items()}


def _unusual(found: Column) -> Column:
    """Participles that are no common adjective by their stem."""
    common = F.array(*(F.lit(w) for w in packs.COMMON_ADJECTIVES if len(w) > 4))

    def usual(w: Column) -> Column:
        stem = F.regexp_replace(w, packs.PARTICIPLE_END, "")
        return F.exists(common, lambda a: F.startswith(a, stem) | F.startswith(stem, F.substring(a, F.lit(1), F.length(a) - 2)))

    return F.filter(found, lambda x: ~usual(x["hit"]))


def lexical_findings(text: str = "text", which: dict[str, tuple[str, ...]] | None = None, normed: Column | None = None) -> dict[str, Column]:
    """Hits of each pack, overlaps counted, and of the passive and participle rules.

    Texts without a letter that all patterns of the packs need cost one look for it. A test of one
    alternation for each pack goes next, so texts without any hit cost one pass a pack.
    """
    n = tx.norm(_raw(text)) if normed is None else normed
    out = {}
    for name, patterns in (packs.PACKS if which is None else which).items():
        every = reduce(lambda a, b: a + b, (F.regexp_count(n, F.lit(java(p))) for p in patterns))
        there = n.rlike(java("|".join(f"(?:{p})" for p in patterns)))
        out[name] = F.when(n.rlike("[а-я]") & there if which is None else there, every).otherwise(0)
    out["passive"] = F.when(F.contains(n, F.lit("был")), F.regexp_count(n, F.lit(java(packs.PASSIVE)))).otherwise(0)
    found = F.transform(F.regexp_extract_all(n, F.lit(java(packs.PARTICIPLE)), F.lit(0)), lambda w: F.struct(w.alias("hit")))
    out["participle"] = F.when(n.rlike("[а-я]"), F.size(_unusual(found))).otherwise(0)
    return out


def _place(sentence: Column, normed: Column) -> Column:
    """Where the first forty characters of a sentence are met first, from 0; -1 if nowhere."""
    return F.position(F.substring(tx.norm(sentence), F.lit(1), F.lit(40)), normed) - 1


def transition_hits(raw: Column, normed: Column) -> Column:
    """Openers at line starts, and at sentence starts where the line has not had the same one.

    Only sentences that begin with an opener are looked up in the text.
    """
    pattern = java(packs.TRANSITION)
    row = lambda pos, hit: F.struct(pos.alias("pos"), hit.alias("hit"), tx.line_of(raw, pos).cast("int").alias("line"))
    at_lines = F.transform(tx.positions(normed, pattern), lambda x: row(x["pos"], x["hit"]))
    opened = F.filter(tx.sentences(raw), lambda s: tx.norm(s).rlike(pattern))
    inside = F.filter(F.transform(opened, lambda s: row(_place(s, normed), F.regexp_extract(tx.norm(s), pattern, 0))), lambda x: x["pos"] >= 0)
    same = lambda a, b: (a["line"] == b["line"]) & (a["hit"] == b["hit"])
    new = F.filter(inside, lambda x, i: ~F.exists(at_lines, lambda y: same(x, y)) & ~F.exists(F.slice(inside, F.lit(1), i), lambda y: same(x, y)))
    return F.concat(at_lines, new)


def transitions(text: str = "text") -> Column:
    """The number of openers (``transition_hits``)."""
    raw = _raw(text)
    n = tx.norm(raw)
    # a plain search for any opener goes first, as most texts have none
    return F.when(n.rlike("(?Ud)" + packs.TRANSITION.removeprefix("^")), F.size(transition_hits(raw, n))).otherwise(0)


def numbers_in_lists(text: Column) -> Column:
    """``array<struct<hit, listed>>``: the numbers of a text, and whether each is a bare list number up to 3."""
    t = F.coalesce(text, F.lit(""))
    # a hit with the character before and the three after its start, without positions
    around = r"(?s)(?<=(^|.))(" + packs.NUMBER + r")(?=(.{0,3}))"
    part = lambda k: F.regexp_extract_all(t, F.lit(around), F.lit(k))
    found = F.arrays_zip(part(1).alias("before"), part(2).alias("hit"), part(3).alias("after"))

    def one(x: Column) -> Column:
        near = F.concat(x["before"], F.substring(F.concat(x["hit"], x["after"]), 1, 3))
        listed = F.get(tx.variants(x["hit"]), 0).rlike("^0*[0-3]$") & near.rlike(r"(?U)^\s*\d[.)]")
        return F.struct(x["hit"].alias("hit"), listed.alias("listed"))

    return F.transform(found, one)


def not_among(numbers: Column, known: Column) -> Column:
    """The numbers (``numbers_in_lists``) of which no form is among ``known`` (``number_variants``); list numbers are let pass."""
    return F.transform(F.filter(numbers, lambda x: ~F.arrays_overlap(tx.variants(x["hit"]), known) & ~x["listed"]), lambda x: F.trim(x["hit"]))


def foreign_numbers(text: Column, source: Column) -> Column:
    """Numbers of a text of which no form is among the source's; bare list numbers up to 3 are let pass."""
    return not_among(numbers_in_lists(text), tx.number_variants(F.coalesce(source, F.lit(""))))


def lint(
    df: DataFrame, text: str = "text", source: str | None = None, greeting: bool | Column = False, max_words: int | Column | None = None, min_score: int | None = None, lexical: bool = True, nfc: bool = True
) -> DataFrame:
    """Adds the counts of ``structure``, ``findings`` (category to number), ``penalty``, ``score`` and ``fail``.

    ``greeting`` and ``max_words`` may be columns; numbers are checked where ``source`` is not null.
    ``nfc=False`` leaves the normal form as it is.
    """
    names = df.columns
    df = df.withColumn("text__", _raw(text))
    df = tx.composed(df, "text__") if nfc else df
    # the normal form is a column of its own, so that hundreds of patterns share one
    counts = structure(df.withColumn("norm__", tx.norm(F.col("text__"))), "text__")
    found = structural_findings()
    if lexical:
        found |= lexical_findings("text__", normed=F.col("norm__")) | {"transition": transitions("text__")}
    asked = greeting if isinstance(greeting, Column) else F.lit(bool(greeting))
    if greeting is not False:
        found["greeting"] = F.when(asked, F.regexp_count(F.col("norm__"), F.lit(java(packs.GREETING)))).otherwise(0)
    if source is not None:
        found["foreign_number"] = F.when(F.col(source).isNotNull(), F.size(foreign_numbers(F.col("text__"), F.col(source)))).otherwise(0)
    made = F.map_filter(F.create_map(*(x for c, n in found.items() for x in (F.lit(c), n.cast("long")))), lambda _, n: n > 0)
    points = F.create_map(*(F.lit(x) for kv in packs.PENALTY.items() for x in kv))
    out = counts.withColumn("findings", made)
    out = out.withColumn("penalty", F.aggregate(F.map_entries("findings"), F.lit(0).cast("long"), lambda a, e: a + e["value"] * F.element_at(points, e["key"])))
    nw = F.greatest(F.col("words"), F.lit(1))
    out = out.withColumn("score", F.greatest(F.lit(0), F.bround(100 - F.col("penalty") * 100 / nw, 0).cast("long")))
    fails = [(F.lit(False), "")]
    if max_words is not None:
        limit = max_words if isinstance(max_words, Column) else F.lit(max_words)
        fails.append(((limit > 0) & (F.col("words") > limit), "too long"))
    if greeting is not False:
        fails.append((F.col("findings").getItem("greeting").isNotNull(), "greeting"))
    if source is not None:
        fails.append((F.col("findings").getItem("foreign_number").isNotNull(), "numbers not in the source"))
    if min_score is not None:
        fails.append((F.col("score") < min_score, "score"))
    out = out.withColumn("fail", F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in fails))))
    return out.select(*names, *(c for c in out.columns if c not in {*names, "text__", "norm__"}))


def any_failed(linted: DataFrame) -> DataFrame:
    """One row: whether any document failed, and how many did."""
    bad = F.size("fail") > 0
    return linted.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("failed"), F.count_if(bad).alias("documents"))


def hits(df: DataFrame, patterns: dict[str, tuple[str, ...]], key: str = "doc_id", text: str = "text", top: int = packs.SHOWN, nfc: bool = True) -> DataFrame:
    """The first ``top`` hits of each document and category, pattern after pattern, with line, context and the category's total.

    Hits of a document are few and ranked inside its row, so nothing is shuffled.
    """
    rows = df.select(F.col(key), _raw(text).alias("_raw"))
    rows = (tx.composed(rows, "_raw") if nfc else rows).withColumn("_n", tx.norm(F.col("_raw")))
    n = F.col("_n")
    arrays = []
    for name, pack in patterns.items():
        found = F.slice(F.flatten(F.array(*(tx.positions(n, java(p), top) for p in pack))), 1, top)
        total = reduce(lambda a, b: a + b, (F.regexp_count(n, F.lit(java(p))) for p in pack))
        arrays.append(F.struct(F.lit(name).alias("category"), total.cast("long").alias("total"), found.alias("found")))
    out = rows.select(key, "_raw", F.explode(F.array(*arrays)).alias("c"))
    out = out.select(key, "_raw", "c.category", "c.total", F.posexplode("c.found").alias("ordinal", "h"))
    return out.select(key, "category", (F.col("ordinal") + 1).cast("long").alias("ordinal"), "total", *_shown(F.col("h")))


def _shown(h: Column) -> list[Column]:
    return [h["pos"].cast("long").alias("pos"), tx.line_of(F.col("_raw"), h["pos"]).cast("long").alias("line"), h["hit"].alias("hit"), tx.context(F.col("_raw"), h["pos"]).alias("context")]


def _patterns(which: dict[str, tuple[str, ...]]) -> Column:
    return F.array(*(F.struct(F.lit(c).alias("category"), F.lit(java(p)).alias("regex")) for c, pack in which.items() for p in pack))


def findings(df: DataFrame, key: str = "doc_id", text: str = "text", source: str | None = None, greeting: bool = False, which: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """All findings as rows: category, ordinal, pos, line, hit, context, note."""
    rows = df.select(F.col(key), _raw(text).alias("text__"), *([F.col(source).alias("source__")] if source else []))
    counts = structure(tx.composed(rows, "text__").withColumn("norm__", tx.norm(F.col("text__"))), "text__").withColumnRenamed("text__", "_raw")
    raw, n = F.col("_raw"), F.col("norm__")
    plain = lambda a: F.transform(a, lambda x: F.struct(x["pos"].cast("int").alias("pos"), x["hit"].alias("hit"), F.lit("").alias("note")))
    at = lambda p: tx.positions(n, java(p))
    one = lambda test, hit, note: F.when(test, F.array(F.struct(F.lit(0).alias("pos"), hit.alias("hit"), F.lit(note).alias("note")))).otherwise(F.array().cast(_HITS))
    # patterns that a text holds are looked for in one list, so that the plan holds the work on a pattern once a pack
    counts = counts.withColumn("held__", F.filter(_patterns(packs.PACKS if which is None else which), lambda p: F.rlike(F.col("norm__"), p["regex"])))
    held = lambda name: F.filter("held__", lambda p: p["category"] == name)
    found = {name: plain(F.flatten(F.transform(held(name), lambda p: tx.positions(n, p["regex"])))) for name in (packs.PACKS if which is None else which)}
    found["passive"] = plain(at(packs.PASSIVE))
    found["participle"] = plain(_unusual(at(packs.PARTICIPLE)))
    found["transition"] = plain(transition_hits(raw, n))
    long = F.filter(F.transform(tx.parts(raw), lambda s: F.struct(s.alias("s"), tx.word_count(s).alias("n"))), lambda x: x["n"] > packs.LONG_SENTENCE)
    note = lambda s: F.concat(F.substring(s, 1, 90), F.when(F.length(s) > 90, "…").otherwise(""))
    found["long_sentence"] = F.transform(long, lambda x: F.struct(F.greatest(_place(x["s"], n), F.lit(0)).alias("pos"), F.concat(x["n"].cast("string"), F.lit(" слов")).alias("hit"), note(x["s"]).alias("note")))
    found |= {name: one(test, hit, said) for name, (test, hit, said) in _rules().items()}
    if greeting:
        found["greeting"] = F.transform(at(packs.GREETING), lambda x: F.struct(x["pos"].alias("pos"), x["hit"].alias("hit"), F.lit("рабочее сообщение — без приветствия").alias("note")))
    if source:
        wrong = foreign_numbers(raw, F.col("source__"))
        numbers = F.transform(tx.positions(raw, packs.NUMBER), lambda x: F.struct(x["pos"].alias("pos"), F.trim(x["hit"]).alias("hit"), F.lit("числа нет в источнике — откуда?").alias("note")))
        found["foreign_number"] = F.when(F.col("source__").isNotNull(), F.filter(numbers, lambda x: F.array_contains(wrong, x["hit"]))).otherwise(F.array().cast(_HITS))
    order = [c for c in packs.PENALTY if c in found] + [c for c in found if c not in packs.PENALTY]
    every = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(i).alias("rank"), found[c].cast(_HITS).alias("found")) for i, c in enumerate(order)))
    out = counts.select(key, "_raw", F.explode(every).alias("c")).select(key, "_raw", "c.category", "c.rank", F.size("c.found").cast("long").alias("total"), F.posexplode("c.found").alias("ordinal", "h"))
    return out.select(key, "category", "rank", "total", (F.col("ordinal") + 1).cast("long").alias("ordinal"), *_shown(F.col("h")), F.col("h.note").alias("note"))


def report(found: DataFrame, top: int = packs.SHOWN) -> DataFrame:
    """The findings that a report shows: the first ``top`` of each category in the order of the categories, and how many more there are."""
    return found.where(F.col("ordinal") <= top).withColumn("more", F.greatest(F.col("total") - top, F.lit(0)))


# ---- grading


def grade(df: DataFrame, text: str = "text") -> DataFrame:
    """Expectations with their evidence for rows that carry a lint result and a ``checks`` struct; null ``passed`` awaits a judge.

    ``checks`` has min_score, max_words, max_paragraphs, max_emoji, required and forbidden (arrays),
    required_any (array of arrays), first_line_any, last_block_any and judgments (arrays); null means no
    check. With ``sourced`` and ``no_greeting`` in it, numbers and greetings are expected to be absent.
    """
    raw = _raw(text)
    has = lambda t, p: F.contains(tx.flat(t), tx.flat(p))
    c = F.col("checks")
    fields = set(df.schema["checks"].dataType.names)
    found = lambda name: F.coalesce(F.col("findings").getItem(name), F.lit(0))
    none = F.array().cast("array<string>")
    listed = lambda name: F.coalesce(c[name], none)
    said = lambda x, what: F.concat(x.cast("string"), F.lit(" " + what))

    def one(name, passed: Column, evidence: Column, when: Column | None = None) -> Column:
        row = F.struct((F.lit(name) if isinstance(name, str) else name).alias("text"), passed.cast("boolean").alias("passed"), evidence.alias("evidence"))
        return row if when is None else F.when(when, row)

    trimmed = F.trim(raw)
    first, last = F.get(tx.lines(trimmed), 0), F.substring(trimmed, F.greatest(F.length(trimmed) - 399, F.lit(1)), F.lit(400))
    missing, wrong = F.filter(listed("required"), lambda p: ~has(raw, p)), F.filter(listed("forbidden"), lambda p: has(raw, p))
    counts = F.array_join(F.transform(F.map_entries("findings"), lambda e: F.concat(e["key"], F.lit("×"), e["value"].cast("string"))), ", ")
    over = lambda name: F.coalesce(c[name], F.lit(0)) > 0
    rows = [
        one("score", F.col("score") >= c["min_score"], F.concat(F.format_string("score %d (penalty %d / %d words); hits: ", "score", "penalty", "words"), counts)),
        one("words", F.col("words") <= c["max_words"], said(F.col("words"), "words"), over("max_words")),
    ]
    if "sourced" in fields:
        rows.append(one("no numbers absent from the source", found("foreign_number") == 0, F.when(found("foreign_number") == 0, F.lit("all numbers traceable")).otherwise(said(found("foreign_number"), "absent")), c["sourced"]))
    if "no_greeting" in fields:
        rows.append(one("no greeting", found("greeting") == 0, F.when(found("greeting") == 0, F.lit("none")).otherwise(F.regexp_extract(tx.norm(raw), java(packs.GREETING), 0)), c["no_greeting"]))
    rows += [
        one("no hard hits", found("hard") == 0, F.when(found("hard") == 0, F.lit("none")).otherwise(said(found("hard"), "hits"))),
        one("paragraphs", F.col("paragraphs") <= c["max_paragraphs"], said(F.col("paragraphs"), "paragraphs"), over("max_paragraphs")),
        one("emoji", F.col("emojis") <= c["max_emoji"], said(F.col("emojis"), "emoji"), over("max_emoji")),
        one("required", F.size(missing) == 0, F.when(F.size(missing) == 0, F.lit("all present")).otherwise(F.concat(F.lit("missing: "), F.array_join(missing, ", ")))),
        one("forbidden", F.size(wrong) == 0, F.when(F.size(wrong) == 0, F.lit("none")).otherwise(F.concat(F.lit("found: "), F.array_join(wrong, ", ")))),
        one("first line", F.exists(c["first_line_any"], lambda p: has(first, p)), F.substring(first, 1, 120), F.size(c["first_line_any"]) > 0),
        one("last block", F.exists(c["last_block_any"], lambda p: has(last, p)), F.replace(F.substring(last, F.greatest(F.length(last) - 159, F.lit(1)), F.lit(160)), F.lit("\n"), F.lit(" ⏎ ")), F.size(c["last_block_any"]) > 0),
    ]
    ok = lambda g: F.exists(g, lambda p: has(raw, p))
    groups = F.transform(F.coalesce(c["required_any"], F.array().cast("array<array<string>>")), lambda g: one(F.concat(F.lit("one of: "), F.array_join(g, " / ")), ok(g), F.when(ok(g), F.lit("found")).otherwise(F.lit("none found"))))
    judged = F.transform(listed("judgments"), lambda j: one(F.concat(F.lit("[judgment] "), j), F.lit(None), F.lit("")))
    return summarised(df.withColumn("expectations", F.concat(F.array_compact(F.array(*rows)), groups, judged)))


def summarised(df: DataFrame) -> DataFrame:
    """Adds ``summary`` of ``expectations``: passed, failed, total and the share passed of all, those that await a judge included."""
    passed = F.size(F.filter("expectations", lambda e: F.coalesce(e["passed"], F.lit(False))))
    known = F.size(F.filter("expectations", lambda e: e["passed"].isNotNull()))
    return df.withColumn("summary", F.struct(passed.alias("passed"), (known - passed).alias("failed"), F.size("expectations").alias("total"), F.bround(passed / F.size("expectations"), 3).alias("pass_rate")))


def chosen_outputs(evals: DataFrame, outputs: DataFrame) -> DataFrame:
    """The output of each eval: the file it names, else the first other one by name that isn't hidden; null without any.

    ``evals`` has id and checks.output, ``outputs`` eval_id, path and text.
    """
    name = F.element_at(F.split("path", "/"), -1)
    files = outputs.select(F.col("eval_id").alias("id"), "path", F.col("text").alias("_text"), name.alias("_name"))
    named = F.col("_name") == F.col("_wanted")
    shown = evals.select("id", F.col("checks.output").alias("_wanted")).join(files, "id").where(named | ~F.col("_name").startswith("."))
    best = shown.groupBy("id").agg(F.min(F.struct((~named).alias("other"), "_name", "path", "_text")).alias("b"))
    return evals.join(best, "id", "left").select(evals["*"], F.col("b.path").alias("output_file"), F.col("b._text").alias("text"))


def graded(evals: DataFrame, outputs: DataFrame, sources: DataFrame) -> DataFrame:
    """Evals joined to their outputs and sources, linted and graded; an eval without output fails its one expectation.

    ``sources`` has path and text; ``checks`` may name a source and carry no_greeting.
    """
    rows = chosen_outputs(evals, outputs).join(sources.select(F.col("path").alias("_path"), F.col("text").alias("source_text")), F.col("checks.source") == F.col("_path"), "left").drop("_path")
    checks = F.col("checks").withField("sourced", F.col("source_text").isNotNull()).withField("no_greeting", F.coalesce(F.col("checks.no_greeting"), F.lit(False)))
    rows = rows.withColumn("checks", checks)
    done = grade(lint(rows, source="source_text", greeting=F.col("checks.no_greeting"), max_words=F.coalesce(F.col("checks.max_words"), F.lit(0))))
    lost = F.array(F.struct(F.lit("output file exists").alias("text"), F.lit(False).alias("passed"), F.lit("no file in outputs").alias("evidence")))
    there = F.col("output_file").isNotNull()
    out = summarised(done.withColumn("expectations", F.when(there, F.col("expectations")).otherwise(lost)))
    return out.select("id", "name", "output_file", F.when(there, F.col("score")).alias("score"), F.when(there, F.col("words")).alias("words"), "summary", "expectations")


def udtf():
    """A Python table function ``lint_findings(text)`` for SQL users: category, pos and hit of the packs. Register it with ``spark.udtf.register``."""
    import re
    import unicodedata

    from pyspark.sql.functions import udtf as table_function

    compiled = [(c, re.compile(p, re.M)) for c, pack in packs.PACKS.items() for p in pack]

    class LintFindings:
        def eval(self, text: str):
            n = unicodedata.normalize("NFC", text or "").lower().replace("ё", "е")
            for category, pattern in compiled:
                for m in pattern.finditer(n):
                    yield category, m.start(), m.group(0)

    return table_function(LintFindings, returnType="category string, pos int, hit string")
