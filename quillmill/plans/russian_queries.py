"""The whole linter and the grader over Russian rows, with their DuckDB twins.

The packs are Russian and the tables are not, so these queries bring rows of their own; ``doc_lint_full``
runs the same rules, and the same twin, over ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import packs
from quillmill.operators import lint
from quillmill.plans.literal import frame, values
from quillmill.plans.text_queries import SENTENCES, blocks, clean_words, numbers, scored_counts

ROWS = [
    (1, "Стоит отметить, что сервис играет ключевую роль в современном мире. Это весьма удобно и очень важно.\nТаким образом, данный модуль является мощным инструментом."),
    (2, "Также мы внедрили кэш.\nТакже важно: было сделано 3 теста, и так далее.\nПри этом стоимость была снижена. Важно помнить об этом. Важно знать меру."),
    (3, "Итак, проведение мероприятий осуществляется в целях обеспечения качества — это не проблема, а возможность. Письмо было отправлено. Отчёты были готовы."),
    (4, "Письмо отправлено.\n\nСрок — 5 595 рублей, то есть 12,5 процента.\n1. Пункт\n2. Другой пункт"),
    (5, "Привет! Работающий сервис, данный ранний срок и решённый вопрос. Устаревшие данные, изменённые настройки и сохранённые файлы."),
    (6, "Простой текст без находок"),
    (7, "ёлка и Ёж, " * 9 + "конец."),
    (8, "Не только цена, но и срок. Не только срок, но и люди. Хлеб, соль и вода. Дом, сад и лес. День, ночь и утро (и вечер) (ещё) (раз)."),
    (9, "**Один** **два** **три** **четыре** 🎉 🎉 🎉 🎉\n# Заголовок\nКороткий текст — и тире — и ещё — раз."),
    (10, "Сервис помогает командам быстро находить нужные данные и собирать из них отчёты которые потом читают руководители отделов и их заместители каждое утро понедельника перед общей встречей за кофе."),
    (11, ""),
    (12, None),
    (13, "Йод, ёлка и крайний срок. Кройка весьма удобна."),
    (14, "Добрый день, коллеги.\nПозволяет обеспечить рост. Предоставляет возможность. Функционал растёт. На моей стороне всё готово.\nПозволяет экономить. Позволяет расти."),
]
SOURCES = [(1, None), (2, "Было сделано 3 теста."), (4, "Цена 5595 рублей и 12.5 процента"), (9, "Без чисел"), (10, "")]


def _rows(spark: SparkSession) -> DataFrame:
    return frame(spark, ROWS, "doc_id long, text string")


def russian_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules and hard limits."""
    return lint.lint(_rows(spark), greeting=True, max_words=20, min_score=60).select("doc_id", "words", "penalty", "score", F.array_join("fail", ",").alias("fail"))


def russian_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of findings of each category in each document."""
    found = lint.lint(_rows(spark), greeting=True).select("doc_id", F.explode("findings").alias("category", "n"))
    return found.select("doc_id", "category", "n")


def russian_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of the passive and of rules with one pattern, with places, lines and hits."""
    found = lint.findings(_rows(spark), which={"calque": (r"позволя(ет|ют)", r"предоставляет возможность"), "hard": (r"в целях",)})
    found = found.where("category in ('calque', 'hard', 'long_sentence')")
    return found.select("doc_id", "category", "ordinal", "total", "pos", "line", "hit")


def russian_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of two findings a category."""
    found = lint.report(lint.findings(_rows(spark), greeting=True), 2)
    return found.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("shown"), F.max("more").alias("more"))


def any_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a run over all rows fails."""
    return lint.any_failed(lint.lint(_rows(spark), greeting=True, max_words=20, min_score=60))


def numbers_with_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are not in the source, list numbers aside."""
    df = _rows(spark).join(frame(spark, SOURCES, "doc_id long, source string"), "doc_id")
    return df.where("source is not null").select("doc_id", F.array_join(lint.foreign_numbers(F.col("text"), F.col("source")), "|").alias("foreign"))


EVALS = [(k, f"eval {k}", f"out{k}.md", 40, 15, "src.txt" if k % 2 else None, k == 5, ["текст", "пункт"][: k % 3], ["привет", "очень"]) for k in (1, 2, 3, 4, 5, 6)]
OUTPUTS = [(1, "run/outputs/out1.md", 1), (1, "run/outputs/a.md", 6), (2, "run/outputs/b.md", 2), (2, "run/outputs/c.md", 3), (3, "run/outputs/.hidden", 3), (4, "run/outputs/out4.md", 4), (5, "run/outputs/x.md", 5)]
SOURCE_TEXT = "Всего 3 теста и 5 595 рублей"


def graded_evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evals joined to their outputs and sources, linted and graded."""
    e = frame(spark, EVALS, "id long, name string, output string, min_score int, max_words int, source string, no_greeting boolean, required array<string>, forbidden array<string>")
    checks = F.struct(
        "output", "min_score", "max_words", "source", "no_greeting", "required", "forbidden",
        F.lit(1).alias("max_paragraphs"), F.lit(2).alias("max_emoji"), F.array(F.array(F.lit("срок"), F.lit("сервис"))).alias("required_any"),
        F.array(F.lit("привет"), F.lit("письмо")).alias("first_line_any"), F.lit(None).cast("array<string>").alias("last_block_any"), F.array(F.lit("читается легко")).alias("judgments"),
    )
    texts = _rows(spark).select(F.col("doc_id").alias("_d"), "text")
    outputs = frame(spark, OUTPUTS, "eval_id long, path string, _d long").join(texts, "_d").select("eval_id", "path", "text")
    sources = frame(spark, [("src.txt", SOURCE_TEXT)], "path string, text string")
    g = lint.graded(e.select("id", "name", checks.alias("checks")), outputs, sources)
    failed = F.array_join(F.transform(F.filter("expectations", lambda x: ~x["passed"]), lambda x: x["text"]), ";")
    return g.select("id", "output_file", F.col("summary.passed").alias("passed"), F.col("summary.failed").alias("failed"), F.col("summary.total").alias("total"), "summary.pass_rate", failed.alias("failing"))


def pattern_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packs as data, counted."""
    return lint.pattern_table(spark).groupBy("category").agg(F.count(F.lit(1)).alias("patterns"), F.max(F.length("regex")).alias("longest")).join(lint.penalty_table(spark), "category")


QUERIES = {f.__name__: f for f in (russian_lint, russian_categories, russian_findings, russian_report, any_failed, numbers_with_sources, graded_evals, pattern_packs)}

# ---- SQL: RE2 has no Unicode word borders, so a border is a character that belongs to no word

_NOT = r"[^\p{L}\p{N}_]"


def re2(pattern: str) -> str:
    """A pattern of the packs as a quoted RE2 literal."""
    p = pattern.replace(r"\w", r"[\p{L}\p{N}_]").replace(r"[а-яё«»\"[\p{L}\p{N}_]-]", r"[\p{L}\p{N}_«»\"-]")
    if p.startswith(r"\b"):
        p = rf"(?:^|{_NOT})" + p[2:]
    if p.endswith(r"\b"):
        p = p[:-2] + rf"(?:$|{_NOT})"
    return "'(?m)" + p.replace("'", "''") + "'"


def _count(patterns, n: str = "n") -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({n}, {re2(p)}))" for p in patterns) + ")"


_STOP = [w for w in packs.COMMON_ADJECTIVES if len(w) > 4]
_PARTICIPLE = re2(packs.PARTICIPLE.replace("[а-я]{3,}(?:", "([а-я]{3,}(?:", 1).removesuffix(r"\b") + r")\b")
_STEM = f"regexp_replace(w, '{packs.PARTICIPLE_END}', '')"
_UNUSUAL = f"len(list_filter(regexp_extract_all(n, {_PARTICIPLE}, 1), lambda w: len(list_filter({_STOP!r}, lambda a: starts_with(a, {_STEM}) OR starts_with({_STEM}, a[:-3]))) = 0))"
_OPENER = re2(packs.TRANSITION)
_LEX = {name: _count(pack) for name, pack in packs.PACKS.items()} | {"passive": _count([packs.PASSIVE]), "participle": _UNUSUAL, "greeting": _count([packs.GREETING])}


def linted(source: str, greeting: bool = True) -> str:
    """CTEs that end in ``f``: doc_id, words and a column for each category, of the documents in ``source`` (doc_id, text)."""
    lexical = ", ".join(f'{sql} AS "{name}"' for name, sql in _LEX.items() if greeting or name != "greeting")
    return f"""
    raw AS (SELECT doc_id, nfc_normalize(coalesce(text, '')) AS text FROM {source}),
    b AS (SELECT *, replace(lower(text), 'ё', 'е') AS n FROM raw),
    st AS ({scored_counts("b")}),
    ln AS (SELECT doc_id, unnest(string_split(n, chr(10))) AS l, unnest(range(1, 1 + len(string_split(n, chr(10))))) AS line FROM b),
    lh AS (SELECT doc_id, line, regexp_extract(l, {_OPENER}, 1) AS hit FROM ln WHERE regexp_matches(l, {_OPENER})),
    se AS (SELECT doc_id, n, unnest({SENTENCES}) AS s FROM b),
    sh AS (SELECT doc_id, n, replace(lower(s), 'ё', 'е') AS m FROM se),
    sp AS (SELECT doc_id, n, regexp_extract(m, {_OPENER}, 1) AS hit, instr(n, substr(m, 1, 40)) AS p FROM sh WHERE regexp_matches(m, {_OPENER})),
    tr AS (SELECT doc_id, count(*) AS transition FROM (SELECT doc_id, line, hit FROM lh UNION SELECT doc_id, 1 + length(substr(n, 1, p - 1)) - length(replace(substr(n, 1, p - 1), chr(10), '')), hit FROM sp WHERE p > 0) GROUP BY doc_id),
    lx AS (SELECT doc_id, {lexical} FROM b),
    f AS (SELECT st.*, lx.* EXCLUDE (doc_id), coalesce(tr.transition, 0) AS transition FROM st JOIN lx USING (doc_id) LEFT JOIN tr USING (doc_id))"""


_CATEGORIES = [c for c in packs.PENALTY if c != "foreign_number"]
PENALTY = " + ".join(f'{packs.PENALTY[c]} * "{c}"' for c in _CATEGORIES)
SCORE = f"greatest(0, round_even(100 - ({PENALTY}) * 100 / nw, 0))::BIGINT"
_DOCS = values(ROWS, "doc_id", "text")
_FAIL = f"array_to_string(list_filter([CASE WHEN words > {{most}} THEN 'too long' END, CASE WHEN greeting > 0 THEN 'greeting' END, CASE WHEN {SCORE} < {{least}} THEN 'score' END], lambda x: x IS NOT NULL), ',')"


def full_lint(source: str, most: int, least: int, extra: str = "words::BIGINT AS words, ") -> str:
    return f"WITH {linted(source)} SELECT doc_id, {extra}({PENALTY})::BIGINT AS penalty, {SCORE} AS score, {_FAIL.format(most=most, least=least)} AS fail FROM f"


_EVERY = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, \"{c}\"::BIGINT AS n FROM f" for c in _CATEGORIES)
_POS = """
    p AS (SELECT doc_id, text, n, '{category}' AS category, {k} AS k, string_split_regex(n, '{p}') AS gaps, regexp_extract_all(n, '{p}') AS hits FROM b),"""
_FOUND_SQL = [("calque", 0, "позволя(ет|ют)"), ("calque", 1, "предоставляет возможность"), ("hard", 0, "в целях")]


def _found() -> str:
    each = " UNION ALL ".join(f"SELECT doc_id, text, n, '{c}' AS category, {k} AS k, string_split_regex(n, '{p}') AS gaps, regexp_extract_all(n, '{p}') AS hits FROM b" for c, k, p in _FOUND_SQL)
    pos = "list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)"
    words = clean_words("s")
    return f"""WITH raw AS (SELECT doc_id, nfc_normalize(coalesce(text, '')) AS text FROM {_DOCS}), b AS (SELECT *, replace(lower(text), 'ё', 'е') AS n FROM raw),
        p AS ({each}), x AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM p),
        y AS (SELECT doc_id, text, category, k, ({pos})::BIGINT AS pos, hits[i] AS hit FROM x),
        s AS (SELECT doc_id, text, n, unnest({SENTENCES}) AS s FROM b), l AS (SELECT doc_id, text, 'long_sentence' AS category, 0 AS k, greatest(instr(n, substr(replace(lower(s), 'ё', 'е'), 1, 40)) - 1, 0)::BIGINT AS pos, len({words}) || ' слов' AS hit FROM s WHERE len({words}) > 25),
        z AS (SELECT * FROM y UNION ALL SELECT * FROM l)
        SELECT doc_id, category, row_number() OVER (PARTITION BY doc_id, category ORDER BY k, pos) AS ordinal, count(*) OVER (PARTITION BY doc_id, category) AS total, pos,
               (1 + length(substr(text, 1, pos)) - length(replace(substr(text, 1, pos), chr(10), '')))::BIGINT AS line, hit FROM z"""


_EVAL_SQL = values([(r[0], *r[1:]) for r in EVALS], "id", "name", "output", "min_score", "max_words", "source", "no_greeting", "required", "forbidden")


def _graded() -> str:
    has = lambda t, p: f"contains(replace(replace(lower({t}), 'ё', 'е'), chr(160), ' '), {p})"
    foreign = f"len(list_filter({numbers('text')[0]}, lambda x: NOT list_has_any({numbers('x')[1]}, flatten(list_transform({numbers(repr(SOURCE_TEXT))[0]}, lambda y: {numbers('y')[1]})))))"
    sourced = "source IS NOT NULL"
    penalty = PENALTY.replace('3 * "greeting"', "CASE WHEN no_greeting THEN 3 * greeting ELSE 0 END") + f" + CASE WHEN {sourced} THEN {packs.PENALTY['foreign_number']} * wrong ELSE 0 END"
    checks = [
        ("'score'", "score >= min_score", "true"),
        ("'words'", "words <= max_words", "true"),
        ("'no numbers absent from the source'", "wrong = 0", sourced),
        ("'no greeting'", "greeting = 0", "no_greeting"),
        ("'no hard hits'", "hard = 0", "true"),
        ("'paragraphs'", f"{blocks('text')} <= 1", "true"),
        ("'emoji'", "emojis <= 2", "true"),
        ("'required'", f"len(list_filter(required, lambda p: NOT {has('text', 'p')})) = 0", "true"),
        ("'forbidden'", f"len(list_filter(forbidden, lambda p: {has('text', 'p')})) = 0", "true"),
        ("'first line'", f"{has('string_split(trim(text), chr(10))[1]', repr('привет'))} OR {has('string_split(trim(text), chr(10))[1]', repr('письмо'))}", "true"),
        ("'one of: срок / сервис'", f"{has('text', repr('срок'))} OR {has('text', repr('сервис'))}", "true"),
    ]
    rows = "[" + ", ".join(f"CASE WHEN {when} THEN {{'t': {t}, 'p': ({p})}} END" for t, p, when in checks) + "]"
    return f"""WITH d AS {_DOCS}, e AS {_EVAL_SQL}, o AS {values(OUTPUTS, "eval_id", "path", "d")},
        {linted("d")}, q AS (SELECT f.*, raw.text, {foreign} AS wrong FROM f JOIN raw USING (doc_id)),
        c AS (SELECT e.*, o.path, o.d, row_number() OVER (PARTITION BY e.id ORDER BY CASE WHEN string_split(o.path, '/')[-1] = e.output THEN 0 ELSE 1 END, string_split(o.path, '/')[-1]) AS r
              FROM e LEFT JOIN o ON e.id = o.eval_id AND (string_split(o.path, '/')[-1] = e.output OR NOT starts_with(string_split(o.path, '/')[-1], '.'))),
        k AS (SELECT c.*, q.* EXCLUDE (doc_id), ({penalty}) AS points FROM c LEFT JOIN q ON c.d = q.doc_id WHERE r = 1),
        s AS (SELECT *, greatest(0, round_even(100 - points * 100 / nw, 0))::BIGINT AS score FROM k),
        g AS (SELECT id, path, CASE WHEN path IS NULL THEN [{{'t': 'output file exists', 'p': false}}] ELSE list_filter({rows}, lambda x: x IS NOT NULL) END AS x FROM s)
        SELECT id, path AS output_file, len(list_filter(x, lambda y: y.p))::INT AS passed, len(list_filter(x, lambda y: NOT y.p))::INT AS failed, (len(x) + CASE WHEN path IS NULL THEN 0 ELSE 1 END)::INT AS total,
               round_even(len(list_filter(x, lambda y: y.p)) / (len(x) + CASE WHEN path IS NULL THEN 0 ELSE 1 END), 3)::DOUBLE AS pass_rate,
               array_to_string(list_transform(list_filter(x, lambda y: NOT y.p), lambda y: y.t), ';') AS failing FROM g"""


_PACK_ROWS = [(c, len(p), max(map(len, p)), packs.PENALTY[c]) for c, p in packs.PACKS.items()]
_LISTED = rf"(regexp_matches(y.c, '^0*[0-3]$') AND regexp_matches(y.near, '^\s*\d[.)]'))"

ORACLE_SQL = {
    "russian_lint": full_lint(_DOCS, 20, 60),
    "russian_categories": f"WITH {linted(_DOCS)} SELECT * FROM ({_EVERY}) WHERE n > 0",
    "russian_findings": _found(),
    "russian_report": f"WITH {linted(_DOCS)} SELECT doc_id, category, least(n, 2) AS shown, greatest(n - 2, 0) AS more FROM ({_EVERY}) WHERE n > 0",
    "any_failed": f"SELECT coalesce(bool_or(fail <> ''), false) AS failed, count(*) FILTER (fail <> '') AS documents FROM ({full_lint(_DOCS, 20, 60)})",
    "numbers_with_sources": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM {_DOCS} JOIN {values(SOURCES, "doc_id", "source")} USING (doc_id) WHERE source IS NOT NULL),
        p AS (SELECT doc_id, text, source, string_split_regex(text, '[0-9][0-9 \\x{{A0}}.,]*[0-9]|[0-9]') AS gaps, {numbers('text')[0]} AS hits FROM d),
        x AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM p),
        y AS (SELECT doc_id, source, i, hits[i] AS h, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0))::BIGINT AS place, text FROM x),
        z AS (SELECT doc_id, source, i, h, ({numbers('h')[1]})[1] AS c, substr(text, greatest(place, 1), CASE WHEN place > 0 THEN 4 ELSE 3 END) AS near FROM y),
        w AS (SELECT doc_id, i, trim(h) AS h FROM z y WHERE NOT list_has_any({numbers('h')[1]}, flatten(list_transform({numbers('source')[0]}, lambda q: {numbers('q')[1]}))) AND NOT {_LISTED})
        SELECT d.doc_id, coalesce(string_agg(w.h, '|' ORDER BY w.i), '') AS "foreign" FROM d LEFT JOIN w USING (doc_id) GROUP BY d.doc_id""",
    "graded_evals": _graded(),
    "pattern_packs": f"SELECT category, patterns::BIGINT AS patterns, longest::INT AS longest, points::INT AS points FROM {values(_PACK_ROWS, 'category', 'patterns', 'longest', 'points')}",
}
