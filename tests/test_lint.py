"""The linter against a plain-Python reading of its rules, on short Russian fixtures."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillmill.functions import packs, text as tx
from quillmill.operators import lint

TEXTS = [
    "Стоит отметить, что сервис играет ключевую роль. Это весьма удобно.",
    "Также мы внедрили кэш.\nТакже важно: было сделано 3 теста, и так далее.",
    "Итак, данный модуль является мощным инструментом — он позволяет обеспечить рост.",
    "Письмо отправлено.\n\nСрок — 5 595 рублей, то есть 12,5 процента.\n1. Пункт",
    "",
    None,
    "Простой текст без находок",
    "ёлка и Ёж, " * 30 + "конец.",
]


def _plain(text: str, patterns) -> int:
    n = (text or "").lower().replace("ё", "е")
    return sum(1 for p in patterns for _ in re.finditer(p, n, re.M))


def test_pack_hits(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    found = lint.lexical_findings("text")
    got = {r["id"]: r for r in df.select("id", *(c.cast("long").alias(k) for k, c in found.items())).collect()}
    for i, t in enumerate(TEXTS):
        for name, patterns in packs.PACKS.items():
            assert got[i][name] == _plain(t, patterns), (t, name)


def test_overlaps_count_twice(spark):
    df = spark.createDataFrame([("это играет ключевую роль",)], "text string")
    assert df.select(lint.lexical_findings("text")["hard"].alias("n")).first()["n"] == 2


def test_passive_participle_transition(spark):
    df = spark.createDataFrame([("Было сделано всё. Работающий сервис и данный ранний срок.\nТакже новое. Также старое.",)], "text string")
    f = lint.lexical_findings("text")
    row = df.select(f["passive"].alias("p"), f["participle"].alias("q"), lint.transitions("text").alias("t")).first()
    assert row["p"] == 1
    assert row["q"] == 1
    assert row["t"] == 1  # the second one is on the line that has it already


def test_score_and_fail(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for r in lint.lint(df, max_words=5, min_score=100).collect():
        points = sum(packs.PENALTY[k] * n for k, n in r["findings"].items())
        assert r["penalty"] == points
        assert r["score"] == max(0, round(100 - points * 100 / max(r["words"], 1)))
        assert ("too long" in r["fail"]) == (r["words"] > 5)
        assert ("score" in r["fail"]) == (r["score"] < 100)


def test_words_and_numbers(spark):
    df = spark.createDataFrame([("Цена 5 595 рублей, 12,5 и v2.0-rc", "Было 5595 и 12.5")], "a string, b string")
    r = df.select(tx.words(F.col("a")).alias("w"), lint.foreign_numbers(F.col("a"), F.col("b")).alias("f"), tx.number_variants(F.col("b")).alias("v")).first()
    assert r["w"] == ["цена", "5595", "рублей", "12,5", "и", "v2.0-rc"]
    assert r["f"] == ["2.0"]
    assert set(r["v"]) == {"5595", "12.5", "125"}


def test_list_numbers_are_exempt(spark):
    df = spark.createDataFrame([("1. Один\n2) Два\n7. Семь", "")], "a string, b string")
    got = df.select(lint.foreign_numbers(F.col("a"), F.col("b")).alias("f")).first()["f"]
    assert [g.strip(". ") for g in got] == ["7"]


def test_positions_lines_and_context(spark):
    text = "раз два\nтри два"
    df = spark.createDataFrame([(text,)], "text string")
    hits = lint.hits(df.withColumn("doc_id", F.lit(1)), {"x": ("два",)}).orderBy("ordinal").collect()
    assert [(h["pos"], h["line"], h["hit"]) for h in hits] == [(4, 1, "два"), (12, 2, "два")]
    assert hits[0]["context"] == text.replace("\n", " ")


def test_grades(spark):
    df = spark.createDataFrame([("Факт есть. Прошу ответить.",)], "text string")
    checks = F.expr(
        "named_struct('min_score', 50, 'max_words', 3, 'max_paragraphs', 0, 'max_emoji', null, 'required', array('факт'), 'forbidden', array('нет'),"
        " 'required_any', array(array('есть', 'нет')), 'first_line_any', array('факт'), 'last_block_any', array('ответить'), 'judgments', array('j'))"
    )
    r = lint.grade(lint.lint(df).withColumn("checks", checks)).first()
    assert next(e["evidence"] for e in r["expectations"] if e["text"] == "words") == "4 words"
    assert {e["text"]: e["passed"] for e in r["expectations"]} == {"score": True, "words": False, "no hard hits": True, "required": True, "forbidden": True, "first line": True, "last block": True, "one of: есть / нет": True, "[judgment] j": None}
    assert r["summary"]["total"] == 9 and r["summary"]["failed"] == 1 and r["summary"]["pass_rate"] == round(7 / 9, 3)


def test_decomposed_texts_count_alike(spark):
    import unicodedata

    text = "Йод и ёлка. Йогурт весьма удобный, крайний срок. " * 3
    df = spark.createDataFrame([(1, text), (2, unicodedata.normalize("NFD", text))], "doc_id long, text string")
    a, b = lint.lint(df).orderBy("doc_id").collect()
    assert a["text"] != b["text"] and a["words"] == b["words"] > 0 and a["findings"] == b["findings"] and a["score"] == b["score"]
    one, two = ([(r["pos"], r["hit"]) for r in lint.hits(df.where(F.col("doc_id") == i), {"x": ("весьма",)}).orderBy("ordinal").collect()] for i in (1, 2))
    assert one == two and len(one) == 3


def test_hits_follow_the_patterns_and_are_cut(spark):
    df = spark.createDataFrame([(1, "b a b a"), (2, "a b " * 13), (3, None)], "doc_id long, text string")
    got = lint.hits(df, {"x": ("a", "b")})
    assert [r["pos"] for r in got.where("doc_id = 1").orderBy("ordinal").collect()] == [2, 6, 0, 4]
    rows = got.where("doc_id = 2").orderBy("ordinal").collect()
    assert [r["hit"] for r in rows] == ["a"] * 12 and {r["total"] for r in rows} == {26}
    assert got.where("doc_id = 3").count() == 0


def test_findings_and_report(spark):
    df = spark.createDataFrame([(1, "Также так. " + "слово " * 30 + "конец.\nЭто весьма важно — да — нет — вот."), (2, None)], "doc_id long, text string")
    found = lint.findings(df)
    rows = {(r["category"], r["hit"]) for r in found.collect()}
    assert ("transition", "также") in rows and ("long_sentence", "33 слов") in rows and ("intro", "весьма") in rows
    counts = {c: n for r in lint.lint(df).collect() for c, n in r["findings"].items()}
    assert {r["category"]: r["count"] for r in found.groupBy("category").count().collect()} == counts
    assert lint.report(found, 1).where("ordinal > 1").count() == 0


def test_positions_of_long_texts(spark):
    text = "ab " * 3000
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(tx.positions(F.col("text"), "b").alias("p")).first()["p"]
    assert [p["pos"] for p in got] == list(range(1, 9000, 3))


def test_udtf(spark):
    spark.udtf.register("lint_findings", lint.udtf())
    rows = spark.sql("SELECT * FROM lint_findings('это весьма важно')").collect()
    assert {(r["category"], r["hit"]) for r in rows} >= {("intro", "весьма"), ("eval", "важн")}


def test_pattern_tables(spark):
    assert lint.packs_of(lint.pattern_table(spark)) == packs.PACKS
