"""What texts cannot hold is not asked of them, and what nobody is named in is not declined; results stay."""

import re

from pyspark.sql import functions as F

from incognita import cluster
from incognita.functions import text as tx
from incognita.operators import audit, detect, names
from incognita.plans import queries

TEXTS = ["Принят Иванов Иван Петрович.", "ИВАНОВУ И. П. и И.П.Ивановой", "Анна Ивановна Белая", "Серик Нұрлан Болатұлы", "Иванова Анна Ильинична", "без имён. Итог", "", None, "счёт kz86125KZT0000000001 и Kz86 125K ZT00 0000 0002", "ИНН 7700000000, СНИЛС: 112-233-445 95", "инн 7700000000", "ОГРНИП № 304500116000157"]


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_gates_lose_no_match(spark):
    rows = spark.createDataFrame([(i, 0, t, None) for i, t in enumerate(TEXTS)], "doc_id long, frag_id int, text string, hint string")
    every = F.concat(*(F.regexp_extract_all(tx.shadow_caps(F.col("text")), F.lit(p), 0) for p in (names.FULL, names.INITIALS_AFTER, names.INITIALS_BEFORE)))
    wanted = {r.doc_id for r in rows.select("doc_id", F.size(every).alias("n")).collect() if (r.n or 0) > 0}
    assert {r.doc_id for r in names.mentions(rows).collect()} == wanted == {0, 1, 2, 3, 4}
    found = {(r.doc_id, r.typ) for r in detect.detect_numbers(rows).filter("typ in ('iban', 'inn', 'rekv')").collect()}
    kinds = lambda p: {r.doc_id for r in rows.filter(F.col("text").rlike(p)).collect()}
    assert {d for d, t in found if t == "iban"} == kinds(detect.IBAN) == {8} and {d for d, t in found if t != "iban"} == kinds(detect.LABELLED) == {9, 11}


def test_cells_without_a_hint_are_not_looked_at(spark):
    rows = spark.createDataFrame([("Ким", "person"), ("Ли", None), ("Цой", "org")], "text string, hint string")
    cells = names.typed_cells(rows, "person")
    assert [r.text for r in cells.collect()] == ["Ким"] and re.search("hint#\\d+ <=> person", plan(cells))


def test_without_names_nothing_is_declined(spark):
    cluster.prepare(spark)
    parts = spark.createDataFrame([], "mention string, sur string, name string, patr string, init_n string, init_p string")
    read = names.readings(parts)
    assert read.columns == [c.split()[0] for c in names.READING.split(", ")] and "Join" not in plan(read) and read.count() == 0
    people = spark.createDataFrame([], "person_id string, sur string, gender string, name string, patr string, init_n string, init_p string, f_sur string, f_name string, f_patr string")
    for rows, kind in zip(names.person_forms(people), (names.FORMS, names.EXACT)):
        assert rows.columns == [c.split()[0] for c in kind.split(", ")] and "Generate" not in plan(rows) and rows.count() == 0


def test_leaks_are_told_without_another_detection(spark):
    rows = spark.createDataFrame([(1, 0, "тел. +7 (701) 123-45-67", None), (2, 0, "тел. +7 (702) 123-45-67", None)], "doc_id long, frag_id int, text string, hint string")
    mapping = spark.createDataFrame([("phone", "phone", "7011234567", "7019999999")], "typ string, family string, key string, fake string")
    assert [tuple(r) for r in audit.leaks(detect.detect_numbers(rows), mapping).collect()] == [(1, 0, "leak", "+7 (701) 123-45-67")]


def test_mentions_beside_common_words_are_found_once(spark):
    """The rows returned read the mentions that were found for parsing, and do not find them again."""
    rows = queries.common_words_vetoed(spark, "/root/testdata/sf0.001")
    assert names.INITIALS_AFTER not in plan(rows)
    assert sum(r.times for r in rows.collect()) == 150
