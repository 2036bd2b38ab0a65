"""Rows that are small but take work are dealt out; matches are told from gaps without compiling a pattern for each row."""

import re

import pytest
from pyspark.sql import functions as F

from incognita.functions import text as tx
from incognita.operators import detect, names
from incognita.plans import queries

TABLES = "/root/testdata/sf0.1"


def test_fragments_are_dealt_out(spark):
    assert queries.fragments(spark, TABLES).rdd.getNumPartitions() >= 7


@pytest.mark.parametrize("pattern", [detect.CARD, detect.PHONE, detect.ORG, tx.TOKEN])
def test_patterns_are_not_split_by_for_each_row(spark, pattern):
    texts = spark.createDataFrame([("ТОО «Ромашка» 4400 4300 0000 0000",), ("a\x01b +7 (701) 123-45-67\x01",), ("",), (None,)], "t string").repartition(2)
    rows = texts.select("t", tx.match_spans(F.col("t"), pattern).alias("found"))
    # The plain way is there for texts with the mark alone.
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(t" in plan.replace("contains(t", "Contains(t")
    for t, found in rows.collect():
        assert [(t[m.start : m.end], m.value) for m in found] == [(m.value, m.value) for m in found]
        assert t or found == []
    held = {t: found for t, found in rows.collect()}
    if pattern == detect.PHONE:
        assert [m.start for m in held["a\x01b +7 (701) 123-45-67\x01"]] == [4]
    if pattern == tx.TOKEN:
        assert [m.value for m in held["a\x01b +7 (701) 123-45-67\x01"]] == re.findall(r"\w+", "a\x01b +7 (701) 123-45-67\x01")[:2] + ["7", "701", "123-45-67"]


def test_numbers_written_like_others_without_a_step_for_each_character(spark):
    rows = queries.written_like(spark, TABLES)
    assert rows.rdd.getNumPartitions() >= 7
    odd = spark.createDataFrame([("+7 (701) 12", "99", "+7 (701) 99"), ("1-2", "0034", "3-4"), ("1-2", "134", "134"), ("a\x01-1\x01", "5", "a\x01-5\x01"), ("", "7", "7"), ("--", "", "--"), (None, "1", None)], "sample string, key string, want string")
    made = odd.select("want", tx.format_like(F.col("sample"), F.col("key")).alias("got"))
    assert "aggregate(" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r.got for r in made.collect()] == [r.want for r in made.collect()]


def test_notes_of_customers_are_dealt_out(spark):
    assert queries._by_customer(spark, TABLES, ("а", "б")).rdd.getNumPartitions() >= 7
    assert queries._derived(spark, TABLES, queries.BESIDE).rdd.getNumPartitions() >= 7


def test_matches_are_found_in_one_pass(spark):
    """One search that marks all matches, and not one that tells whether there are any, before two more."""
    texts = ["Иванов А. Б. и 😀 Петров-Водкин К.", "$0 \\ Ким А.", "Ким А.Ким Б.", "ничего", "", "Ким А.\x01Юнг Б."]
    rows = spark.createDataFrame([(t,) for t in (*texts, None)], "t string").repartition(2)
    made = rows.select("t", tx.match_spans(F.col("t"), names.INITIALS_AFTER).alias("found"))
    assert "RLIKE" not in made._jdf.queryExecution().optimizedPlan().toString()
    pattern = names.INITIALS_AFTER.removeprefix("(?U)")
    for t, found in made.collect():
        assert [(m.start, m.end, m.value) for m in found] == [(*m.span(), m.group()) for m in re.finditer(pattern, t or "")]


def test_patronymics_are_asked_at_the_ends_of_words(spark):
    """The same full names as with an ending that is asked at each letter."""
    assert "++(?<=" in names.FULL
    words = ["Иванов", "Иван", "Иванович", "Ивановичем", "Ильинична", "Ильиничной-Ким", "Нұрлан", "Болатұлы", "Болат ұлы", "Петровичев", "и"]
    texts = [(f"{a} {b} {c}",) for a in words for b in words for c in words]
    rows = spark.createDataFrame(texts, "t string")
    all_of = lambda p: F.regexp_extract_all("t", F.lit(p), 0)
    assert rows.filter(~all_of(names.FULL).eqNullSafe(all_of(names.FULL.replace("++(?<=", "+(?<=")))).count() == 0
    assert rows.filter(F.col("t").rlike(names.FULL)).count() > 0
