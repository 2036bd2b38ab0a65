"""Addresses and domains that carry the stand-ins of the people and organisations that they name."""

import re

import pytest
from pyspark.sql import functions as F

from incognita import cluster
from incognita.functions import text as tx
from incognita.operators import links
from incognita.operators.replace import MAPPING
from incognita.plans import jobs

TEXTS = [
    "Принят Иванов Сергей Петрович.", "Передано Кузнецовой Марии Олеговне.", "ТОО «Ромашка» и ТОО «Белый Парус»", "пишите на s.ivanov@romashka.kz или ivanov_sp7@mail.beliyparus.kz",
    "почта kuznecova.mo@romashka.kz, ivanov@gmail.com, info@romashka.kz и user1@chuzhoy.kz", "сайт https://www.romashka.kz/", "второй ivanov@gmail.com, а также kuznetsova-m@romashka.kz",
]


@pytest.fixture(scope="module")
def learned(spark):
    cluster.prepare(spark)
    rows = spark.createDataFrame([(0, i, t, None) for i, t in enumerate(TEXTS)], "doc_id long, frag_id long, text string, hint string").checkpoint()
    known = jobs.learn(rows, spark.createDataFrame([], MAPPING), "s")
    return rows, known, {(r.family, r.key): r.fake for r in known.mapping.collect()}


def latin(spark, text):
    return spark.range(1).select(F.regexp_replace(tx.translit(F.lit(text)), "[ -]", "")).first()[0]


def test_the_stand_in_of_an_address_names_the_same_person(spark, learned):
    _, _, fakes = learned
    ivanov, kuznetsova = (latin(spark, next(v for (f, k), v in fakes.items() if f == "surname" and k.startswith(s))) for s in ("иванов|", "кузнецова|"))
    romashka, parus = latin(spark, fakes["org", "ромашка"]), latin(spark, fakes["org", "белый парус"])
    assert fakes["domain", "romashka.kz"] == f"{romashka}.kz" and fakes["domain", "beliyparus.kz"] != "beliyparus.kz"
    assert re.fullmatch(rf"[a-z]\.{ivanov}@{romashka}\.kz", fakes["email", "s.ivanov@romashka.kz"])
    assert re.fullmatch(rf"{ivanov}_[a-z]{{2}}7@mail\.[a-z]+\.kz", fakes["email", "ivanov_sp7@mail.beliyparus.kz"])
    assert re.fullmatch(rf"{kuznetsova}\.[a-z]{{2}}@{romashka}\.kz", fakes["email", "kuznecova.mo@romashka.kz"])
    assert fakes["email", "ivanov@gmail.com"] == f"{ivanov}@gmail.com" and fakes["email", "info@romashka.kz"] == f"info@{romashka}.kz"
    assert "user" not in fakes["email", "user1@chuzhoy.kz"] and parus not in fakes["email", "user1@chuzhoy.kz"]
    assert len(set(fakes.values())) == len(fakes)


def test_what_is_linked_comes_back(spark, learned):
    rows, known, _ = learned
    copies = jobs.obfuscate(rows, known).checkpoint()
    told = " ".join(r.new_text.lower() for r in copies.collect())
    assert not any(word in told for word in ("ivanov", "kuznec", "kuznets", "romashka", "ромашка", "иванов", "кузнецов"))
    back = jobs.restore(copies.select("doc_id", "frag_id", F.col("new_text").alias("text"), "hint"), known)
    assert {r.frag_id: r.new_text for r in back.collect()} == dict(enumerate(TEXTS))


def found(spark, addresses, people):
    people = spark.createDataFrame([(f"{i}", s, g) for i, (s, g) in enumerate(people)], "person_id string, sur string, gender string")
    rows = links.surnames_within(spark.createDataFrame([(a,) for a in addresses], "key string"), people).collect()
    return {r.key: (r.at, r.spelling, r.person.sur) for r in rows}


def test_the_longest_surname_counts(spark):
    cluster.prepare(spark)
    people = [("Иван", "m"), ("Иванов", "m"), ("Иванова", "f"), ("Ким", "m"), ("Хрящев", "m"), ("Цой", "m"), ("Толстой-Южный", "m"), ("Петровский", "m")]
    got = found(spark, ["ivanov1@a.kz", "vivanovai@a.kz", "kim@a.kz", "hryaschev@a.kz", "x.khriaschev@a.kz", "tolstoyyuzhnyy@a.kz", "petrovskivanov@a.kz", "petrovski@a.kz", "iva@b.kz", "ivanivan@b.kz", "info@b.kz", "@", "ivan", None], people)
    assert got == {
        "ivanov1@a.kz": (0, "ivanov", "Иванов"), "vivanovai@a.kz": (1, "ivanova", "Иванова"), "hryaschev@a.kz": (0, "hryaschev", "Хрящев"), "x.khriaschev@a.kz": (2, "khriaschev", "Хрящев"),
        "tolstoyyuzhnyy@a.kz": (0, "tolstoyyuzhnyy", "Толстой-Южный"), "petrovskivanov@a.kz": (0, "petrovski", "Петровский"), "petrovski@a.kz": (0, "petrovski", "Петровский"), "ivanivan@b.kz": (0, "ivan", "Иван"), "ivan": (0, "ivan", "Иван"),
    }


def test_nobody_and_nothing(spark):
    cluster.prepare(spark)
    assert found(spark, ["ivanov@a.kz"], []) == {} and found(spark, [], [("Иванов", "m")]) == {}
    none = spark.createDataFrame([], "key string, fake string")
    assert links.linked_domains(spark.createDataFrame([("a.kz",), (None,)], "key string"), none).count() == 0


def test_addresses_with_one_stand_in_are_numbered(spark):
    cluster.prepare(spark)
    people = spark.createDataFrame([("1", "Юдин", "m", "Норберг", "Эгон", None)], "person_id string, sur string, gender string, f_sur string, f_name string, f_patr string")
    addresses = ["yudin@a.kz", "iudin@a.kz", "a.yudin@a.kz", "b.yudin@a.kz", "yudin@b.kz", "yudin1990@a.kz", "yudinbest@a.kz"]
    got = {r.key: r.fake for r in links.linked_addresses(spark.createDataFrame([(a,) for a in addresses], "key string"), people).collect()}
    assert got["yudin@b.kz"] == "norberg@b.kz" and {got["yudin@a.kz"], got["iudin@a.kz"]} == {"norberg@a.kz", "norberg2@a.kz"}
    assert {got["a.yudin@a.kz"], got["b.yudin@a.kz"]} == {"e.norberg@a.kz", "e.norberg2@a.kz"}
    assert got["yudin1990@a.kz"] == "norberg1990@a.kz" and got["yudinbest@a.kz"] == "norbergbest@a.kz"
