"""Persons merged by levels against mentions read one after another."""

import random
import time

from pyspark.sql import functions as F

from incognita.operators import merging

KIND = "sur_key string, gender string, name string, patr string, init_n string, init_p string"
LETTERS = "АБВ"


def in_turn(mentions):
    """Each mention, fullest first, to the first person whom it does not contradict."""
    persons = {}
    low = lambda v: v and v.lower().replace("ё", "е")
    first = lambda m: (-sum(p is not None for p in m[2:]), [(p is not None, p or "") for p in m[2:]])
    for sur, gender, *parts in sorted(set(mentions), key=first):
        group = persons.setdefault((sur, gender), [])
        for k, person in enumerate(group):
            if all(a is None or b is None or low(a) == low(b) for a, b in zip(person, parts)):
                group[k] = [a or b for a, b in zip(person, parts)]
                break
        else:
            group.append(parts)
    return sorted(((*key, *p) for key, group in persons.items() for p in group), key=str)


def drawn(rng, n):
    out = []
    for _ in range(n):
        name, patr = rng.choice(LETTERS) + rng.choice(["лёна", "лена", "на", "ра"]), rng.choice(LETTERS) + rng.choice(["ич", "ович"])
        parts = rng.choice([(name, patr, name[0], patr[0]), (None, None, name[0], patr[0]), (name, None, name[0], None), (None, None, name[0], None), (None, None, None, None)])
        out.append((rng.choice(["иванов", "ким", "ли"]), rng.choice("mf"), *parts))
    return out


def persons(spark, mentions, known=()):
    held = spark.createDataFrame(list(known), "person_id string, " + KIND)
    return [tuple(r) for r in merging.merge(spark.createDataFrame(mentions, KIND), held).collect()]


def test_levels_equal_reading_in_turn(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    for seed in range(6):
        mentions = drawn(random.Random(seed), (3, 8, 15, 30, 60, 150)[seed])
        found = persons(spark, mentions)
        assert sorted((r[1:] for r in found), key=str) == in_turn(mentions), seed
        assert len({r[0] for r in found}) == len(found)


def test_known_persons_stay_and_gain_parts(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    full, other = ("ким", "m", "Иван", "Петрович", "И", "П"), ("ким", "m", "Илья", None, "И", None)
    known = [("ким|m|0", "ким", "m", None, None, "И", None), ("ким|m|1", *full), ("ким|m|2", *other)]
    found = dict((r[0], r[3:]) for r in persons(spark, [full, ("ким", "m", "Илья", "Ильич", "И", "И"), ("ким", "m", None, None, "И", "С"), ("ким", "m", None, None, "Ж", None)], known))
    assert found == {
        "ким|m|0": (None, None, "И", "С"), "ким|m|1": full[2:], "ким|m|2": ("Илья", "Ильич", "И", "И"), "ким|m|||ж|": (None, None, "Ж", None),
    }
    again = [(k, "ким", "m", *v) for k, v in found.items()]
    assert dict((r[0], r[3:]) for r in persons(spark, [full, other], again)) == found


def test_empty(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    assert persons(spark, []) == [] and len(persons(spark, [], [("a", "ким", "m", None, None, None, None)])) == 1


def test_many_mentions_of_one_surname(spark, tmp_path):
    """100,000 mentions of one surname, also of one initial: as many steps as for ten."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    n = F.col("id")
    name, patr = F.concat(F.lit("И"), (n % 400).cast("string")), F.concat(F.lit("П"), (n / 400).cast("int").cast("string"))
    none = F.lit(None).cast("string")
    rows = spark.range(100_000).select(F.lit("ким").alias("sur_key"), F.lit("m").alias("gender"), name.alias("name"), F.when(n % 5 > 0, patr).alias("patr"), F.lit("И").alias("init_n"), F.when(n % 5 > 0, "П").alias("init_p"))
    rows = rows.union(spark.range(1).select(F.lit("ким"), F.lit("m"), none, none, F.lit("И"), F.lit("С")))
    began = time.monotonic()
    found = merging.merge(rows, spark.createDataFrame([], "person_id string, " + KIND))
    # 320 of the names have patronymics; of the 80 names alone, the first takes the initials that nobody else has.
    assert found.count() == 80_000 + 80 and found.filter("init_p = 'С'").first()["name"] == "И0"
    assert time.monotonic() - began < 120
