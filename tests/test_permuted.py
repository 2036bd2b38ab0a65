"""Keyed permutations of numbers: bijective by construction, valid, never a real number, also where numbers are crowded."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from incognita.functions import checks
from incognita.operators import permuted as pm

NONE = "family string, key string, fake string"
FAMILY = {"iin": "number12", "bin": "number12", "num12": "number12"}


def numbers(prefix, n):
    return [f"{prefix}{i:0{n}d}" for i in range(10**n)]


def given(spark, keys, typ, known=(), secret="s"):
    rows = spark.createDataFrame([(typ, FAMILY.get(typ, typ), k) for k in keys], "typ string, family string, key string")
    found = pm.permuted(rows, spark.createDataFrame(list(known), NONE), secret)
    return {r.key: r.fake for r in found.collect()}


@pytest.mark.parametrize("typ, keys", [("rekv", numbers("77", 3)), ("phone", numbers("701", 4)), ("bin", numbers("9504401", 5)[::7]), ("num12", numbers("38123456", 4)), ("inn", numbers("771234", 4))])
def test_maps_are_permutations(typ, keys):
    """Of all numbers of a part, or of many: a map sends different ones to different ones, and its inverse leads back."""
    maps = pm.Maps("s")
    parts = [z for k in keys if (z := pm.read(typ, k)) is not None and pm.write(z) == k]
    for t in (0, 3):
        images = [maps.walk(z, t) for z in parts]
        assert len({v for _, v in images}) == len(parts) > 90
        assert all(maps.walk(after, t, -1)[0] == z for z, (after, _) in zip(parts, images))


def test_parts_are_written_back():
    rng = random.Random(3)
    for typ, n in (("phone", 10), ("acc20", 20), ("rekv", 13), ("num12", 12), ("rekv", 8), ("rekv", 3)):
        for _ in range(300):
            key = "".join(rng.choice("0123456789") for _ in range(n))
            assert pm.write(pm.read(typ, key)) == key
    assert [pm.read(*x) for x in (("phone", "70112x4567"), ("num12", "123"), ("inn", "123456789"), ("card", ""), ("passport", "1"), ("phone", "٧٠١١٢٣٤٥٦٧"))] == [None] * 6


def test_dates_of_birth_move_and_sex_stays():
    maps, keys = pm.Maps("s"), []
    for day, serial in itertools.product(("000229", "991231", "850101", "450615", "010101"), range(0, 9999, 487)):
        for century in "3456":
            body = f"{day}{century}{serial:04d}"
            if (check := pm.kz_digit(body)) is not None and pm._born(body + check):
                keys.append(body + check)
    fakes = [maps.image(pm.read("iin", k), 0)[1] for k in keys]
    for key, fake in zip(keys, fakes):
        if fake is not None:
            assert pm.kind_of("num12", fake) == "iin" and 20 <= abs((pm._born(fake) - pm._born(key)).days) <= 400 and (int(fake[6]) - int(key[6])) % 2 == 0
    assert len(set(fakes) - {None}) >= 0.95 * len(keys)


def test_check_digits_agree_with_the_columns(spark):
    rows = spark.createDataFrame([(f"{(i * 7919 + 850101300000) % 10**12:012d}",) for i in range(3000)], "k string")
    found = rows.select("k", checks.kz_valid(F.col("k")).alias("v"), checks.classify12(F.col("k")).alias("c")).collect()
    for r in found:
        kind = pm.kind_of("num12", r.k)
        assert (kind != "x12") == r.v and (r.c if r.v and r.c != "num12" else "v12" if r.v else "x12") == kind


@pytest.mark.parametrize("typ, keys", [
    ("card", ["4400430000000000", "4400430000000018", "4400430000000026"]), ("iban", ["KZ86125KZT0000000001", "KZ00125KZT0000000001", "KZ11125KZT0000000001", "KZ86125ABCDEFGHIJKLM"]),
    ("inn", ["7700000000", "7700000001", "7700000002", "7700000019", "770000000012"]), ("phone", numbers("701", 7)[::40_000]), ("rekv", ["12345678", "1234567890123"]), ("acc20", ["40817810000000000001"]),
])
def test_stand_ins_are_valid_unique_and_not_real(spark, typ, keys):
    found = given(spark, keys, typ)
    assert set(found) == set(keys) and len(set(found.values())) == len(keys) and not set(found.values()) & set(keys)
    valid = {"card": checks.luhn_valid, "iban": checks.iban_valid, "inn": checks.inn_valid}.get(typ)
    if valid:
        rows = spark.createDataFrame([(v,) for v in found.values()], "v string")
        assert rows.filter(~valid(F.col("v"))).count() == 0
    assert all(len(k) == len(v) for k, v in found.items())
    assert given(spark, keys[::-1] + keys, typ) == found


@pytest.mark.parametrize("share", [0.02, 0.1, 0.3, 0.5])
def test_crowded_parts(spark, share):
    """Up to half of all numbers of a part are real: each still gets a stand-in of its own that is none of them."""
    keys = random.Random(5).sample(numbers("77", 3), int(1000 * share))
    found = given(spark, keys, "rekv")
    assert set(found) == set(keys) and len(set(found.values())) == len(keys) and not set(found.values()) & set(keys)


def test_nothing_left_is_an_error(spark):
    with pytest.raises(ValueError):
        given(spark, numbers("77", 1)[:6], "rekv")
    with pytest.raises(ValueError):
        given(spark, ["70112345"] + ["+70112345"], "phone")
    assert given(spark, [], "phone") == {}


def test_later_runs_keep_clear_of_earlier_ones(spark):
    """Numbers given before are neither real values nor stand-ins of later numbers, in whatever order they come."""
    keys = numbers("77", 3)
    rng, known = random.Random(9), []
    for _ in range(4):
        fresh = [k for k in rng.sample(keys, 60) if k not in {x for _, *pair in known for x in pair}]
        found = given(spark, fresh, "rekv", known)
        known += [("rekv", k, v) for k, v in found.items()]
    real, fakes = [k for _, k, _ in known], [v for *_, v in known]
    assert len(set(fakes)) == len(fakes) > 120 and not set(real) & set(fakes)


def test_another_secret_gives_others(spark):
    keys = numbers("701", 7)[:50]
    assert not set(given(spark, keys, "phone", secret="s" * 100).values()) & set(given(spark, keys, "phone").values())
