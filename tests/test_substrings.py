"""Substrings by equality, against the plain search."""

import random

from incognita import cluster
from incognita.operators import audit, substrings


def test_places_equal_plain_search(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(30))) for _ in range(60)] + ["", None, "aaaaaaaa", "x" * 300 + "needle" + "y" * 300]
    pieces = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(25)] + ["", None, "aaaa", "x" * 280 + "need", "needle", "zz"]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = sorted(tuple(r) for r in substrings.places(rows, spark.createDataFrame([(p,) for p in pieces], "piece string")).collect())
    assert got == sorted((i, k, p) for i, t in enumerate(texts) if t for p in set(pieces) if p for k in range(len(t)) if t.startswith(p, k))
    none = spark.createDataFrame([], "piece string")
    assert substrings.places(rows, none).count() == 0


DOCS = [
    (1, "Приехал Переивановский с отчётом"), (2, "ИВАНОВ и Белый  Парус"), (3, "у белого паруса нет; абелый\nпарусник"), (4, None), (5, ""), (6, "C++ и c+ +; R&D-отдел"), (7, "слово иванов-петровский"), (8, "x" * 5000 + "иванов"), (None, "иванов без номера"), (2, "второй раз Иванов"),
]
STEMS = ["иванов", "белый парус", "ый пар", "c++", "петров", "&d-от", "++", "ива", "отчет", "нет; абел"]


def test_holding_anywhere_and_at_beginnings(spark):
    cluster.prepare(spark)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    stems = spark.createDataFrame([(s,) for s in STEMS + STEMS[:2]], "stem string")
    plain = lambda t: " ".join(t.lower().replace("ё", "е").split())
    wanted = {(d, s) for d, t in DOCS if t for s in STEMS if s in plain(t) and s != "++"} - {(None, s) for s in STEMS}
    got = {tuple(r) for r in audit.holding(docs, stems, inside=True).collect()}
    assert got - {(None, "иванов"), (None, "ива")} == wanted
    begins = {(d, s) for d, s in wanted if any(d == e and t and any(plain(t).startswith(s, k) and (k == 0 or not (plain(t)[k - 1].isalnum() or plain(t)[k - 1] == "_")) for k in range(len(t))) for e, t in DOCS)}
    found = {tuple(r) for r in audit.holding(docs, stems).collect()}
    assert found - {(None, "иванов"), (None, "ива")} == begins


def test_words_shorter_than_all_pieces_are_not_searched(spark, monkeypatch):
    cluster.prepare(spark)
    asked, places = [], substrings.places
    monkeypatch.setattr(audit.substrings, "places", lambda texts, pieces: asked.append(texts) or places(texts, pieces))
    docs = spark.createDataFrame([(1, "он и the иванова иванов петров"), (2, "the иванов по ивановский по")], "doc_id long, text string")
    stems = spark.createDataFrame([("иванов по",), ("вано",)], "stem string")
    for few in (audit.FEW, 0):
        monkeypatch.setattr(audit, "FEW", few)
        assert {tuple(r) for r in audit.holding(docs, stems, inside=True).collect()} == {(1, "вано"), (2, "вано"), (2, "иванов по")}
    assert {r.key for r in asked[0].collect()} == {"иванова", "иванов", "петров", "ивановский"}
