from incognita.operators import audit


def test_stems_with_hyphens_and_short_first_words(spark):
    texts = [(1, "договор с ТД-Востоком"), (2, "для Юг  Строя и других"), (3, "тд и восток"), (4, "строй на юге"), (5, "О'Нил"), (6, "(а.б) и a\\E"), (7, None)]
    stems = [("тд-восток",), ("юг строй",), ("юг стро",), ("о'нил",), ("а.б",), ("восток",), ("a\\e",)]
    found = audit.holding(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(stems, "stem string"))
    expected = {(1, "тд-восток"), (1, "восток"), (2, "юг стро"), (3, "восток"), (5, "о'нил"), (6, "а.б"), (6, "a\\e")}
    assert sorted(map(tuple, found.collect())) == sorted(expected)
