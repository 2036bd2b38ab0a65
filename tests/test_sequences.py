"""The walk along sorted sequences against a search at every place, with one first token at a third of all places."""

import random

from incognita.operators import sequences


def brute(texts, keys):
    out = []
    for doc, frag, names in texts:
        for i in range(len(names or [])):
            out += [(doc, frag, i, len(k), "".join(t + "\x01" for t in k)) for k in keys if k and tuple(names[i : i + len(k)]) == k]
    return sorted(out, key=str)


def found(spark, texts, keys):
    rows = spark.createDataFrame(texts, "doc_id long, frag_id long, names array<string>")
    return sorted(map(tuple, sequences.standing(rows, spark.createDataFrame([(list(k),) for k in keys], "key array<string>")).collect()), key=str)


def test_walk_equals_search(spark, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr(sequences, "PART_ROWS", 50)
    rng = random.Random(7)
    word = lambda: rng.choice(["а", "а", "а", "б", "ба", "аб", "в", "«", "ё", "\U0001f600"])
    texts = [(d, f, [word() for _ in range(rng.choice([0, 1, 5, 30]))]) for d in range(40) for f in range(2)]
    texts += [texts[0], (None, 0, ["а", "б"]), (99, 0, None), (98, 0, [])]
    keys = {tuple(word() for _ in range(rng.randint(1, 4))) for _ in range(60)}
    for doc, _, names in texts[:20]:
        keys |= {tuple(names[:n]) for n in (7, 11, 15) if names and len(names) >= n}
    keys = [*keys, (), ("а",), ("а",)]
    got = found(spark, texts, keys)
    assert got == brute(texts, set(keys)) and {n for *_, n, _ in got} >= {1, 2, 3, 4, 7, 11, 15}


def test_empty_tables(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    assert found(spark, [], [("а",)]) == [] and found(spark, [(1, 0, ["а"])], []) == []


def test_one_shuffled_row_for_a_place(spark, tmp_path):
    """However many lengths the sequences have that may begin there."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = spark.createDataFrame([(1, 0, ["а"] * 50 + ["б"] * 50)], "doc_id long, frag_id long, names array<string>")
    keys = spark.createDataFrame([(["а"] * n,) for n in range(1, 16)], "key array<string>")
    found = sequences.candidates(rows, keys)
    assert found.count() == 50 and found.filter("path is not null").count() == 49


def test_longest_at_each_place(spark, tmp_path, monkeypatch):
    """One row a place without grouping places again; a sequence of one token where the walk finds no longer one."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    texts = [(1, 0, ["а", "б", "в", "а", "б", "г", "а"]), (2, 0, ["а", "б"]), (None, 0, ["б", "г"]), (3, 0, None)]
    keys = [("а",), ("а", "б", "в"), ("а", "б", "г"), ("б", "в"), ("г",), ("б", "г", "а", "а")]
    rows = spark.createDataFrame(texts, "doc_id long, frag_id long, names array<string>")
    every = brute(texts, keys)
    want = sorted((max((r for r in every if r[:3] == place), key=lambda r: r[3]) for place in {r[:3] for r in every}), key=str)
    for few in (sequences.FEW, 0):
        monkeypatch.setattr(sequences, "FEW", few)
        got = sequences.standing(rows, spark.createDataFrame([(list(k),) for k in keys], "key array<string>"), longest=True)
        assert sorted(map(tuple, got.collect()), key=str) == want
        assert found(spark, texts, keys) == every


def test_few_sequences_shuffle_no_tokens(spark):
    """Places are told where the texts are read, whatever Spark knows of the sequences' size."""
    rows = spark.createDataFrame([(1, 0, ["а", "б"])], "doc_id long, frag_id long, names array<string>")
    keys = spark.createDataFrame([(["а", "б"],), (["а"],)], "key array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sequences.candidates(rows, keys)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
