"""Each stage of the pipeline on awkward documents, against brute force on the same input."""

import zlib

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from incognita.llm.queries import TOKENIZER

from . import brute
from .test_queries import ITEM, PROSE, TEXTS, rows_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    made = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows_of(TEXTS), "doc_id long, text string, lang string, source string, n_chars long, score string, n_words int").repartition(3).write.parquet(f"{made}/documents.parquet")
    spark.createDataFrame([(i, 1, int("idiot" in (t or ""))) for i, t in enumerate(TEXTS)], "doc_id long, quality int, toxic int").write.parquet(f"{made}/labels.parquet")
    spark.createDataFrame([(0, ITEM), (1, "Tiny item, HERE"), (2, None)], "item_id long, text string").write.parquet(f"{made}/benchmark.parquet")
    return made


def stage(n):
    return corpus_pipeline.STAGES[n][1]


def test_stages_keep_what_brute_force_keeps(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    calm = stage(0)(spark, docs, folder)
    assert calm.columns == docs.columns and calm.exceptAll(docs).isEmpty()
    kept = stage(1)(spark, docs, folder)
    assert kept.columns == docs.columns
    known = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").distinct().collect() if r.doc_id is not None]
    expected = sorted({d for (d, _), (_, least) in zip(known, brute.groups(known, 5, 80)) if d == least})
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == expected
    assert kept.filter("doc_id is null").count() == docs.filter("doc_id is null").count()
    clean = stage(2)(spark, docs, folder)
    assert clean.columns == docs.columns
    told = [(r.doc_id, r.text) for r in docs.collect()]
    hit = brute.contamination(told, [(0, ITEM), (1, "Tiny item, HERE"), (2, None)])
    assert sorted(str((r.doc_id, r.text)) for r in clean.collect()) == sorted(str(d) for d, h in zip(told, hit) if not h[5])


def test_the_mix_repeats_whole_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    mixed = stage(3)(spark, docs, folder)
    assert mixed.columns == docs.columns
    times = {(r.doc_id, r.text): r["count"] for r in mixed.groupBy("doc_id", "text").count().collect()}
    held = {(r.doc_id, r.text): r["count"] for r in docs.groupBy("doc_id", "text").count().collect()}
    assert all(n <= 3 * held[k] for k, n in times.items())
    words = lambda t: len(brute.re.findall(brute.SPACED, t or ""))
    taken, whole = sum(n * words(t) for (_, t), n in times.items()), sum(n * words(t) for (_, t), n in held.items())
    assert abs(taken - whole) <= max(words(t) for _, t in held)


def test_run_on_all_and_on_nothing(spark, folder, tmp_path):
    found = corpus_pipeline.run(spark, folder).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = {}
    for i, text in enumerate([*TEXTS, PROSE]):
        raw = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        ids.setdefault(i if i < len(TEXTS) else None, set()).add((len(raw), zlib.crc32(raw.tobytes())))
    assert found and all((r.n_tokens, r.ids_crc32) in ids[r.doc_id] for r in found)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
