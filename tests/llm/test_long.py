"""Very long texts, and texts with very many matches, in time that grows with their length; groups that are hot."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from incognita.llm import chat, decontamination, line_dedup, near_duplicates, pii, quality, token_ids, warc
from incognita.llm.queries import TOKENIZER

from . import brute


def seconds(job):
    began = time.time()
    out = job()
    return out, time.time() - began


def test_many_matches_in_one_text(spark):
    text = "\n".join(f"write to user{i}@mail.example.com or call +1 (456) 555-{i % 10000:04d}" for i in range(10_000))
    docs = spark.createDataFrame([(1, text), (2, "x" * 2_000_000 + " call +1 (456) 555-2186")], "doc_id long, text string")
    rows, took = seconds(lambda: {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()})
    base = sorted((s.start, s.kind, s.end) for s in rows[1] if s.kind != pii.FOUND)
    assert base == sorted((a, k, b) for a, _, k, b in brute.base_spans(text)) and len(rows[2]) == 1
    assert took < 90


def test_long_roles_texts_and_conversations(spark):
    role, text = "r\\" * 50_000 + "\n", "<|end|>é\\" * 300_000
    rows = [(1, 0, role, text), (1, 1, "assistant", text[::-1])] + [(2, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(20_000)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.read_back(chat.render(chat.fold_events(chat.conversation_events(talks))).checkpoint())
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    got, took = seconds(lambda: sorted(tuple(r) for r in found.select("conv_id", F.size("turns"), digest, F.char_length("loss_text"), F.sha2("loss_text", 256)).collect()))
    assert got == sorted(brute.conversations(rows)) and took < 120


def test_spans_are_places_of_the_whole(spark):
    messages = spark.createDataFrame([(1, 0, "a", "us\ner", "x<|y"), (1, 1, "b", "assistant", "é😀[INST]"), (1, 2, "c", "assistant", "")], "conv_id long, first_seq long, message_id string, role string, text string")
    row = chat.render(messages).first()
    assert [row.formatted[s.start : s.start + s.length] for s in row.spans] == ["x<\\|y", "é😀[\\INST]", ""] and [s.loss for s in row.spans] == [False, True, True]


def test_the_log_has_edits_and_regenerations(spark):
    talks = spark.createDataFrame([(1, i, "user", f"text {i}") for i in range(40)], "conv_id long, turn long, role string, text string")
    log = chat.conversation_events(talks)
    assert {r.event for r in log.select("event").distinct().collect()} == {"start", "delta", "edit", "regenerate"}


def test_a_page_of_many_segments(spark):
    html = "0\r\n\r\n<p>é" * 5_000_000
    pages = spark.createDataFrame([(1, "http://a", html), (2, "http://b", html), (3, "http://c", "short")], "page_id long, url string, html string")
    rows, took = seconds(lambda: {r.page_id: r for r in warc.archive(pages).drop("payload").collect()})
    raw = html.encode()
    assert rows[2].payload_bytes == len(raw) and rows[2].payload_digest == hashlib.sha1(raw).hexdigest() and rows[1].refers_to == 2 and took < 180


def test_a_language_of_empty_texts(spark):
    docs = spark.createDataFrame([(1, "some words", "en"), (2, "", "xx"), (3, None, "yy"), (4, None, None)], "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in quality.judge_quality(docs).select("doc_id", "n_words", "kept").collect()) == [(1, 2, False), (2, 0, False), (3, 0, False), (4, 0, False)]


def test_a_repeated_word_against_a_repeated_word(spark):
    docs = spark.createDataFrame([(1, "la " * 200_000), (2, "ti " * 12)], "doc_id long, text string")
    items = spark.createDataFrame([(i, "la " * 3_000) for i in range(3)] + [(9, "ti " * 20)], "item_id long, text string")
    rows = {r.doc_id: (r.n_hit, r.items) for r in decontamination.decontaminate(docs, items).collect()}
    assert rows == {1: (200_000, ["0", "1", "2"]), 2: (0, [])}


def test_a_line_that_all_hold(spark):
    docs = [(i, f"this line is in all of the documents\nown line number {i} of the document\nshort") for i in range(3_000)]
    found = line_dedup.deduplicate_lines(spark.createDataFrame(docs, "doc_id long, text string"), keys_per_shard=2, probes_per_task=100)
    assert [tuple(r) for r in found.groupBy("n_lines", "n_dropped").agg(F.count("*")).orderBy("n_dropped").collect()] == [(3, 0, 1), (3, 1, 2_999)]


def test_files_of_limited_size(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} and more words") for i in range(3_000)], "doc_id long, text string").repartition(2)
    with open(TOKENIZER, encoding="utf-8") as file:
        definition = file.read()
    manifest = token_ids.write_ids(docs, definition, f"file://{tmp_path}/small", file_bytes=1)
    one = token_ids.read_ids(spark, f"file://{tmp_path}/small", manifest).collect()
    whole = token_ids.token_ids(docs, TOKENIZER).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, whole))


def test_words_of_all_kinds_get_the_ids_of_the_whole_text():
    with open(TOKENIZER, encoding="utf-8") as file:
        encoder = token_ids.Encoder(file.read())
    import pyarrow as pa

    rng = np.random.default_rng(7)
    kinds = ["a", "B", "é", "É", "é", "漢", "7", "77", "'s", "'", "<", "<|endoftext|>", "-", "_", ".", "​", "ß", "İ", "÷", "ﬁ", " ", "  ", "\n", "\t", " ", "😀", "\x00", "</w>"]
    texts = ["".join(rng.choice(kinds, rng.integers(0, 12))) for _ in range(4_000)]
    ids, counts = encoder.encode(*token_ids.ta.buffers(pa.array(texts)), 2)
    ends = np.cumsum(counts)
    for text, end, count in zip(texts, ends, counts):
        assert ids[end - count : end - 1].tolist() == encoder.library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_slices_and_stars_of_stars_change_nothing(spark, seed):
    """Groups of variants of a few texts, which share passages; compared by brute force."""
    rng = np.random.default_rng(seed)
    common = [f"p{i}" for i in range(12)]
    docs = []
    for i in range(240):
        base = i % 6
        own = [f"b{base}w{j}" for j in range(30)] + common
        for at in rng.choice(42, rng.integers(0, 7), replace=False):
            own[at] = f"x{rng.integers(0, 5)}"
        docs.append((i, " ".join(own)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).checkpoint()
    expected = {d: e for (d, _), e in zip(docs, brute.groups(docs, 2, 60))}
    for limits in ({}, {"comparisons_per_slice": 4_000, "fan": 3}):
        found = near_duplicates.near_duplicates(table, 2, 60, bands=32, band_rows=2, **limits).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
