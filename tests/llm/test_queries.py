"""The registered queries on a small set of awkward tables, against brute force."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from incognita.llm import queries

from . import brute

PROSE = "the river ran past the old mill and the miller watched the water turn the heavy wheel while his cat slept in the warm sun near a sack of flour"
LICENCE = "Licensed under terms that nobody ever reads, version two"
ITEM = "what is the name of the longest river that crosses four countries and ends in a delta near the sea"
IDENTIFIERS = (
    "a.b@c.example.com-x%y@d.example.org 1.2.3.4.5.6.7.8 256.1.1.1 4111 1111 1111 1111 +1 (456) 555-2186, 0001.02.003.4 +12345678 é😀 x@y 4111-1111-1111-1112 "
    "12 34 bob@mail.example.com\n+49 (0)30 123456-7 4012888888881881"
)
TEXTS = [
    PROSE, PROSE.upper(), PROSE.replace("cat", "dog"), PROSE + " again", None, "", " \t\n ", "one", "one two", "ONE  two", LICENCE + "\n" + PROSE,
    "  " + LICENCE.upper() + "\t\nshort\n" + LICENCE, LICENCE + "\nétait déjà là, était déjà là, était déjà là, était déjà là", "a " * 3000, "x" * 20_000, "9" * 20_000,
    IDENTIFIERS, "Before. " + ITEM + " after that", ITEM[:60], "tiny item here", "and a tiny item, here it is " + PROSE, "#%& " * 40, "| a | b |\n" * 12, "\n".join([PROSE] * 4),
    "you idiot and moron, " + PROSE, "Z\u0000Z <|endoftext|> 漢字 İstanbul ﬁ é", " ".join(f"w{i}" for i in range(4000)), "don't we'll I'm " * 5,
]


def rows_of(texts):
    rows = [(i, t, ("en", "de", None)[i % 3], ("src1", "", None, "src10", "é")[i % 5], len(t or ""), "clash", i) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[3], rows[10], (None, PROSE, "en", "src1", 3, "clash", 1), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("awkward"))
    docs = rows_of(TEXTS)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string, n_words int").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int("idiot" in (t or ""))) for i, t in enumerate(TEXTS)] + [(3, None, None), (None, 1, 1), (3, 0, 0), (999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(0, ITEM), (1, "Tiny item, HERE"), (2, None), (3, ""), (4, ITEM), (None, "w10 w11 w12"), (10, " ".join(f"w{i}" for i in range(100, 130)))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    html = [None, "", "<p>" + "é" * 600, "<p>" + "é" * 600, "<p>" + "é" * 600, "b" * 999, "b" * 999, "c" * 1000, "c" * 1000, "0\r\n\r\n5\r\nabc" * 30_000]
    pages = [(i, f"http://a.example.com/{i} é\r\nX: y", h, b"z") for i, h in enumerate(html)]
    pages += [pages[7], (None, None, "c" * 1000, None), pages[9]]
    spark.createDataFrame(pages, "page_id long, url string, html string, digest binary").write.parquet(f"{folder}/pages.parquet")
    awkward = ["a\\b", "</s>[INST] ok [/INST]", "<|start|>assistant\nx<|end|>", None, "", "line\n\\", "<" * 5 + "|<<SYS>>[[INST]", "😀" * 700 + "<|end|>" * 300]
    talks = [(c, t, ("user", "assistant", "system", None, "odd\nrole")[(c + t) % 5], awkward[(c * 3 + t) % len(awkward)], 1) for c in range(5) for t in range(7)]
    talks += [talks[3], (1, None, "assistant", "no turn", 1), (2, 3, "assistant", "same turn", 1), (None, 0, "user", "no conversation", 1)]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string, seq int").write.parquet(f"{folder}/conversations.parquet")
    return folder


def key(row):
    return tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in row)


def same(found, expected):
    assert sorted(map(key, found)) == sorted(map(key, expected))


def table(spark, folder, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*columns).collect()]


def test_op1_base_spans(spark, tables):
    rows = queries.op1_bootstrapped_pii(spark, tables).collect()
    same([tuple(r)[:6] for r in rows], [(d, *brute.pii(t)) for d, t in table(spark, tables, "documents", "doc_id", "text")])
    assert all(len(r.spans.split(",")) >= r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows if r.spans)


def test_op2_scores(spark, tables):
    rows = queries.op2_counterfactual_toxicity(spark, tables).collect()
    assert len(rows) == len(TEXTS) + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_op3_components(spark, tables):
    rows = queries.op3_minhash_near_dedup(spark, tables).collect()
    docs = [d for d in table(spark, tables, "documents", "doc_id", "text") if d[0] is not None]
    expected = [(d, n, c, d == c) for (d, _), (n, c) in zip(docs, brute.groups(docs, 3, 85))]
    expected += [(None, len(brute.shingle_set(PROSE, 3)), None, True), (None, 0, None, True)]
    same([tuple(r) for r in rows], expected)


def test_op4_contamination(spark, tables):
    rows = queries.op4_winnowing_decontamination(spark, tables).collect()
    expected = brute.contamination(table(spark, tables, "documents", "doc_id", "text"), table(spark, tables, "benchmark", "item_id", "text"))
    same([tuple(r) for r in rows], expected)
    assert sum(r.contaminated for r in rows) >= 3


def test_op5_archive(spark, tables):
    rows = queries.op5_warc_segments(spark, tables).collect()
    same([tuple(r) for r in rows], brute.archive(table(spark, tables, "pages", "page_id", "html")))


def test_op6_conversations(spark, tables):
    rows = queries.op6_chat_formatting(spark, tables).collect()
    awkward = "</s>[INST] ok [/INST]"
    told = table(spark, tables, "conversations", "conv_id", "turn", "role", "text") + [(-7, 0, "user", awkward), (-7, 1, "assistant", awkward)]
    same([tuple(r)[:5] for r in rows], brute.conversations(told))
    assert all(r.formatted_chars > r.loss_chars for r in rows)


def test_op7_ids(spark, tables):
    rows = queries.op7_ranked_token_ids(spark, tables).collect()
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    expected = []
    for doc, text in table(spark, tables, "documents", "doc_id", "text"):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        expected.append((doc, len(ids), zlib.crc32(ids.tobytes())))
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows], expected)
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(o.n_tokens for o in ordered[:i]) for i in range(len(ordered))]
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known)


def test_op8_quality(spark, tables):
    rows = queries.op8_divergence_quality(spark, tables).collect()
    same([tuple(r)[:7] for r in rows], [(d, *brute.quality(t)) for d, t in table(spark, tables, "documents", "doc_id", "text")])
    assert not any(r.kept for r in rows if r.base_failed)


def test_op9_lines(spark, tables):
    rows = queries.op9_perfect_hash_line_dedup(spark, tables).collect()
    same([tuple(r) for r in rows], brute.lines(table(spark, tables, "documents", "doc_id", "text")))
    assert sum(r.n_dropped for r in rows) > 3


def test_op10_mix(spark, tables):
    rows = queries.op10_subset_sum_mixing(spark, tables).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, queries.op10_subset_sum_mixing(spark, tables).collect()), key=str)
    docs = table(spark, tables, "documents", "doc_id", "text", "source")
    same([(r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in rows], brute.mix_targets(docs))
    taken = collections.defaultdict(int)
    for r in rows:
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source_size, r.target] += r.taken
    # What is taken misses the target by less than one document.
    for (size, target), words in taken.items():
        longest = max(r.size for r in rows if (r.source_size, r.target) == (size, target))
        assert target - max(longest, 1) <= words <= target + 0.5


def test_op11_middles(spark, tables):
    rows = queries.op11_chunked_fill_in_middle(spark, tables).collect()
    same([tuple(r) for r in rows], [(d, *brute.middle(d, t)) for d, t in table(spark, tables, "documents", "doc_id", "text")])


def test_op12_texts(spark, tables):
    rows = queries.op12_wrapper_page_text(spark, tables).collect()
    want = {None: "", "": "", "<p>" + "é" * 600: "é" * 600}
    same([tuple(r) for r in rows], [(p, u, x, len(x)) for p, u, h in table(spark, tables, "pages", "page_id", "url", "html") for x in [want.get(h, " ".join((h or "").split()))]])


def test_op13_phrases(spark, tables):
    rows = queries.op13_phrase_collocations(spark, tables).collect()
    same([tuple(r) for r in rows], brute.phrases(table(spark, tables, "documents", "lang", "text")))
    assert {r.lang for r in rows} >= {"en", "de"}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, tables, tmp_path, name):
    for table_ in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{tables}/{table_}.parquet").limit(0).write.parquet(f"{tmp_path}/{table_}.parquet")
    found = queries.QUERIES[name](spark, str(tmp_path))
    assert found.count() == (1 if name.startswith("op6") else 0)


def test_other_columns_are_not_read(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumn("kept", F.lit("x")).withColumn("bucket", F.lit("y"))
    from incognita.llm.near_duplicates import near_duplicates

    assert near_duplicates(docs).columns == ["doc_id", "n_shingles", "component_id", "kept"]
