"""Parts of the operators by themselves."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from incognita.llm import chat, decontamination, line_dedup, mixing, near_duplicates, quality, token_ids, toxicity, warc
from incognita.llm import text_arrays as ta

from . import brute


@given(st.lists(st.text(alphabet="aB \t\né漢\x00,", max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_and_base_counts(texts):
    data, offsets = ta.buffers(pa.array(texts, pa.string()))
    found = quality.base_counts(data, offsets)
    for i, text in enumerate(texts):
        assert tuple(found[c][i] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute.quality(text)[:5]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
@settings(max_examples=60, deadline=None)
def test_ranks_come_back(ranks):
    ranks = np.array(ranks, np.uint32)
    assert np.array_equal(token_ids.unpack(*token_ids.pack(ranks), len(ranks)), ranks)


@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
@settings(max_examples=30, deadline=None)
def test_perfect_hash_is_minimal(keys):
    h1 = np.array(sorted(keys), np.int64)
    h2 = h1 ^ 0x5555
    found = line_dedup.PerfectHash.build(h1, h2).index(h1, h2)
    assert sorted(found) == list(range(len(h1)))


@given(st.integers(0, 60), st.lists(st.tuples(st.integers(1, 12), st.integers(0, 3)), max_size=4, unique_by=lambda x: x[0]))
@settings(max_examples=80, deadline=None)
def test_knapsack_is_best(budget, kinds):
    lengths, counts = np.array([k for k, _ in kinds], np.int64), np.array([n for _, n in kinds], np.int64)
    picked = mixing.bounded_knapsack(budget, lengths, counts)
    sums = [sum(k * n for (k, _), n in zip(kinds, combo)) for combo in itertools.product(*(range(n + 1) for _, n in kinds))]
    assert (picked <= counts).all() and int((picked * lengths).sum()) == max(x for x in sums if x <= budget)


def test_fit_is_near_and_within_budget():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(1, 5_000, 900))
    counts = rng.integers(1, 40, len(lengths))
    for share in (0.1, 0.5, 0.99):
        budget = int((lengths * counts).sum() * share)
        picked = mixing.fit(budget, lengths, counts)
        assert (picked <= counts).all() and (picked >= 0).all() and (picked * lengths).sum() == budget


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 0), ("Ω", 1)], "source string, words long").repartition(3)
    found = {r.source: r.target for r in mixing.targets(sizes, (1, 2, 3)).collect()}
    assert found[None] == 0 and found["a"] == 30 and found["Ω"] == 3 and abs(sum(found.values()) - 1011) < 1e-9


def test_winnowing_finds_every_shared_span():
    rng = np.random.default_rng(2)
    for _ in range(50):
        words = rng.integers(0, 4, 60).astype(ta.U64)
        at = int(rng.integers(0, 47))
        other = np.concatenate([rng.integers(0, 4, 20).astype(ta.U64), words[at : at + 13], rng.integers(0, 4, 20).astype(ta.U64)])
        _, a = decontamination.winnow(words, np.zeros(60, int), 7, 7)
        _, b = decontamination.winnow(other, np.zeros(53, int), 7, 7)
        assert {x - at for x in a if at <= x <= at + 6} & {x - 20 for x in b if 20 <= x <= 26}


def test_benchmark_in_blocks_gives_the_same(spark):
    docs = spark.createDataFrame([(1, "w1 w2 w3 " * 9 + "tail end"), (2, "a b c d"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(f"w{1 + (i + j) % 3}" for j in range(14))) for i in range(5)] + [(9, "c d")], "item_id long, text string")
    one = decontamination.decontaminate(docs, items).select("doc_id", "n_words", "n_hit", "items").collect()
    many = decontamination.decontaminate(docs, items, block_words=20).select("doc_id", "n_words", "n_hit", "items").collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and {r.doc_id: r.n_hit for r in one} == {1: 27, 2: 2, 3: 0}


def test_chunks():
    payload = b"x\r\n0\r\n" * 5000
    assert warc.dechunked(warc.chunked(payload, 7)) == payload and warc.dechunked(warc.chunked(b"")) == b""
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_missing_segments_are_errors(spark, tmp_path):
    parts = list(warc.records_of(1, "http://a", b"y" * 500, "0" * 40, None, "0-0", 100))
    assert len(parts) > 3
    import gzip

    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts[:2] + parts[3:]))
    with pytest.raises(Exception, match="segments do not add up"):
        warc.read_archives(spark, str(tmp_path), spark.createDataFrame([(f.name,) for f in tmp_path.glob("*.warc.gz")], "file string")).collect()


def test_events_are_folded(spark):
    rows = [
        ("c", "m1", 1, "start", "user", ""), ("c", "m1", 2, "delta", None, "he"), ("c", "m1", 3, "delta", None, "llo"), ("c", "m2", 4, "start", "assistant", ""),
        ("c", "m2", 5, "delta", None, "bad"), ("c", "m2", 6, "regenerate", None, ""), ("c", "m2", 7, "delta", None, "good"), ("c", "m1", 8, "edit", None, "hi"),
        ("c", "m1", 9, "delta", None, "!"), ("c", "m3", 10, "start", "user", "gone"), ("c", "m3", 11, "delete", None, None), (None, "m", 1, "start", None, None),
    ]
    log = spark.createDataFrame(rows, "conv_id string, message_id string, seq long, event string, role string, text string")
    found = chat.read_back(chat.render(chat.fold_events(log.repartition(3)))).orderBy("conv_id").collect()
    assert [(r.conv_id, [(t.role, t.text) for t in r.turns], r.loss_text) for r in found] == [(None, [("", "")], ""), ("c", [("user", "hi!"), ("assistant", "good")], "good")]


def test_escaped_texts_hold_no_control_strings(spark):
    texts = ["<|end|>", "\\<|", "<\\|", "a<s>b</s>[INST][/INST]<<SYS>><</SYS>>", "\\\\", "<<|", "[[INST]"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and not any(c in r.e for c in chat.CONTROL) for r in rows)


def test_identity_terms_weigh_little():
    """Toxic texts name one group more often; with the penalty the name itself moves the score less."""
    rng = np.random.default_rng(3)
    vocabulary = ta.mix(np.arange(1, 400, dtype=ta.U64))
    names = toxicity._word_hashes(["muslim", "christian"])
    rude = ta.mix(np.array([10_001], dtype=ta.U64))
    rows, y = [], []
    for i in range(600):
        own = rng.choice(vocabulary, 20, replace=False)
        toxic = i % 3 == 0
        parts = [own, rude if toxic and i % 2 else own[:0], names[:1] if rng.random() < (0.7 if toxic else 0.1) else own[:0]]
        rows.append(np.unique(np.concatenate(parts)))
        y.append(float(toxic))
    words = np.unique(np.concatenate([vocabulary, names, rude, np.array(sorted(toxicity._SWAPS), ta.U64)]))
    at = np.searchsorted(words, names[0])
    free, _ = toxicity.fit(rows, np.array(y), words, 1e-3, 0.0)
    held, _ = toxicity.fit(rows, np.array(y), words, 1e-3, 5.0)
    change = lambda w: abs(w[at] - w[np.searchsorted(words, ta.U64(toxicity._SWAPS[int(names[0])]))])
    assert change(held) < 0.5 * change(free)
    assert held[np.searchsorted(words, rude[0])] > 0.5


def test_held_out_labels_are_told(spark):
    """On the small tables: nearly all held-out labels are met."""
    from incognita.llm import queries

    folder = "/root/testdata/sf0.1"
    rows = queries.op2_counterfactual_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert right > 0.97
    assert sum(r.predicted for r in rows if r.toxic) > 0.85 * sum(r.toxic for r in rows)


def test_sketches_of_similar_sets_agree():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 300).astype(ta.U64)
    sets = [np.unique(base), np.unique(np.concatenate([base[:280], rng.integers(0, 2**63, 20).astype(ta.U64)])), np.unique(base[:2])]
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    sketch = near_duplicates.densified_sketch(np.concatenate(sets), first, 192)
    assert 0.75 < (sketch[0] == sketch[1]).mean() < 1 and (sketch[0] == sketch[2]).mean() < 0.1
    assert len(set(sketch[2].tolist())) == 2


def test_large_near_copy_group(spark):
    """A base text, hundreds of copies with two or more words changed, and chains: as brute force has them."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(150)]
    docs = [(0, " ".join(words))]
    for i in range(1, 200):
        own = list(words)
        for at in rng.choice(150, 1 + i % 9, replace=False):
            own[at] = f"x{rng.integers(0, 40)}"
        docs.append((i, " ".join(own)))
    for i in range(200, 215):  # each drops five more words
        docs.append((i, " ".join(f"c{j}" for j in range(5 * (i - 200), 120 + 5 * (i - 200)))))
    found = near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), 3, 85).collect()
    expected = brute.groups(docs, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {d: e for (d, _), e in zip(docs, expected)}
    sliced = near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85, comparisons_per_slice=3_000).collect()
    assert sorted(map(str, found)) == sorted(map(str, sliced))


def test_further_stars_have_bounded_arms(spark):
    """A bucket of 6,000 nodes that nothing links, and one where most are of one component: no centre has many arms, all nodes are asked."""
    rows = spark.range(6_000).selectExpr("explode(array(1L, 2L)) as bucket", "6000L as n", "id as nid").selectExpr("*", "if(bucket = 2 and nid % 3 > 0, 1L, nid) as label")
    for turn in (0, 1):
        pairs = near_duplicates.further_stars(rows, 4, 64, turn)
        assert pairs.groupBy("a").count().agg(F.max("count")).first()[0] <= 160
        # In the bucket without links each part's main component is one node.
        assert 5_800 <= pairs.select("b").distinct().count() <= 6_000 and pairs.count() < 6 * 6_000


def test_slices_when_the_heaviest_component_changes(spark):
    """In the first slice 9 is heaviest and 3 joins 2; then 2 is, and its pair with 9 must still be compared."""
    docs = [
        (1, "q0s1 b3s1 r3s1 a1s1 r6s1 p1s1 r7s1 r1s1 b0s1 p0s1 p2s1 b2s1 a3s1"), (2, "q0s1 r2s1 a2s1 b1s1 r5s1 q1s1 h0s1 r4s1 a0s1"),
        (3, "q0s1 q1s1 h0s1 r4s1 a0s1 r2s1 r0s1 r8s1"), (9, "q0s1 r2s1 a2s1 b1s1 r5s1 q1s1 b3s1 r3s1 a1s1"),
    ]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for limit in (6, 1):  # two slices, and one for each comparison
        found = near_duplicates.near_duplicates(table, 1, 50, 1, 1, comparisons_per_slice=limit).collect()
        assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 2, 3: 2, 9: 2}


def test_files_of_lost_tasks_are_not_read(spark, tmp_path):
    """A file that a lost attempt left, whole or cut, changes nothing; one that is missing is an error."""
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}" * (400 if i % 3 else 9000)) for i in range(20)], "page_id long, url string, html string").repartition(2)
    names = warc.write_archives(pages, f"file://{tmp_path}")
    first, *_ = sorted(tmp_path.glob("*.warc.gz"))
    (tmp_path / "000000-999-0000.warc.gz").write_bytes(first.read_bytes())
    (tmp_path / "000001-998-0000.warc.gz").write_bytes(first.read_bytes()[:100])
    rows = warc.read_archives(spark, f"file://{tmp_path}", names).collect()
    assert sorted(r.page_id for r in rows) == list(range(20)) and all(bytes(r.payload).decode() == f"<p>{r.page_id}" * (400 if r.page_id % 3 else 9000) for r in rows)
    first.unlink()
    with pytest.raises(ValueError):
        warc.read_archives(spark, f"file://{tmp_path}", names)
