"""One query per operator of this subpackage over its whole table; SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita.llm import chat, oracles, session, toxicity
from incognita.llm import pii as personal
from incognita.llm.collocations import collocations
from incognita.llm.decontamination import contaminated, decontaminate
from incognita.llm.fill_in_middle import fill_in_middle, restored
from incognita.llm.line_dedup import deduplicate_lines
from incognita.llm.mixing import mix
from incognita.llm.near_duplicates import near_duplicates
from incognita.llm.page_text import main_texts
from incognita.llm.quality import judge_quality
from incognita.llm.token_ids import token_ids
from incognita.llm.warc import archive

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal_data(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != personal.FOUND)
    counts = [personal.number_of(k).alias(f"n_{k}") for k in personal.BASE_KINDS]
    every = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2(personal.written(base), 256).alias("base_sha256"), personal.written(F.col("spans")).alias("spans"), every)


def op2_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = session.columns(_table(spark, sf_dir, "documents"), "doc_id", "text"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op4_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = contaminated(decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))
    items = F.array_sort(F.coalesce("items", F.array().cast("array<string>")))
    return scanned.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")


def op5_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    awkward = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", awkward), (-7, 1, "assistant", awkward)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select(*extra.columns).union(extra)
    session.prepare(spark)
    formatted = session.Tables(spark, "chat").keep(chat.render(chat.fold_events(chat.conversation_events(rows))), "formatted")
    read = chat.read_back(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_ranked_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(_table(spark, sf_dir, "documents"), TOKENIZER)


def op8_divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(_table(spark, sf_dir, "documents"))
    return judged.select(*[F.round(c, 6).alias(c) if c.endswith("distance") else c for c in judged.columns])


def op9_perfect_hash_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = deduplicate_lines(_table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_subset_sum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).drop("source", "row_key")


def op11_chunked_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = fill_in_middle(_table(spark, sf_dir, "documents"))
    back = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return told.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))


def op12_wrapper_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10 gives but for the picks, which SQL can't make."""
    return op10_subset_sum_mixing(spark, sf_dir).drop("taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bootstrapped_pii, op2_counterfactual_toxicity, op3_minhash_near_dedup, op4_winnowing_decontamination, op5_warc_segments,
        op6_chat_formatting, op7_ranked_token_ids, op8_divergence_quality, op9_perfect_hash_line_dedup, op10_subset_sum_mixing, mixing_targets,
        op11_chunked_fill_in_middle, op12_wrapper_page_text, op13_phrase_collocations,
    )
}

#: SQL can express neither a classifier, nor a tokenizer, nor spans that patterns learned from the texts add; for op10, all but the picks.
ORACLES: dict[str, str] = {
    "op3_minhash_near_dedup": oracles.NEAR_DUPLICATES, "op4_winnowing_decontamination": oracles.DECONTAMINATION, "op5_warc_segments": oracles.ARCHIVES,
    "op6_chat_formatting": oracles.CONVERSATIONS, "op8_divergence_quality": oracles.QUALITY, "op9_perfect_hash_line_dedup": oracles.LINES, "mixing_targets": oracles.MIX_TARGETS,
    "op11_chunked_fill_in_middle": oracles.MIDDLES, "op12_wrapper_page_text": oracles.PAGE_TEXTS, "op13_phrase_collocations": oracles.PHRASES,
}
