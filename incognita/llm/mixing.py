"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length (words) per source. A source whose target is m times its size and a rest r is
taken m times whole, and r words more are picked: from every length the share r / size of its documents, rounded down,
then single documents from the longest length downwards while they fit, until what is left is a small budget, and that
is fitted by a bounded knapsack over the lengths still free. The plan is a number of documents per length; which ones
is decided by a seeded order of doc_ids, so reruns agree.

Only counts per (source, length) reach the planner, one source in a task. Lengths with very many documents are picked
from by buckets of the seeded order, so no length's documents meet in one task. Sources are ranked and their targets found
by rounds over a table of sources; the driver sees two sums a round.

Defined cases: null text has length 0; documents of length 0 are never picked, as they add no words. A very long text counts
whole. A null source is a source of its own, ordered last. Rows that repeat a doc_id are documents of their own; which of
them is picked goes by a hash of their text, and equal rows are alike. An empty table gives an empty result. Columns other
than doc_id, text and source are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incognita.llm import session

WORD = "[^ \\t\\n\\x0B\\f\\r]+"
#: Budgets up to this many words are fitted exactly, by dynamic programming.
KNAPSACK_WORDS = 20_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The words to take from each source of sizes (source, words): shares of all words by weight, at most `most` times its size.

    Sources by code point, null last, weigh as weights say, again and again. What a source can't take goes to the others by
    weight, round by round. If all are full, the rest is not taken. Adds weight and target.
    """
    tables = session.Tables(sizes.sparkSession, "mix-targets")
    # Ranks: places within ranges of sources, and how many sources the ranges before have.
    ranged = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = tables.keep(ranged, "ranged")
    held = ranged.groupBy("part").agg(F.count("*").alias("held"))
    before = held.select("part", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    ranked = ranged.withColumn("own", own).join(before, "part").select("source", "words", (F.col("before") + F.col("own") - 1).alias("rank"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    state, turn = tables.keep(ranked.select("source", "words", weight.alias("weight"), F.lit(False).alias("filled")), "0"), 0
    total = float(state.agg(F.sum("words")).first()[0] or 0)
    while True:
        row = state.agg(F.sum(F.when(F.col("filled"), F.col("words")) * most), F.sum(F.when(~F.col("filled"), F.col("weight")))).first()
        left, share = total - (row[0] or 0), row[1] or 1
        target = F.when(F.col("filled"), (F.col("words") * most).cast("double")).otherwise(F.lit(left) * F.col("weight") / share)
        out, turn = state.withColumn("target", target), turn + 1
        if out.filter(~F.col("filled") & (F.col("target") > F.col("words") * most)).isEmpty():
            return out.drop("filled")
        state = tables.keep(out.withColumn("filled", F.col("filled") | (F.col("target") > F.col("words") * most)).drop("target"), str(turn))


def bounded_knapsack(budget: int, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each length make the largest sum up to budget. Reachable sums are bits of one integer."""
    reached, history = 1, []
    keep = (1 << (budget + 1)) - 1
    for length, count in zip(lengths.tolist(), counts.tolist()):
        part, free = 1, min(count, budget // length)
        while free > 0:
            n = min(part, free)
            before = reached
            reached |= (reached << (n * length)) & keep
            history.append((length, n, before))
            part, free = part * 2, free - n
        if reached >> budget & 1:
            break
    at, used = reached.bit_length() - 1, {}
    for length, n, before in reversed(history):
        if not before >> at & 1:
            at -= n * length
            used[length] = used.get(length, 0) + n
    return np.array([used.get(x, 0) for x in lengths.tolist()], dtype=np.int64)


def fit(budget: int, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many documents of each length (ascending, positive) to pick for about budget words, never more than it."""
    whole = int((lengths * counts).sum())
    if budget >= whole:
        return counts.copy()
    picked = counts * budget // max(whole, 1)
    left = budget - int((lengths * picked).sum())
    for i in range(len(lengths) - 1, -1, -1):
        if left <= KNAPSACK_WORDS:
            break
        n = min(int(counts[i] - picked[i]), (left - KNAPSACK_WORDS // 2) // int(lengths[i]))
        picked[i] += max(n, 0)
        left -= max(n, 0) * int(lengths[i])
    fits = np.flatnonzero((lengths <= left) & (counts > picked))
    # Long lengths first: they leave few steps; short ones close what remains.
    fits = fits[::-1]
    picked[fits] += bounded_knapsack(left, lengths[fits], (counts - picked)[fits])
    return picked


PLAN = "source string, size long, n long, source_size long, target double, times long, picked long"


def _planner(most: int):
    def plan(counted: pd.DataFrame) -> pd.DataFrame:
        counted = counted.sort_values("size", kind="stable").reset_index(drop=True)
        lengths, counts = counted["size"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)
        whole = int((lengths * counts).sum())
        budget = int(round(counted["target"].iloc[0]))
        times = min(budget // whole, most) if whole else 0
        picked = np.zeros(len(lengths), dtype=np.int64)
        if whole and times < most:
            some = lengths > 0
            picked[some] = fit(budget - times * whole, lengths[some], counts[some])
        counted["times"], counted["picked"] = times, picked
        return counted

    return plan


def mix(docs: DataFrame, weights: Iterable[int] = (1, 2, 3), most: int = 3, seed: int = 7, bucket_docs: int = 500) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and row_key of each row of docs (doc_id, text, source).

    taken is a multiple of size; no document is taken more than `most` times. row_key is a hash of doc_id and text.
    """
    spark = docs.sparkSession
    session.prepare(spark)
    tables = session.Tables(spark, "mix")
    sized = session.columns(docs, "doc_id", "text", "source").select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("row_key"))
    sized = tables.keep(sized.withColumn("h", F.xxhash64("doc_id", F.lit(seed))), "sized")
    counted = tables.keep(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "counted")
    sizes = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    known = targets(sizes, tuple(weights), most).select(F.col("source").alias("t_source"), F.col("words").alias("source_size"), "target")
    planned = counted.join(known, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    # A table of its own: where it is small Spark sends it to all tasks, else it splits the rows of a length that very many have.
    plan = tables.keep(planned.groupBy("source").applyInPandas(_planner(most), PLAN).withColumn("buckets", F.ceil(F.col("n") / F.lit(bucket_docs))), "plan")
    same = [F.col("d.source").eqNullSafe(F.col("p.source")), F.col("d.size") == F.col("p.size")]
    joined = sized.alias("d").join(plan.alias("p"), same).select("d.*", "p.source_size", "p.target", "p.times", "p.picked", F.pmod(F.col("d.h"), F.col("p.buckets")).alias("bucket"))
    joined = tables.keep(joined, "joined")
    tables.drop("sized")
    # Buckets are used up in order: whole ones, then part of one.
    open_ = joined.filter("picked > 0")
    filled = open_.groupBy("source", "size", "bucket").agg(F.count("*").alias("held"), F.first("picked").alias("want"))
    before = F.sum("held").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    quota = filled.select(F.col("source").alias("q_source"), F.col("size").alias("q_size"), F.col("bucket").alias("q_bucket"), F.greatest(F.lit(0), F.col("want") - F.coalesce(before, F.lit(0))).alias("quota"))
    same = [F.col("source").eqNullSafe(F.col("q_source")), F.col("size") == F.col("q_size"), F.col("bucket") == F.col("q_bucket")]
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id", "row_key"))
    ranked = open_.join(quota, same).withColumn("copies", F.col("times") + (rank <= F.col("quota")).cast("long"))
    copies = ranked.select(*joined.columns, "copies").union(joined.filter("picked = 0").withColumn("copies", F.col("times")))
    return copies.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "row_key")
