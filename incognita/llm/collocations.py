"""Phrase collocations: word sequences that occur together far more often than their parts would by themselves.

All runs of 1 to max_n words are exploded into rows and summed up by language. A run is a row twice. First as a 64-bit
hash of language and words, two longs a row and summed up within tasks: what is met min_count times by its hash may be met
so often, and nothing else can be. These hashes set two bits each in a filter of FILTER_BITS bits, whatever their number,
and the runs that the filter lets pass are rows again, now with their words: these are summed up exactly. (Rows of words
for all runs shuffle about nine times the input, as most runs of three words are met once.) A fuller filter lets more rows
pass and changes no result.

A phrase that is met min_count times has parts that are met as often at least. So candidates meet the counts of their
first and last parts in joins on (lang, phrase), are scored in Decimal, lose to an extension by one word that is met half
as often (anti-join; an extension by more words is met no more often than the one by one word between them), and are
ranked by a window, first within SHARDS parts of each language and then among the first of these. A language that holds most
rows is no hot group, as the sums are by phrase.

Defined cases: null texts are empty; null languages are `und`. Texts without words give no rows, nor do empty tables.
Repeated rows count each. Ties of score and count go to the phrase whose UTF-8 bytes come first. Very long texts are read
whole, one at a time. Columns other than lang and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incognita.llm import session
from incognita.llm import text_arrays as ta
from incognita.llm.text_arrays import U64

#: How much of a phrase's count an extension needs in order to replace it, of 100.
SHARE = 50
#: Hashes that a task sums up at once.
HELD = 4 << 20
#: Parts of a language that are ranked by themselves before the language is.
SHARDS = 32
_PLACE_BITS = 27
FILTER_BITS = 1 << _PLACE_BITS

_STOPS = np.zeros(256, dtype=np.int64)
_STOPS[[*b".,;:!?", *range(10, 14)]] = 1
_apart = lambda b: b in b" \t" or bool(_STOPS[b])
_LETTERS = ta.table(lambda b: not _apart(b), lower=True)
_LETTERS[0] = 0xFF  # a zero byte belongs to a word; 0 marks separators here, and no UTF-8 text has 0xFF
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[ord("A") : ord("Z") + 1] += 32
_SMALL[[b for b in range(256) if _apart(b)]] = ord(" ")


class Runs:
    """All runs of words of a batch of texts: hashes by length, and the words of those that are asked for."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.words = ta.Words(data, offsets, _LETTERS)
        self.data = data
        #: Words of one piece have one number.
        self.piece = np.cumsum(_STOPS[data])[self.words.start] + self.words.text if len(data) else self.words.text
        self.hashes = self.words.hashes()
        langs = rows.column("lang").dictionary_encode()
        self.names, self.lang = langs.dictionary, np.asarray(langs.indices.to_numpy(zero_copy_only=False), dtype=np.int64)
        spelled, places = ta.buffers(self.names)
        self.seeds = ta.span_hashes(spelled, places[:-1], places[1:])

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of n words, with their language, and the first word of each."""
        found, at = ta.gram_hashes_within(self.hashes, self.piece, n)
        return ta.mix(found ^ self.seeds[self.lang[self.words.text[at]]]), at

    def told(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes in which every word is followed by one space, and where in them the runs of n words from at on begin and end."""
        inside = self.words.bytes != 0
        kept = inside.copy()
        kept[1:] |= inside[:-1]
        place = np.cumsum(kept) - 1
        return _SMALL[self.data[kept]], place[self.words.start[at]], place[self.words.end[at + n - 1] - 1] + 1


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    sizes = end - start
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return ta.binaries(data[np.repeat(start - bounds[:-1], sizes) + np.arange(bounds[-1])].tobytes(), bounds).cast(pa.string())


def _prepared(docs: DataFrame) -> DataFrame:
    return session.columns(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text <> ''")


def hash_counts(docs: DataFrame, max_n: int) -> DataFrame:
    """hash and f: a row for each run of 1 to max_n words, summed up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times)], ["hash", "f"])

        for batch in ta.pieces(batches, "text"):
            runs = Runs(*batch)
            held += [runs.of(n)[0] for n in range(1, max_n + 1)]
            if sum(map(len, held)) >= HELD:
                yield summed()
        if held:
            yield summed()

    return _prepared(docs).mapInArrow(count, "hash long, f long").groupBy("hash").agg(F.sum("f").alias("f"))


def _filter_of(hashes: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, as 64-bit words; each hash sets the two that its lowest bits name."""
    mask = FILTER_BITS - 1
    places = F.explode(F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", _PLACE_BITS).bitwiseAND(mask)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63).cast("int"))
    words = hashes.select(places.alias("place")).groupBy(F.shiftright("place", 6).cast("int").alias("at")).agg(F.bit_or(bit).alias("word")).toArrow()
    bits = np.zeros(FILTER_BITS >> 6, dtype=np.int64)
    bits[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return bits.view(U64)


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    mask = U64(FILTER_BITS - 1)
    set_ = lambda place: (bits[(place >> U64(6)).view(np.int64)] >> (place & U64(63))) & U64(1) != 0
    found = np.flatnonzero(set_(hashes & mask))
    return found[set_((hashes[found] >> U64(_PLACE_BITS)) & mask)]


def phrase_counts(docs: DataFrame, max_n: int, bits: Broadcast) -> DataFrame:
    """lang, words, phrase and occurrences f of the runs that the filter lets pass; and with 0 words all words of each language."""
    schema = "lang string, words int, phrase string, f long"

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.pieces(batches, "text"):
            runs = Runs(*batch)
            every = np.bincount(runs.lang[runs.words.text], minlength=len(runs.names))
            none = pa.nulls(len(every), pa.string())
            yield pa.RecordBatch.from_arrays([runs.names, pa.array(np.zeros(len(every), np.int32)), none, pa.array(every.astype(np.int64))], ["lang", "words", "phrase", "f"])
            for n in range(1, max_n + 1):
                hashes, at = runs.of(n)
                kept = _passes(bits.value, hashes)
                hashes, at = hashes[kept], at[kept]
                if not len(at):
                    continue
                data, start, end = runs.told(at, n)
                # Runs of one hash are one row if a hash of their letters agrees as well.
                again = ta.span_hashes(data, start, end)
                order = np.lexsort((again, hashes))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (np.diff(hashes[order]) != 0) | (np.diff(again[order]) != 0)
                first = np.flatnonzero(new)
                times, one = np.diff(np.append(first, len(order))), order[first]
                langs = runs.names.take(pa.array(runs.lang[runs.words.text[at[one]]]))
                columns = [langs, pa.array(np.full(len(one), n, np.int32)), _slices(data, start[one], end[one]), pa.array(times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "words", "phrase", "f"])

    return _prepared(docs).mapInArrow(tell, schema).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def _part(first: int | Column, many: int | Column) -> Column:
    return F.array_join(F.slice("w", first, many), " ")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact for counts of up to 14 digits."""
    exact = lambda c: c.cast("decimal(14,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (exact(a) * exact(a)), exact(left) * exact(right))


def collocations(docs: DataFrame, max_n: int = 3, min_count: int = 10, top: int = 2000, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first phrases of 2 to max_n words of each language.

    a: occurrences of the phrase; l, r: of its parts at the cut that scores least; n: all words of the language.
    """
    spark = docs.sparkSession
    session.prepare(spark)
    tables = session.Tables(spark, "collocations")
    frequent = hash_counts(docs, max_n).filter(F.col("f") >= min_count).select("hash")
    bits = spark.sparkContext.broadcast(_filter_of(frequent))
    counts = tables.keep(phrase_counts(docs, max_n, bits).filter((F.col("f") >= min_count) | (F.col("words") == 0)), "counts")
    bits.unpersist()
    totals = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    known = counts.filter("words > 0").select("lang", "phrase", "f")
    wanted = counts.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    cuts = wanted.withColumn("w", F.split("phrase", " ")).select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "words", "phrase", "a", "k", _part(1, F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    named = lambda part, f: known.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    cuts = cuts.join(named("first", "l"), ["lang", "first"]).join(named("rest", "r"), ["lang", "rest"])
    scored = cuts.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    least = scored.groupBy("lang", "words", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = wanted.filter("words > 2").withColumn("w", F.split("phrase", " "))
    inner = longer.select("lang", F.explode(F.array(_part(1, F.col("words") - 1), _part(2, F.col("words") - 1))).alias("inner"), F.col("a").alias("outer"))
    inner = inner.groupBy("lang", "inner").agg(F.max("outer").alias("outer"))
    replaced = (F.col("o.lang") == F.col("i.lang")) & (F.col("o.phrase") == F.col("i.inner")) & (100 * F.col("i.outer") >= share * F.col("o.a"))
    stay = least.alias("o").join(inner.alias("i"), replaced, "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # First within shards of a language, so that no task gets more than SHARDS times top of its rows.
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    shard = F.pmod(F.xxhash64("phrase"), F.lit(SHARDS))
    first = stay.withColumn("shard", shard).withColumn("rank", place("lang", "shard")).filter(F.col("rank") <= top).drop("shard", "rank")
    first = first.withColumn("rank", place("lang")).filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))
    # One row a language: a sum over words, small as the languages are few; not hinted, Spark knows the size of what it has read.
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
