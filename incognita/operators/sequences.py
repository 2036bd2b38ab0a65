"""Which of many sequences of tokens stand where in many texts, the tokens of each place walked once along a sorted trie.

Sequences and places are rows of one table, dealt by their first two tokens and sorted by their tokens; a sequence comes right
before all that it begins. So one pass over the sorted rows is a walk through the trie of sequences, and the path to the
current row is all that a task holds: no trie in memory, no group collected. A place where two tokens begin a sequence is
one shuffled row, however many lengths sequences have; sequences of one token need no walk.

Where sequences are FEW, their beginnings go to all tasks, and of the texts only the places where one stands are ever rows of
a table; else each token is a shuffled row, with what follows it. A beginning with more than PART_ROWS places is dealt into
parts, and the sequences that it begins go to each of them.

Defined cases: sequences without tokens stand nowhere, nor does anything in null or empty texts. Equal sequences are
one. Repeated texts give equal rows. Tokens hold none of the marks U+0001 and U+0002.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_ROWS = 200_000
#: Up to how many sequences have their beginnings, of two tokens, broadcast.
FEW = 300_000
_END, _PART = "\x01", "\x02"


def path(tokens: Column) -> Column:
    """The tokens, each with a mark behind it, so that a sequence begins another if its path does."""
    return F.concat(F.array_join(tokens, _END), F.lit(_END))


def _begin(tokens: Column) -> Column:
    """The first two tokens; null where there are fewer."""
    return F.when(F.size(tokens) >= 2, path(F.slice(tokens, 1, 2)))


def candidates(texts: DataFrame, sequences: DataFrame) -> DataFrame:
    """doc_id, frag_id, i (from 0), first, single, begin and path of the places of texts (doc_id, frag_id, names) where a sequence may stand.

    single tells whether the token alone is a sequence; begin and path are there where two tokens begin a longer one.
    """
    told = sequences.agg(F.count("*").alias("rows"), F.coalesce(F.max(F.size("key")), F.lit(0)).alias("longest")).first()
    dealt = F.broadcast if told.rows <= FEW else lambda rows: rows
    firsts = sequences.filter(F.size("key") > 0).groupBy(F.get("key", F.lit(0)).alias("first")).agg(F.bool_or(F.size("key") == 1).alias("single"))
    begins = sequences.select(_begin(F.col("key")).alias("begin")).filter("begin is not null").distinct().withColumn("longer", F.lit(True))
    # No function of a function here: so places are told and joined in one pass, and what follows is cut out where something begins alone.
    each = texts.select("doc_id", "frag_id", "names", F.posexplode("names").alias("i", "first"))
    second, run = F.get("names", F.col("i") + 1), F.slice("names", F.col("i") + 1, F.lit(told.longest))
    each = each.select("doc_id", "frag_id", "i", "first", F.concat("first", F.lit(_END), second, F.lit(_END)).alias("begin"), run.alias("run"))
    met = each.join(dealt(firsts), "first").join(dealt(begins), "begin", "left").filter("single or longer")
    return met.select("doc_id", "frag_id", "i", "first", "single", F.when(F.col("longer"), F.col("begin")).alias("begin"), F.when(F.col("longer"), path(F.col("run"))).alias("path"))


def _walk(batches: Iterator[pa.RecordBatch], longest: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows sorted by path, sequences (with an n) before places: each place with the sequences on the way to it, or the last of them."""
    way: list[tuple[str, int]] = []
    for batch in batches:
        found: list[tuple] = []
        paths, lengths = (batch.column(c).to_pylist() for c in ("path", "n"))
        docs, frags, places, singles = (batch.column(c).to_pylist() for c in ("doc_id", "frag_id", "i", "single"))
        for at, n, doc, frag, i, single in zip(paths, lengths, docs, frags, places, singles):
            while way and not at.startswith(way[-1][0]):
                way.pop()
            if n is not None:
                way.append((at, n))
            elif longest and not way:
                found.extend([(doc, frag, i, 1, at.partition(_PART)[2].partition(_END)[0] + _END)] if single else [])
            else:
                found.extend((doc, frag, i, length, which.partition(_PART)[2]) for which, length in (way[-1:] if longest else way))
        columns = list(zip(*found)) or [()] * 5
        schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("frag_id", batch.schema.field("frag_id").type), ("i", pa.int32()), ("n", pa.int32()), ("path", pa.string())])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def standing(texts: DataFrame, sequences: DataFrame, longest: bool = False) -> DataFrame:
    """doc_id, frag_id, i, n and path: at which token of texts (doc_id, frag_id, names) which sequence (key), of n tokens, stands.

    longest: of the sequences that stand at one place, the longest alone.
    """
    sequences = sequences.select("key").distinct().checkpoint()
    spots = candidates(texts, sequences).checkpoint()
    longer = spots.filter("begin is not null")
    parts = longer.groupBy("begin").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")).checkpoint()
    dealt = longer.join(parts.filter("parts > 1"), "begin", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "frag_id", "i"), F.coalesce("parts", F.lit(1))).cast("int"))
    begun = sequences.select("key", _begin(F.col("key")).alias("begin")).join(parts, "begin").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    ids = {c: texts.schema[c].dataType for c in ("doc_id", "frag_id")}
    every = begun.select("begin", "part", path(F.col("key")).alias("path"), F.size("key").alias("n"), *(none(c, kind) for c, kind in ids.items()), none("i", "int"), none("single", "boolean"))
    every = every.union(dealt.select("begin", "part", "path", none("n", "int"), *ids, "i", "single")).withColumn("path", F.concat(F.col("part").cast("string"), F.lit(_PART), "path"))
    walked = every.repartition("begin", "part").sortWithinPartitions(F.col("path"), F.col("n").isNull())
    kinds = ", ".join(f"{c} {kind.simpleString()}" for c, kind in ids.items())
    found = walked.select("path", "n", *ids, "i", "single").mapInArrow(partial(_walk, longest=longest), f"{kinds}, i int, n int, path string")
    # Where a longer one may stand too, the walk tells which is the longest.
    alone = spots.filter("single and begin is null" if longest else "single")
    return found.union(alone.select(*ids, "i", F.lit(1).alias("n"), F.concat("first", F.lit(_END)).alias("path")))
