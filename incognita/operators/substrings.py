"""Substrings by equality: which of many wanted pieces stand where in many short texts.

A piece is known by its first GRAM letters (by all of them, if it is shorter). Places of texts whose next letters begin some
piece are found by a semi-join with the distinct beginnings; from these places, runs of letters as long as some piece meet
the distinct pieces. A run meets one piece at most, so common beginnings do not multiply rows, and nothing is compared with
everything: rows grow with the letters of the texts times the number of different lengths of pieces, at the worst.

Defined cases: empty and null texts hold nothing, empty and null pieces stand nowhere. A piece that stands in a text several
times, also overlapping itself, gives a row for each place. Repeated texts of one key give equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 4


def places(texts: DataFrame, pieces: DataFrame) -> DataFrame:
    """key, at (from 0) and piece for each place of texts (key, text) where one of pieces (piece) stands."""
    wanted = pieces.select("piece").filter("piece <> ''").distinct()
    begin = wanted.select(F.substring("piece", 1, GRAM).alias("gram")).distinct()
    # One row: how long pieces, and their beginnings, are.
    sizes = F.broadcast(wanted.agg(F.collect_set(F.char_length("piece")).alias("sizes"), F.collect_set(F.char_length(F.substring("piece", 1, GRAM))).alias("firsts")))
    rows = texts.select("key", "text").filter("text <> ''").crossJoin(sizes).filter("size(sizes) > 0")
    every = rows.select("key", "text", "sizes", "firsts", F.explode(F.sequence(F.lit(0), F.char_length("text") - 1)).alias("at"))
    every = every.select("key", "at", "sizes", "firsts", F.substr("text", F.col("at") + 1, F.array_max("sizes")).alias("tail"))
    fitting = lambda name: F.explode(F.filter(name, lambda n: n <= F.char_length("tail"))).alias("n")
    begun = every.select("key", "at", "tail", "sizes", fitting("firsts")).withColumn("gram", F.substring("tail", F.lit(1), F.col("n"))).join(begin, "gram", "left_semi")
    runs = begun.select("key", "at", "tail", "sizes").distinct().select("key", "at", "tail", fitting("sizes"))
    return runs.select("key", "at", F.substring("tail", F.lit(1), F.col("n")).alias("piece")).join(wanted, "piece").select("key", "at", "piece")
