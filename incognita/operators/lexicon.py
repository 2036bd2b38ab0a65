"""Common words, learned from the texts themselves, and the veto that they have over names.

A capitalised word beside initials need not be a surname (`Отчёт А. Б.`). Words of the language are written small somewhere
in the texts; names are not. Only words that are in doubt are counted: those that stand for a surname beside initials alone,
with no first name or patronymic, and do not end as surnames do. They, and the words of which they may be a case in all
their cases, meet the small-written words of all texts in a join whose sums are made in the tasks first. The table (word,
small) can be kept and added to, or be a dictionary from elsewhere.

Joins are exact on purpose: a filter with false positives would veto real names now and then.

Defined cases: without texts nothing is vetoed. A surname that is a common word as well (Белый) is vetoed beside initials
alone, as nothing tells the two apart; with a patronymic, in a cell of a column of people, or with a surname's ending it
stays. Null texts have no words. Repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incognita.functions import morphology as mo
from incognita.functions import text as tx
from incognita.operators.inflection import bases

#: How often a word is written small, in any case, before it is a common one.
LEAST = 2


def doubtful(parts: DataFrame) -> DataFrame:
    """token, base and word: tokens in doubt of parsed mentions (sur, name, patr), words of which each may be a case, and these in all cases."""
    tokens = parts.filter("name is null and patr is null").select(F.col("sur").alias("token")).distinct().filter(~mo.is_surname_like(F.col("token")))
    cased = bases(tokens, lambda word, gender: mo.noun_paradigm(word)).select("token", "base", F.explode(mo.noun_paradigm(F.col("base"))).alias("word"))
    every = cased.union(tokens.select("token", "token", "token"))
    return every.select("token", "base", tx.fold_yo(F.lower("word")).alias("word")).distinct()


def small_counts(texts: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """word and small: how often each word (of words, if given) is written small in texts (text)."""
    each = texts.select(F.explode(F.regexp_extract_all("text", F.lit(f"(?U)(?<![\\w.-])[{tx.LOWER}]{{2,}}(?![\\w-])"), 0)).alias("word")).select(tx.fold_yo(F.col("word")).alias("word"))
    # Sums before the join: a join of words would send each of them, and all of a frequent one to one task.
    counts = each.groupBy("word").agg(F.count("*").alias("small"))
    if words is not None:
        counts = counts.join(words.select("word").distinct(), "word", "left_semi")
    return counts


def veto(parts: DataFrame, texts: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """parts (parsed mentions) without those whose surname is a common word by texts (text), or by lexicon (word, small)."""
    asked = doubtful(parts).checkpoint()
    if asked.isEmpty():
        return parts
    counts = small_counts(texts, asked)
    if lexicon is not None:
        counts = counts.unionByName(lexicon.select("word", "small")).groupBy("word").agg(F.sum("small").alias("small"))
    common = asked.join(counts, "word").groupBy("token", "base").agg(F.sum("small").alias("small")).filter(F.col("small") >= LEAST).select(F.col("token").alias("sur")).distinct()
    alone = F.col("name").isNull() & F.col("patr").isNull()
    return parts.filter(~alone).unionByName(parts.filter(alone).join(common, "sur", "left_anti").select(*parts.columns))
