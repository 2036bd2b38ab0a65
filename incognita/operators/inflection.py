"""Base forms of words met in texts, found by declining candidates forwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incognita.functions import morphology as mo


def bases(tokens: DataFrame, decline: Callable[[Column, Column], Column]) -> DataFrame:
    """token, base, gender and case: every base form that the token may be a case of."""
    each = tokens.select("token", F.explode(mo.base_candidates(F.col("token"))).alias("base")).select("*", F.explode(F.array(F.lit("m"), F.lit("f"))).alias("gender"))
    formed = each.select("token", "base", "gender", F.posexplode(decline(F.col("base"), F.col("gender"))).alias("i", "form"))
    case = F.element_at(F.array(*map(F.lit, mo.CASES)), F.col("i") + 1)
    return formed.filter(mo.same_word(F.col("form"), F.col("token"))).select("token", "base", "gender", case.alias("case")).distinct()
