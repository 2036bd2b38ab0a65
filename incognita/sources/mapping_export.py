"""Writing the mapping for people to read: a semicolon-separated table with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The order of types in the table.
ORDER = ("surname", "org", "iin", "bin", "num12", "iban", "card", "phone", "acc20", "inn", "rekv", "email", "domain")


def export_rows(mapping: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("typ"))
    return mapping.orderBy(place, "key").select("typ", F.col("key").alias("real"), "fake")


def export(mapping: DataFrame, folder: str) -> None:
    export_rows(mapping).write.mode("overwrite").option("sep", ";").option("header", True).csv(folder)
