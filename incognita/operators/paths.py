"""Names of files and folders: every distinct component is replaced once, and no two paths become one.

Components of all paths are a dictionary, so a folder that a million paths share is searched once. Each component but the
extension of the last is replaced as a text of its own and comes back to its paths by position. Paths that would be the same
afterwards are numbered, " (2)" before the extension, with the numbers that no other path has. Only paths that share their new
name with others are looked at for that.

Defined cases: null paths stay null, empty ones empty; empty components (a leading or doubled slash) stay. A file whose only
dot is its first character has no extension. Repeated paths are one. Of paths that clash the first by order keeps the name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXTENSION = "(?<=[^/.])\\.[^./]*$"
_NUMBERED = "^(.*) \\(([1-9][0-9]{0,8})\\)$"


def extension(path: Column) -> Column:
    """What is behind the last dot of a file's name, with the dot; empty if there is none."""
    return F.regexp_extract(path, EXTENSION, 0)


def stem(path: Column) -> Column:
    return F.regexp_replace(path, EXTENSION, "")


def number_clashes(renamed: DataFrame) -> DataFrame:
    """path and new_path of renamed (path, new_path; one row a path), new paths made different where several have the same."""
    wanted = F.count("*").over(Window.partitionBy("new_path"))
    rows = renamed.select("path", "new_path", wanted.alias("n"), F.row_number().over(Window.partitionBy("new_path").orderBy("path")).alias("k"))
    rows = rows.withColumn("clash", F.col("new_path").isNotNull() & (F.col("k") > 1)).checkpoint()
    clash = rows.filter("clash").select("path", "new_path", (F.col("k") - 1).alias("k"))
    groups = clash.groupBy("new_path").agg(F.count("*").alias("n")).withColumns({"stem": stem(F.col("new_path")), "ext": extension(F.col("new_path"))})
    # Numbers that other paths have by themselves are not given again.
    plain = rows.filter("not clash").select(stem(F.col("new_path")).alias("s"), extension(F.col("new_path")).alias("ext")).filter(F.col("s").rlike(_NUMBERED))
    taken = plain.select(F.regexp_extract("s", _NUMBERED, 1).alias("stem"), "ext", F.regexp_extract("s", _NUMBERED, 2).cast("long").alias("number")).join(groups.select("stem", "ext"), ["stem", "ext"], "left_semi").checkpoint()
    held = taken.groupBy("stem", "ext").agg(F.count("*").alias("held"))
    spare = groups.join(held, ["stem", "ext"], "left").select("new_path", "stem", "ext", F.explode(F.sequence(F.lit(2), F.col("n") + F.coalesce("held", F.lit(0)) + 1)).alias("number"))
    spare = spare.join(taken, ["stem", "ext", "number"], "left_anti")
    spare = spare.withColumn("k", F.row_number().over(Window.partitionBy("new_path").orderBy("number")))
    told = clash.join(spare, ["new_path", "k"]).select("path", F.concat("stem", F.lit(" ("), F.col("number").cast("string"), F.lit(")"), "ext").alias("new_path"))
    return rows.filter("not clash").select("path", "new_path").union(told)


def map_paths(paths: DataFrame, replaced: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """path and new_path of the distinct paths. replaced: a job that gives fragments with their new_text (obfuscate or restore)."""
    distinct = paths.select("path").distinct()
    cut = F.when(F.col("path").isNotNull(), F.split(stem(F.col("path")), "/"))
    parts = distinct.select("path", F.posexplode(cut).alias("i", "part")).checkpoint()
    # Components are their own ids.
    words = parts.select("part").filter("part <> ''").distinct()
    fragments = words.select(F.col("part").alias("doc_id"), F.lit(0).alias("frag_id"), F.col("part").alias("text"), F.lit(None).cast("string").alias("hint"))
    # A stand-in has no slash; should one have, it would make another folder.
    new = replaced(fragments).select(F.col("doc_id").alias("part"), F.replace("new_text", F.lit("/"), F.lit("-")).alias("new"))
    changed = parts.join(new.filter("part <> new"), "part", "left").select("path", "i", F.coalesce("new", "part").alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda p: p["part"]), "/")
    whole = changed.groupBy("path").agg(joined.alias("body")).select("path", F.concat("body", extension(F.col("path"))).alias("new_path"))
    return number_clashes(distinct.filter("path is null").select("path", F.col("path").alias("new_path")).union(whole))
