"""Who is who: mentions of one surname merged into persons level by level, each level by equi-joins.

Mentions are taken by what they tell: full names first, then initials, then names alone, then a surname alone. A mention that
tells nothing more than some person holds is that person's: an anti-join on what it tells. Of those left, the k-th that a
person could be, and the k-th person that lacks what it tells, are the same, asking first persons who share most with it: a
join on what both tell and k. What is left then is a new person. So no list of persons or mentions is held anywhere.

Without known persons that gives what one gets by reading mentions in this order and giving each to the first person whose
parts do not contradict it, but for mentions with parts that texts do not give (a patronymic without a name, a name with the
initial of a patronymic). Known persons who hold all that a mention tells come before those whom it would complete.

Ranks are counted among mentions and persons of one surname, gender and whatever both tell, by a sorted window over rows of
a few words. Loops on the driver are over the kinds of mentions, sixteen at most.

Defined cases: parts may be null in any combination. Case, ё and repeated white space do not count; of spellings that differ
in nothing else, the first by order stays. Persons of known stay, with their ids and parts, and gain parts. Repeated mentions
are one. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incognita.functions import text as tx

PARTS = ("name", "patr", "init_n", "init_p")
_KEYS = tuple(f"k_{p}" for p in PARTS)


def _kind() -> Column:
    """Which parts are there: a figure for each."""
    return F.concat(*(F.when(F.col(p).isNull(), "0").otherwise("1") for p in PARTS))


def _told(kind: str) -> list[str]:
    return [k for k, there in zip(_KEYS, kind) if there == "1"]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({k: tx.norm_key(F.col(p)) for k, p in zip(_KEYS, PARTS)}).withColumn("kind", _kind())


def _ranked(rows: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*on).orderBy(*order)))


def merge(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """person_id, sur_key, gender and parts of known (these columns) and of the persons whom mentions (sur_key, gender, parts) add."""
    group = ["sur_key", "gender"]
    one = _keyed(mentions.select(*group, *PARTS)).groupBy(*group, *_KEYS, "kind").agg(F.min(F.struct(*PARTS)).alias("v"))
    own_id = F.concat_ws("|", *group, *(F.coalesce(k, F.lit("")) for k in _KEYS))
    one = one.select(*group, *_KEYS, "kind", "v.*", own_id.alias("own_id")).checkpoint()
    persons = _keyed(known.select("person_id", *group, *PARTS)).withColumn("born", F.lit(-1)).checkpoint()
    held = {r.kind for r in persons.select("kind").distinct().collect()}
    kinds = sorted((r.kind for r in one.select("kind").distinct().collect()), key=lambda k: (-k.count("1"), k))
    for level, kind in enumerate(kinds):
        told = _told(kind)
        left = one.filter(F.col("kind") == kind)
        if any(set(told) <= set(_told(q)) for q in held):
            full = persons
            for k in told:
                full = full.filter(F.col(k).isNotNull())
            left = left.join(full.select(*group, *told).distinct(), [*group, *told], "left_anti")
        lacking = sorted((q for q in held if not set(told) <= set(_told(q))), key=lambda q: (-len(set(told) & set(_told(q))), q))
        for other in lacking:
            both = [*group, *(k for k in told if k in _told(other))]
            left = left.checkpoint()
            asked = _ranked(persons.filter(F.col("kind") == other), both, ["born", *PARTS, "person_id"]).select("person_id", *both, "rank")
            asking = _ranked(left, both, [*PARTS]).select(*both, "rank", "own_id", *(F.col(p).alias(f"v_{p}") for p in PARTS))
            pairs = asked.join(asking, [*both, "rank"]).select("person_id", "own_id", *(f"v_{p}" for p in PARTS)).checkpoint()
            left = left.join(pairs.select("own_id"), "own_id", "left_anti")
            filled = persons.join(pairs.drop("own_id"), "person_id", "left").select("person_id", *group, *(F.coalesce(p, f"v_{p}").alias(p) for p in PARTS), "born")
            persons = _keyed(filled).checkpoint()
            held.add("".join(max(a, b) for a, b in zip(kind, other)))
        new = left.select(F.col("own_id").alias("person_id"), *group, *PARTS, *_KEYS, "kind", F.lit(level).alias("born"))
        persons = persons.select(new.columns).union(new).checkpoint()
        held.add(kind)
    return persons.select("person_id", *group, *PARTS)
