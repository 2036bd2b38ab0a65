"""Links of addresses and domains to people and organisations, so that their stand-ins fit together.

`ivanov.s@romashka.kz` names a person and an organisation that texts name as well: its stand-in carries the stand-in of the
surname, with the stand-in's initials, and the stand-in of the organisation. Both sides are spelled out and meet in
equi-joins: organisations by every usual transliteration of their names, people by those of their surnames, which may stand
anywhere in a local part (see substrings.py). A piece of a local part meets one row at most, however many people have the
surname, so neither a common surname nor a common beginning of surnames multiplies rows.

Defined cases: of the surnames in a local part the longest counts, of equally long ones the leftmost, and of people with one
spelling the first by person_id; of organisations with one spelling the first by key. Spellings shorter than LEAST letters are
not looked for. Local parts that name an office and no person (info, sales) are left to others. Null addresses link to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incognita.functions import morphology as mo
from incognita.functions import text as tx
from incognita.operators import substrings
from incognita.operators.stand_ins import GENERIC_LOCALS

#: Letters that a surname must have to be looked for in a local part.
LEAST = 4


def _closed(word: Column) -> Column:
    return F.regexp_replace(word, "[ -]", "")


def organisation_labels(organisations: DataFrame) -> DataFrame:
    """label, org and fake_label: every spelling of organisations (key, fake) as a domain's first label."""
    each = organisations.select("key", _closed(tx.translit(F.col("fake"))).alias("fake_label"), F.explode(tx.translit_variants(F.col("key"))).alias("label"))
    each = each.select("key", "fake_label", _closed(F.col("label")).alias("label")).filter("label <> ''")
    first = each.groupBy("label").agg(F.min(F.struct("key", "fake_label")).alias("o"))
    return first.select("label", F.col("o.key").alias("org"), F.col("o.fake_label").alias("fake_label"))


def linked_domains(domains: DataFrame, organisations: DataFrame) -> DataFrame:
    """key, org and fake of those domains (key) whose first label spells an organisation (key, fake)."""
    labelled = domains.select("key", F.substring_index("key", ".", 1).alias("label"))
    suffix = F.regexp_replace("key", "^[^.]*", "")
    return labelled.join(organisation_labels(organisations), "label").select("key", "org", F.concat("fake_label", suffix).alias("fake"))


def surname_spellings(people: DataFrame) -> DataFrame:
    """spelling and person, the first of people (person_id, sur, gender, ..) whose surname is spelled so in Latin letters."""
    base = tx.norm_key(mo.surname_base(F.col("sur"), F.col("gender")))
    each = people.select(F.struct("person_id", *(c for c in people.columns if c != "person_id")).alias("person"), F.explode(tx.translit_variants(base)).alias("plain"))
    # Women's surnames are spelled with their ending, and as often without it.
    forms = F.when(F.col("person.gender") == "f", F.array(F.concat("plain", F.lit("a")), "plain")).otherwise(F.array("plain"))
    each = each.select("person", F.explode(forms).alias("spelling")).select("person", _closed(F.col("spelling")).alias("spelling"))
    return each.filter(F.char_length("spelling") >= LEAST).groupBy("spelling").agg(F.min_by("person", "person.person_id").alias("person"))


def surnames_within(addresses: DataFrame, people: DataFrame) -> DataFrame:
    """key, at (from 0), spelling and person of each of addresses (key) whose local part holds a surname of people."""
    known = surname_spellings(people).checkpoint()
    local = F.substring_index("key", "@", 1)
    rows = addresses.select("key", local.alias("text")).filter(~F.col("text").isin(*GENERIC_LOCALS)).distinct()
    met = substrings.places(rows, known.select(F.col("spelling").alias("piece"))).withColumnRenamed("piece", "spelling").join(known, "spelling")
    best = met.groupBy("key").agg(F.min(F.struct((-F.char_length("spelling")).alias("size"), "at", "spelling", "person.person_id")).alias("b"))
    return best.select("key", "b.at", "b.spelling").join(known, "spelling")


def linked_addresses(addresses: DataFrame, people: DataFrame) -> DataFrame:
    """key and fake (at the real host) of those addresses (key) that name one of people, who have f_sur, f_name and f_patr.

    Initials beside the surname become those of the stand-in; what else the local part has stays, so that an address that
    tells a surname and a number is told apart from the next. Addresses that would be given one stand-in are numbered.
    """
    found = surnames_within(addresses, people)
    local, host = F.substring_index("key", "@", 1), F.substring_index("key", "@", -1)
    size = F.char_length("spelling")
    front, back = F.substring(local, F.lit(1), F.col("at")), F.substr(local, F.col("at") + size + 1)
    initials = F.concat(*(F.substring(tx.translit(F.coalesce(f"person.{c}", F.lit(""))), 1, 1) for c in ("f_name", "f_patr")))
    before, gap = F.regexp_extract(front, "^([a-z]{1,2})[._-]?$", 1), F.regexp_extract(front, "^[a-z]{1,2}([._-]?)$", 1)
    front = F.when(before != "", F.concat(F.substring(initials, F.lit(1), F.char_length(before)), gap)).otherwise(front)
    parts = [F.regexp_extract(back, "^([._-]?)([a-z]{1,2})([0-9]*)$", i) for i in (1, 2, 3)]
    back = F.when(parts[1] != "", F.concat(parts[0], F.substring(initials, F.lit(1), F.char_length(parts[1])), parts[2])).otherwise(back)
    made = found.select("key", host.alias("host"), F.concat(front, _closed(tx.translit(F.col("person.f_sur"))), back).alias("local"))
    number = F.row_number().over(Window.partitionBy("host", "local").orderBy("key"))
    numbered = made.select("key", "host", "local", number.alias("number"))
    return numbered.select("key", F.concat("local", F.when(F.col("number") > 1, F.col("number").cast("string")).otherwise(""), F.lit("@"), "host").alias("fake"))
