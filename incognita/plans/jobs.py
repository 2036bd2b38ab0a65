"""The three jobs: obfuscate, check, restore. Each takes and gives DataFrames; where tables are kept is the caller's."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incognita.functions.headers import is_other
from incognita.functions.text import norm_key
from incognita.operators import audit, lexicon, names
from incognita.operators.detect import detect_numbers
from incognita.operators.replace import extend_mapping, replace
from incognita.operators.stand_ins import assign


@dataclass
class Knowledge:
    """What obfuscating has learned: needed, and enough, to restore."""

    mapping: DataFrame
    forms: DataFrame
    exact: DataFrame
    people: DataFrame


def learn(fragments: DataFrame, mapping: DataFrame, secret: str, stoplist: DataFrame | None = None, people: DataFrame | None = None, candidates: DataFrame | None = None, words: DataFrame | None = None) -> Knowledge:
    """Stand-ins for all people, organisations, numbers, addresses and domains of fragments.

    mapping and people are what earlier runs learned. Learning comes to its end before anything is replaced, so a name told
    in full in one place is known everywhere. Cells whose hint is person or org are learned whole. candidates: what
    detect_numbers has found in fragments, if at hand. words (word, small): common words known from elsewhere.
    """
    told = lexicon.veto(names.parsed(names.mentions(fragments).select("mention").distinct()).checkpoint(), fragments, words)
    read = names.readings(told.union(names.parsed_cells(names.typed_cells(fragments, "person"))).distinct()).checkpoint()
    found = names.people(read, people)
    orgs = names.organisations(fragments, mapping)
    if stoplist is not None:
        stop = stoplist.select(norm_key(F.col("key")).alias("stop"))
        found = found.join(stop, norm_key(F.col("sur")) == F.col("stop"), "left_anti")
        orgs = orgs.join(stop, F.col("key") == F.col("stop"), "left_anti")
    found, orgs = found.checkpoint(), orgs.checkpoint()
    shown, mapping = names.with_stand_ins(found, mapping, secret)
    mapping = mapping.unionByName(assign(orgs.select(F.lit("org").alias("typ"), F.lit("org").alias("family"), "key"), mapping, secret, ("org",)))
    shown = shown.checkpoint()
    mapping = extend_mapping(detect_numbers(fragments) if candidates is None else candidates, mapping.checkpoint(), secret, stoplist, shown).checkpoint()
    person_forms, person_exact = names.person_forms(shown)
    org_forms, org_exact = names.organisation_forms(orgs.join(mapping.filter("family = 'org'").select("key", "fake"), "key"))
    # What is a person's name already is no organisation's: a form stands for one thing.
    org_forms = org_forms.join(person_forms.select("direction", "key"), ["direction", "key"], "left_anti")
    org_exact = org_exact.join(person_exact.select("direction", "key"), ["direction", "key"], "left_anti")
    return Knowledge(mapping, person_forms.unionByName(org_forms).checkpoint(), person_exact.unionByName(org_exact).checkpoint(), found)


def obfuscate(fragments: DataFrame, known: Knowledge, candidates: DataFrame | None = None) -> DataFrame:
    """fragments with new_text and spans. Cells under headers of sums, dates and the like keep their numbers."""
    if "header" in fragments.columns:
        found = detect_numbers(fragments.filter(~is_other(F.col("header"))))
        candidates = found if candidates is None else candidates.join(fragments.filter(~is_other(F.col("header"))).select("doc_id", "frag_id"), ["doc_id", "frag_id"], "left_semi")
    return replace(fragments, known.mapping, False, known.forms, known.exact, candidates)


def restore(fragments: DataFrame, known: Knowledge) -> DataFrame:
    return replace(fragments, known.mapping, True, known.forms, known.exact)


def check(copies: DataFrame, known: Knowledge) -> DataFrame:
    return audit.leftovers(copies, known.mapping)
