"""Audit of copies, leftovers of restoring, and what has to be done again.

Substring searches of the kind "does any text hold any of these stems" are equi-joins here: runs of letters of the distinct
words of all texts meet the longest words of the stems by equality, and only ids meet texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incognita.functions import morphology as mo
from incognita.functions import text as tx
from incognita.operators import lexicon, names, substrings
from incognita.operators.detect import detect_numbers, find_organisations
from incognita.operators.replace import looked_up
from incognita.operators.stand_ins import PUBLIC_DOMAINS

#: Up to how many words that hold a piece are broadcast.
FEW = 300_000


def leaks(candidates: DataFrame, mapping: DataFrame) -> DataFrame:
    """doc_id, frag_id, category and value of the real values that mapping knows, of candidates as detect_numbers gives them."""
    return looked_up(candidates, mapping, restore=False).select("doc_id", "frag_id", F.lit("leak").alias("category"), F.col("old").alias("value"))


def leftovers(copies: DataFrame, mapping: DataFrame) -> DataFrame:
    """doc_id, frag_id, category and value of what in copies looks like personal data and is no stand-in.

    Categories: leak (a real value that the mapping knows), email, iban, number12, phone, card, org, person.
    """
    found = detect_numbers(copies).checkpoint()
    leak = leaks(found, mapping)
    known = mapping.select("family", "key").union(mapping.select("family", "fake")).distinct()
    unknown = found.join(known, ["family", "key"], "left_anti")
    host = tx.registrable_domain(F.substring_index("key", "@", -1))
    hosts = mapping.filter("typ = 'domain'").select(F.col("fake").alias("host"))
    email = unknown.filter("typ = 'email'").withColumn("host", host).join(hosts, "host", "left_anti").filter(~F.substring_index("key", "@", -1).isin(*PUBLIC_DOMAINS))
    # Round sums are no numbers of anybody; neither are numbers that a spreadsheet robbed of their leading zero.
    lost = mapping.filter("family = 'number12'").select(F.explode(F.array("key", "fake")).alias("full")).distinct()
    numbers = unknown.filter(F.col("family").isin("iban", "number12", "phone", "card")).filter(~F.col("old").rlike("^[0-9]+0{6}$"))
    eleven = F.when(F.col("old").rlike("^[0-9]{11}$"), F.lpad("old", 12, "0"))
    numbers = numbers.withColumn("full", eleven).join(lost, "full", "left_anti")
    out = leak.union(email.select("doc_id", "frag_id", F.lit("email"), "old")).union(numbers.select("doc_id", "frag_id", "family", "old"))
    orgs = copies.select("doc_id", "frag_id", F.explode(find_organisations(F.col("text"))).alias("o")).select("doc_id", "frag_id", F.col("o.value").alias("value"))
    given = mapping.filter("family = 'org'").select(F.explode(F.array("key", tx.norm_key(F.col("fake")))).alias("k")).distinct()
    orgs = orgs.withColumn("k", tx.norm_key(F.col("value"))).join(given, "k", "left_anti")
    said = names.mentions(copies)
    read = names.readings(lexicon.veto(names.parsed(said.select("mention").distinct()).checkpoint(), copies))
    fakes = mapping.filter("family = 'surname'").select(tx.norm_key(F.col("fake")).alias("base")).distinct()
    ours = read.withColumn("base", tx.norm_key(mo.surname_base(F.col("sur"), F.col("gender")))).join(fakes, "base", "left_semi").select("mention").distinct()
    strangers = said.join(read.select("mention").distinct(), "mention", "left_semi").join(ours, "mention", "left_anti")
    out = out.union(orgs.select("doc_id", "frag_id", F.lit("org"), "value"))
    return out.union(strangers.select("doc_id", "frag_id", F.lit("person"), "mention"))


def suspicious(found: DataFrame) -> DataFrame:
    """How often each (category, value) was found."""
    return found.groupBy("category", "value").agg(F.count("*").alias("times"))


def surname_stem(base: Column) -> Column:
    first = F.get(F.split(base, "-"), F.lit(0))
    return F.when(F.char_length(first) > 6, F.substring(first, F.lit(1), F.char_length(first) - 2)).otherwise(first)


def org_stem(name: Column) -> Column:
    return F.when(F.char_length(name) > 5, F.substring(name, F.lit(1), F.char_length(name) - 1)).otherwise(name)


def stems(mapping: DataFrame, side: str = "fake") -> DataFrame:
    """Stems, at least four letters long, of stand-ins (side fake) or real names (side key)."""
    value = F.col(side) if side == "fake" else F.substring_index("key", "|", 1)
    found = mapping.filter("family in ('surname', 'org')").select(F.when(F.col("family") == "surname", surname_stem(value)).otherwise(org_stem(F.col(side))).alias("stem"))
    return found.select(tx.norm_key(F.col("stem")).alias("stem")).filter(F.char_length("stem") >= 4).distinct()


def holding(texts: DataFrame, stems_: DataFrame, inside: bool = False) -> DataFrame:
    """doc_id and stem for each text (doc_id, text) in which a stem stands at the beginning of a word; or anywhere, if inside.

    A stem is looked up by the longest of its words in the distinct words of all texts, and the ids of the texts that have
    such a word follow by an equi-join. That settles stems of one word; for others, the texts of these ids are read.
    Stems without a letter or figure are not looked up; a stem stands in no null text. Case, ё and repeated white space do not
    count.
    """
    parts = lambda c: F.filter(F.split(c, "(?U)[^\\w]+"), lambda w: w != "")
    longest = F.get(F.array_sort(parts(F.col("stem")), lambda a, b: F.char_length(b) - F.char_length(a)), F.lit(0))
    wanted = stems_.select("stem", longest.alias("piece")).filter("piece is not null").distinct()
    # Beside the piece, a stem of several words has what is of no word: there the text's word begins or ends as well.
    begins, ends = F.instr("stem", F.col("piece")) > 1, F.instr("stem", F.col("piece")) + F.char_length("piece") <= F.char_length("stem")
    wanted = wanted.select("stem", "piece", begins.alias("begins"), ends.alias("ends")).checkpoint()
    keyed = texts.select("doc_id", tx.norm_key(F.col("text")).alias("text"))
    # Words shorter than any piece hold none.
    told = wanted.agg(F.count("*").alias("rows"), F.coalesce(F.min(F.char_length("piece")), F.lit(0)).alias("least")).first()
    words = keyed.select("doc_id", F.filter(F.array_distinct(parts(F.col("text"))), lambda w: F.char_length(w) >= told.least).alias("words")).checkpoint().select("doc_id", F.explode("words").alias("word"))
    met = substrings.places(words.select(F.col("word").alias("key"), F.col("word").alias("text")).distinct(), wanted)
    met = (met if inside else met.filter("at = 0")).join(wanted, "piece").filter("(not begins or at = 0) and (not ends or at + char_length(piece) = char_length(key))")
    met = met.select(F.col("key").alias("word"), "piece", "stem").distinct().checkpoint()
    held = words.join(F.broadcast(met) if met.count() <= FEW else met, "word").groupBy("doc_id")
    held = held.agg(F.collect_set(F.when(F.col("piece") == F.col("stem"), F.col("stem"))).alias("whole"), F.collect_set(F.when(F.col("piece") != F.col("stem"), F.col("stem"))).alias("several")).checkpoint()
    whole = held.select("doc_id", F.explode("whole").alias("stem"))
    # Texts are read once more where a stem has several words, or a character that is of none.
    meant = keyed.join(held.filter(F.size("several") > 0).select("doc_id", "several"), "doc_id")

    def stands(stem: Column) -> Column:
        if inside:
            return F.contains("text", stem)
        written = F.concat(F.lit("(?U)(?:^|[^\\w])\\Q"), F.replace(stem, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        return F.contains("text", stem) & F.rlike("text", written)

    return whole.union(meant.select("doc_id", F.explode(F.filter("several", stands)).alias("stem")).distinct())


def changed_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files (path, sha256) whose content the ledger (path, sha256) does not have."""
    return files.join(ledger.select("path", "sha256"), ["path", "sha256"], "left_anti")


def to_redo(old_texts: DataFrame, mapping: DataFrame, new_since: DataFrame) -> DataFrame:
    """doc_ids of old texts that name people or organisations learned since (new_since: family, key)."""
    fresh = mapping.join(new_since, ["family", "key"], "left_semi")
    return holding(old_texts, stems(fresh, "key"), inside=True).select("doc_id").distinct()
