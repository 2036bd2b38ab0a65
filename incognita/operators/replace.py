"""Replacing spans in one pass: real values by stand-ins, and stand-ins by real values.

A mapping has typ, family, key and fake, unique on (family, key) and on (family, fake). Forms of names, if given, are
(direction, first, key, dst, need_quotes): token sequences that stand for one another.

Candidates meet the mapping in one join on (family, key); the hash of a text is not needed, so texts are shuffled once,
with the spans that remain, by (doc_id, frag_id). A value that a third of all fragments hold makes a hot key of that
join only where the mapping is too large to broadcast; Spark then splits the skewed side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incognita.functions import text as tx
from incognita.operators.detect import PRIORITY, detect_numbers
from incognita.operators.links import linked_addresses, linked_domains
from incognita.operators.permuted import TYPES, permuted
from incognita.operators.sequences import path, standing
from incognita.operators.stand_ins import GENERIC_LOCALS, PUBLIC_DOMAINS, assign, unassigned

SPAN = "array<struct<prio:int,start:int,end:int,typ:string,old:string,new:string>>"
MAPPING = "typ string, family string, key string, fake string"


def creatable(typ: Column, key: Column) -> Column:
    """Public and government domains, and generic addresses at them, name nobody."""
    host = F.substring_index(key, "@", -1)
    public = F.array_contains(tx.strings(PUBLIC_DOMAINS), host) | host.endswith(".gov.kz")
    generic = F.array_contains(tx.strings(GENERIC_LOCALS), F.substring_index(key, "@", 1))
    return F.when(typ == "domain", ~public).when(typ == "email", ~(public & generic)).otherwise(True)


def new_keys(candidates: DataFrame, stoplist: DataFrame | None = None) -> DataFrame:
    """The keys to give stand-ins to: those of spans that win their place, and the domains of such addresses.

    A number met with several kinds is of the first of iin, bin and num12. stoplist has a column key.
    """
    spans = candidates.filter(creatable(F.col("typ"), F.col("key")))
    ordered = spans.groupBy("doc_id", "frag_id").agg(F.array_sort(F.collect_list(F.struct("prio", "start", "end", "typ", "family", "key"))).alias("spans"))
    kind = "array<struct<prio:int,start:int,end:int,typ:string,family:string,key:string>>"
    won = ordered.select(F.explode(tx.keep_disjoint(F.col("spans"), kind)).alias("s")).select("s.typ", "s.family", "s.key")
    hosts = won.filter("typ = 'email'").select(F.lit("domain").alias("typ"), F.lit("domain").alias("family"), F.substring_index("key", "@", -1).alias("key"))
    hosts = hosts.select("typ", "family", tx.registrable_domain(F.col("key")).alias("key")).filter(creatable(F.col("typ"), F.col("key")))
    rank = F.when(F.col("typ") == "iin", 0).when(F.col("typ") == "bin", 1).otherwise(2)
    keys = won.union(hosts).groupBy("family", "key").agg(F.min_by("typ", rank).alias("typ")).select("typ", "family", "key")
    if stoplist is not None:
        keys = keys.join(stoplist.select(tx.norm_key(F.col("key")).alias("stop")), F.lower("key") == F.col("stop"), "left_anti")
    return keys


def extend_mapping(candidates: DataFrame, mapping: DataFrame, secret: str, stoplist: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """mapping with stand-ins for all numbers, addresses and domains among candidates, as detect_numbers gives them.

    Domains that spell an organisation of mapping, and addresses that hold the surname of one of people (as
    names.with_stand_ins gives them), carry the stand-ins of these. Addresses are given stand-ins after domains: the part
    behind the at sign is the domain's stand-in.
    """
    keys = new_keys(candidates, stoplist).checkpoint()
    met = {r.typ for r in keys.select("typ").distinct().collect()}
    others = mapping
    if met & set(TYPES):
        others = others.unionByName(permuted(unassigned(keys.filter(F.col("typ").isin(*TYPES)), mapping), mapping, secret))
    if "domain" in met:
        hosts = keys.filter("typ = 'domain'")
        named = linked_domains(hosts.select("key"), mapping.filter("family = 'org'").select("key", "fake")).select(F.lit("domain").alias("family"), "key", "fake")
        others = others.unionByName(assign(hosts, mapping, secret, ("domain",), proposed=named))
    if "email" not in met:
        return others
    written_to = keys.filter("typ = 'email'")
    meant = None if people is None or people.isEmpty() else linked_addresses(written_to.select("key"), people).select(F.lit("email").alias("family"), "key", "fake")
    emails = assign(written_to, mapping, secret, ("email",), proposed=meant)
    host = F.substring_index("key", "@", -1)
    tail = tx.registrable_domain(host)
    domains = others.filter("typ = 'domain'").select(F.col("key").alias("tail"), F.col("fake").alias("tail_fake"))
    moved = emails.withColumn("host", host).withColumn("tail", tail).join(domains, "tail", "left")
    front = F.substring(F.col("host"), F.lit(1), F.char_length("host") - F.char_length("tail"))
    fake = F.concat(F.substring_index("fake", "@", 1), F.lit("@"), F.when(F.col("tail_fake").isNull(), F.col("host")).otherwise(F.concat(front, F.col("tail_fake"))))
    return others.unionByName(moved.select("typ", "family", "key", fake.alias("fake")))


def _written(step: Column, typ: Column, old: Column, new: Column) -> Column:
    """A stand-in in the written form of what it replaces."""
    iban = tx.format_like(F.upper(old), new, "[A-Za-z0-9]")
    plain = step.isin(*(PRIORITY.index(s) for s in ("email", "domain", "acc20", "number12", "hinted_inn")))
    return F.when(typ == "iban", iban).when(plain, new).otherwise(tx.format_like(old, new))


def looked_up(candidates: DataFrame, mapping: DataFrame, restore: bool) -> DataFrame:
    """Candidate spans that have a counterpart, with it as new."""
    side = mapping.select(F.col("family").alias("m_family"), (F.col("fake") if restore else F.col("key")).alias("m_key"), (F.col("key") if restore else F.col("fake")).alias("m_new"))
    found = candidates.join(side, (F.col("family") == F.col("m_family")) & (F.col("key") == F.col("m_key")), "left" if restore else "inner")
    new = F.when(F.col("m_new").isNotNull(), _written(F.col("prio"), F.col("typ"), F.col("old"), F.col("m_new")))
    if restore:
        # An address that was changed in the copy: the local part stays, the domain comes back.
        domains = mapping.filter("typ = 'domain'").select(F.col("fake").alias("d_fake"), F.col("key").alias("d_key"))
        host = F.substring_index("key", "@", -1)
        found = found.withColumn("tail", F.when(F.col("typ") == "email", tx.registrable_domain(host))).join(domains, F.col("tail") == F.col("d_fake"), "left")
        kept = F.substring(F.col("old"), F.lit(1), F.char_length("old") - F.char_length("tail"))
        new = F.when((F.col("typ") == "email") & F.col("m_new").isNull() & F.col("d_key").isNotNull(), F.concat(kept, F.col("d_key"))).otherwise(new)
    # Exploded, as a filter on a column would have it worked out several times over.
    changed = F.explode(F.filter(F.array(new), lambda n: n != F.col("old"))).alias("new")
    return found.select("doc_id", "frag_id", "prio", "start", "end", "typ", "old", changed)


def form_spans(fragments: DataFrame, forms: DataFrame) -> DataFrame:
    """Spans of token sequences in fragments that forms (key, dst, need_quotes) has.

    From the left, the longest form at each place is taken and the search goes on behind it. Forms are found by a walk along
    them, sorted (sequences.py); places hold a few tokens and no text, and only fragments with a hit meet their text again.
    """
    named = fragments.select("doc_id", "frag_id", F.transform(tx.words(F.col("text")), tx.fold_yo).alias("names"))
    met = standing(named, forms.select("key")).join(forms.select(path(F.col("key")).alias("path"), "dst", "need_quotes"), "path")
    hits = met.groupBy(F.col("doc_id").alias("h_doc"), F.col("frag_id").alias("h_frag")).agg(F.collect_list(F.struct("i", "n", "dst", "need_quotes")).alias("hits"))
    rows = fragments.join(hits, F.col("doc_id").eqNullSafe(F.col("h_doc")) & (F.col("frag_id") == F.col("h_frag"))).select("doc_id", "frag_id", "text", tx.tokens(F.col("text")).alias("toks"), "hits")

    def span(h: Column) -> Column:
        own, text = F.slice("toks", h["i"] + 1, h["n"]), F.col("text")
        left, right = F.get("toks", h["i"] - 1)["value"], F.get("toks", h["i"] + h["n"])["value"]
        quoted = F.coalesce(left.rlike(f"^[{tx.OPENING}]$") & right.rlike(f"^[{tx.CLOSING}]$"), F.lit(False))
        after = F.slice("toks", h["i"] + 2, h["n"] - 1)
        gaps = F.zip_with(F.slice(own, F.lit(1), h["n"] - 1), after, lambda t, u: F.substring(text, t["end"] + 1, u["start"] - t["end"]))
        ok = (~h["need_quotes"] | quoted) & F.forall(gaps, lambda g: g.rlike("^\\s*$"))
        # As many tokens: the source's gaps are kept; else single spaces.
        joined = F.array_join(F.zip_with(h["dst"], F.concat(F.array(F.lit("")), gaps), lambda d, g: F.concat(g, d)), "")
        new = F.when(F.size(h["dst"]) == h["n"], joined).otherwise(F.array_join(h["dst"], " "))
        start, end = F.get("toks", h["i"])["start"], F.get("toks", h["i"] + h["n"] - 1)["end"]
        return F.struct(ok.alias("ok"), start.alias("start"), end.alias("end"), F.substring(text, start + 1, end - start).alias("old"), new.alias("new"))

    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).when(a["new"] < b["new"], -1).otherwise(1)
    found = F.array_sort(F.filter(F.transform("hits", span), lambda s: s["ok"]), order)
    kept = tx.keep_disjoint(found, "array<struct<ok:boolean,start:int,end:int,old:string,new:string>>", by_place=True)
    each = rows.select("doc_id", "frag_id", F.explode(kept).alias("s"))
    return each.select("doc_id", "frag_id", F.lit(PRIORITY.index("form")).alias("prio"), "s.start", "s.end", F.lit("form").alias("typ"), "s.old", "s.new").filter("new <> old")


def exact_spans(fragments: DataFrame, exact: DataFrame) -> DataFrame:
    """Fragments that are, but for space around them, one known value (exact: key, dst)."""
    body = F.trim(F.col("text"))
    at = F.char_length(F.regexp_extract("text", "(?U)^\\s*", 0))
    found = fragments.withColumn("x_key", tx.norm_key(F.col("text"))).join(exact.select(F.col("key").alias("x_key"), "dst"), "x_key")
    shout = (body == F.upper(body)) & (body != F.lower(body))
    new = F.when(shout, F.upper("dst")).otherwise(F.col("dst"))
    span = found.select("doc_id", "frag_id", F.lit(0).alias("prio"), at.alias("start"), (at + F.char_length(body)).alias("end"), F.lit("exact").alias("typ"), body.alias("old"), new.alias("new"))
    return span


def resolve(spans: DataFrame) -> DataFrame:
    """One row per fragment: its spans, disjoint and from left to right. Of overlapping ones the first by priority stays.

    A fragment with an exact span has no others.
    """
    ordered = spans.groupBy("doc_id", "frag_id").agg(F.array_sort(F.collect_list(F.struct("prio", "start", "end", "typ", "old", "new"))).alias("spans"))
    alone = F.filter("spans", lambda s: s["prio"] == 0)
    kept = F.when(F.size(alone) > 0, F.slice(alone, 1, 1)).otherwise(tx.keep_disjoint(F.col("spans"), SPAN))
    by_place = lambda a, b: a["start"] - b["start"]
    return ordered.select("doc_id", "frag_id", F.array_sort(kept, by_place).alias("spans"))


def replace(fragments: DataFrame, mapping: DataFrame, restore: bool = False, forms: DataFrame | None = None, exact: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """fragments with new_text and spans. Blank and null texts stay as they are. candidates: what detect_numbers has found in them, if at hand."""
    spans = looked_up(detect_numbers(fragments) if candidates is None else candidates, mapping, restore)
    direction = "rev" if restore else "fwd"
    if forms is not None:
        spans = spans.unionByName(form_spans(fragments, forms.filter(F.col("direction") == direction)))
    if exact is not None:
        spans = spans.unionByName(exact_spans(fragments, exact.filter(F.col("direction") == direction)))
    resolved = resolve(spans).select(F.col("doc_id").alias("s_doc"), F.col("frag_id").alias("s_frag"), "spans")
    joined = fragments.join(resolved, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("frag_id") == F.col("s_frag")), "left").drop("s_doc", "s_frag")
    empty = F.array().cast(SPAN)
    return joined.withColumn("new_text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(tx.splice(F.col("text"), F.col("spans")))).withColumn("spans", F.coalesce("spans", empty))


def statistics(replaced: DataFrame) -> DataFrame:
    """How often each (typ, before, after) was replaced."""
    each = replaced.select(F.explode("spans").alias("s"))
    return each.groupBy(F.col("s.typ").alias("typ"), F.col("s.old").alias("before"), F.col("s.new").alias("after")).agg(F.count("*").alias("times"))


def by_type(replaced: DataFrame) -> DataFrame:
    """How many spans of each type were replaced, and in all (typ null)."""
    return replaced.select(F.explode("spans.typ").alias("typ")).rollup("typ").agg(F.count("*").alias("times"))
