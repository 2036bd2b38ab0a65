"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Seeds are what four plain patterns find (e-mail and IP addresses, card numbers, phone numbers), and keys: runs of 24 or more
letters and digits that have both, as access tokens and digests are. Each token that looks like an identifier (it has a digit
or an at sign) has two lexical patterns: the two words before it, back to the token before (a single one where there is but
one), and the words next to it on both sides; those without a letter are none. Patterns and tokens form a graph, which is
scored in rounds: a pattern's score is the mean score of the distinct tokens that follow it, provided enough of them
are good; a token's score is 1 for a seed and else that of its best pattern. Tokens that end above the threshold are
added, wherever a pattern above the threshold holds them. A key is no base match, so it is added only there too: a digest
in some other place, as of a file, is left alone. The graph is counted over all documents, by partial sums.

Positions come from splitting the text at the matches: gaps and matches are read side by side, and their lengths summed up
in a window over one text's matches. All positions are code points. Patterns begin only where a run of their characters
begins, or where the last match ended, so a long run without a match costs one pass, and time grows with the length of a
text also where it has very many matches.

Defined cases: null and empty texts have no spans. Very long texts are read whole. Spans with one start are ordered by kind,
then by end. Rows that repeat a doc_id are each returned; equal rows have equal spans. A row without doc_id is treated like any other. An empty table gives an empty result. Columns other than doc_id
and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incognita.llm import session

BASE_KINDS = ("email", "ip", "card", "phone")
FOUND = "identifier"
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\\.{_HOST}++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    # Chains of fewer than 12 digits are no cards, and stand in no other chain's way.
    "card": "(?:\\G|(?<![0-9]))[0-9](?:[ -]?+[0-9]){11}(?:[ -]?[0-9])*+",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
}
_SPACE = " \\t\\n\\x0B\\f\\r"
TOKEN = f"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"
KEY = "(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{24,}+"
_PIECES = "array<struct<gap:int,value:string,contexts:array<string>>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    """Whether a match of a kind's pattern is one of that kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda p: F.char_length(F.ltrim(p, F.lit("0"))) < F.when(F.ltrim(p, F.lit("0")) > "255", 3).otherwise(4))
    n = F.char_length(digits(value))
    return (n.between(12, 19) & F.call_function("luhn_check", digits(value))) if kind == "card" else n.between(9, 15)


def _last_words(gap: Column) -> Column:
    """The last two words of a gap between tokens, in small letters; a single one where it has but one."""
    spaced = F.rtrim(F.translate(gap, "\t\n\x0b\f\r", "     "))
    last = F.substring_index(spaced, " ", -1)
    rest = F.rtrim(F.substring(spaced, F.lit(1), F.char_length(spaced) - F.char_length(last)))
    return F.lower(F.trim(F.concat_ws(" ", F.substring_index(rest, " ", -1), last)))


def _contexts(before: Column, after: Column) -> Column:
    """The patterns of a token between two gaps, in small letters: the last words before it, and the words on both sides."""
    left = _last_words(before)
    right = F.lower(F.substring_index(F.ltrim(F.translate(F.coalesce(after, F.lit("")), "\t\n\x0b\f\r", "     ")), " ", 1))
    sides = F.when((left != "") & (right != ""), F.concat(F.substring_index(left, " ", -1), F.lit(" _ "), right))
    # A pattern holds a word, not signs alone.
    return F.filter(F.array(left, sides), lambda c: c.rlike("\\p{L}"))


def _pieces(text: Column, pattern: str, when: Column, context: bool = False) -> Column:
    """The matches, each with the length of the gap before it, and its patterns if asked for."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)

    def piece(value: Column, gap: Column, contexts: Column) -> Column:
        return F.struct(F.char_length(gap).alias("gap"), value.alias("value"), contexts.alias("contexts"))

    # The last gap has no match behind it.
    if not context:
        none = F.array().cast("array<string>")
        return F.when(when, F.filter(F.zip_with(found, gaps, lambda v, g: piece(v, g, none)), lambda p: p["value"].isNotNull()))
    pairs = F.zip_with(gaps, F.slice(gaps, 2, F.size(gaps)), lambda before, after: F.struct(before.alias("before"), after.alias("after")))
    return F.when(when, F.filter(F.zip_with(found, pairs, lambda v, g: piece(v, g["before"], _contexts(g["before"], g["after"]))), lambda p: p["value"].isNotNull()))


def matches(docs: DataFrame) -> DataFrame:
    """All matches of the four patterns and all identifier-like tokens: doc_id, version, kind, start, end, value, contexts.

    version tells texts of one doc_id apart. Equal rows give their matches once.
    """
    text = F.col("text")
    at, digit = F.contains(text, F.lit("@")), text.rlike("[0-9]")
    when = {"email": at, "ip": digit & F.contains(text, F.lit(".")), "card": digit, "phone": F.contains(text, F.lit("+"))}
    kinds = [F.struct(F.lit(k).alias("kind"), F.coalesce(_pieces(text, p, when[k]), F.array().cast(_PIECES)).alias("pieces")) for k, p in PATTERNS.items()]
    kinds.append(F.struct(F.lit("token").alias("kind"), _pieces(text, TOKEN, at | digit, context=True).alias("pieces")))
    # The cheap test comes first, in a filter of its own, so that most texts meet none of the patterns.
    some = docs.filter(at | digit).select("doc_id", F.xxhash64("text").alias("version"), F.explode(F.array(*kinds)).alias("of"))
    once = some.select("doc_id", "version", "of.kind", "of.pieces").filter(F.size("pieces") > 0).groupBy("doc_id", "version", "kind").agg(F.any_value("pieces").alias("pieces"))
    each = once.select("doc_id", "version", "kind", F.posexplode("pieces").alias("i", "p"))
    size = F.char_length("p.value")
    until = F.sum(F.col("p.gap") + size).over(Window.partitionBy("doc_id", "version", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return each.select("doc_id", "version", "kind", (until - size).alias("start"), until.alias("end"), F.col("p.value").alias("value"), F.col("p.contexts").alias("contexts"))


def is_seed(token: Column) -> Column:
    """Whether a token holds a base match or begins one."""
    first = lambda kind: F.regexp_extract(token, PATTERNS[kind], 0)
    checks = [(first(k) != "") & F.coalesce(valid(k, first(k)), F.lit(False)) for k in ("email", "ip", "card")]
    return checks[0] | checks[1] | checks[2] | token.rlike("\\+[0-9]") | token.rlike(KEY)


def bootstrap(tokens: DataFrame, rounds: int, threshold: float, support: int) -> DataFrame:
    """(context, value) pairs to add: tokens in high-scoring patterns. tokens has contexts and value."""
    edges = tokens.select(F.explode("contexts").alias("context"), "value").groupBy("context", "value").agg(F.lit(1).alias("edge"))
    graph = edges.select("context", "value", is_seed(F.col("value")).alias("seed")).checkpoint()
    scored = graph.withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds):
        patterns = scored.groupBy("context").agg(F.avg("score").alias("mean"), F.count_if(F.col("score") >= threshold).alias("good"))
        patterns = patterns.select("context", F.when(F.col("good") >= support, F.col("mean")).otherwise(0.0).alias("pattern_score"))
        edges = graph.join(patterns, "context")
        best = edges.groupBy("value").agg(F.max("pattern_score").alias("best"))
        scored = edges.join(best, "value").select("context", "value", "seed", "pattern_score", F.when(F.col("seed"), 1.0).otherwise(F.col("best")).alias("score"))
    return scored.filter((F.col("score") >= threshold) & (F.col("pattern_score") >= threshold)).select("context", "value")


def find_personal_data(docs: DataFrame, rounds: int = 3, threshold: float = 0.9, support: int = 5) -> DataFrame:
    """doc_id and spans (start, rank of kind, kind, end) of each row of docs (doc_id, text), in order.

    threshold: the least score of a pattern and of a token to be added. support: how many distinct tokens of at least
    that score must follow a pattern.
    """
    session.prepare(docs.sparkSession)
    docs = session.columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = matches(docs).checkpoint()
    ok = F.lit(False)
    for k in BASE_KINDS:
        ok = F.when(F.col("kind") == k, F.coalesce(valid(k, F.col("value")), F.lit(False))).otherwise(ok)
    base = found.filter(F.col("kind") != "token").filter(ok).select("doc_id", "version", "kind", "start", "end")
    tokens = found.filter(F.col("kind") == "token")
    held = tokens.select("doc_id", "version", "start", "end", "value", F.explode("contexts").alias("context"))
    # Punctuation around a token is not part of it; a token of nothing else goes. Both of its patterns may hold it.
    inner = F.regexp_replace("value", "[^\\p{L}\\p{N}=]+$", "")
    lead = F.char_length(inner) - F.char_length(F.regexp_replace(inner, "^[^\\p{L}\\p{N}@+]+", ""))
    added = held.join(bootstrap(tokens, rounds, threshold, support), ["context", "value"])
    added = added.select("doc_id", "version", F.lit(FOUND).alias("kind"), (F.col("start") + lead).alias("start"), (F.col("end") - F.char_length("value") + F.char_length(inner)).alias("end"))
    added = added.filter("start < end").distinct()
    # No base span is lost to an added one: an added one that overlaps a base span is dropped. It does if of the base
    # spans that begin before its end one ends behind its start.
    is_base = F.col("kind") != FOUND
    placed = base.union(added).withColumn("at", F.when(is_base, F.col("start")).otherwise(F.col("end")))
    own = Window.partitionBy("doc_id", "version").orderBy("at", is_base.cast("int")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.when(is_base, F.col("end"))).over(own), F.lit(0))
    clear = placed.withColumn("reach", reach).filter(is_base | (F.col("reach") <= F.col("start")))
    rank = F.array_position(F.array(*map(F.lit, (*BASE_KINDS, FOUND))), F.col("kind")).cast("int")
    spans = clear.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("s_doc"), F.col("version").alias("s_version"), "spans")
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("version") == F.col("s_version")), "left")
    return joined.select("doc_id", F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")).alias("spans"))


def number_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
