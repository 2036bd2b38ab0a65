"""Keys, tokens, spans and spelling, as Column expressions. All positions are code points from 0."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Russian and Kazakh letters.
UPPER = "А-ЯЁӘҒҚҢӨҰҮҺІ"
LOWER = "а-яёәғқңөұүһі"
TRANSLIT = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "",
    "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "ә": "a", "ғ": "g", "қ": "k", "ң": "n", "ө": "o", "ұ": "u", "ү": "u", "һ": "h", "і": "i",
}
OPENING = "«\"“„'"
CLOSING = "»\"”“'"
TOKEN = "(?U)(?:[^\\W\\d_]\\.)|\\w+(?:[-‐]\\w+)*|[«»\"“”„']"
SPAN = "array<struct<start:int,end:int,value:string>>"
_MARK = "\x01"
_DOUBLE_SUFFIX = ("com", "org", "net", "gov", "edu", "co")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once, however often body names it, also within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values: Iterable[str]) -> Column:
    """An array of strings. One SQL expression: many small ones take their time to build."""
    return F.expr(f"array({', '.join(map(quoted, values))})")


def holds_any(text: Column, values: Iterable[str]) -> Column:
    """Whether a text holds one of some plain strings, which is told much faster than a pattern's match."""
    return reduce(or_, (F.contains(text, F.lit(v)) for v in values))


def fold_yo(value: Column) -> Column:
    """ё is written е as often as not."""
    return F.translate(value, "ёЁ", "еЕ")


def norm_key(value: Column) -> Column:
    """Trimmed, single-spaced, in small letters."""
    return fold_yo(F.lower(F.trim(F.regexp_replace(value, "(?U)\\s+", " "))))


def registrable_domain(host: Column) -> Column:
    """The last two labels; three behind com.kz and the like."""
    parts = F.split(F.lower(host), "\\.")
    n = F.size(parts)
    three = (n >= 3) & F.get(parts, n - 2).isin(*_DOUBLE_SUFFIX)
    keep = F.least(n, F.when(three, 3).otherwise(2))
    return F.array_join(F.slice(parts, n - keep + 1, keep), ".")


def gaps(text: Column, pattern: str) -> Column:
    """What stands before, between and behind the matches of a pattern, which matches no empty string.

    split compiles its pattern for each row, and that takes longer than matching it; replacing keeps the compiled one. So
    matches become marks first, and texts that hold the mark themselves are split in the plain way.
    """
    marked = F.split(F.regexp_replace(text, pattern, _MARK), _MARK, -1)
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, pattern, -1)).otherwise(marked)


def match_spans(text: Column, pattern: str) -> Column:
    """start, end and value of each match of a pattern, which matches no empty string, in a short text: gaps and matches, side by side, summed up from the left.

    One pass of the pattern puts marks around all matches; looking for one, taking them out and taking out what stands
    between were three. Texts that hold the mark themselves go the plain way.
    """
    none, nothing = F.array().cast(SPAN), F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    pair = lambda gap, v: F.struct(F.char_length(gap).alias("gap"), v.alias("value"))

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.char_length(p["value"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value")))).alias("spans"))

    def spans(pieces: Column) -> Column:
        pairs = F.transform(F.filter(pieces, lambda _, i: i % 2 == 1), lambda v, i: pair(F.get(pieces, i * 2), v))
        return F.aggregate(pairs, nothing, add)["spans"]

    # The last gap has no match behind it.
    plain = F.filter(F.zip_with(F.regexp_extract_all(text, F.lit(pattern), 0), gaps(text, pattern), lambda v, g: pair(g, v)), lambda p: p["value"].isNotNull())
    # Most texts have no match, and stay whole.
    found = let(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), lambda m: F.when(F.contains(m, F.lit(_MARK)), let(F.split(m, _MARK, -1), spans)).otherwise(none))
    return F.when(F.contains(text, F.lit(_MARK)), F.aggregate(plain, nothing, add)["spans"]).otherwise(found)


def tokens(text: Column) -> Column:
    """Initials, words (with inner hyphens) and quotation marks, with positions."""
    return match_spans(text, TOKEN)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def shadow_caps(text: Column) -> Column:
    """ALL-CAPS Cyrillic words in title case, each half of a hyphenated one; the length stays."""
    pattern = f"(?U)\\b[{UPPER}]{{2,}}(?:-[{UPPER}]{{2,}})?\\b"
    values = F.regexp_extract_all(text, F.lit(pattern), 0)
    titled = F.transform(values, lambda v: F.array_join(F.transform(F.split(v, "-"), lambda part: F.initcap(part)), "-"))
    joined = F.array_join(F.zip_with(gaps(text, pattern), titled, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")
    return F.when(text.rlike(pattern), joined).otherwise(text)


def _by_letter(value: Column) -> Column:
    table = F.map_from_arrays(strings(TRANSLIT), strings(TRANSLIT.values()))
    return F.array_join(F.transform(F.split(F.lower(value), ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")


def translit(value: Column) -> Column:
    return _by_letter(value)


def translit_variants(value: Column) -> Column:
    """How names are commonly spelled in addresses: the plain transliteration and its usual variants."""
    base = translit(value)
    soft = F.replace(F.replace(base, F.lit("yu"), F.lit("iu")), F.lit("ya"), F.lit("ia"))
    found = [base, F.replace(base, F.lit("kh"), F.lit("h")), soft, F.replace(base, F.lit("zh"), F.lit("j")), F.replace(base, F.lit("ts"), F.lit("c"))]
    ends = base.endswith("iy")
    found += [F.when(ends, F.regexp_replace(base, "iy$", "y")), F.when(ends, F.regexp_replace(base, "iy$", "i"))]
    return F.filter(F.array_distinct(F.array_compact(F.array(*found))), lambda v: v != "")


def format_like(sample: Column, key: Column, significant: str = "[0-9]") -> Column:
    """The sample with its last significant characters replaced by key's, separators kept.

    A sample that lost leading zeros gets the key without as many zeros; if the key has none to lose, the key itself.
    """
    # Significant characters, and what stands around them: one more of these.
    own, around = F.regexp_extract_all(sample, F.lit(significant), 0), gaps(sample, significant)
    n = F.size(own)
    lost = F.greatest(F.char_length(key) - n, F.lit(0))
    short = F.substring(key, lost + 1, F.char_length(key))
    # The first characters stay where the key has fewer.
    signs = F.concat(F.slice(own, F.lit(1), n - F.char_length(short)), F.when(short == "", F.array().cast("array<string>")).otherwise(F.split(short, "")))
    written = F.array_join(F.zip_with(around, signs, lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))), "")
    loses_digits = (lost > 0) & F.substring(key, F.lit(1), lost).rlike("[^0]")
    return F.when(loses_digits, key).otherwise(written)


def splice(text: Column, spans: Column) -> Column:
    """The text with each of the ordered, disjoint spans (start, end, new) replaced at once."""

    def add(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], kept, s["new"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text)))


def keep_disjoint(spans: Column, kind: str, by_place: bool = False) -> Column:
    """Of ordered spans, each that overlaps none kept before it; kind is the array's type.

    Of spans that are ordered by place (and are not empty), only the last one kept can reach into the next.
    """

    def add(acc: Column, s: Column) -> Column:
        if by_place:
            clash = F.coalesce(s["start"] < F.try_element_at(acc, F.lit(-1))["end"], F.lit(False))
        else:
            clash = F.exists(acc, lambda k: (s["start"] < k["end"]) & (k["start"] < s["end"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, F.array().cast(kind), add)


def redistribute(runs: Column, spans: Column) -> Column:
    """Texts of formatting runs after replacing spans of their joined text.

    A replacement goes whole to the run in which it starts; other runs keep what no span covers.
    """
    sized = F.transform(runs, lambda r, i: F.struct(F.aggregate(F.slice(runs, 1, i), F.lit(0), lambda a, x: a + F.char_length(x)).alias("from"), r.alias("run")))

    def one(r: Column) -> Column:
        start, text = r["from"], r["run"]
        end = start + F.char_length(text)
        own = F.filter(spans, lambda s: (s["start"] < end) & (s["end"] > start))

        def add(acc: Column, s: Column) -> Column:
            a, b = F.greatest(s["start"], start), F.least(s["end"], end)
            kept = F.substring(text, acc["at"] - start + 1, a - acc["at"])
            new = F.when(s["start"] >= start, s["new"]).otherwise("")
            return F.struct(b.alias("at"), F.concat(acc["out"], kept, new).alias("out"))

        done = F.aggregate(own, F.struct(start.alias("at"), F.lit("").alias("out")), add)
        return F.concat(done["out"], F.substring(text, done["at"] - start + 1, F.char_length(text)))

    return F.transform(sized, one)
