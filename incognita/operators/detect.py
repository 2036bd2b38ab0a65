"""Detection of numbers, addresses and organisations in fragments of text.

A fragment is a paragraph, a cell or a line: (doc_id, frag_id, text, hint), where hint is the kind of the cell's column
or null. Every detector gives candidate spans; which of them are replaced is decided later, when it is known which have
a stand-in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incognita.functions import text as tx
from incognita.functions.checks import classify12, digits_only, luhn_valid

# What the detectors look for.
TLDS = "kz|ru|com|net|org|io|info|biz|uz|kg|by|su|pro|online|site|tech|app|dev|ai|co|me|eu|рф|қаз"
EMAIL = "(?U)(?<![\\w.+-])[\\w.+-]++@[\\w-]++(?:\\.[\\w-]++)++"
DOMAIN = f"(?iU)(?<![\\w@.-])(?:https?://)?(?:www\\.)?(?:[a-z0-9-]+\\.)+(?:{TLDS})(?![\\w-])"
IBAN = "(?i)(?<![A-Za-z0-9])KZ[0-9]{2}(?: ?[A-Z0-9]){16}(?![A-Za-z0-9])"
CARD = "(?U)(?<!\\d)(?:\\d{4}[ -]?){3}\\d{4}(?!\\d)"
ACCOUNT20 = "(?U)(?<!\\d)\\d{20}(?!\\d)"
NUMBER12 = "(?U)(?<!\\d)\\d{12}(?!\\d)"
PHONE = "(?U)(?<![\\w+])(?:\\+7|8|7)[\\s\\-]?\\(?\\d(?:[\\s\\-()]{0,2}\\d){9}(?!\\d)"
LABELLED = "(?U)\\b(ИНН|КПП|ОГРНИП|ОГРН|ОКПО|РНН|СНИЛС)\\s*(?::|№)?\\s*(\\d[\\d\\- ]{6,16}\\d)(?!\\d)"
#: What a text must hold for these patterns to match: plain strings are found much faster.
IN_IBAN, IN_LABELLED = ("KZ", "kz", "Kz", "kZ"), ("ИНН", "КПП", "ОГРН", "ОКПО", "РНН", "СНИЛС")
LEGAL_FORMS = (
    "Товарищество с ограниченной ответственностью", "Общество с ограниченной ответственностью", "Акционерное общество", "Публичное акционерное общество",
    "Закрытое акционерное общество", "Открытое акционерное общество", "Индивидуальный предприниматель", "Некоммерческое акционерное общество",
    "Жауапкершілігі шектеулі серіктестігі", "Жауапкершілігі шектеулі серіктестік", "Акционерлік қоғам", "Производственный кооператив", "Крестьянское хозяйство",
    "Частное учреждение", "Общественный фонд", "Общественное объединение", "ТОО", "ООО", "ОАО", "ЗАО", "ПАО", "НАО", "АО", "ИП", "ПК", "КХ", "ГУ", "КГУ", "РГП",
    "ГКП", "ОФ", "ОЮЛ", "ЧУ", "ЖШС", "АҚ", "LLP", "LLC", "JSC", "TOO", "Ltd", "Inc", "GmbH",
)
_FORMS = "|".join(sorted(LEGAL_FORMS, key=len, reverse=True))
ORG = f"(?iU)(?<!\\w)(?:{_FORMS})\\s*[{tx.OPENING}]([^»\"”“\\n]{{2,80}}?)[{tx.CLOSING}]"

#: Spans of one place are settled in this order; forms of names come last.
PRIORITY = ("exact", "email", "domain", "iban", "labelled", "acc20", "card", "number12", "lost_zero", "phone", "hinted_inn", "hinted_phone", "form")
CANDIDATE = "array<struct<prio:int,start:int,end:int,typ:string,family:string,key:string,old:string>>"
#: Kinds of 12-digit numbers share one family: a number has one stand-in, whatever column it is met in.
FAMILIES = {"iin": "number12", "bin": "number12", "num12": "number12"}


def _candidates(found: Column, step: str, typ, key, tail=None, keep=None) -> Column:
    """Spans of a detector; tail(value) is the part at the end of a match that is replaced."""

    def one(m: Column) -> Column:
        old = m["value"] if tail is None else tail(m["value"])
        kind = typ(m["value"]) if callable(typ) else F.lit(typ)
        family = lambda k: F.when(k.isin(*FAMILIES), "number12").otherwise(k)
        span = lambda o, k: F.struct(
            F.lit(PRIORITY.index(step)).alias("prio"), (m["end"] - F.char_length(o)).alias("start"), m["end"].alias("end"), k.alias("typ"), family(k).alias("family"), key(o).alias("key"), o.alias("old")
        )
        return tx.let(old, lambda o: tx.let(kind, lambda k: span(o, k)))

    found = found if keep is None else F.filter(found, lambda m: keep(m["value"]))
    return F.transform(found, one)


def _host(value: Column) -> Column:
    return F.regexp_replace(value, "(?i)^(?:https?://)?(?:www\\.)?(?=.*\\.)", "")


def _domain_tail(value: Column) -> Column:
    host = F.when(_host(value).rlike("\\."), _host(value)).otherwise(F.regexp_replace(value, "(?i)^https?://", ""))
    n = F.char_length(tx.registrable_domain(host))
    return F.substring(host, F.char_length(host) - n + 1, n)


def type12(hint: Column):
    def typ(value: Column) -> Column:
        kind = classify12(value)
        return F.when((kind == "num12") & hint.isin("iin", "bin"), hint).otherwise(kind)

    return typ


def _whole(text: Column, pattern: str) -> Column:
    """The trimmed text as a span, where all of it matches."""
    body = F.regexp_extract(text, f"(?U)^\\s*({pattern})\\s*$", 1)
    start = F.char_length(F.regexp_extract(text, "(?U)^\\s*", 0))
    span = F.struct(start.cast("int").alias("start"), (start + F.char_length(body)).cast("int").alias("end"), body.alias("value"))
    return F.when(body != "", F.array(span)).otherwise(F.array().cast(tx.SPAN))


def number_candidates(text: Column, hint: Column) -> Column:
    """All candidate spans of addresses and numbers, in no order."""
    compact = lambda v: F.upper(F.regexp_replace(v, "(?U)\\s", ""))
    labelled = lambda v: F.regexp_extract(v, LABELLED, 2)
    label_type = lambda v: F.when((F.regexp_extract(v, LABELLED, 1) == "ИНН") & F.char_length(digits_only(labelled(v))).isin(10, 12), "inn").otherwise("rekv")
    not_twelve = lambda v: ~((label_type(v) == "inn") & (F.char_length(digits_only(labelled(v))) == 12))
    none = F.array().cast(tx.SPAN)
    found = [
        _candidates(F.when(F.contains(text, F.lit("@")), tx.match_spans(text, EMAIL)).otherwise(none), "email", "email", F.lower),
        _candidates(F.when(F.contains(text, F.lit(".")), tx.match_spans(text, DOMAIN)).otherwise(none), "domain", "domain", F.lower, _domain_tail),
        _candidates(F.when(tx.holds_any(text, IN_IBAN), tx.match_spans(text, IBAN)).otherwise(none), "iban", "iban", compact),
        _candidates(F.when(tx.holds_any(text, IN_LABELLED), tx.match_spans(text, LABELLED)).otherwise(none), "labelled", label_type, digits_only, labelled, not_twelve),
        _candidates(tx.match_spans(text, ACCOUNT20), "acc20", "acc20", lambda v: v),
        _candidates(tx.match_spans(text, CARD), "card", "card", digits_only, None, lambda v: luhn_valid(digits_only(v))),
        _candidates(tx.match_spans(text, NUMBER12), "number12", type12(hint), lambda v: v),
        _candidates(F.when(hint.isin("iin", "bin"), _whole(text, "[0-9]{11}")).otherwise(none), "lost_zero", lambda v: type12(hint)(F.lpad(v, 12, "0")), lambda v: F.lpad(v, 12, "0")),
        _candidates(tx.match_spans(text, PHONE), "phone", "phone", lambda v: F.right(digits_only(v), F.lit(10))),
        _candidates(F.when(hint == "inn", _whole(text, "[0-9]{10}|[0-9]{12}")).otherwise(none), "hinted_inn", "inn", lambda v: v),
        _candidates(F.when((hint == "phone") & (F.char_length(digits_only(text)) == 10), _whole(text, "[\\s\\d()\\-+]+")).otherwise(none), "hinted_phone", "phone", digits_only),
    ]
    digits = text.rlike("[0-9]")
    numbers = F.when(digits, F.concat(*found[2:])).otherwise(F.array().cast(CANDIDATE))
    return F.concat(found[0], found[1], numbers)


def detect_numbers(fragments: DataFrame) -> DataFrame:
    """doc_id, frag_id and each candidate span of fragments (doc_id, frag_id, text, hint)."""
    each = fragments.select("doc_id", "frag_id", F.explode(number_candidates(F.col("text"), F.col("hint"))).alias("c"))
    return each.select("doc_id", "frag_id", "c.*")


def find_organisations(text: Column) -> Column:
    """Names between quotation marks behind a legal form, with positions."""
    # One character tells most texts that name none; the legal forms are asked for at each place.
    found = F.when(text.rlike(f"[{tx.OPENING}]"), tx.match_spans(text, ORG)).otherwise(F.array().cast(tx.SPAN))
    name = lambda m: F.regexp_extract(m["value"], ORG, 1)
    return F.transform(found, lambda m: F.struct((m["end"] - 1 - F.char_length(name(m))).alias("start"), (m["end"] - 1).alias("end"), F.trim(name(m)).alias("value")))


def strip_legal_form(value: Column) -> Column:
    """An organisation's bare name out of a cell."""
    quoted = F.regexp_extract(value, ORG, 1)
    bare = F.regexp_replace(F.trim(value), f"(?iU)^\\s*(?:{_FORMS})\\s+", "")
    return F.when(quoted != "", F.trim(quoted)).otherwise(F.regexp_replace(bare, f"^[{tx.OPENING}{tx.CLOSING} ]+|[{tx.OPENING}{tx.CLOSING} ]+$", ""))
