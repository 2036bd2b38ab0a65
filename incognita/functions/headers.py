"""What a table column holds, told by its header, and whether a cell looks like it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from incognita.functions.checks import digits_only

# Words of headers. Numbers are tried first, in this order, then people, then organisations.
NUMBERS = (
    ("bin", "\\bбин\\b|\\bбсн\\b"), ("iin", "\\bиин\\b|\\bжсн\\b"), ("iban", "\\bиик\\b|iban|\\bсч[её]т\\b|р/с"),
    ("phone", "\\bтел(ефон)?\\b|моб"), ("email", "\\bпочта\\b|e-?mail|эл\\. ?почта"), ("inn", "\\bинн\\b"),
)
PERSON = (
    "фио", "ф.и.о", "контакт", "сотрудник", "ответствен", "фамилия", "подписант", "исполнитель", "менеджер", "получатель (фио", "аты-жөні",
    "аты жөні", "т.а.ә", "тегі", "руководител", "директор", "бухгалтер", "работник", "клиент (фио", "заявитель", "представитель",
)
ORG = (
    "подрядчик", "поставщик", "контрагент", "заказчик", "клиент", "компания", "организация", "покупатель", "получатель", "продавец",
    "арендатор", "арендодатель", "дебитор", "кредитор", "ұйым", "наименование юр", "юр. лицо", "юрлицо",
)
OTHER = ("фактур", "сумм", "итог", "кол-во", "количеств", "цена", "дата", "номер счета-ф", "статус", "вид", "тип", "должност")
NOT_VALUES = ("итого", "всего", "-", "—", "нет", "н/д")


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(text, p))


def is_other(header: Column) -> Column:
    """Headers of sums, dates and the like: their numbers are no identifiers."""
    return F.coalesce(_any(F.lower(F.trim(header)), OTHER), F.lit(False))


def kind_by_header(header: Column) -> Column:
    """iin, bin, iban, phone, email, inn, person, org or null."""
    h = F.lower(F.trim(header))
    found = F.when((h == "") | (F.char_length(h) > 60) | _any(h, OTHER), F.lit(None).cast("string"))
    for kind, pattern in NUMBERS:
        found = found.when(h.rlike(f"(?U){pattern}"), kind)
    return found.when(_any(h, PERSON), "person").when(_any(h, ORG), "org")


def looks(kind: Column, value: Column) -> Column:
    """Whether a cell can be of its column's kind."""
    v = F.trim(value)
    n = F.char_length(digits_only(v))
    compact = F.regexp_replace(v, "[ \\t-]", "")
    number12 = n.isin(11, 12) & (n == F.char_length(compact))
    iban = F.regexp_replace(v, " ", "").rlike("(?i)^KZ[0-9]{2}[A-Z0-9]{16}$") | (n == 20)
    rest = (F.char_length(v) >= 2) & v.rlike("\\p{L}")
    by_kind = F.when(kind.isin("iin", "bin"), number12).when(kind == "iban", iban).when(kind == "phone", n >= 10).when(kind == "email", F.contains(v, F.lit("@"))).when(kind == "inn", n.isin(10, 12)).otherwise(rest)
    return F.coalesce((v != "") & ~F.lower(v).isin(*NOT_VALUES) & by_kind, F.lit(False))
