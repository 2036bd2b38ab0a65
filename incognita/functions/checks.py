"""Validity of identity, bank and tax numbers, as Column expressions over strings.

Numbers are strings throughout: leading zeros count. A null gives a null or false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the check digits.
KZ_WEIGHTS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)
KZ_WEIGHTS_AGAIN = (3, 4, 5, 6, 7, 8, 9, 10, 11, 1, 2)
INN10_WEIGHTS = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN11_WEIGHTS = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_WEIGHTS = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def all_digits(value: Column, n: int) -> Column:
    return value.rlike(f"^[0-9]{{{n}}}$")


def weighted(value: Column, weights: tuple[int, ...]) -> Column:
    """The sum of the first digits times their weights; null where a digit is missing."""
    chars = F.split(F.substring(value, 1, len(weights)), "")
    terms = F.zip_with(chars, F.expr(f"array({', '.join(map(str, weights))})"), lambda c, w: F.when(c.between("0", "9"), F.ascii(c) - 48) * w)
    return F.aggregate(terms, F.lit(0), lambda total, term: total + term)


def kz_check_digit(body: Column) -> Column:
    """The twelfth digit for eleven given ones; null where no such number is issued."""
    first, again = weighted(body, KZ_WEIGHTS) % 11, weighted(body, KZ_WEIGHTS_AGAIN) % 11
    return F.get(F.filter(F.array(first, again), lambda digit: digit < 10), F.lit(0))


def kz_valid(number: Column) -> Column:
    return F.coalesce(all_digits(number, 12) & (kz_check_digit(number) == F.substring(number, 12, 1).try_cast("int")), F.lit(False))


def iin_date(number: Column) -> Column:
    """The date of birth in an individual's number, or null."""
    century = F.element_at(F.create_map(*(F.lit(x) for pair in zip("123456", ("18", "18", "19", "19", "20", "20")) for x in pair)), F.substring(number, 7, 1))
    return F.try_to_date(F.concat(century, F.substring(number, 1, 6)), "yyyyMMdd")


def classify12(number: Column) -> Column:
    """iin, bin or num12."""
    month = F.substring(number, 3, 2).try_cast("int")
    company = F.substring(number, 5, 1).isin("4", "5", "6") & month.between(1, 12)
    return F.when(~kz_valid(number), "num12").when(iin_date(number).isNotNull(), "iin").when(company, "bin").otherwise("num12")


def luhn_valid(number: Column) -> Column:
    return F.coalesce(number.rlike("^[0-9]+$") & F.call_function("luhn_check", number), F.lit(False))


def iban_check(country: Column, account: Column) -> Column:
    """The two check digits of an IBAN, by remainders of the digits from the left."""
    chars = F.split(F.upper(F.concat(account, country, F.lit("00"))), "")
    step = lambda left, c: F.when(c.rlike("[0-9]"), (left * 10 + c.try_cast("int")) % 97).otherwise((left * 100 + F.ascii(c) - 55) % 97)
    return F.lpad((98 - F.aggregate(chars, F.lit(0), step)).cast("string"), 2, "0")


def iban_valid(iban: Column) -> Column:
    upper = F.upper(iban)
    right = iban_check(F.substring(upper, 1, 2), F.substring(upper, 5, 100)) == F.substring(upper, 3, 2)
    return F.coalesce((F.char_length(upper) >= 15) & upper.rlike("^[A-Z0-9]+$") & right, F.lit(False))


def inn_check_digit(number: Column, weights: tuple[int, ...]) -> Column:
    return (weighted(number, weights) % 11 % 10).cast("string")


def inn_valid(number: Column) -> Column:
    """A tax number of 10 or 12 digits with right check digits."""
    ten = all_digits(number, 10) & (inn_check_digit(number, INN10_WEIGHTS) == F.substring(number, 10, 1))
    twelve = all_digits(number, 12) & (inn_check_digit(number, INN11_WEIGHTS) == F.substring(number, 11, 1)) & (inn_check_digit(number, INN12_WEIGHTS) == F.substring(number, 12, 1))
    return F.coalesce(ten | twelve, F.lit(False))
