"""Stand-ins for numbers as keyed permutations: no draws, no collisions.

The free part of a number is a pair (x, y) with 0 <= x < a and 0 <= y < b. A Feistel network whose round function is a keyed
hash permutes the pairs; where the permuted pair gives no valid number, it is permuted again until one does (cycle walking). So
numbers of one kind and kept part have different stand-ins by construction, and each stand-in leads back to its number.
What a kind keeps is in `read` and `write`. Twelve-digit numbers are permuted within one of four disjoint sets (persons,
companies, other valid ones, invalid ones), whatever column they come from. A person's date of birth moves by 90 to 380
days: days are dealt into blocks, and a block's days go to the next block but one.

A stand-in must be no real number either. Map 0 gives most keys theirs: one semi-join with all real values tells which it
does not serve. These take the first of the maps 1 to MAPS - 1 whose value is no real number and not the image of one under
an earlier map; both are questions about real values only, since maps can be turned around, so nothing has to know what
others were given. Where a kept part is so crowded that these maps do not serve, its remaining values are listed, ordered by
a keyed hash and dealt out; the list is as long as the real values of that part times a constant. If none remain, it is an error.

Keys whose free part does not tell them apart (tax numbers and IBANs that differ in check digits alone) begin with map 1, 2
and so on. Maps are computed key by key in tasks that Spark deals out; all questions about other keys are joins.

Defined cases: a repeated key counts once; a key that is no number of its type (wrong length, other characters) is an error;
no keys give no rows. Other columns are not read.
"""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incognita.functions import checks

ROUNDS, MAPS = 8, 12
#: About how many keys a task permutes.
KEYS = 10_000
#: The most values of one kept part that are ever listed.
LISTED = 10**8
TYPES = ("iin", "bin", "num12", "iban", "card", "phone", "acc20", "inn", "rekv")
#: Leading characters that stay, and how many closing check digits a kind has.
_KEPT = {"bin": (6, 1), "v12": (1, 1), "x12": (1, 0), "card": (6, 1), "phone": (3, 0), "acc20": (5, 0), "inn10": (2, 1), "inn12": (2, 2), "rekv": (2, 0)}
#: Kinds whose check digits may be wrong.
_LOOSE = ("iban", "inn10", "inn12", "card")
_EPOCH, _GROUP, _BLOCK, _LAST, _LAST_BLOCK = datetime.date(1800, 1, 1), 508, 127, 215, 89


def _weighted(digits: str, weights: tuple[int, ...]) -> int:
    return sum(int(d) * w for d, w in zip(digits, weights))


def kz_digit(body: str) -> str | None:
    """The twelfth digit for eleven given ones."""
    found = next((r for w in (checks.KZ_WEIGHTS, checks.KZ_WEIGHTS_AGAIN) if (r := _weighted(body, w) % 11) < 10), None)
    return None if found is None else str(found)


def _luhn_digit(body: str) -> str:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in body[::-2])
    return str(-(doubled + sum(int(d) for d in body[-2::-2])) % 10)


def iban_digits(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _born(number: str) -> datetime.date | None:
    century = {"1": 1800, "2": 1800, "3": 1900, "4": 1900, "5": 2000, "6": 2000}.get(number[6])
    try:
        return datetime.date(century + int(number[:2]), int(number[2:4]), int(number[4:6])) if century else None
    except ValueError:
        return None


def kind_of(typ: str, key: str) -> str:
    if typ in ("iin", "bin", "num12"):
        if kz_digit(key[:11]) != key[11:]:
            return "x12"
        return "iin" if _born(key) else "bin" if key[4] in "456" and 1 <= int(key[2:4]) <= 12 else "v12"
    return f"inn{len(key)}" if typ == "inn" else typ


class Parts(NamedTuple):
    """A number as what is kept (kind, kept), and what is free: x below a, y below b; block and rest are free in ways of their own."""

    kind: str
    kept: str
    block: int
    rest: str
    x: int
    y: int
    a: int
    b: int

    def body(self) -> str:
        return "/".join(map(str, self[:6]))


def _halves(kind: str, kept: str, digits: str, rest: str = "") -> Parts:
    u = (len(digits) + 1) // 2
    return Parts(kind, kept, 0, rest, int(digits[:u] or 0), int(digits[u:] or 0), 10**u, 10 ** (len(digits) - u))


def read(typ: str, key: str) -> Parts | None:
    """A number of a type; None where it is none."""
    if typ not in TYPES or not key.isascii() or not key.isalnum() or (typ != "iban" and not key.isdigit()) or typ in ("iin", "bin", "num12") and len(key) != 12:
        return None
    kind = kind_of(typ, key)
    if kind == "iin":
        day = (_born(key) - _EPOCH).days
        group = min(day // _GROUP, _LAST)
        size = _BLOCK if group < _LAST else _LAST_BLOCK
        place, x = divmod(day - group * _GROUP, size)
        return Parts(kind, f"{(int(key[6]) + 1) % 2}:{group}:{place % 2}", place // 2, "", x, int(key[7:11]), size, 10**4)
    if kind == "iban":
        account = key[7:]
        shape = "".join("0" if c.isdigit() else c for c in account)
        return _halves(kind, f"{key[:2]}:{key[4:7]}:{''.join(c if c == '0' else 'A' for c in shape)}", "".join(c for c in account if c.isdigit()), shape)
    keep, closing = _KEPT.get(kind, (0, 0))
    free = key[keep : len(key) - closing]
    return _halves(kind, f"{key[:keep]}:{len(key)}", free) if keep and free else None


def write(z: Parts) -> str | None:
    """The number; None where there is none of these parts."""
    if z.kind == "iin":
        woman, group, place = map(int, z.kept.split(":"))
        day = _EPOCH + datetime.timedelta(group * _GROUP + (place + 2 * z.block) * z.a + z.x)
        if day.year >= 2100:
            return None
        body = f"{day:%y%m%d}{(1, 3, 5)[day.year // 100 - 18] + woman}{z.y:04d}"
        check = kz_digit(body)
        return None if check is None else body + check
    free = (f"{z.x:0{len(str(z.a)) - 1}d}" if z.a > 1 else "") + (f"{z.y:0{len(str(z.b)) - 1}d}" if z.b > 1 else "")
    if z.kind == "iban":
        country, bank, _ = z.kept.split(":")
        digits = iter(free)
        account = bank + "".join(next(digits) if c == "0" else c for c in z.rest)
        return country + iban_digits(country, account) + account
    body = z.kept.partition(":")[0] + free
    if z.kind in ("bin", "v12"):
        check = kz_digit(body)
        found = None if check is None else body + check
        return found if found and kind_of("num12", found) == z.kind else None
    if z.kind == "x12":
        return body if kind_of("num12", body) == "x12" else None
    if z.kind == "card":
        return body + _luhn_digit(body)
    closing = {"inn10": (checks.INN10_WEIGHTS,), "inn12": (checks.INN11_WEIGHTS, checks.INN12_WEIGHTS)}.get(z.kind, ())
    for weights in closing:
        body += str(_weighted(body, weights) % 11 % 10)
    return body


class Maps:
    """Permutations t = 0, 1, .. of one secret."""

    def __init__(self, secret: str):
        key = secret.encode()
        self.key = key if len(key) <= 64 else hashlib.sha256(key).digest()

    def drawn(self, *message) -> int:
        """A number by a keyed hash."""
        return int.from_bytes(hashlib.blake2b("|".join(map(str, message)).encode(), key=self.key, digest_size=12).digest())

    def drawer(self, *begin) -> Callable[..., int]:
        """drawn for messages that begin so: what they share is hashed once."""
        begun = hashlib.blake2b(("|".join(map(str, begin)) + "|").encode(), key=self.key, digest_size=12)

        def drawn(first, second) -> int:
            own = begun.copy()
            own.update(f"{first}|{second}".encode())
            return int.from_bytes(own.digest())

        return drawn

    def step(self, z: Parts, t: int, sign: int) -> Parts:
        x, y, drawn = z.x, z.y, self.drawer(z.kind, z.kept, t)
        for i in range(ROUNDS) if sign > 0 else range(ROUNDS - 1, -1, -1):
            if i % 2 == 0:
                x = (x + sign * drawn(i, y)) % z.a
            else:
                y = (y + sign * drawn(i, x)) % z.b
        rest = "".join(c if c == "0" else chr((ord(c) - 65 + sign * drawn("letter", i)) % 26 + 65) for i, c in enumerate(z.rest))
        return z._replace(x=x, y=y, rest=rest, block=1 - z.block if z.kind == "iin" else z.block)

    def walk(self, z: Parts, t: int, sign: int = 1) -> tuple[Parts, str]:
        """The first valid number on the way of map t, or of its inverse (sign -1)."""
        while True:
            z = self.step(z, t, sign)
            if (value := write(z)) is not None:
                return z, value

    def image(self, z: Parts, t: int) -> tuple[Parts, str | None]:
        """z under map t; no value where a date of birth would move too little."""
        after, value = self.walk(z, t)
        return after, value if z.kind != "iin" or after.block != z.block else None


def _per_row(make: Callable[..., Iterator[tuple]], schema: pa.Schema):
    """mapInArrow's function: the rows that make gives for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for row in zip(*(c.to_pylist() for c in batch.columns)) for r in make(*row)]
            columns = list(zip(*rows)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


_TEXT, _MANY = pa.string(), pa.list_(pa.string())


def _fields(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


def permuted(pending: DataFrame, known: DataFrame, secret: str) -> DataFrame:
    """typ, family, key and fake for each of pending (typ, family, key); known (family, key, fake) has what was given before."""
    maps = Maps(secret)
    of_family = lambda family: "num12" if family == "number12" else family

    def first(typ: str, family: str, key: str) -> Iterator[tuple]:
        z = read(typ, key)
        yield (typ, family, key, None, None, None) if z is None else (typ, family, key, z.kind, z.body(), maps.image(z, 0)[1])

    def known_body(family: str, key: str) -> Iterator[tuple]:
        z = read(of_family(family), key)
        yield (None if z is None else z.body(),)

    def later(typ: str, family: str, key: str, begin: int) -> Iterator[tuple]:
        z = read(typ, key)
        for t in range(begin, begin + MAPS - 1):
            after, value = maps.image(z, t)
            if value is not None:
                yield typ, family, key, t, value, [maps.walk(after, u, -1)[0].body() for u in range(t)]

    rows = pending.select("typ", "family", "key").dropDuplicates(["family", "key"]).checkpoint()
    # A key is a few bytes and some work: Spark would put many of them into one task.
    rows = rows.repartition(rows.count() // KEYS + 1).mapInArrow(_per_row(first, _fields(typ=_TEXT, family=_TEXT, key=_TEXT, kind=_TEXT, body=_TEXT, fake=_TEXT)), "typ string, family string, key string, kind string, body string, fake string").checkpoint()
    if not rows.filter("kind is null").isEmpty():
        raise ValueError("some keys are no numbers of their types")
    given = known.join(F.broadcast(rows.select("family").distinct()), "family", "left_semi").select("family", "key", "fake")
    taken = rows.select("family", "key").union(given.select("family", "key")).union(given.select("family", "fake")).distinct()
    older = given.select("family", "key").mapInArrow(_per_row(known_body, _fields(body=_TEXT)), "body string").filter("body is not null")
    # Numbers that differ in their check digits alone begin with one map after the other.
    loose = rows.filter(F.col("kind").isin(*_LOOSE)).select("family", "key", "body")
    held = older.groupBy("body").agg(F.count("*").cast("int").alias("held"))
    turn = (F.row_number().over(Window.partitionBy("body").orderBy("key")) - 1).alias("turn")
    begin = loose.select("*", turn).join(held, "body", "left").select("family", "key", (F.col("turn") + F.coalesce("held", F.lit(0))).alias("begin")).filter("begin > 0")
    real = rows.join(taken.select("family", F.col("key").alias("fake")), ["family", "fake"], "left_semi").union(rows.filter("fake is null").select("family", "fake", "typ", "key", "kind", "body"))
    late = begin.unionByName(real.select("family", "key").withColumn("begin", F.lit(1))).groupBy("family", "key").agg(F.max("begin").alias("begin")).checkpoint()
    drawn = rows.select("typ", "family", "key", "fake")
    if late.isEmpty():
        return drawn
    settled = drawn.join(late, ["family", "key"], "left_anti").checkpoint()
    asked = drawn.select("typ", "family", "key").join(late, ["family", "key"]).select("typ", "family", "key", "begin")
    kinds = _fields(typ=_TEXT, family=_TEXT, key=_TEXT, t=pa.int32(), fake=_TEXT, sources=_MANY)
    tried = asked.mapInArrow(_per_row(later, kinds), "typ string, family string, key string, t int, fake string, sources array<string>").checkpoint()
    # A value is refused if it is real, or the image of a real one under an earlier map.
    is_real = tried.join(taken.select("family", F.col("key").alias("fake")), ["family", "fake"], "left_semi").select("family", "key", "t")
    bodies = rows.select("body").union(older).distinct()
    is_image = tried.select("family", "key", "t", F.explode("sources").alias("body")).join(bodies, "body", "left_semi").select("family", "key", "t")
    free = tried.join(is_real.union(is_image).distinct(), ["family", "key", "t"], "left_anti")
    second = free.groupBy("family", "key").agg(F.min_by(F.struct("typ", "fake"), "t").alias("v")).select("v.typ", "family", "key", "v.fake").checkpoint()
    out = settled.unionByName(second)
    left = asked.join(second.select("family", "key"), ["family", "key"], "left_anti").select("typ", "family", "key").checkpoint()
    return out if left.isEmpty() else out.unionByName(_dealt(left, taken, out, maps))


def _dealt(left: DataFrame, taken: DataFrame, out: DataFrame, maps: Maps) -> DataFrame:
    """Stand-ins for numbers of crowded kept parts, out of the values that remain."""

    def parts(typ: str, family: str, key: str) -> Iterator[tuple]:
        z = read(typ, key)
        z = z._replace(block=1 - z.block if z.kind == "iin" else z.block)
        yield typ, family, key, "/".join(map(str, z[:4])), z.a, z.b

    def values(family: str, part: str, wanted: int, a: int, b: int, x: int) -> Iterator[tuple]:
        kind, kept, block, rest = part.split("/")
        for y in range(b):
            if (value := write(Parts(kind, kept, int(block), rest, x, y, a, b))) is not None:
                yield family, part, wanted, value, maps.drawn("dealt", value).to_bytes(12).hex()

    kinds = _fields(typ=_TEXT, family=_TEXT, key=_TEXT, part=_TEXT, a=pa.int64(), b=pa.int64())
    asked = left.mapInArrow(_per_row(parts, kinds), "typ string, family string, key string, part string, a long, b long").withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("key"))).checkpoint()
    if not asked.filter(F.col("a") * F.col("b") > LISTED).isEmpty():
        raise ValueError("a kept part with more values than can be listed is crowded")
    each = asked.groupBy("family", "part", "a", "b").agg(F.count("*").alias("wanted")).select("family", "part", "wanted", "a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("a") - 1)).alias("x"))
    kinds = _fields(family=_TEXT, part=_TEXT, wanted=pa.int64(), fake=_TEXT, rank=_TEXT)
    listed = each.repartition("part", "x").mapInArrow(_per_row(values, kinds), "family string, part string, wanted long, fake string, rank string")
    listed = listed.join(taken.select("family", F.col("key").alias("fake")).union(out.select("family", "fake")), ["family", "fake"], "left_anti")
    dealt = listed.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("rank"))).filter(F.col("place") <= F.col("wanted")).select("part", "place", "fake")
    given = asked.join(dealt, ["part", "place"], "left").select("typ", "family", "key", "fake").checkpoint()
    if not given.filter("fake is null").isEmpty():
        raise ValueError("all numbers of some kept part are real: none is left to stand in")
    return given
