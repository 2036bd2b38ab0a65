"""Registered queries over the test tables and the SQL that gives the same rows.

The tables hold no Cyrillic text, so most queries run on fragments derived from customers by SQL that both engines
read. Properties that SQL cannot compute (a stand-in is valid, a round trip gives the text back) are counted by the
query, and the SQL states the count that must come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita import cluster
from incognita.functions import checks, headers
from incognita.functions import morphology as mo
from incognita.functions import text as tx
from incognita.functions.keyed import digits, hmac_hex, padded
from incognita.operators import audit, lexicon, links, names, paths
from incognita.operators.detect import detect_numbers, find_organisations
from incognita.operators.replace import MAPPING, by_type, extend_mapping, replace, statistics
from incognita.operators.sequences import standing
from incognita.plans import jobs
from incognita.sources.mapping_export import export_rows

SECRET = "a secret of the tests"

_N = "CAST(c_custkey AS BIGINT)"
_PAD = lambda value, n: f"lpad(CAST({value} AS STRING), {n}, '0')"
#: doc_id, frag_id, kind, text and hint: six fragments of each customer.
DERIVED = f"""
SELECT c_custkey AS doc_id, frag_id, kind, text, hint FROM (
  SELECT c_custkey, 0 AS frag_id, 'number12' AS kind, 'ИИН ' || {_PAD(f"({_N} * 7919 + 850101300000) % 1000000000000", 12)} || ' от ' || {_PAD(f"{_N} % 28 + 1", 2)} || '.01.2024' AS text, CAST(NULL AS STRING) AS hint FROM customer
  UNION ALL SELECT c_custkey, 1, 'phone', 'тел. +7 (7' || {_PAD(f"{_N} % 100", 2)} || ') ' || {_PAD(f"{_N} * 37 % 1000", 3)} || '-' || {_PAD(f"{_N} % 89 + 10", 2)} || '-' || {_PAD(f"{_N} * 7 % 100", 2)}, NULL FROM customer
  UNION ALL SELECT c_custkey, 2, 'card', 'карта 4400 43' || {_PAD(f"{_N} % 100", 2)} || ' ' || {_PAD(f"{_N} * 31 % 10000", 4)} || ' ' || {_PAD(f"{_N} * 77 % 10000", 4)} || '; счёт 40817810' || {_PAD(_N, 12)}, NULL FROM customer
  UNION ALL SELECT c_custkey, 3, 'email', 'почта user' || CAST({_N} AS STRING) || '@firma' || CAST({_N} % 20 AS STRING) || '.kz или info@gmail.com', NULL FROM customer
  UNION ALL SELECT c_custkey, 4, 'org', 'ТОО «Ромашка' || CAST({_N} % 50 AS STRING) || '» и ЖШС "Жұлдыз ' || CAST({_N} % 30 AS STRING) || '"', NULL FROM customer
  UNION ALL SELECT c_custkey, 5, 'labelled', 'ОГРН: ' || {_PAD(f"{_N} + 1027700000000", 13)} || ', ИНН ' || {_PAD(f"({_N} * 104729 + 7700000000) % 10000000000", 10)} || ', IBAN KZ86125KZT' || {_PAD(_N, 10)}, NULL FROM customer
) AS d
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: How many customers a task gets.
_CUSTOMERS = 2_000


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey of all customers, dealt out: a key is a few bytes and some work, and Spark would put all keys into a few tasks."""
    keys = _table(spark, sf_dir, "customer").select("c_custkey")
    return keys.repartition(keys.count() // _CUSTOMERS + 1, "c_custkey")


def _derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """What a query that DuckDB reads too derives from customers."""
    return spark.sql(sql.replace("FROM customer", "FROM {customer}"), customer=_customers(spark, sf_dir))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, DERIVED)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("frag_id"), "text", F.lit(None).cast("string").alias("hint"))


def _no_mapping(spark: SparkSession) -> DataFrame:
    """An empty mapping that the optimizer knows to be empty."""
    return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {kind}) AS {name}" for name, kind in (c.split() for c in MAPPING.split(", "))) + " WHERE false")


def roundtrip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and cards of documents: how many, and whether replacing and restoring gives the text back."""
    cluster.prepare(spark)
    lines = F.posexplode_outer(F.split("text", "\n")).alias("frag_id", "text")
    docs = _table(spark, sf_dir, "documents").select("doc_id", lines).select("doc_id", F.coalesce("frag_id", F.lit(0)).alias("frag_id"), "text", F.lit(None).cast("string").alias("hint"))
    found = detect_numbers(docs).checkpoint()
    mapping = extend_mapping(found, _no_mapping(spark), SECRET).checkpoint()
    done = replace(docs, mapping, candidates=found).select("doc_id", "frag_id", "text", "hint", "new_text", "spans").checkpoint()
    # Lines that did not change are their own copies.
    changed = done.filter(F.size("spans") > 0)
    back = replace(changed.select("doc_id", "frag_id", F.col("new_text").alias("text"), "hint"), mapping, restore=True)
    wrong = changed.select("doc_id", "frag_id", "text").join(back.select("doc_id", "frag_id", F.col("new_text").alias("now")), ["doc_id", "frag_id"]).filter(~F.col("text").eqNullSafe(F.col("now")))
    wrong = wrong.groupBy("doc_id").agg(F.count("*").alias("wrong"))
    # Of a text that is null, nothing is known.
    count = lambda kind: F.sum(F.when(F.col("text").isNotNull(), F.size(F.filter("spans", lambda s: s["typ"] == kind)))).cast("long")
    told = done.groupBy("doc_id").agg(count("email").alias("n_email"), count("card").alias("n_card"))
    return told.join(wrong, "doc_id", "left").select("doc_id", "n_email", "n_card", F.col("wrong").isNull().alias("roundtrip_ok"))


_DOUBLED = "regexp_replace(text, '([^0-9])', '\\1\\1', 'g')"
_LUHN = "list_sum(list_transform(range(16), lambda i: CASE WHEN i % 2 = 0 THEN CAST(c[i + 1] AS INT) * 2 - CASE WHEN CAST(c[i + 1] AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST(c[i + 1] AS INT) END)) % 10 = 0"


def _cards(text: str) -> str:
    """DuckDB: the Luhn-valid numbers written like cards; every non-digit is doubled, so that matches can touch."""
    found = f"regexp_extract_all({_DOUBLED.replace('text', text)}, '(?:^|[^0-9])((?:[0-9]{{4}}(?:  |--)?){{3}}[0-9]{{4}})(?:[^0-9]|$)', 1)"
    return f"list_filter(list_transform({found}, lambda v: regexp_replace(v, '[^0-9]', '', 'g')), lambda c: {_LUHN})"


_EMAILS = "regexp_extract_all(text, '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_-]+(?:\\.[\\p{L}\\p{N}_-]+)+')"
O_ROUNDTRIP = f"SELECT doc_id, len({_EMAILS}) AS n_email, len({_cards('text')}) AS n_card, true AS roundtrip_ok FROM documents"


def detect_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_numbers(_documents(spark, sf_dir)).filter("typ = 'email'")
    return found.groupBy("doc_id", "key").agg(F.count("*").alias("times"))


O_EMAILS = f"SELECT doc_id, lower(e) AS key, count(*) AS times FROM (SELECT doc_id, unnest({_EMAILS}) AS e FROM documents) GROUP BY ALL"


def detect_url_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(0).alias("frag_id"), F.col("url").alias("text"), F.lit(None).cast("string").alias("hint"))
    return detect_numbers(pages).filter("typ = 'domain'").groupBy("key").agg(F.count("*").alias("pages"))


O_URL_DOMAINS = "SELECT regexp_extract(lower(url), '://([a-z0-9.-]+)', 1) AS host, 1 FROM pages"
O_URL_DOMAINS = f"SELECT array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS key, count(*) AS pages FROM ({O_URL_DOMAINS}) GROUP BY ALL"


def detect_in_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in the derived fragments: kinds, keys and places."""
    found = detect_numbers(fragments(spark, sf_dir))
    return found.select("doc_id", "frag_id", "typ", "key", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"))


def _kz(d: str) -> str:
    """DuckDB: whether a 12-digit string has the right check digit."""
    total = lambda w: "(" + " + ".join(f"CAST(substr({d}, {i + 1}, 1) AS INT) * {x}" for i, x in enumerate(w)) + ") % 11"
    first, again = total(checks.KZ_WEIGHTS), total(checks.KZ_WEIGHTS_AGAIN)
    return f"(CASE WHEN {first} < 10 THEN {first} WHEN {again} < 10 THEN {again} ELSE -1 END = CAST(substr({d}, 12, 1) AS INT))"


def _class12(d: str) -> str:
    born = f"try_strptime(CASE substr({d}, 7, 1) WHEN '1' THEN '18' WHEN '2' THEN '18' WHEN '3' THEN '19' WHEN '4' THEN '19' WHEN '5' THEN '20' WHEN '6' THEN '20' ELSE 'xx' END || substr({d}, 1, 6), '%Y%m%d')"
    return f"CASE WHEN NOT {_kz(d)} THEN 'num12' WHEN {born} IS NOT NULL THEN 'iin' WHEN substr({d}, 5, 1) IN ('4', '5', '6') AND CAST(substr({d}, 3, 2) AS INT) BETWEEN 1 AND 12 THEN 'bin' ELSE 'num12' END"


def _piece(kind: str, label: str, pattern: str, typ: str, key: str = "v") -> str:
    """DuckDB: the span behind a label in fragments of one kind."""
    at = f"strpos(text, '{label}' || v) - 1 + length('{label}')"
    found = f"SELECT doc_id, frag_id, text, regexp_extract(text, '{label}({pattern})', 1) AS v FROM f WHERE frag_id = {kind}"
    return f"SELECT doc_id, frag_id, {typ} AS typ, {key} AS key, {at} AS span_start, {at} + length(v) AS span_end FROM ({found}) WHERE v <> ''"


_BARE = "regexp_replace(v, '[^0-9]', '', 'g')"
_CARDS = f"SELECT * FROM ({_piece('2', 'карта ', '[0-9 ]{19}', "'card'", _BARE)}) WHERE len(list_filter([key], lambda c: {_LUHN})) = 1"
O_FRAGMENTS = f"WITH f AS ({DERIVED}) " + " UNION ALL ".join((
    _piece("0", "ИИН ", "[0-9]{12}", _class12("v")), _piece("1", "тел. ", "[^a-z]*", "'phone'", f"right({_BARE}, 10)"), _CARDS, _piece("2", "счёт ", "[0-9]{20}", "'acc20'"),
    _piece("3", "почта ", "user[0-9]+@[a-z0-9.]+", "'email'"), _piece("3", " или ", "info@gmail.com", "'email'"), _piece("5", "ОГРН: ", "[0-9]{13}", "'rekv'"),
    _piece("5", "ИНН ", "[0-9]{10}", "'inn'"), _piece("5", "IBAN ", "KZ[0-9A-Z]{18}", "'iban'"),
))


def validate_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.lpad(((F.col("o_orderkey").cast("long") * 98765431 + 850101300000) % 1000000000000).cast("string"), 12, "0")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", number.alias("number"))
    return rows.select("o_orderkey", "number", checks.kz_valid(F.col("number")).alias("valid"), checks.classify12(F.col("number")).alias("kind"), checks.luhn_valid(F.col("number")).alias("luhn"), checks.inn_valid(F.col("number")).alias("inn"))


def _inn12(d: str) -> str:
    part = lambda w: "(" + " + ".join(f"CAST(substr({d}, {i + 1}, 1) AS INT) * {x}" for i, x in enumerate(w)) + ") % 11 % 10"
    return f"({part(checks.INN11_WEIGHTS)} = CAST(substr({d}, 11, 1) AS INT) AND {part(checks.INN12_WEIGHTS)} = CAST(substr({d}, 12, 1) AS INT))"


_LUHN12 = "(" + " + ".join(f"CASE WHEN {i} % 2 = 0 THEN CAST(substr(number, {i + 1}, 1) AS INT) * 2 - CASE WHEN CAST(substr(number, {i + 1}, 1) AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST(substr(number, {i + 1}, 1) AS INT) END" for i in range(12)) + ") % 10 = 0"
O_VALIDATE = f"SELECT o_orderkey, number, {_kz('number')} AS valid, {_class12('number')} AS kind, {_LUHN12} AS luhn, {_inn12('number')} AS inn FROM (SELECT o_orderkey, lpad(CAST((CAST(o_orderkey AS BIGINT) * 98765431 + 850101300000) % 1000000000000 AS VARCHAR), 12, '0') AS number FROM orders)"


def iban_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    account = F.concat(F.lit("125KZT"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0"))
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", account.alias("account"))
    made = rows.withColumn("check_digits", checks.iban_check(F.lit("KZ"), F.col("account")))
    iban = F.concat(F.lit("KZ"), "check_digits", "account")
    return made.select("s_suppkey", "check_digits", checks.iban_valid(iban).alias("valid"), checks.iban_valid(F.concat(F.lit("KZ00"), "account")).alias("valid_zero"))


_IBAN_NUMBER = "CAST('125' || '20' || '35' || '29' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') || '2035' || '00' AS HUGEINT)"
O_IBAN = f"SELECT s_suppkey, lpad(CAST(98 - {_IBAN_NUMBER} % 97 AS VARCHAR), 2, '0') AS check_digits, true AS valid, false AS valid_zero FROM supplier"


def normalised_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  Ёлка  «"), F.col("c_name"), F.lit("»\t ЩУКА "))
    return _table(spark, sf_dir, "customer").select("c_custkey", tx.norm_key(raw).alias("key"), tx.translit(F.concat(F.lit("Щербакова Хрящий "), F.col("c_mktsegment"))).alias("latin"))


O_KEYS = "SELECT c_custkey, 'елка «' || lower(c_name) || '» щука' AS key, 'scherbakova khryaschiy ' || lower(c_mktsegment) AS latin FROM customer"


def registrable_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/:?#]+)", 1)
    rows = _table(spark, sf_dir, "pages").select("page_id", host.alias("host"))
    return rows.select("page_id", tx.registrable_domain(F.col("host")).alias("domain"), tx.registrable_domain(F.concat(F.col("host"), F.lit(".com.kz"))).alias("double_suffix"))


_HOST = "string_split(lower(regexp_extract(url, '://([^/:?#]+)', 1)), '.')"
O_DOMAINS = f"SELECT page_id, array_to_string(list_slice({_HOST}, -2, -1), '.') AS domain, list_last({_HOST}) || '.com.kz' AS double_suffix FROM pages"

_HEADERS = {
    "ИИН сотрудника": "iin", "БИН": "bin", "р/с": "iban", "Счёт": "iban", "Счет-фактура": None, "Телефон": "phone", "Эл. почта": "email", "ИНН": "inn", "ФИО": "person",
    "Контактное лицо": "person", "Контрагент": "org", "Сумма, тг": None, "Получатель": "org", "Получатель (ФИО)": "person", "Дата": None, "": None, "Ұйым": "org", "Примечание": None,
}


def _by_customer(spark: SparkSession, sf_dir: str, texts: tuple[str, ...]) -> DataFrame:
    """c_custkey and word: one of the texts for each customer, in turn."""
    named = F.element_at(tx.strings(texts), (F.col("c_custkey") % len(texts)).cast("int") + 1)
    return _customers(spark, sf_dir).select("c_custkey", named.alias("word"))


def _in_turn(rows: str) -> str:
    """DuckDB: c_custkey with the row that _by_customer gives it, of VALUES whose first column is the place."""
    return f"SELECT * FROM customer JOIN (VALUES {rows}) AS t"


def header_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the headers of columns tell, each spelled as in a customer's own sheet: with white space, capitals and a number."""
    rows = _by_customer(spark, sf_dir, tuple(_HEADERS))
    spelled = F.when(F.col("word") == "", "").when(F.col("c_custkey") % 3 == 0, F.upper("word")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("  "), "word")).otherwise(F.concat("word", F.lit(" "), F.col("c_custkey").cast("string")))
    rows = rows.select("c_custkey", spelled.alias("header"))
    return rows.select("c_custkey", "header", headers.kind_by_header(F.col("header")).alias("kind"), headers.is_other(F.col("header")).alias("other"))


_text = lambda v: "NULL" if v is None else f"'{v}'"
_OTHER_HEADERS = ("Счет-фактура", "Сумма, тг", "Дата")
_HEADER_ROWS = ", ".join(f"({i}, {_text(h)}, CAST({_text(k)} AS VARCHAR), {str(h in _OTHER_HEADERS).lower()})" for i, (h, k) in enumerate(_HEADERS.items()))
O_HEADERS = f"""
SELECT c_custkey, CASE WHEN word = '' THEN '' WHEN c_custkey % 3 = 0 THEN upper(word) WHEN c_custkey % 3 = 1 THEN '  ' || word ELSE word || ' ' || CAST(c_custkey AS VARCHAR) END AS header, kind, other
FROM ({_in_turn(_HEADER_ROWS)}(i, word, kind, other) ON i = c_custkey % {len(_HEADERS)})
"""

_PARADIGMS = (
    ("surname", "m", "Иванов Иванова Иванову Иванова Ивановым Иванове"), ("surname", "f", "Иванова Ивановой Ивановой Иванову Ивановой Ивановой"),
    ("surname", "m", "Чайковский Чайковского Чайковскому Чайковского Чайковским Чайковском"), ("surname", "f", "Толстая Толстой Толстой Толстую Толстой Толстой"),
    ("surname", "m", "Хименес Хименеса Хименесу Хименеса Хименесом Хименесе"), ("surname", "f", "Хименес Хименес Хименес Хименес Хименес Хименес"),
    ("surname", "m", "Шевченко Шевченко Шевченко Шевченко Шевченко Шевченко"), ("surname", "m", "Гоголь Гоголя Гоголю Гоголя Гоголем Гоголе"),
    ("surname", "f", "Римская-Корсакова Римской-Корсаковой Римской-Корсаковой Римскую-Корсакову Римской-Корсаковой Римской-Корсаковой"),
    ("name", "m", "Дмитрий Дмитрия Дмитрию Дмитрия Дмитрием Дмитрии"), ("name", "m", "Павел Павла Павлу Павла Павлом Павле"), ("name", "m", "Игорь Игоря Игорю Игоря Игорем Игоре"),
    ("name", "f", "Мария Марии Марии Марию Марией Марии"), ("name", "f", "Любовь Любови Любови Любовь Любовью Любови"), ("name", "m", "Илья Ильи Илье Илью Ильей Илье"),
    ("name", "f", "Айгерим Айгерим Айгерим Айгерим Айгерим Айгерим"), ("patronymic", "m", "Петрович Петровича Петровичу Петровича Петровичем Петровиче"),
    ("patronymic", "f", "Петровна Петровны Петровне Петровну Петровной Петровне"), ("patronymic", "m", "Болатұлы Болатұлы Болатұлы Болатұлы Болатұлы Болатұлы"),
)


def paradigms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cases of names that belong to customers; every other customer's surname is the half of a double one."""
    rows = _by_customer(spark, sf_dir, tuple(f"{k} {g} {f.split()[0]}" for k, g, f in _PARADIGMS)).withColumn("w", F.split("word", " "))
    own = F.get("w", F.lit(2))
    double = (F.get("w", F.lit(0)) == "surname") & (F.get("w", F.lit(1)) == "m") & (F.floor(F.col("c_custkey") / 19) % 2 == 1)
    rows = rows.select("c_custkey", F.get("w", F.lit(0)).alias("kind"), F.get("w", F.lit(1)).alias("gender"), F.when(double, F.concat(own, F.lit("-Ким"))).otherwise(own).alias("word"))
    word, gender = F.col("word"), F.col("gender")
    forms = F.when(F.col("kind") == "surname", mo.decline_surname(word, gender)).when(F.col("kind") == "name", mo.decline_name(word, gender)).otherwise(mo.decline_patronymic(word, gender))
    return rows.select("c_custkey", "kind", "gender", "word", F.array_join(forms, " ").alias("forms"))


_KIM = ("Ким", "Кима", "Киму", "Кима", "Кимом", "Киме")
_CASES = ", ".join(f"({i}, '{k}', '{g}', '{f.split()[0]}', '{f}', '{' '.join(f'{w}-{c}' for w, c in zip(f.split(), _KIM))}')" for i, (k, g, f) in enumerate(_PARADIGMS))
O_PARADIGMS = f"""
SELECT c_custkey, kind, gender, CASE WHEN double THEN word || '-Ким' ELSE word END AS word, CASE WHEN double THEN doubled ELSE forms END AS forms
FROM (SELECT *, kind = 'surname' AND gender = 'm' AND c_custkey // 19 % 2 = 1 AS double FROM ({_in_turn(_CASES)}(i, kind, gender, word, forms, doubled) ON i = c_custkey % {len(_PARADIGMS)}))
"""


def keyed_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = hmac_hex(SECRET, F.concat_ws("|", F.lit("phone"), F.col("c_custkey").cast("string"), F.lit("0")))
    return _table(spark, sf_dir, "customer").select("c_custkey", digest.alias("digest"), digits(digest, 0, 7).alias("figures"))


_INNER, _OUTER = padded(SECRET)
_DIGEST = f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode('phone|' || CAST(c_custkey AS VARCHAR) || '|0'))))"
O_KEYED = f"SELECT c_custkey, digest, array_to_string(list_transform(range(7), lambda i: CAST(CAST('0x' || substr(digest, CAST(2 * i + 1 AS INT), 2) AS INT) % 10 AS VARCHAR)), '') AS figures FROM (SELECT c_custkey, {_DIGEST} AS digest FROM customer)"


def organisations_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = fragments(spark, sf_dir).select(F.explode(find_organisations(F.col("text"))).alias("o")).select(tx.norm_key(F.col("o.value")).alias("key"))
    return each.groupBy("key").agg(F.count("*").alias("times"))


O_ORGS = "SELECT 'ромашка' || CAST(c_custkey % 50 AS VARCHAR) AS key, count(*) AS times FROM customer GROUP BY 1 UNION ALL SELECT 'жұлдыз ' || CAST(c_custkey % 30 AS VARCHAR), count(*) FROM customer GROUP BY 1"


def stand_ins_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each type: keys, distinct stand-ins, stand-ins that are real values, and stand-ins that are not valid."""
    cluster.prepare(spark)
    mapping = extend_mapping(detect_numbers(fragments(spark, sf_dir)), _no_mapping(spark), SECRET).checkpoint()
    fake, key, typ = F.col("fake"), F.col("key"), F.col("typ")
    keeps = F.when(typ.isin("card", "bin"), 6).when(typ == "acc20", 5).when(typ == "phone", 3).when(typ.isin("inn", "rekv"), 2).otherwise(0)
    shape = F.char_length(fake) == F.char_length(key)
    sound = (
        F.when(typ == "iin", (checks.classify12(fake) == "iin") & (F.substring(fake, 7, 1).cast("int") % 2 == F.substring(key, 7, 1).cast("int") % 2))
        .when(typ == "bin", checks.kz_valid(fake)).when(typ == "num12", checks.kz_valid(fake) == checks.kz_valid(key)).when(typ == "iban", checks.iban_valid(fake) & (F.substring(fake, 5, 3) == F.substring(key, 5, 3)))
        .when(typ == "card", checks.luhn_valid(fake)).when(typ == "inn", checks.inn_valid(fake)).when(typ == "domain", fake.endswith(".kz")).when(typ == "email", fake.rlike("^[a-z0-9.+-]+@[a-z0-9.-]+$")).otherwise(F.lit(True))
    )
    prefix = F.substring(fake, F.lit(1), keeps) == F.substring(key, F.lit(1), keeps)
    ok = sound & prefix & F.when(typ.isin("email", "domain"), True).otherwise(shape)
    real = mapping.select("family", F.col("key").alias("fake"), F.lit(1).alias("real")).distinct()
    rows = mapping.withColumn("ok", ok).join(real, ["family", "fake"], "left")
    return rows.groupBy("typ").agg(F.count("*").alias("keys"), F.count_distinct("fake").alias("fakes"), F.count("real").alias("real_values"), F.count_if(~F.col("ok")).alias("unsound"))


O_STAND_INS = f"SELECT typ, count(DISTINCT key) AS keys, count(DISTINCT key) AS fakes, 0 AS real_values, 0 AS unsound FROM (SELECT typ, key FROM ({O_FRAGMENTS}) WHERE key <> 'info@gmail.com' UNION ALL SELECT 'domain', 'firma' || CAST(c_custkey % 20 AS VARCHAR) || '.kz' FROM customer) GROUP BY typ"


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    cluster.prepare(spark)
    rows = fragments(spark, sf_dir)
    found = detect_numbers(rows).checkpoint()
    return replace(rows, extend_mapping(found, _no_mapping(spark), SECRET).checkpoint(), candidates=found)


def replaced_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_type(_replaced(spark, sf_dir))


O_BY_TYPE = f"SELECT typ, count(*) AS times FROM ({O_FRAGMENTS}) WHERE key <> 'info@gmail.com' GROUP BY ROLLUP (typ)"


def most_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(_replaced(spark, sf_dir)).groupBy("typ", "before").agg(F.sum("times").alias("times"), F.count_distinct("after").cast("long").alias("afters"))


O_MOST = f"WITH f AS ({DERIVED}), s AS ({O_FRAGMENTS}) SELECT s.typ, substr(f.text, CAST(span_start AS INT) + 1, CAST(span_end - span_start AS INT)) AS before, count(*) AS times, 1 AS afters FROM s JOIN f ON s.doc_id = f.doc_id AND s.frag_id = f.frag_id WHERE key <> 'info@gmail.com' GROUP BY ALL"


def _full_cycle(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, jobs.Knowledge, DataFrame]:
    """What detect_numbers finds in the derived fragments, what is learned from them, and their copies."""
    cluster.prepare(spark)
    rows = fragments(spark, sf_dir).select("doc_id", "frag_id", "text", "hint").checkpoint()
    found = detect_numbers(rows).checkpoint()
    known = jobs.learn(rows, _no_mapping(spark), SECRET, candidates=found)
    return found, known, jobs.obfuscate(rows, known, found).checkpoint()


def full_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, addresses and organisations together: by kind of fragment, how many change and how many come back."""
    _, known, copies = _full_cycle(spark, sf_dir)
    back = jobs.restore(copies.select("doc_id", "frag_id", F.col("new_text").alias("text"), "hint"), known)
    both = copies.select("doc_id", "frag_id", "text", F.col("new_text").alias("copy")).join(back.select("doc_id", "frag_id", F.col("new_text").alias("restored")), ["doc_id", "frag_id"])
    return both.groupBy("frag_id").agg(F.count("*").alias("rows"), F.count_if(F.col("text") != F.col("copy")).alias("changed"), F.count_if(F.col("text") == F.col("restored")).alias("restored"))


O_FULL = "SELECT frag_id, count(*) AS rows, count(*) AS changed, count(*) AS restored FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS frag_id, c_custkey FROM customer) GROUP BY frag_id"


def audit_of_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audit finds in copies: nothing. In the originals: every known value."""
    found, known, copies = _full_cycle(spark, sf_dir)
    clean = jobs.check(copies.select("doc_id", "frag_id", F.col("new_text").alias("text"), "hint"), known).agg(F.count("*").alias("found")).select(F.lit("copies").alias("of"), "found")
    leaks = audit.leaks(found, known.mapping).agg(F.count("*").alias("found")).select(F.lit("originals").alias("of"), "found")
    return clean.union(leaks)


O_AUDIT = f"SELECT 'copies' AS of, 0 AS found UNION ALL SELECT 'originals', count(*) FROM ({O_FRAGMENTS}) WHERE key <> 'info@gmail.com'"

_SURNAMES = ("Иванов", "Петренко", "Чайковский", "Гоголь", "Сидорин", "Баймагамбетов", "Ким", "Лебедев")
_NAMES = ("Иван", "Сергей", "Дмитрий", "Игорь", "Ерлан", "Нурлан")
_FATHERS = ("Петр", "Олег", "Болат", "Николай")


def people_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names told in full in one fragment and with initials, in another case, in the next: linked, replaced, restored."""
    cluster.prepare(spark)
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % n % len(values)).cast("int") + 1)
    # Few surnames and fathers: what is made of them is made once for each.
    of = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    surnames = of(_SURNAMES, "s").select("s", mo.decline_surname(F.col("s"), F.lit("m")).alias("cases"))
    fathers = of(_FATHERS, "father").select("father", mo.make_patronymic(F.col("father"), F.lit("m")).alias("p"))
    man = _customers(spark, sf_dir).select("c_custkey", pick(_SURNAMES, 8).alias("s"), pick(_NAMES, 90).alias("n"), pick(_FATHERS, 1000).alias("father"))
    man = man.join(F.broadcast(surnames), "s").join(F.broadcast(fathers), "father")
    full = F.concat(F.lit("Принят "), "s", F.lit(" "), "n", F.lit(" "), "p", F.lit("."))
    case = (F.col("c_custkey") % 6).cast("int")
    short = F.concat(F.lit("Передано "), F.get("cases", case), F.lit(" "), F.substring("n", 1, 1), F.lit("."), F.substring("p", 1, 1), F.lit("."))
    none = F.lit(None).cast("string")
    rows = man.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("frag_id"), full.alias("text"), none.alias("hint")).union(man.select("c_custkey", F.lit(1), short, none)).checkpoint()
    known = jobs.learn(rows, _no_mapping(spark), SECRET)
    copies = jobs.obfuscate(rows, known).checkpoint()
    back = jobs.restore(copies.select("doc_id", "frag_id", F.col("new_text").alias("text"), "hint"), known)
    both = copies.select("doc_id", "frag_id", "text", F.col("new_text").alias("copy")).join(back.select("doc_id", "frag_id", F.col("new_text").alias("restored")), ["doc_id", "frag_id"])
    return both.groupBy("frag_id").agg(F.count("*").alias("rows"), F.count_if(F.col("text") != F.col("copy")).alias("changed"), F.count_if(F.col("text") == F.col("restored")).alias("restored"))


O_PEOPLE = "SELECT frag_id, count(*) AS rows, count(*) AS changed, count(*) AS restored FROM (SELECT unnest([0, 1]) AS frag_id, c_custkey FROM customer) GROUP BY frag_id"


_STEMS_LINKED = (("Иван", "ivan"), ("Петр", "petr"), ("Сидор", "sidor"), ("Кузнец", "kuznec"), ("Щербак", "scherbak"), ("Цветк", "tsvetk"), ("Харит", "harit"), ("Южан", "iuzhan"))
_LINKED_SURNAMES = [(a + b, x + y) for a, x in _STEMS_LINKED for b, y in (("ов", "ov"), ("ин", "in"), ("енко", "enko"), ("ский", "skiy"))]
_NTH = lambda values: f"split_part('{','.join(values)}', ',', CAST(c_custkey % {len(values)} + 1 AS INT))"
#: An employee of each customer: surname, gender, address and employer. Some addresses name the person, some do not.
LINKED = f"""
SELECT sur, gender, org, CASE CAST(({_N} - {_N} % 32) / 32 AS BIGINT) % 6 WHEN 0 THEN latin || CAST({_N} AS STRING) WHEN 1 THEN substr('abcdefghij', CAST({_N} % 10 + 1 AS INT), 1) || '.' || latin
  WHEN 2 THEN latin || '_ip' || CAST({_N} % 10 AS STRING) WHEN 3 THEN 'info' WHEN 4 THEN 'user' || CAST({_N} AS STRING) ELSE 'x' || latin || 'a' || CAST({_N} % 100 AS STRING) END || '@' || host AS address
FROM (
  SELECT c_custkey, latin, CASE WHEN c_custkey % 4 < 2 AND CAST(({_N} - {_N} % 32) / 32 AS BIGINT) % 3 = 0 THEN sur || 'а' ELSE sur END AS sur, CASE WHEN c_custkey % 4 < 2 AND CAST(({_N} - {_N} % 32) / 32 AS BIGINT) % 3 = 0 THEN 'f' ELSE 'm' END AS gender,
    CASE WHEN c_custkey % 5 > 0 THEN 'ромашка ' || CAST({_N} % 50 AS STRING) END AS org, CASE WHEN c_custkey % 5 > 0 THEN 'romashka' || CAST({_N} % 50 AS STRING) ELSE 'firma' || CAST({_N} % 20 AS STRING) END || '.kz' AS host
  FROM (SELECT c_custkey, {_NTH([a for a, _ in _LINKED_SURNAMES])} AS sur, {_NTH([b for _, b in _LINKED_SURNAMES])} AS latin FROM customer) AS c
) AS d
"""


def addresses_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose surname each address holds, spelled how and where, and whose domain it is at; of all customers' employees."""
    cluster.prepare(spark)
    staff = _derived(spark, sf_dir, LINKED).checkpoint()
    people = staff.select(F.concat_ws("|", "sur", "gender").alias("person_id"), "sur", "gender").distinct()
    orgs = staff.filter("org is not null").select(F.col("org").alias("key"), F.lit("Ольмента").alias("fake")).distinct()
    addresses = staff.select(F.col("address").alias("key")).distinct()
    found = links.surnames_within(addresses, people).select("key", F.col("at").cast("long").alias("place"), "spelling", F.col("person.person_id").alias("person"))
    host = F.substring_index("key", "@", -1)
    owned = links.linked_domains(addresses.select(host.alias("key")).distinct(), orgs).select(F.col("key").alias("host"), "org")
    return addresses.join(found, "key", "left").withColumn("host", host).join(owned, "host", "left").drop("host")


def _spellings() -> list[tuple[str, str, str]]:
    """Surname, gender and each spelling of it, of all surnames of LINKED."""
    out = []
    for base, _ in _LINKED_SURNAMES:
        plain = "".join(tx.TRANSLIT[c] for c in base.lower())
        forms = {plain, plain.replace("kh", "h"), plain.replace("yu", "iu").replace("ya", "ia"), plain.replace("zh", "j"), plain.replace("ts", "c")}
        forms |= {plain[:-2] + e for e in "yi" if plain.endswith("iy")}
        out += [(base, "m", f) for f in forms] + [(base + "а", "f", f + e) for f in forms for e in ("", "a")]
    return out


O_LINKED = f"""
WITH d AS ({LINKED}), v AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _spellings())}) AS t(sur, gender, spelling)),
s AS (SELECT spelling, min(d.sur || '|' || d.gender) AS person FROM d JOIN v ON v.sur = d.sur AND v.gender = d.gender WHERE length(spelling) >= 4 GROUP BY spelling),
a AS (SELECT DISTINCT address AS key, split_part(address, '@', 1) AS local, split_part(address, '@', 2) AS host FROM d),
m AS (SELECT key, strpos(local, spelling) - 1 AS place, spelling, person FROM a JOIN s ON contains(local, spelling) WHERE local <> 'info' QUALIFY row_number() OVER (PARTITION BY key ORDER BY length(spelling) DESC, strpos(local, spelling), spelling) = 1),
o AS (SELECT DISTINCT org, replace(replace(org, 'ромашка', 'romashka'), ' ', '') || '.kz' AS host FROM d WHERE org IS NOT NULL)
SELECT a.key, place, spelling, person, org FROM a LEFT JOIN m ON m.key = a.key LEFT JOIN o ON o.host = a.host
"""


_BESIDE = ("Отчёт", "Протокол", "Иванов", "Ким", "Вестник", "Юнг", "Ведомость", "Гофман", "Реестр", "Лист")
#: A word beside initials in each customer's first fragment; in the second, some of these words written small.
BESIDE = f"""
SELECT c_custkey AS doc_id, 'Смотри: ' || word || ' ' || substr('АБВГДЕКЛМН', CAST(({_N} - {_N} % 10) / 10 % 10 + 1 AS INT), 1) || '. ' || substr('ПРСТ', CAST(c_custkey % 4 + 1 AS INT), 1) || '.' AS text FROM (SELECT c_custkey, {_NTH(_BESIDE)} AS word FROM customer) AS c
UNION ALL SELECT c_custkey, 'это ' || {_NTH(["отчет", "протокол", "иванов", "вестник", "ведомость", "лист", "рассказ"])} || ' за год' FROM customer
UNION ALL SELECT c_custkey, 'смотри реестр и гофман' FROM customer WHERE c_custkey = 7
"""


def common_words_vetoed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of a word beside initials: how often, and whether the texts' own words leave them a name."""
    cluster.prepare(spark)
    rows = _derived(spark, sf_dir, BESIDE)
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("frag_id"), "text", F.lit(None).cast("string").alias("hint")).checkpoint()
    # Both what is parsed and what is returned read the mentions, which take most of the work to find.
    said = names.mentions(rows).groupBy("mention").agg(F.count("*").alias("times")).checkpoint()
    kept = lexicon.veto(names.parsed(said.select("mention")).checkpoint(), rows).select("mention", F.lit(True).alias("kept"))
    return said.join(kept, "mention", "left").select("mention", "times", F.coalesce("kept", F.lit(False)).alias("kept"))


O_VETO = f"""
WITH f AS ({BESIDE}), s AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[а-яё]{{2,}}')) AS w FROM f WHERE NOT starts_with(text, 'Смотри: ')) GROUP BY w),
m AS (SELECT replace(text, 'Смотри: ', '') AS mention, count(*) AS times FROM f WHERE starts_with(text, 'Смотри: ') GROUP BY 1)
SELECT mention, times, starts_with(mention, 'Иванов ') OR coalesce(n, 0) < 2 AS kept FROM m LEFT JOIN s ON w = replace(lower(split_part(mention, ' ', 1)), 'ё', 'е')
"""


def changed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content a ledger of the even ones (of which each fourth is outdated) does not have."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    ledger = docs.filter("path % 2 = 0").withColumn("sha256", F.when(F.col("path") % 4 == 0, "old").otherwise(F.col("sha256")))
    return audit.changed_files(docs, ledger)


O_CHANGED = "SELECT doc_id AS path, sha256(text) AS sha256 FROM documents WHERE doc_id % 2 = 1 OR doc_id % 4 = 0"


def texts_holding_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    cluster.prepare(spark)
    stems = spark.createDataFrame([("idio",), ("worthless",), ("berlin",), ("thanedble",)], "stem string")
    return audit.holding(_table(spark, sf_dir, "documents").select("doc_id", "text"), stems)


O_STEMS = "SELECT DISTINCT doc_id, stem FROM documents, (VALUES ('idio'), ('worthless'), ('berlin'), ('thanedble')) AS s(stem) WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])' || stem)"


def texts_holding_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a piece out of the middle of a long word of the benchmark, or across two of its words, anywhere."""
    cluster.prepare(spark)
    items = _table(spark, sf_dir, "benchmark").select(F.lower("text").alias("t"))
    long = items.select(F.explode(F.regexp_extract_all("t", F.lit("[a-z]{8,}"), 0)).alias("w")).select(F.substring("w", 3, 5).alias("stem"))
    across = items.select(F.regexp_extract("t", "[a-z]{2} [a-z]{5}", 0).alias("stem")).filter("stem <> ''")
    return audit.holding(_table(spark, sf_dir, "documents").select("doc_id", "text"), long.union(across).distinct(), inside=True)


O_SUBSTRINGS = """
WITH i AS (SELECT lower(text) AS t FROM benchmark),
s AS (SELECT substr(w, 3, 5) AS stem FROM (SELECT unnest(regexp_extract_all(t, '[a-z]{8,}')) AS w FROM i) UNION SELECT regexp_extract(t, '[a-z]{2} [a-z]{5}') FROM i WHERE regexp_matches(t, '[a-z]{2} [a-z]{5}')),
d AS (SELECT doc_id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t FROM documents)
SELECT DISTINCT doc_id, stem FROM d JOIN s ON contains(t, stem)
"""


#: How many words the longest beginnings of benchmark items have.
_LONGEST = 15


def sequences_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At how many places of documents each beginning of a benchmark item, one to fifteen words long, is the longest that stands there."""
    cluster.prepare(spark)
    item = tx.words(F.lower("text"))
    lengths = F.sequence(F.lit(1), F.least(F.size(item), F.lit(_LONGEST)))
    begins = _table(spark, sf_dir, "benchmark").select(F.explode(F.transform(lengths, lambda n: F.slice(item, F.lit(1), n))).alias("key")).distinct()
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("frag_id"), tx.words(F.lower("text")).alias("names"))
    found = standing(docs, begins, longest=True).select("doc_id", "i", "path", F.col("n").alias("words"))
    # Where an id is there once, a place is one row already.
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        found = found.groupBy("doc_id", "i").agg(F.max_by("path", "words").alias("path"), F.max("words").alias("words"))
    return found.groupBy(F.rtrim(F.translate("path", "\x01", " ")).alias("begin"), F.col("words").cast("long").alias("words")).agg(F.count("*").alias("places"))


O_SEQUENCES = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}]\\.|[\\p{{L}}\\p{{M}}\\p{{N}}_]+(?:[-‐][\\p{{L}}\\p{{M}}\\p{{N}}_]+)*|[«»"“”„'']') AS t FROM documents),
b AS (SELECT regexp_extract_all(lower(text), '[\\p{{L}}]\\.|[\\p{{L}}\\p{{M}}\\p{{N}}_]+(?:[-‐][\\p{{L}}\\p{{M}}\\p{{N}}_]+)*|[«»"“”„'']') AS t FROM benchmark),
k AS (SELECT DISTINCT n, array_to_string(t[1:n], ' ') AS begin FROM b, range(1, {_LONGEST + 1}) AS r(n) WHERE n <= len(t)),
f AS (SELECT DISTINCT begin FROM k WHERE n = 1),
p AS (SELECT doc_id, i, t[i:i + {_LONGEST - 1}] AS run FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM w) WHERE t[i] IN (SELECT begin FROM f)),
h AS (SELECT doc_id, i, p.n, array_to_string(run[1:p.n], ' ') AS begin FROM (SELECT * FROM p, range(1, {_LONGEST + 1}) AS r(n) WHERE n <= len(run)) AS p SEMI JOIN k ON k.n = p.n AND k.begin = array_to_string(run[1:p.n], ' '))
SELECT begin, n AS words, count(*) AS places FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY n DESC) = 1) GROUP BY ALL
"""


def written_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lpad(((F.col("c_custkey").cast("long") * 12347) % 10000000000).cast("string"), 10, "0")
    rows = _customers(spark, sf_dir).select("c_custkey", key.alias("key"))
    return rows.select("c_custkey", tx.format_like(F.lit("+7 (701) 123-45-67"), F.col("key")).alias("phone"), tx.format_like(F.lit("KZ86 125K"), F.upper(F.substring("key", 1, 8)), "[A-Za-z0-9]").alias("iban"))


O_WRITTEN = "SELECT c_custkey, '+7 (' || substr(k, 1, 3) || ') ' || substr(k, 4, 3) || '-' || substr(k, 7, 2) || '-' || substr(k, 9, 2) AS phone, substr(k, 1, 4) || ' ' || substr(k, 5, 4) AS iban FROM (SELECT c_custkey, lpad(CAST((CAST(c_custkey AS BIGINT) * 12347) % 10000000000 AS VARCHAR), 10, '0') AS k FROM customer)"


#: A file of each customer and the name it is to get: many get the same, and some of those that do not have a number already.
RENAMED = f"""
SELECT 'in/' || CAST({_N} AS STRING) AS path, CASE WHEN c_custkey % 7 = 0 THEN 'out/a' || CAST({_N} % 5 AS STRING) || ' (' || CAST({_N} % 11 + 1 AS STRING) || ').txt'
  WHEN c_custkey % 7 = 1 THEN 'out.d/' || CAST({_N} % 3 AS STRING) WHEN c_custkey % 7 = 2 THEN '.hidden' ELSE 'out/a' || CAST({_N} % 13 AS STRING) || '.txt' END AS new_path FROM customer
"""


def paths_without_clash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers' files are called once no two have the same name."""
    cluster.prepare(spark)
    return paths.number_clashes(spark.sql(RENAMED.replace("FROM customer", "FROM {customer}"), customer=_table(spark, sf_dir, "customer").select("c_custkey")))


O_NO_CLASH = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY new_path ORDER BY path) AS k FROM ({RENAMED})),
s AS (SELECT path, new_path, k, regexp_extract(new_path, '^(.*/)?[^/.]+(\\.[^./]*)$', 2) AS ext FROM r),
t AS (SELECT *, left(new_path, length(new_path) - length(ext)) AS stem FROM s),
p AS (SELECT new_path FROM r WHERE k = 1),
g AS (SELECT new_path, stem, ext, max(k) AS n FROM t GROUP BY ALL HAVING n > 1),
f AS (SELECT g.new_path, stem || ' (' || u || ')' || ext AS name, row_number() OVER (PARTITION BY g.new_path ORDER BY u) + 1 AS k FROM g, range(2, 40000) AS x(u) WHERE u <= n + 20 AND stem || ' (' || u || ')' || ext NOT IN (SELECT new_path FROM p))
SELECT path, coalesce(name, t.new_path) AS new_path FROM t LEFT JOIN f ON f.new_path = t.new_path AND f.k = t.k
"""


def page_paths_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts and folders of the pages' addresses as paths: how many parts, whether the host got a stand-in, whether no other path has the new one, and whether it can be undone."""
    cluster.prepare(spark)
    pages = _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path")).checkpoint()
    hosts = pages.select(F.col("page_id").alias("doc_id"), F.lit(0).alias("frag_id"), F.substring_index("path", "/", 1).alias("text"), F.lit(None).cast("string").alias("hint"))
    mapping = extend_mapping(detect_numbers(hosts).checkpoint(), _no_mapping(spark), SECRET).checkpoint()
    done = paths.map_paths(pages, lambda f: replace(f, mapping)).checkpoint()
    back = paths.map_paths(done.select(F.col("new_path").alias("path")), lambda f: replace(f, mapping, restore=True))
    told = done.join(back.select(F.col("path").alias("new_path"), F.col("new_path").alias("again")), "new_path").join(done.groupBy("new_path").agg(F.count("*").alias("times")), "new_path")
    host = lambda c: F.substring_index(c, "/", 1)
    told = told.select("path", F.size(F.split("path", "/")).cast("long").alias("parts"), (host("path") != host("new_path")).alias("replaced"), (F.col("times") == 1).alias("alone"), (F.col("again") == F.col("path")).alias("restored"))
    return pages.join(told, "path").drop("path")


#: example.com is one of the domains that name nobody.
O_PAGE_PATHS = "SELECT page_id, len(string_split(regexp_replace(url, '^[a-z]+://', ''), '/')) AS parts, NOT regexp_matches(url, '^[a-z]+://([^/]*\\.)?example\\.com(/|$)') AS replaced, true AS alone, true AS restored FROM pages"


def runs_redistributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name split over formatting runs: the stand-in goes to the run where the name begins."""
    runs = F.array(F.lit("Поставщик Ро"), F.lit("машка"), F.concat(F.lit(" № "), F.col("n_nationkey").cast("string")))
    spans = F.array(F.struct(F.lit(10).alias("start"), F.lit(17).alias("end"), F.col("n_name").alias("new")))
    return _table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(tx.redistribute(runs, spans), "|").alias("runs"))


O_RUNS = "SELECT n_nationkey, 'Поставщик ' || n_name || '|| № ' || CAST(n_nationkey AS VARCHAR) AS runs FROM nation"


def exported_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    cluster.prepare(spark)
    mapping = extend_mapping(detect_numbers(fragments(spark, sf_dir)), _no_mapping(spark), SECRET).checkpoint()
    return export_rows(mapping).select("typ", "real")


O_EXPORTED = f"SELECT DISTINCT typ, key AS real FROM ({O_FRAGMENTS}) WHERE key <> 'info@gmail.com' UNION ALL SELECT DISTINCT 'domain', 'firma' || CAST(c_custkey % 20 AS VARCHAR) || '.kz' FROM customer"


def person_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best readings of mentions in customers' notes, and how many customers have each."""
    cluster.prepare(spark)
    notes = _by_customer(spark, sf_dir, tuple(_READINGS)).withColumn("word", F.concat(F.lit("Договор с "), "word", F.lit(" подписан, № "), F.col("c_custkey").cast("string")))
    rows = notes.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("frag_id"), F.col("word").alias("text"), F.lit(None).cast("string").alias("hint"))
    said = names.mentions(rows).groupBy("mention").agg(F.count("*").alias("times")).checkpoint()
    read = names.readings(names.parsed(said.select("mention")))
    best = read.groupBy("mention").agg(F.max_by(F.struct("sur", "gender", "name", "patr", "init_n", "init_p"), F.struct("score", "gender", "sur")).alias("r"))
    best = best.select("mention", F.concat_ws(" ", "r.sur", "r.gender", "r.name", "r.patr", "r.init_n", "r.init_p").alias("reading"))
    return said.join(best, "mention").select("mention", "reading", "times")


_READINGS = {
    "Ивановой Марией Петровной": "Иванова f Мария Петровна М П", "Иванову Сергею Олеговичу": "Иванов m Сергей Олегович С О", "А. С. Пушкину": "Пушкин m А С", "Иванова М.П.": "Иванова f М П",
    "Серик Нұрлан Болатұлы": "Серик m Нұрлан Болатұлы Н Б", "Игоря Николаевича Чайковского": "Чайковский m Игорь Николаевич И Н",
}
_READ = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(_READINGS.items()))
O_READINGS = f"SELECT mention, reading, count(*) AS times FROM ({_in_turn(_READ)}(i, mention, reading) ON i = c_custkey % {len(_READINGS)}) GROUP BY ALL"

_ALL = (
    (roundtrip_documents, O_ROUNDTRIP), (detect_emails, O_EMAILS), (detect_url_domains, O_URL_DOMAINS), (detect_in_fragments, O_FRAGMENTS), (validate_numbers, O_VALIDATE),
    (iban_checks, O_IBAN), (normalised_keys, O_KEYS), (registrable_domains, O_DOMAINS), (header_kinds, O_HEADERS), (paradigms, O_PARADIGMS), (keyed_digits, O_KEYED),
    (organisations_found, O_ORGS), (stand_ins_by_type, O_STAND_INS), (replaced_by_type, O_BY_TYPE), (most_replaced, O_MOST), (full_roundtrip, O_FULL), (audit_of_copies, O_AUDIT),
    (people_roundtrip, O_PEOPLE), (changed_documents, O_CHANGED), (texts_holding_stems, O_STEMS), (written_like, O_WRITTEN), (runs_redistributed, O_RUNS), (exported_mapping, O_EXPORTED),
    (person_readings, O_READINGS), (addresses_linked, O_LINKED), (texts_holding_substrings, O_SUBSTRINGS), (common_words_vetoed, O_VETO), (sequences_standing, O_SEQUENCES), (paths_without_clash, O_NO_CLASH), (page_paths_mapped, O_PAGE_PATHS),
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f, _ in _ALL}
ORACLES: dict[str, str] = {f.__name__: sql for f, sql in _ALL}
