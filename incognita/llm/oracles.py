"""DuckDB SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from incognita.llm import chat
from incognita.llm.quality import COMMON

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = "'[^\\x20\\x09-\\x0D]+'"
_ALNUM = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_small = lambda text: f"translate({text}, '{_UPPER}', '{_LOWER}')"
_TEXT = "coalesce(text, '')"


def _grams(words: str, n: str) -> str:
    """All runs of n words of a list, each joined by spaces."""
    return f"list_transform(range(1, CAST(len({words}) - {n} + 2 AS BIGINT)), lambda k: array_to_string(list_slice({words}, k, k + {n} - 1), ' '))"


NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_small(_TEXT)}, {_SPACED}) AS w FROM documents),
s AS (SELECT doc_id, list_distinct({_grams("w", "least(3, len(w))")}) AS s FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS both_have FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met WHERE 100 * both_have >= 85 * (m + n - both_have)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, other FROM reach JOIN link ON a = doc_id)
SELECT w.doc_id, coalesce(len(s.s), 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN s ON w.doc_id = s.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) AS c ON w.doc_id = c.doc_id
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_small(_TEXT)}, {_ALNUM}) AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_small(_TEXT)}, {_ALNUM}) AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(13, len(w)) AS n, unnest({_grams("w", "least(13, len(w))")}) AS x FROM i WHERE len(w) > 0),
dw AS (SELECT doc_id, n, unnest({_grams("w", "n")}) AS x, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS k FROM d JOIN (SELECT DISTINCT n FROM iw) ON len(w) >= n),
hit AS (SELECT doc_id, dw.n, k, item FROM dw JOIN iw ON dw.n = iw.n AND dw.x = iw.x),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p WHERE octet_length(encode(h)) >= 1000 GROUP BY h)
SELECT page_id, octet_length(encode(p.h)) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k ON p.h = k.h
"""


def _escaped(text: str) -> str:
    """Only the length counts, so one more character stands for the backslash in a control string."""
    text = f"replace({text}, '\\', '\\\\')"
    for control in chat.CONTROL:
        text = f"replace({text}, '{control}', '{control[0]}\\{control[1:]}')"
    return text


_TURN = f"length({_escaped('role')}) + length(replace({_escaped('text')}, '~', '~')) + {len(chat.START) + len(chat.END) + 2} + length(role) - length(replace(role, chr(10), ''))"
_ORDER = "ORDER BY turn, sha256(role), sha256(text)"
CONVERSATIONS = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_TURN}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

_KEY = f"{_small(f'trim(line, {_BLANK})')}"
LINES = f"""
WITH l AS (SELECT doc_id, unnest(string_split({_TEXT}, chr(10))) AS line, generate_subscripts(string_split({_TEXT}, chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, {_KEY} AS key FROM l),
often AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
seen AS (SELECT k.doc_id, i, line, largest IS NOT NULL AND largest <> k.doc_id AS gone FROM k LEFT JOIN often ON k.key = often.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM seen GROUP BY doc_id
"""

_COMMON = "[" + ", ".join(f"'{w}'" for w in sorted({w for words in COMMON.values() for w in words.split()})) + "]"
_number = lambda pattern: f"length({_TEXT}) - length(regexp_replace({_TEXT}, '{pattern}', '', 'g'))"
_CLASSES = {
    "lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": "[\\x20\\x09-\\x0D]", "stop": "[.,;:!?\\x27\"()-]", "symbol": "[#*$%&|<>]",
    "other": "[\\x00-\\x08\\x0E-\\x1F+/=@\\x5B-\\x60{}~\\x7F]", "beyond": "[^\\x00-\\x7F]",
}
QUALITY = f"""
WITH t AS (SELECT doc_id, lang, {_TEXT} AS text, regexp_extract_all({_TEXT}, {_SPACED}) AS w FROM documents),
g AS (SELECT doc_id, unnest({_grams("w", "5")}) AS x, unnest(range(1, CAST(len(w) - 3 AS BIGINT))) AS k FROM t WHERE len(w) >= 5),
again AS (SELECT doc_id, unnest(list(k)) AS k FROM g GROUP BY doc_id, x HAVING count(*) > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, {_SPACED}) GROUP BY doc_id),
h AS (
  {" UNION ALL ".join(f"SELECT doc_id, lang, 'class' AS kind, '{name}' AS place, {_number(p)} AS n FROM t" for name, p in _CLASSES.items())}
  UNION ALL SELECT doc_id, lang, 'word', CASE WHEN list_contains({_COMMON}, v) THEN v ELSE ' ' END, count(*) FROM (SELECT doc_id, lang, unnest(regexp_extract_all({_small("text")}, {_ALNUM})) AS v FROM t) GROUP BY ALL
),
r AS (SELECT lang, kind, place, CAST(sum(n) AS DOUBLE) AS n FROM h GROUP BY ALL),
q AS (SELECT lang, kind, place, n / sum(n) OVER (PARTITION BY lang, kind) AS q FROM r WHERE n > 0),
p AS (SELECT doc_id, lang, kind, place, n / sum(n) OVER (PARTITION BY doc_id, kind) AS p, sum(n) OVER (PARTITION BY doc_id, kind) AS size FROM h WHERE n > 0),
js AS (
  SELECT doc_id, p.kind, any_value(size) AS size, sqrt(least(1, greatest(0, (sum(p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q))) + 1 - sum(q)) / 2))) AS d
  FROM p JOIN q ON p.lang IS NOT DISTINCT FROM q.lang AND p.kind = q.kind AND p.place = q.place GROUP BY doc_id, p.kind
),
b AS (
  SELECT t.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda v: length(v))), 0) AS BIGINT) AS word_chars, {_number("[#*$%&|<>]").replace(_TEXT, "text")} AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, c.size AS c_size, c.d AS c_d, v.size AS v_size, v.d AS v_d
  FROM t LEFT JOIN lines ON t.doc_id = lines.doc_id LEFT JOIN repeated ON t.doc_id = repeated.doc_id
  LEFT JOIN js AS c ON t.doc_id = c.doc_id AND c.kind = 'class' LEFT JOIN js AS v ON t.doc_id = v.doc_id AND v.kind = 'word'
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR coalesce(c_size >= 600 AND c_d > 0.26, false) OR coalesce(v_size >= 100 AND v_d > 0.5, false)) AS kept,
  round(coalesce(c_d, 0), 6) AS class_distance, round(coalesce(v_d, 0), 6) AS word_distance
FROM b
"""

#: Rounds in which sources become full; each but the last adds one source at least, so few sources need few.
_ROUNDS = 8
_FILL = "".join(
    f""",
f{k + 1} AS (SELECT source, words, weight, filled OR ({"false" if k == 0 else "left_over * weight / share > 3 * words"}) AS filled FROM (
  SELECT *, (SELECT sum(words) FROM f{k}) - (SELECT coalesce(sum(3 * words), 0) FROM f{k} WHERE filled) AS left_over, (SELECT sum(weight) FROM f{k} WHERE NOT filled) AS share FROM f{k}))"""
    for k in range(_ROUNDS)
)
MIX_TARGETS = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all({_TEXT}, {_SPACED})) AS size FROM documents),
f0 AS (SELECT source, CAST(sum(size) AS DOUBLE) AS words, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, false AS filled FROM d GROUP BY source){_FILL},
t AS (SELECT source, words, CASE WHEN filled THEN 3 * words ELSE ((SELECT sum(words) FROM f{_ROUNDS}) - (SELECT coalesce(sum(3 * words), 0) FROM f{_ROUNDS} WHERE filled)) * weight / (SELECT sum(weight) FROM f{_ROUNDS} WHERE NOT filled) END AS target FROM f{_ROUNDS})
SELECT doc_id, size, CAST(words AS BIGINT) AS source_size, target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""

MIDDLES = f"""
WITH h AS (SELECT doc_id, {_TEXT} AS t, regexp_extract_all({_TEXT}, '[^\\n]*\\n|[^\\n]+') AS u, sha256('7:' || CAST(doc_id AS VARCHAR)) AS x FROM documents),
r AS (SELECT *, len(u) AS n, {", ".join(f"CAST('0x' || substr(x, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

#: Of pages whose article is one article element of headings and paragraphs, with the character references that the tables have.
_DECODED = "regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g')"
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _DECODED = f"replace({_DECODED}, '{_name}', '{_char}')"
_DECODED = f"regexp_replace({_DECODED}, '&amp$', '&')"
PAGE_TEXTS = f"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS x FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(x, '</?(?:p|h1)>'), lambda b: trim(regexp_replace({_DECODED}, '\\s+', ' ', 'g'))) AS bs FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(bs, lambda b: b <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""

PHRASES = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, {_small(_TEXT)} AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p),
g AS ({" UNION ALL ".join(f"SELECT lang, {k} AS k, unnest({_grams('w', str(k))}) AS phrase FROM w WHERE len(w) >= {k}" for k in (1, 2, 3))}),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, k, phrase, f AS a FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT c.*, j, array_to_string(list_slice(string_split(phrase, ' '), 1, j), ' ') AS p1, array_to_string(list_slice(string_split(phrase, ' '), j + 1, k), ' ') AS p2 FROM c, (VALUES (1), (2)) AS v(j) WHERE j < k),
s AS (SELECT cut.lang, cut.k, cut.phrase, a, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score, j FROM cut JOIN f AS x ON x.lang = cut.lang AND x.phrase = p1 JOIN f AS y ON y.lang = cut.lang AND y.phrase = p2),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
stay AS (SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM c AS o WHERE o.lang = best.lang AND o.k > best.k AND contains(' ' || o.phrase || ' ', ' ' || best.phrase || ' ') AND 100 * o.a >= 50 * best.a)),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT stay.lang, row_number() OVER (PARTITION BY stay.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score
FROM stay JOIN n ON n.lang = stay.lang QUALIFY rank <= 2000
"""
