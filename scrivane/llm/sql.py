"""DuckDB twins of the queries that SQL can express over whole tables."""

from __future__ import annotations

from scrivane.llm import bitsliced, quality, substring

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _quoted(x: str) -> str:
    """A JSON string as Spark's writer escapes it."""
    text = rf"""replace(replace({x}, '\', '\\'), '"', '\"')"""
    short = {8: r"\b", 9: r"\t", 10: r"\n", 12: r"\f", 13: r"\r"}
    for k in range(1, 32):
        text = f"replace({text}, chr({k}), '{short.get(k, f'\\u{k:04X}')}')"
    return f"""('"' || {text} || '"')"""


TOP_K = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({bitsliced.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= {bitsliced.TOP}
"""

SUBSTRING = f"""
WITH RECURSIVE split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, i AS para, parts[i + 1] AS line, coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x) + 1)), 0) AS start
  FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM split)
),
paras AS (SELECT doc_id, para, start, length(line) AS length, {_WORDS.format("line")} AS w FROM lines),
marked AS (SELECT *, len(w) BETWEEN 1 AND {substring.LEAST_WORDS - 1} AS short FROM paras),
heads AS (SELECT *, NOT (short AND coalesce(lag(short) OVER (PARTITION BY doc_id ORDER BY para), false)) AS head FROM marked),
grouped AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY para) AS g FROM heads),
units AS (SELECT doc_id, g, min(para) AS para, min(start) AS start, max(start + length) - min(start) AS length, flatten(list(w ORDER BY para)) AS w FROM grouped GROUP BY doc_id, g),
long AS (SELECT *, len(w) AS words, array_to_string(w, ' ') AS norm FROM units WHERE len(w) >= {substring.LEAST_WORDS}),
classes AS (SELECT norm, row_number() OVER (ORDER BY norm) AS c, any_value(w) AS w FROM long GROUP BY norm),
shingles AS (SELECT DISTINCT c, array_to_string(w[i : i + {substring.WORDS - 1}], ' ') AS s FROM (SELECT c, w, unnest(range(1, len(w) - {substring.WORDS - 2})) AS i FROM classes)),
sizes AS (SELECT c, count(*) AS n FROM shingles GROUP BY c),
links AS (
  SELECT a, b FROM (SELECT x.c AS a, y.c AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.c <> y.c GROUP BY x.c, y.c) p
  JOIN sizes m ON m.c = a JOIN sizes n ON n.c = b WHERE 100 * shared >= {round(100 * substring.SIMILAR)} * (m.n + n.n - shared)
),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
labels AS (SELECT a AS c, min(b) AS root FROM reach GROUP BY a),
members AS (SELECT root, doc_id, g, para, start, length, words FROM long JOIN classes USING (norm) JOIN labels USING (c)),
firsts AS (SELECT root, min(ROW(doc_id, para)) AS k FROM members GROUP BY root HAVING count(*) > 1),
alike AS (SELECT doc_id, g, para, start, length, words, k[1] AS keeper_doc_id, k[2] AS keeper_para, ROW(doc_id, para) <> k AS removed FROM members JOIN firsts USING (root)),
remaining AS (
  SELECT doc_id, para, start, line, count(*) FILTER (gone) OVER (PARTITION BY doc_id ORDER BY para) AS seg, gone
  FROM (SELECT l.*, s.doc_id IS NOT NULL AS gone FROM lines l JOIN grouped USING (doc_id, para) LEFT JOIN (SELECT doc_id, g FROM alike WHERE removed) s USING (doc_id, g))
),
tokens AS (SELECT doc_id, seg, para, start, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM (SELECT *, regexp_extract_all(line, '[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+') AS toks FROM remaining WHERE NOT gone)),
placed AS (SELECT *, start + coalesce(sum(length(tok)) OVER (PARTITION BY doc_id, para ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM tokens),
numbered AS (SELECT doc_id, seg, para, a, tok, row_number() OVER (PARTITION BY doc_id, seg ORDER BY para, i) AS place FROM placed WHERE regexp_matches(tok, '^[^\x20\x09-\x0D]')),
windows AS (
  SELECT doc_id, seg, place, para, a, lead(a + length(tok), {substring.LEAST_WORDS - 1}) OVER (PARTITION BY doc_id, seg ORDER BY place) AS stop,
    md5(string_agg(tok, ' ') OVER (PARTITION BY doc_id, seg ORDER BY place ROWS BETWEEN CURRENT ROW AND {substring.LEAST_WORDS - 1} FOLLOWING)) AS h
  FROM numbered
),
earliest AS (SELECT h, min(doc_id) AS k FROM windows WHERE stop IS NOT NULL GROUP BY h HAVING min(doc_id) < max(doc_id)),
again AS (SELECT doc_id, seg, place, para, a, stop, k, doc_id > k AS removed FROM windows JOIN earliest USING (h) WHERE stop IS NOT NULL),
runs AS (
  SELECT doc_id, min(para) AS para, min(a) AS start, max(stop) - min(a) AS length, count(*) + {substring.LEAST_WORDS - 1} AS words, min_by(k, place) AS k, removed
  FROM (SELECT *, place - row_number() OVER (PARTITION BY doc_id, seg, removed ORDER BY place) AS island FROM again) GROUP BY doc_id, seg, removed, island
)
SELECT doc_id, kind, CAST(para AS INTEGER) AS para, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS length, CAST(words AS INTEGER) AS words,
       keeper_doc_id, CAST(keeper_para AS INTEGER) AS keeper_para, removed
FROM (SELECT 'paragraph' AS kind, * EXCLUDE (g) FROM alike UNION ALL SELECT 'run', doc_id, para, start, length, words, k, NULL, removed FROM runs)
"""

_CALL = f"""'{{"arguments":{{"prompt":' || {_quoted("u.text")} || ',"turn":' || u.turn || '}},"call_id":"' || u.turn || '"'"""

CHAT = f"""
WITH RECURSIVE u AS (SELECT conv_id, turn, text FROM conversations WHERE lower(role) = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE lower(role) = 'assistant'),
d AS (
  SELECT u.conv_id, u.turn, 0 AS p FROM u LEFT JOIN u v ON v.conv_id = u.conv_id AND v.turn = u.turn - 2 WHERE v.turn IS NULL
  UNION ALL SELECT u.conv_id, u.turn, p + 1 FROM u JOIN d ON u.conv_id = d.conv_id AND u.turn = d.turn + 2
),
calls AS (
  SELECT u.conv_id, u.turn, d.p, a.text AS content, {_CALL} || coalesce(',"content":' || {_quoted("a.text")}, '') || ',"faults":[],"n_calls":1' || CASE WHEN a.text IS NULL THEN '' ELSE ',"n_results":1' END
    || ',"name":"reply","position":' || d.p || ',"status":"' || CASE WHEN a.text IS NULL THEN 'pending' ELSE 'ok' END || '"}}' AS json
  FROM u JOIN d USING (conv_id, turn) LEFT JOIN a USING (conv_id, turn)
)
SELECT conv_id, CAST(turn AS VARCHAR) AS call_id, CAST(p AS BIGINT) AS position, 'reply' AS name, CASE WHEN content IS NULL THEN 'pending' ELSE 'ok' END AS status, '' AS faults, json FROM calls
UNION ALL
SELECT a.conv_id, CAST(a.turn AS VARCHAR), NULL, NULL, 'orphan', NULL, '{{"call_id":"' || a.turn || '","content":' || {_quoted("a.text")} || ',"n_results":1,"status":"orphan"}}' FROM a LEFT JOIN u USING (conv_id, turn) WHERE u.turn IS NULL
UNION ALL
SELECT conv_id, CAST(turn AS VARCHAR), NULL, NULL, 'message', NULL, '{{"content":' || {_quoted("text")} || ',"role":' || {_quoted("role")} || ',"status":"message","turn":' || turn || '}}' FROM conversations WHERE lower(role) NOT IN ('user', 'assistant')
"""


def _term(p: str, q: float) -> str:
    m = f"((({p}) + {q!r}) / 2)"
    return f"(CASE WHEN ({p}) > 0 THEN ({p}) * log2(({p}) / {m}) ELSE 0 END + {q!r} * log2({q!r} / {m}))"


def _distance(terms: list[str]) -> str:
    return f"round(sqrt(greatest(0.0, ({' + '.join(terms)}) / 2)), 6)"


def _quality() -> str:
    shares = {"lower": "chars - rest - upper", "upper": "upper", "space": "space", "digit": "digits", "punctuation": "points", "other": "rest - space - digits - points"}
    classes = _distance([_term(f"CAST({shares[k]} AS DOUBLE) / chars", v) for k, v in quality.CLASSES.items()])
    like = quality.common_shares()
    lists = " ".join(f"WHEN '{k}' THEN {v.split()!r}" for k, v in quality.COMMON.items())
    common = _distance([*(_term(f"CAST(counted[{k + 1}] AS DOUBLE) / n", v) for k, v in enumerate(like)), _term("1.0 - CAST(list_sum(counted) AS DOUBLE) / n", 1 - sum(like))])
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, lower(lang) AS lang FROM documents),
w AS (SELECT *, {_WORDS.format("text")} AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, regexp_replace(text, '\p{{L}}+', '', 'g') AS other FROM d),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat FROM (SELECT r, i, unnest([0, 1, 2]) AS k FROM again) GROUP BY r),
f AS (
  SELECT r, doc_id, len(words) AS n, length(array_to_string(words, '')) AS word_chars, length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS symbols, len(lines) - len(list_distinct(lines)) AS dup_lines,
    length(text) AS chars, length(other) AS rest, len(regexp_extract_all(text, '\p{{Lu}}')) AS upper, len(regexp_extract_all(other, '[\x20\x09-\x0D]')) AS space, len(regexp_extract_all(other, '\p{{Nd}}')) AS digits,
    len(regexp_extract_all(other, '[.,;:!?''"()\-]')) AS points,
    list_transform(CASE lang {lists} END, lambda c: len(list_filter(words, lambda x: x = c OR x = upper(c[1]) || c[2:]))) AS counted
  FROM w
),
j AS (
  SELECT *, coalesce(n_repeat, 0) AS again, n < {quality.LEAST_WORDS} OR 100 * coalesce(n_repeat, 0) > {quality.MOST_REPEATED} * n AS failed,
    CASE WHEN chars >= {quality.LEAST_CHARS} THEN {classes} END AS class_distance, CASE WHEN n >= {quality.LEAST_COUNTED} AND counted IS NOT NULL THEN {common} END AS common_distance
  FROM f LEFT JOIN covered USING (r)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols, CAST(dup_lines AS BIGINT) AS n_dup_lines, CAST(again AS BIGINT) AS n_repeat_words, failed AS base_failed,
  class_distance, common_distance, NOT failed AND coalesce(class_distance, 0) <= {quality.MOST_CLASSES} AND coalesce(common_distance, 0) <= {quality.MOST_COMMON} AS kept
FROM j
"""


ORACLE_SQL = {"op1_exact_top_k": TOP_K, "op6_substring_dedup": SUBSTRING, "op9_chat_formatting": CHAT, "op10_quality_rules": _quality()}
