"""DuckDB fragments that restate the model and the operators for the side-by-side check."""

from __future__ import annotations

from lorebank import constants as K
from lorebank.functions.tokens import SEGMENT

W = K.WS


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{W}]+|[{W}]+$', '', 'g')"


def squash(x: str) -> str:
    return f"regexp_replace({x}, '[{W}]+', ' ', 'g')"


def blank(x: str) -> str:
    return f"regexp_full_match({x}, '[{W}]*')"


def or_default(x: str, default: str) -> str:
    return f"coalesce(nullif({x}, ''), {default})"


def first_filled(x: str) -> str:
    return trim(f"regexp_extract({x}, '[^{W}][^\\n]*')")


def heading(x: str) -> str:
    return f"regexp_extract({x}, '(?m)^#[{W}]+([^\\n\\r]+)$', 1)"


def title(x: str) -> str:
    line = f"left({first_filled(x)}, {K.TITLE_PREVIEW})"
    return f"CASE WHEN {heading(x)} <> '' THEN {trim(heading(x))} ELSE {or_default(line, lit(K.UNTITLED_MARKDOWN))} END"


def no_marks(x: str) -> str:
    return f"regexp_replace({x}, '(?m)^#+[{W}]+', '', 'g')"


def summary(x: str) -> str:
    return f"left({trim(squash(no_marks(x)))}, {K.SUMMARY_PREVIEW})"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def terms(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


def overlap(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 1)"


def ts_text(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


NOTES = f"""notes AS (
  SELECT source AS user_id, CAST(doc_id AS VARCHAR) AS note_id, {title('text')} AS title, text AS content,
    {summary('text')} AS summary,
    [lang, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END,
     'd' || CAST(doc_id % 7 AS VARCHAR)] AS tags,
    lang AS topic,
    CASE WHEN doc_id % 3 = 0 THEN 'https://' || source || '.example.org/' || CAST(doc_id AS VARCHAR)
         WHEN doc_id % 3 = 1 THEN source ELSE '' END AS source,
    [CAST(doc_id + 20 AS VARCHAR), CAST(doc_id + 140 AS VARCHAR), CAST(doc_id * 2 AS VARCHAR), CAST(doc_id AS VARCHAR)]
      AS related_note_ids,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS updated_at, doc_id
  FROM documents)"""

NOW = "TIMESTAMP '2024-01-08 00:00:00'"

LEDGER = f"""ledger AS (
  SELECT source AS user_id, CAST(doc_id AS VARCHAR) AS note_id,
    CASE WHEN quality = 0 THEN sha256('old:' || text) ELSE sha256(text) END AS content_hash, status,
    CAST(CASE status WHEN 'failed' THEN 4 WHEN 'ready' THEN 1 ELSE doc_id % 6 END AS INTEGER) AS attempts,
    {NOW} + to_minutes(doc_id % 97 - 60) AS available_at,
    CASE WHEN status = 'processing' THEN {NOW} - to_minutes(doc_id % 13) END AS locked_at,
    CASE WHEN status = 'failed' THEN 'Indexing failed.' END AS last_error,
    {NOW} + to_minutes(doc_id % 89 - 200) AS created_at,
    {NOW} + to_minutes(doc_id % 83 - 100) AS updated_at
  FROM (SELECT d.*, l.quality,
          CASE WHEN l.quality IS NOT NULL THEN 'ready' WHEN d.doc_id % 5 IN (0, 1) THEN 'pending'
               WHEN d.doc_id % 5 = 2 THEN 'failed' WHEN d.doc_id % 5 = 3 THEN 'processing' END AS status
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) x
  WHERE status IS NOT NULL)"""

WINDOWS = f"""segs AS MATERIALIZED (
  SELECT doc_id, source AS user_id, CAST(doc_id AS VARCHAR) AS note_id, text AS body, lang,
    length(regexp_extract(text, '^[{W}]*')) AS lead, regexp_extract_all({trim('text')}, '{SEGMENT}') AS s
  FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, user_id, note_id, body, lang, w AS ordinal,
    note_id || '#' || lpad(CAST(w AS VARCHAR), 6, '0') AS chunk_id,
    regexp_replace(array_to_string(s[w * 600 + 1 : w * 600 + 700], ''), '[{W}]+$', '') AS content,
    lead + length(array_to_string(s[1 : w * 600], '')) AS start_offset,
    len(s[w * 600 + 1 : w * 600 + 700]) AS token_count
  FROM (SELECT *, unnest(range(0, CASE WHEN len(s) <= 700 THEN 1 ELSE CAST(ceil((len(s) - 700) / 600.0) AS BIGINT) + 1 END)) AS w
        FROM segs WHERE len(s) > 0) x)"""

INDEX = f"""{WINDOWS},
index_chunks AS (
  SELECT w.*, CASE WHEN l.quality = 0 OR w.doc_id % 11 = 0 THEN sha256('old:' || w.body) ELSE sha256(w.body) END AS content_hash,
    CASE WHEN w.lang = 'es' THEN 0 ELSE 1 END AS index_version
  FROM windows w LEFT JOIN labels l ON l.doc_id = w.doc_id
  WHERE coalesce(l.toxic, 0) = 0)"""

SEARCHABLE = f"""{LEDGER},
{INDEX},
searchable AS MATERIALIZED (
  SELECT c.*, {terms('c.content')} AS search_terms FROM index_chunks c
  JOIN ledger j ON j.user_id = c.user_id AND j.note_id = c.note_id AND j.content_hash = c.content_hash AND j.status = 'ready'
  WHERE c.index_version = 1)"""

QUESTIONS = f"""turns AS (
  SELECT *, 'src' || CAST(conv_id % 20 AS VARCHAR) AS user_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n
  FROM conversations),
questions AS MATERIALIZED (
  SELECT t.user_id, CAST(t.conv_id AS VARCHAR) || ':' || CAST(t.turn AS VARCHAR) AS question_id, t.conv_id,
    concat_ws(chr(10), (SELECT string_agg({trim('h.text')}, chr(10) ORDER BY h.n) FROM turns h
       WHERE h.conv_id = t.conv_id AND h.n BETWEEN t.n - 6 AND t.n - 1 AND h.role = 'user' AND {trim('h.text')} <> ''),
      {trim('t.text')}) AS query
  FROM turns t WHERE t.role = 'user' AND {trim('t.text')} <> '')"""

QTERMS = f"qterms AS (SELECT user_id, question_id, unnest({terms('query')}) AS term FROM questions)"

KEYWORD_SCORES = f"""{QTERMS},
cterms AS (SELECT user_id, chunk_id, note_id, unnest(search_terms) AS term FROM searchable),
kscore AS MATERIALIZED (SELECT q.user_id, q.question_id, c.chunk_id, c.note_id, count(*) AS hits FROM qterms q
  JOIN cterms c ON c.user_id = q.user_id AND c.term = q.term GROUP BY ALL)"""
KEYWORD = f"""{KEYWORD_SCORES},
keyword AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY hits DESC, chunk_id) AS rank
  FROM kscore) WHERE rank <= 30)"""


def vector_cte(name: str, source: str, key: str, text: str) -> str:
    """Sparse hashed trigram vectors: key, bucket, float32 value."""
    folded = f"regexp_replace(lower(nfc_normalize({text})), '[{W}]+', '', 'g')"

    def mix(h: str, c: str) -> str:
        return f"((xor(CAST({h} AS BIGINT), CAST({c} AS BIGINT)) * 16777619) & 4294967295)"

    h = mix(mix(mix("2166136261", "unicode(g[1])"), "unicode(g[2])"), "unicode(g[3])")
    return f"""{name}_grams AS (SELECT DISTINCT user_id, {key}, substr(t, CAST(i AS BIGINT), 3) AS g FROM (
    SELECT user_id, {key}, t, unnest(range(1, greatest(length(t) - 1, 2))) AS i FROM (SELECT user_id, {key}, {folded} AS t FROM {source}))),
{name}_counts AS (SELECT user_id, {key}, {h} % 1536 AS bucket, count(*) AS n FROM {name}_grams GROUP BY ALL),
{name} AS MATERIALIZED (SELECT user_id, {key}, bucket,
    CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY user_id, {key})) AS FLOAT) AS DOUBLE) AS v FROM {name}_counts)"""


DENSE_SCORES = f"""{vector_cte('qvec', 'questions', 'question_id', 'query')},
{vector_cte('cvec', 'searchable', 'chunk_id', 'content')},
qnorm AS (SELECT user_id, question_id, sqrt(sum(v * v)) AS n FROM qvec GROUP BY ALL),
cnorm AS (SELECT user_id, chunk_id, sqrt(sum(v * v)) AS n FROM cvec GROUP BY ALL),
dots AS (SELECT q.user_id, q.question_id, c.chunk_id, sum(q.v * c.v) AS d FROM qvec q
  JOIN cvec c ON c.user_id = q.user_id AND c.bucket = q.bucket GROUP BY ALL),
dscore AS (SELECT q.user_id, q.question_id, c.chunk_id, round(coalesce(d.d, 0) / (q.n * c.n), 12) AS score
  FROM qnorm q JOIN cnorm c ON c.user_id = q.user_id
  LEFT JOIN dots d ON d.user_id = q.user_id AND d.question_id = q.question_id AND d.chunk_id = c.chunk_id)"""
DENSE = f"""{DENSE_SCORES},
dense AS MATERIALIZED (SELECT *, regexp_extract(chunk_id, '^(.*)#', 1) AS note_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY score DESC, chunk_id) AS rank FROM dscore) WHERE rank <= 30)"""

FUSED = """both_lists AS (SELECT user_id, question_id, chunk_id, note_id, 1 AS ch, rank FROM dense
  UNION ALL SELECT user_id, question_id, chunk_id, note_id, 2, rank FROM keyword),
fused0 AS (SELECT user_id, question_id, chunk_id, note_id, sum(1.0 / CAST(60 + rank AS DOUBLE)) AS score,
    min(CASE WHEN ch = 1 THEN rank END) AS dense_rank, min(CASE WHEN ch = 2 THEN rank END) AS keyword_rank
  FROM both_lists GROUP BY ALL),
fused AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id, question_id
    ORDER BY score DESC, dense_rank NULLS LAST, keyword_rank NULLS LAST) AS rank FROM fused0)"""

CONTEXT = """ctx1 AS (SELECT *, row_number() OVER (PARTITION BY user_id, question_id, note_id ORDER BY rank) AS np,
    min(rank) OVER (PARTITION BY user_id, question_id, note_id) AS fr FROM fused),
ctx2 AS (SELECT *, dense_rank() OVER (PARTITION BY user_id, question_id ORDER BY fr) AS no FROM ctx1 WHERE np <= 2),
ctx3 AS (SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY rank) AS position FROM ctx2 WHERE no <= 5),
context AS MATERIALIZED (SELECT user_id, question_id, chunk_id, note_id, score, rank, position FROM ctx3 WHERE position <= 8)"""

HYBRID = f"{SEARCHABLE},\n{QUESTIONS},\n{KEYWORD},\n{DENSE},\n{FUSED},\n{CONTEXT}"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
