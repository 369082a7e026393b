"""Registered queries: chunking, index lifecycle, retrieval, context, answers (with their SQL twins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebank import constants as K
from lorebank.functions.text import trim_ws
from lorebank.functions.tokens import search_terms
from lorebank.operators import answers as A
from lorebank.operators import chunking as C
from lorebank.operators import index as I
from lorebank.operators import replies as P
from lorebank.operators import retrieval as R
from lorebank.plans import model as M
from lorebank.plans import sqlparts as Q

DIM = K.EMBEDDING_DIM


def long(c: str):
    return F.col(c).cast("long").alias(c)


# ---- tokens and chunks --------------------------------------------------------------------------


def search_terms_q(spark: SparkSession, d: str) -> DataFrame:
    return M.notes(spark, d).select("note_id", F.explode(search_terms("content")).alias("term"))


SEARCH_TERMS_SQL = f"SELECT CAST(doc_id AS VARCHAR) AS note_id, unnest({Q.terms('text')}) AS term FROM documents"


def postings_df_q(spark: SparkSession, d: str) -> DataFrame:
    return (
        M.notes(spark, d)
        .select("user_id", F.explode(search_terms("content")).alias("term"))
        .groupBy("user_id", "term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


POSTINGS_SQL = f"""SELECT user_id, term, count(*) AS df FROM (
  SELECT source AS user_id, unnest({Q.terms('text')}) AS term FROM documents) GROUP BY ALL"""


def chunk_windows_q(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_notes(M.notes(spark, d)).select(
        "chunk_id", "user_id", "note_id", long("ordinal"), "content", long("start_offset"), long("end_offset"), long("token_count")
    )


CHUNK_WINDOWS_SQL = Q.with_(Q.WINDOWS) + """SELECT chunk_id, user_id, note_id, CAST(ordinal AS BIGINT) AS ordinal, content,
  CAST(start_offset AS BIGINT) AS start_offset, CAST(start_offset + length(content) AS BIGINT) AS end_offset,
  CAST(token_count AS BIGINT) AS token_count FROM windows"""

# Headings from the pages' own markup: one Markdown body per page, its text under two nested headings.
_PAGE_TITLE = r"(?s)<h1[^>]*>(.*?)</h1>"
_PAGE_PARA = r"(?s)<p>([^<]*)</p>"


def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    pages = M.spread(M.read(spark, d, "pages"))
    head = F.regexp_replace(trim_ws(F.regexp_extract("html", _PAGE_TITLE, 1)), r"[^\p{L}\p{N} ]", "")
    paras = F.filter(
        F.transform(
            F.regexp_extract_all("html", F.lit(_PAGE_PARA), F.lit(1)),
            lambda p: trim_ws(F.regexp_replace(p, r"[^\p{L}\p{N} .,]", "")),
        ),
        lambda p: p.rlike(r"^\p{L}"),
    )
    body = F.array_join(F.transform(paras, lambda p, i: F.concat(F.lit("## Part "), i.cast("string"), F.lit("\n\n"), p)), "\n\n")
    return pages.select(
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("user_id"),
        F.col("page_id").cast("string").alias("note_id"),
        head.alias("head"),
        paras.alias("paras"),
        F.concat(F.lit("# "), head, F.lit("\n\n"), body).alias("content"),
    )


def chunk_sections_q(spark: SparkSession, d: str) -> DataFrame:
    return C.section_rows(page_markdown(spark, d).where(F.col("head") != "")).select(
        "user_id", "note_id", long("section"), F.array_join("heading_path", " > ").alias("path"), long("start"), "text"
    )


CHUNK_SECTIONS_SQL = f"""WITH p AS (
  SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS user_id, CAST(page_id AS VARCHAR) AS note_id,
    regexp_replace({Q.trim(f"regexp_extract(html, '{_PAGE_TITLE}', 1)")}, '[^\\p{{L}}\\p{{N}} ]', '', 'g') AS head,
    list_filter(list_transform(regexp_extract_all(html, '{_PAGE_PARA}', 1),
      lambda x: {Q.trim("regexp_replace(x, '[^\\p{L}\\p{N} .,]', '', 'g')")}), lambda x: regexp_matches(x, '^\\p{{L}}')) AS paras
  FROM pages),
s AS (SELECT *, unnest(range(1, len(paras) + 1)) AS i FROM p WHERE head <> '')
SELECT user_id, note_id, CAST(i - 1 AS BIGINT) AS section, {Q.squash('head')} || ' > Part ' || CAST(i - 1 AS VARCHAR) AS path,
  CAST(length(head) + 4 + coalesce(list_sum(list_transform(range(1, i), lambda j: length('## Part ' || CAST(j - 1 AS VARCHAR)) + 4 + length(paras[j]))), 0)
    + length('## Part ' || CAST(i - 1 AS VARCHAR)) + 2 AS BIGINT) AS start, paras[i] AS text FROM s"""
CHUNK_SECTIONS_SQL = CHUNK_SECTIONS_SQL.replace(Q.squash("head"), Q.trim("head"))


# ---- index lifecycle ----------------------------------------------------------------------------


def searchable_chunks_q(spark: SparkSession, d: str) -> DataFrame:
    return M.searchable_rows(spark, d).select("user_id", "note_id", "chunk_id", "content_hash", long("ordinal"))


SEARCHABLE_SQL = Q.with_(Q.SEARCHABLE) + "SELECT user_id, note_id, chunk_id, content_hash, CAST(ordinal AS BIGINT) AS ordinal FROM searchable"


def index_coverage_q(spark: SparkSession, d: str) -> DataFrame:
    return I.coverage(M.notes(spark, d), M.ledger(spark, d), M.index_chunks(spark, d))


INDEX_COVERAGE_SQL = Q.with_(Q.LEDGER, Q.INDEX) + f"""SELECT user_id, count(*) AS total,
  count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processing') AS processing,
  count(*) FILTER (WHERE status = 'ready' AND covered) AS ready, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status IS NULL OR (status = 'ready' AND NOT covered)) AS missing
FROM (SELECT d.source AS user_id, j.status, {Q.blank('d.text')} OR EXISTS (
    SELECT 1 FROM index_chunks c WHERE c.note_id = j.note_id AND c.user_id = j.user_id
      AND c.content_hash = j.content_hash AND c.index_version = 1) AS covered
  FROM documents d LEFT JOIN ledger j ON j.note_id = CAST(d.doc_id AS VARCHAR) AND j.user_id = d.source) x
GROUP BY user_id"""

_STATES_SQL = Q.with_(Q.LEDGER, Q.INDEX) + f""", states AS (
  SELECT d.source AS user_id, CAST(d.doc_id AS VARCHAR) AS note_id, sha256(d.text) AS content_hash, j.content_hash AS job_hash,
    j.status, coalesce(c.n, 0) AS n_chunks, coalesce(c.all_current, true) AS chunks_current,
    coalesce(j.status = 'ready' AND j.content_hash = sha256(d.text) AND coalesce(c.all_current, true)
      AND ({Q.blank('d.text')} OR c.n IS NOT NULL), false) AS ready
  FROM documents d LEFT JOIN ledger j ON j.note_id = CAST(d.doc_id AS VARCHAR) AND j.user_id = d.source
  LEFT JOIN (SELECT user_id, note_id, count(*) AS n, bool_and(content_hash = sha256(body) AND index_version = 1) AS all_current
             FROM index_chunks GROUP BY ALL) c ON c.user_id = d.source AND c.note_id = CAST(d.doc_id AS VARCHAR))
"""


def index_states_q(spark: SparkSession, d: str) -> DataFrame:
    return I.index_states(M.notes(spark, d), M.ledger(spark, d), M.index_chunks(spark, d))


INDEX_STATES_SQL = _STATES_SQL + "SELECT * FROM states"


def index_backlog_q(spark: SparkSession, d: str) -> DataFrame:
    return I.backlog(M.notes(spark, d), M.ledger(spark, d), M.index_chunks(spark, d))


_BACKLOG = """SELECT user_id, note_id, content_hash FROM states WHERE NOT ready
  AND (job_hash IS NULL OR job_hash <> content_hash OR status = 'ready')"""
INDEX_BACKLOG_SQL = _STATES_SQL + _BACKLOG

_TS = ("available_at", "locked_at", "created_at", "updated_at")


def _ledger_out(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "user_id", "note_id", "content_hash", "status", long("attempts"), "last_error",
        *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in _TS], *extra,
    )


def _ledger_sql(table: str, extra: str = "") -> str:
    return ("SELECT user_id, note_id, content_hash, status, CAST(attempts AS BIGINT) AS attempts, last_error, "
            + ", ".join(f"{Q.ts_text(c)} AS {c}" for c in _TS) + extra + f" FROM {table}")


def ledger_upsert_q(spark: SparkSession, d: str) -> DataFrame:
    ledger = M.ledger(spark, d)
    return _ledger_out(I.ledger_upsert(ledger, I.backlog(M.notes(spark, d), ledger, M.index_chunks(spark, d)), M.now()))


LEDGER_UPSERT_SQL = _STATES_SQL + f""", queued AS ({_BACKLOG}),
merged AS (SELECT coalesce(j.user_id, q.user_id) AS user_id, coalesce(j.note_id, q.note_id) AS note_id,
    coalesce(q.content_hash, j.content_hash) AS content_hash,
    CASE WHEN q.note_id IS NOT NULL THEN 'pending' ELSE j.status END AS status,
    CASE WHEN q.note_id IS NOT NULL THEN 0 ELSE j.attempts END AS attempts,
    CASE WHEN q.note_id IS NOT NULL THEN NULL ELSE j.last_error END AS last_error,
    CASE WHEN q.note_id IS NOT NULL THEN {Q.NOW} ELSE j.available_at END AS available_at,
    CASE WHEN q.note_id IS NOT NULL THEN NULL ELSE j.locked_at END AS locked_at,
    coalesce(j.created_at, {Q.NOW}) AS created_at,
    CASE WHEN q.note_id IS NOT NULL THEN {Q.NOW} ELSE j.updated_at END AS updated_at
  FROM ledger j FULL OUTER JOIN queued q ON q.user_id = j.user_id AND q.note_id = j.note_id)
{_ledger_sql('merged')}"""


def due_work_q(spark: SparkSession, d: str) -> DataFrame:
    """Every ledger row that may run now, as claimed."""
    ledger = I.expire_leases(M.ledger(spark, d), M.now())
    return _ledger_out(I.claim(I.due_rows(ledger, M.now()), M.now()))


DUE_WORK_SQL = Q.with_(Q.LEDGER) + f""", due AS (SELECT * REPLACE ('processing' AS status, attempts + 1 AS attempts,
    {Q.NOW} AS locked_at, {Q.NOW} AS updated_at) FROM ledger
  WHERE attempts < 4 AND ((status = 'pending' AND available_at <= {Q.NOW})
    OR (status = 'processing' AND locked_at <= {Q.NOW} - INTERVAL 5 MINUTE)))
{_ledger_sql('due')}"""


def lease_expiry_q(spark: SparkSession, d: str) -> DataFrame:
    """The whole ledger after dead leases have failed."""
    return _ledger_out(I.expire_leases(M.ledger(spark, d), M.now()))


LEASE_EXPIRY_SQL = Q.with_(Q.LEDGER) + f""", dead AS (SELECT *, status = 'processing' AND attempts >= 4
    AND locked_at <= {Q.NOW} - INTERVAL 5 MINUTE AS d FROM ledger),
out AS (SELECT user_id, note_id, content_hash, CASE WHEN d THEN 'failed' ELSE status END AS status, attempts,
  CASE WHEN d THEN 'Indexing failed.' ELSE last_error END AS last_error, available_at,
  CASE WHEN NOT coalesce(d, false) THEN locked_at END AS locked_at, created_at,
  CASE WHEN d THEN {Q.NOW} ELSE updated_at END AS updated_at FROM dead)
{_ledger_sql('out')}"""


def retry_backoff_q(spark: SparkSession, d: str) -> DataFrame:
    ledger = M.ledger(spark, d)
    failed = ledger.where(F.col("status") == "processing").select("user_id", "note_id", "content_hash")
    return _ledger_out(I.record_failures(ledger, failed, M.now()))


RETRY_BACKOFF_SQL = Q.with_(Q.LEDGER) + f""", out AS (SELECT user_id, note_id, content_hash,
  CASE WHEN status <> 'processing' THEN status WHEN attempts BETWEEN 1 AND 3 THEN 'pending' ELSE 'failed' END AS status, attempts,
  CASE WHEN status = 'processing' THEN 'Indexing failed.' ELSE last_error END AS last_error,
  CASE WHEN status = 'processing' AND attempts BETWEEN 1 AND 3
    THEN {Q.NOW} + to_seconds([5, 30, 300][attempts]) ELSE available_at END AS available_at,
  CASE WHEN status <> 'processing' THEN locked_at END AS locked_at, created_at,
  CASE WHEN status = 'processing' THEN {Q.NOW} ELSE updated_at END AS updated_at FROM ledger)
{_ledger_sql('out')}"""


def manual_retry_q(spark: SparkSession, d: str) -> DataFrame:
    users = M.turns(spark, d).select("user_id")
    return (
        I.retry_failed(M.ledger(spark, d), users, M.now())
        .groupBy("user_id", "status")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("retried").alias("retried"))
    )


MANUAL_RETRY_SQL = Q.with_(Q.LEDGER) + """SELECT user_id, status, count(*) AS n, count(*) FILTER (WHERE hit) AS retried FROM (
  SELECT j.user_id, a.user_id IS NOT NULL AND j.status = 'failed' AS hit,
    CASE WHEN a.user_id IS NOT NULL AND j.status = 'failed' THEN 'pending' ELSE j.status END AS status
  FROM ledger j LEFT JOIN (SELECT DISTINCT 'src' || CAST(conv_id % 20 AS VARCHAR) AS user_id FROM conversations) a USING (user_id))
GROUP BY ALL"""


def cascade_cleanup_q(spark: SparkSession, d: str) -> DataFrame:
    """Notes labelled toxic are deleted: what is left of ledger and chunks."""
    gone = M.read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("note_id"))
    live = M.notes(spark, d).join(gone, "note_id", "left_anti")
    parts = [
        I.cascade(rows.select("user_id", "note_id"), live).withColumn("part", F.lit(name))
        for name, rows in (("chunk", M.index_chunks(spark, d)), ("ledger", M.ledger(spark, d)))
    ]
    return parts[0].unionByName(parts[1]).groupBy("part", "user_id", "note_id").agg(F.count(F.lit(1)).alias("n"))


CASCADE_SQL = Q.with_(Q.LEDGER, Q.INDEX) + """, gone AS (SELECT CAST(doc_id AS VARCHAR) AS note_id FROM labels WHERE toxic = 1)
SELECT part, user_id, note_id, count(*) AS n FROM (
  SELECT 'chunk' AS part, user_id, note_id FROM index_chunks UNION ALL SELECT 'ledger', user_id, note_id FROM ledger)
WHERE note_id NOT IN (SELECT note_id FROM gone) GROUP BY ALL"""


def replace_chunks_q(spark: SparkSession, d: str) -> DataFrame:
    """Backlog notes re-chunked and swapped in; chunks of other notes stay."""
    lib, chunks = M.notes(spark, d), M.index_chunks(spark, d)
    queued = I.backlog(lib, M.ledger(spark, d), chunks)
    work = I.claimed_notes(queued.withColumn("attempts", F.lit(1)), lib)
    fresh = I.index_rows(work).select("chunk_id", "user_id", "note_id", "content_hash", "index_version")
    current = chunks.select("chunk_id", "user_id", "note_id", "content_hash", "index_version")
    return I.replace_chunks(current, fresh, queued, lib).select(
        "chunk_id", "user_id", "note_id", "content_hash", long("index_version")
    )


REPLACE_SQL = _STATES_SQL + f""", queued AS ({_BACKLOG})
SELECT chunk_id, user_id, note_id, content_hash, CAST(index_version AS BIGINT) AS index_version FROM index_chunks
WHERE note_id NOT IN (SELECT note_id FROM queued)
UNION ALL SELECT w.chunk_id, w.user_id, w.note_id, q.content_hash, 1 FROM windows w JOIN queued q USING (user_id, note_id)"""


# ---- retrieval ----------------------------------------------------------------------------------


def keyword_topk_q(spark: SparkSession, d: str) -> DataFrame:
    q = M.questions(spark, d)
    return R.keyword_topk(q, M.searchable_chunks(spark, d)).select("user_id", "question_id", "chunk_id", "hits", long("rank"))


KEYWORD_SQL = Q.with_(Q.SEARCHABLE, Q.QUESTIONS, Q.KEYWORD) + "SELECT user_id, question_id, chunk_id, hits, rank FROM keyword"


def dense_topk_q(spark: SparkSession, d: str) -> DataFrame:
    """Every stored vector as a question over its own library."""
    v = M.vectors(spark, d)
    asked = v.select("user_id", F.col("vec_id").alias("question_id"), "embedding")
    chunks = v.withColumnRenamed("vec_id", "chunk_id")
    return R.dense_topk(asked, chunks, dim=64).select(
        "user_id", "question_id", "chunk_id", F.round("score", 6).alias("score"), long("rank")
    )


DENSE_SQL = """WITH v AS (SELECT 'lib' || CAST(label AS VARCHAR) AS user_id, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.user_id, a.vec_id AS question_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.e, b.e), 12) AS score
  FROM v a JOIN v b ON a.user_id = b.user_id)
SELECT user_id, question_id, chunk_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 30"""


def _hybrid(spark: SparkSession, d: str, scoped: bool = False) -> tuple[DataFrame, DataFrame]:
    q = M.questions(spark, d)
    return (M.with_scopes(q) if scoped else q), M.searchable_chunks(spark, d)


def hybrid_rrf_q(spark: SparkSession, d: str) -> DataFrame:
    q, chunks = _hybrid(spark, d)
    return R.hybrid(q, chunks, DIM).select(
        "user_id", "question_id", "chunk_id", "note_id", F.round("score", 12).alias("score"),
        long("dense_rank"), long("keyword_rank"), long("rank"),
    )


HYBRID_SQL = Q.with_(Q.HYBRID) + """SELECT user_id, question_id, chunk_id, note_id, round(score, 12) AS score, dense_rank,
  keyword_rank, rank FROM fused"""


def context_select_q(spark: SparkSession, d: str) -> DataFrame:
    q, chunks = _hybrid(spark, d)
    return R.select_context(R.hybrid(q, chunks, DIM)).select("user_id", "question_id", "chunk_id", "note_id", long("position"))


CONTEXT_SQL = Q.with_(Q.HYBRID) + "SELECT user_id, question_id, chunk_id, note_id, position FROM context"


def scope_filter_q(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid retrieval inside scopes: ranks of both channels and the fused rank."""
    q, chunks = _hybrid(spark, d, scoped=True)
    return R.hybrid(q, chunks, DIM).select("user_id", "question_id", "chunk_id", long("dense_rank"), long("keyword_rank"), long("rank"))


SCOPE_SQL = Q.with_(Q.NOTES, Q.SEARCHABLE, Q.QUESTIONS, Q.KEYWORD_SCORES, Q.DENSE_SCORES) + f""", sq AS (SELECT *, conv_id % 4 AS kind FROM questions),
ok AS MATERIALIZED (SELECT q.user_id, q.question_id, n.note_id FROM sq q JOIN notes n ON n.user_id = q.user_id
  WHERE (q.kind <> 3 OR (n.doc_id - q.conv_id % 20) % 20 = 0 AND n.doc_id <= q.conv_id % 20 + 380)
    AND (q.kind NOT IN (1, 2) OR n.topic IN ('en', 'de'))
    AND (q.kind <> 2 OR list_has_any(n.tags, ['d1', 'long']))),
keyword AS (SELECT * FROM (SELECT k.*, row_number() OVER (PARTITION BY user_id, question_id ORDER BY hits DESC, chunk_id) AS rank
  FROM kscore k JOIN ok USING (user_id, question_id, note_id)) WHERE rank <= 30),
dense AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY user_id, question_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT *, regexp_extract(chunk_id, '^(.*)#', 1) AS note_id FROM dscore) s JOIN ok USING (user_id, question_id, note_id)) WHERE rank <= 30),
{Q.FUSED}
SELECT user_id, question_id, chunk_id, dense_rank, keyword_rank, rank FROM fused"""


def _context(spark: SparkSession, d: str, again: bool = False) -> tuple[DataFrame, DataFrame]:
    """Questions and their context; ``again`` for queries that read it more than once, so that questions are ranked once."""
    q, chunks = _hybrid(spark, d)
    selected = R.select_context(R.hybrid(q, chunks, DIM))
    if again:
        selected = M.once(spark, "context", selected)
    return q, R.with_payload(selected, M.index_chunks(spark, d), M.notes(spark, d))


def fallback_answer_q(spark: SparkSession, d: str) -> DataFrame:
    q, context = _context(spark, d)
    return A.fallback_answers(q.select("user_id", "question_id"), context).select(
        "user_id", "question_id", "answer", F.array_join("source_ids", ",").alias("source_ids"),
        F.size("citations").cast("long").alias("n_citations"),
        F.array_join(F.transform("citations", lambda c: c["source_url"]), ",").alias("urls"), "insufficient", "mode",
    )


_CTX_TEXT = ", lines AS (SELECT x.*, w.content, n.title, n.source FROM context x JOIN windows w USING (chunk_id) JOIN notes n ON n.note_id = x.note_id)"
FALLBACK_SQL = Q.with_(Q.NOTES, Q.HYBRID) + _CTX_TEXT + f""",
agg AS (SELECT user_id, question_id, string_agg(title || ': ' || left({Q.trim('content')}, 500), chr(10) || chr(10) ORDER BY position) AS answer,
   list(note_id ORDER BY position) AS ids, count(*) AS n,
   string_agg(CASE WHEN regexp_matches(source, '^https?://') THEN source ELSE '' END, ',' ORDER BY position) AS urls
  FROM lines GROUP BY ALL)
SELECT q.user_id, q.question_id, coalesce(a.answer, {Q.lit(K.NO_EVIDENCE)}) AS answer,
  coalesce(array_to_string(list_filter(a.ids, lambda x, i: list_position(a.ids, x) = i), ','), '') AS source_ids,
  coalesce(a.n, 0) AS n_citations, coalesce(a.urls, '') AS urls, a.n IS NULL AS insufficient, 'fallback' AS mode
FROM questions q LEFT JOIN agg a USING (user_id, question_id)"""


def prompt_context_q(spark: SparkSession, d: str) -> DataFrame:
    _, context = _context(spark, d)
    out = A.prompt_contexts(context)
    parsed = F.from_json("chunks_json", "array<struct<chunkId:string,noteId:string,title:string,content:string>>")
    return out.select(
        "user_id", "question_id", "n_chunks",
        F.array_join(F.transform(parsed, lambda c: c["chunkId"]), ",").alias("chunk_ids"),
        F.array_join(F.transform(parsed, lambda c: c["content"]), "\n").alias("contents"),
    )


PROMPT_SQL = Q.with_(Q.NOTES, Q.HYBRID) + _CTX_TEXT + f"""SELECT user_id, question_id, count(*) AS n_chunks,
  string_agg(chunk_id, ',' ORDER BY position) AS chunk_ids,
  string_agg('<UNTRUSTED_SOURCE_TEXT>' || chr(10) || content || chr(10) || '</UNTRUSTED_SOURCE_TEXT>', chr(10) ORDER BY position) AS contents
FROM lines GROUP BY ALL"""


#: One user's index is taken as not built yet: their questions are answered in basic mode.
_UNINDEXED = "src3"


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """Mode and candidate counts of every question."""
    q, chunks = _hybrid(spark, d)
    users = chunks.where(F.col("user_id") != _UNINDEXED).select("user_id")
    moded = R.retrieval_mode(q, DIM, users).select("user_id", "question_id", "search_terms", "embedding", "retrieval_mode")
    rag, basic = moded.where("retrieval_mode <> 'basic'"), moded.where("retrieval_mode = 'basic'")
    counts = R.candidate_counts(rag, R.mark_context(R.hybrid(rag, chunks, DIM)))
    return counts.unionByName(R.basic_counts(basic, M.notes(spark, d))).drop("search_terms", "embedding")


def candidate_counts_q(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("user_id", "question_id", "dense_count", "keyword_count", "context_count", "retrieval_mode")


_COUNTS = f"""counts AS (SELECT q.user_id, q.question_id,
  CASE WHEN basic THEN 0 ELSE (SELECT count(*) FROM dense x WHERE x.question_id = q.question_id) END AS dense_count,
  CASE WHEN basic THEN (SELECT count(*) FROM documents n WHERE n.source = q.user_id) ELSE (SELECT count(*) FROM keyword x WHERE x.question_id = q.question_id) END AS keyword_count,
  CASE WHEN basic THEN (SELECT count(*) FROM documents n WHERE n.source = q.user_id) ELSE (SELECT count(*) FROM context x WHERE x.question_id = q.question_id) END AS context_count,
  CASE WHEN basic THEN 'basic' WHEN len({Q.terms('query')}) > 0 THEN 'hybrid' ELSE 'dense' END AS retrieval_mode
  FROM (SELECT *, user_id = '{_UNINDEXED}' OR user_id NOT IN (SELECT user_id FROM searchable) AS basic FROM questions) q)"""
COUNTS_SQL = Q.with_(Q.HYBRID, _COUNTS) + "SELECT user_id, question_id, dense_count, keyword_count, context_count, retrieval_mode FROM counts"


def answer_metrics_q(spark: SparkSession, d: str) -> DataFrame:
    """The metric events of retrieval and answering, summed by their fixed categories. Replies that are no JSON fall back."""
    counts = M.once(spark, "counts", _metrics(spark, d))  # summed twice
    bad = P.parse_replies(_replies(spark, d)).select("user_id", "question_id", "bad")
    return P.answer_metrics(counts, bad)


ANSWER_METRICS_SQL = Q.with_(Q.HYBRID, _COUNTS) + """, a AS (SELECT *, CASE WHEN context_count = 0 THEN 'fallback' WHEN retrieval_mode = 'basic' THEN 'model'
    WHEN CAST(split_part(question_id, ':', 1) AS BIGINT) % 5 = 2 THEN 'fallback' ELSE 'model' END AS outcome,
    CASE WHEN context_count > 0 AND retrieval_mode <> 'basic' AND CAST(split_part(question_id, ':', 1) AS BIGINT) % 5 = 2 THEN 'answer_generation_failed' END AS why FROM counts)
SELECT 'knowledge_retrieval' AS event, 'success' AS outcome, retrieval_mode, CAST(NULL AS VARCHAR) AS failure_category, count(*) AS n, CAST(sum(dense_count) AS BIGINT) AS dense_candidates,
  CAST(sum(keyword_count) AS BIGINT) AS keyword_candidates, CAST(sum(context_count) AS BIGINT) AS context FROM counts GROUP BY retrieval_mode
UNION ALL SELECT 'answer_generation', outcome, retrieval_mode, why, count(*), NULL, NULL, CAST(sum(context_count) AS BIGINT) FROM a GROUP BY ALL"""


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """A reply text for every user turn: plain JSON, JSON inside prose, cut off JSON, fields of odd types, or none of the fields."""
    turns, n = M.turns(spark, d), F.col("conv_id") % 5
    said = turns.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said"))
    cites = F.array(*[
        F.struct(F.concat(_cited_note(), F.lit(c)).alias("chunkId"), _cited_note().alias("noteId"), F.lit(quote).alias("quote"))
        for c, quote in (("#000000", "a"), ("#000000", "a"), ("#000000", " "), ("#000009", "a"), ("#000000", "e"))
    ])
    fields = F.to_json(F.struct(F.coalesce("said", F.lit("")).alias("knowledgeAnswer"), F.lit("more").alias("generalSupplement"), (F.col("turn") > 6).alias("insufficient"), cites.alias("citations")))
    odd = F.concat(F.lit('{"knowledgeAnswer": '), F.col("turn").cast("string"), F.lit(', "generalSupplement": ["no"], "insufficient": "yes", "citations": {"chunkId": 1}}'))
    text = (
        F.when(n == 0, fields).when(n == 1, F.concat(F.lit("Here it is:\n```json\n"), fields, F.lit("\n```"))).when(n == 2, F.concat(F.lit("{"), fields)).when(n == 3, odd).otherwise("[1, 2]")
    )
    asked = turns.where(F.col("role") == "user").join(said, ["conv_id", "turn"], "left")
    return asked.select("user_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"), text.alias("reply"))


def _cited_note() -> Column:
    return (F.col("conv_id") % M.USERS + M.USERS * F.col("turn")).cast("string")


def model_replies_q(spark: SparkSession, d: str) -> DataFrame:
    """Replies parsed, their citations held against chunks of one note per question, and judged; ``bad`` ones are no JSON."""
    parsed = P.parse_replies(_replies(spark, d)).withColumns({"conv_id": F.split_part("question_id", F.lit(":"), F.lit(1)).cast("long"), "turn": F.split_part("question_id", F.lit(":"), F.lit(2)).cast("long")})
    shown = parsed.select("user_id", "question_id", _cited_note().alias("note_id")).join(
        M.index_chunks(spark, d).select("user_id", "note_id", "chunk_id", "content"), ["user_id", "note_id"]
    )
    context = shown.join(M.notes(spark, d).select("user_id", "note_id", "title", "source"), ["user_id", "note_id"])
    cited = A.check_chunk_citations(P.proposed_citations(parsed), context)
    judged = A.judge_model_outputs(parsed.drop("citations", "conv_id", "turn"), cited)
    return judged.select("user_id", "question_id", "bad", "knowledge_answer", "general_supplement", "insufficient", long("n_citations"), F.array_join("source_ids", ",").alias("source_ids"))


MODEL_REPLIES_SQL = Q.with_(Q.INDEX) + f""", t AS (SELECT *, 'src' || CAST(conv_id % 20 AS VARCHAR) AS user_id, CAST(conv_id % 20 + 20 * turn AS VARCHAR) AS note_id FROM conversations),
r AS (SELECT t.user_id, CAST(t.conv_id AS VARCHAR) || ':' || CAST(t.turn AS VARCHAR) AS question_id, t.conv_id % 5 AS kind, t.turn, t.note_id,
    {Q.trim("coalesce(s.text, '')")} AS said FROM t LEFT JOIN t s ON s.conv_id = t.conv_id AND s.turn = t.turn + 1 AND s.role = 'assistant' WHERE t.role = 'user'),
c AS (SELECT r.*, CASE WHEN kind > 1 OR w.content IS NULL THEN 0 ELSE CAST(contains(w.content, 'a') AS INTEGER) + CAST(contains(w.content, 'e') AS INTEGER) END
    + CASE WHEN kind > 1 OR w9.content IS NULL THEN 0 ELSE CAST(contains(w9.content, 'a') AS INTEGER) END AS n
  FROM r LEFT JOIN index_chunks w ON w.user_id = r.user_id AND w.note_id = r.note_id AND w.chunk_id = r.note_id || '#000000'
  LEFT JOIN index_chunks w9 ON w9.user_id = r.user_id AND w9.note_id = r.note_id AND w9.chunk_id = r.note_id || '#000009'),
o AS (SELECT *, CASE WHEN kind < 2 THEN said WHEN kind = 3 AND turn <> 0 THEN CAST(turn AS VARCHAR) ELSE '' END AS a, (kind < 2 AND turn > 6) OR kind = 3 AS flagged FROM c)
SELECT user_id, question_id, kind = 2 AS bad, coalesce(nullif(a, ''), {Q.lit(K.NO_MODEL_ANSWER)}) AS knowledge_answer,
  CASE WHEN kind < 2 AND (flagged OR n = 0 OR a = '') THEN 'more' ELSE '' END AS general_supplement, flagged OR n = 0 OR a = '' AS insufficient, CAST(n AS BIGINT) AS n_citations,
  CASE WHEN n > 0 THEN note_id ELSE '' END AS source_ids FROM o"""


def history_query_q(spark: SparkSession, d: str) -> DataFrame:
    return M.question_rows(spark, d).select("user_id", "question_id", "query")


HISTORY_SQL = Q.with_(Q.QUESTIONS) + "SELECT user_id, question_id, query FROM questions"

# Proposed citations: from each context row a verbatim quote from its middle, the same again, an altered quote, an
# over-long one, a wrong note, and a verbatim quote from its end.


def _proposals(context: DataFrame) -> DataFrame:
    inner = trim_ws(F.substring(F.col("content"), F.floor(F.length("content") / 2).cast("int") + 1, F.lit(120)))
    kinds = F.array(
        F.struct(F.lit(0).alias("k"), "note_id", inner.alias("quote")),
        F.struct(F.lit(1).alias("k"), "note_id", inner.alias("quote")),
        F.struct(F.lit(2).alias("k"), "note_id", F.concat(inner, F.lit("|")).alias("quote")),
        F.struct(F.lit(3).alias("k"), "note_id", F.left("content", F.lit(501)).alias("quote")),
        F.struct(F.lit(4).alias("k"), F.concat(F.lit("x"), "note_id").alias("note_id"), inner.alias("quote")),
        F.struct(F.lit(5).alias("k"), "note_id", trim_ws(F.right("content", F.lit(120))).alias("quote")),
    )
    return context.select("user_id", "question_id", "chunk_id", "position", F.explode(kinds).alias("p")).select(
        "user_id", "question_id", "chunk_id", "p.note_id", "p.quote", (F.col("position") * 6 + F.col("p.k")).alias("pos")
    )


def citation_verify_q(spark: SparkSession, d: str) -> DataFrame:
    _, context = _context(spark, d, again=True)
    return A.check_chunk_citations(_proposals(context), context).select(
        "user_id", "question_id", "chunk_id", "note_id", "quote", "title", "source_url", long("pos"), long("position")
    )


_PROPOSED_SQL = f""", props AS (
  SELECT user_id, question_id, chunk_id, note_id, {Q.trim("substr(content, length(content) // 2 + 1, 120)")} AS quote, position * 6 AS pos FROM lines
  UNION ALL SELECT user_id, question_id, chunk_id, note_id, left(content, 501), position * 6 + 3 FROM lines WHERE length(content) <= 500
  UNION ALL SELECT user_id, question_id, chunk_id, note_id, {Q.trim("right(content, 120)")}, position * 6 + 5 FROM lines),
good AS (SELECT user_id, question_id, chunk_id, note_id, quote, min(pos) AS pos FROM props GROUP BY ALL),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY pos) AS position FROM good) WHERE position <= 12)
"""
CITATION_SQL = Q.with_(Q.NOTES, Q.HYBRID) + _CTX_TEXT + _PROPOSED_SQL + """SELECT g.user_id, g.question_id, g.chunk_id, g.note_id, g.quote, n.title,
  CASE WHEN regexp_matches(n.source, '^https?://') THEN n.source ELSE '' END AS source_url, g.pos, g.position
FROM capped g JOIN notes n USING (note_id)"""


def model_judgement_q(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns stand for model replies; replies of odd conversations cite nothing."""
    q, context = _context(spark, d, again=True)
    cited = A.check_chunk_citations(
        _proposals(context).where(F.split_part("question_id", F.lit(":"), F.lit(1)).cast("long") % 2 == 0), context
    )
    turns = M.turns(spark, d)
    replies = turns.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    asked = turns.where(F.col("role") == "user").join(replies, ["conv_id", "turn"], "left")
    outputs = asked.select(
        "user_id",
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        F.col("reply").alias("knowledge_answer"),
        F.lit("more").alias("general_supplement"),
        (F.col("turn") > 6).alias("insufficient"),
    )
    return A.judge_model_outputs(outputs, cited).select(
        "user_id", "question_id", "knowledge_answer", "general_supplement", "insufficient", long("n_citations"),
        F.array_join("source_ids", ",").alias("source_ids"),
    )


JUDGE_SQL = Q.with_(Q.NOTES, Q.HYBRID) + _CTX_TEXT + _PROPOSED_SQL + f""", cites AS (
  SELECT user_id, question_id, count(*) AS n, list(note_id ORDER BY position) AS ids FROM capped
  WHERE CAST(split_part(question_id, ':', 1) AS BIGINT) % 2 = 0 GROUP BY ALL),
outs AS (SELECT t.user_id, CAST(t.conv_id AS VARCHAR) || ':' || CAST(t.turn AS VARCHAR) AS question_id,
    {Q.trim("coalesce(r.text, '')")} AS a, t.turn FROM turns t
  LEFT JOIN turns r ON r.conv_id = t.conv_id AND r.turn = t.turn + 1 AND r.role = 'assistant' WHERE t.role = 'user')
SELECT o.user_id, o.question_id, coalesce(nullif(o.a, ''), {Q.lit(K.NO_MODEL_ANSWER)}) AS knowledge_answer,
  CASE WHEN o.turn > 6 OR c.n IS NULL OR o.a = '' THEN 'more' ELSE '' END AS general_supplement,
  o.turn > 6 OR c.n IS NULL OR o.a = '' AS insufficient, coalesce(c.n, 0) AS n_citations,
  coalesce(array_to_string(list_filter(c.ids, lambda x, i: list_position(c.ids, x) = i), ','), '') AS source_ids
FROM outs o LEFT JOIN cites c USING (user_id, question_id)"""


def whole_text_quality(chunks: DataFrame, stored: DataFrame, notes: DataFrame, dim: int = DIM) -> DataFrame:
    """Every chunk asks with its whole text, through both channels, and expects itself and its whole quote among the citations.

    Quotes come from the answers, which read the ``stored`` chunks, and are looked for in the text of the notes. Chunks and notes are joined
    by their own ids alone: one that reached a foreign user would count as a leak.
    """
    asked = chunks.select(
        "user_id", F.col("chunk_id").alias("question_id"), "search_terms", "embedding", F.col("note_id").alias("expected_note"),
        F.col("ordinal").alias("expected_ordinal"), F.left(trim_ws("content"), F.lit(K.QUOTE_LIMIT)).alias("expected_quote"),
    )
    selected = R.select_context(R.hybrid(asked.select("user_id", "question_id", "search_terms", "embedding"), chunks, dim))
    context = selected.join(notes.select("note_id", "title", "source"), "note_id").join(stored.select("chunk_id", A.answer_quote("content").alias("quote")), "chunk_id")
    answers = A.fallback_answers(asked.select("user_id", "question_id"), context)
    quotes = answers.select("user_id", "question_id", F.posexplode("citations").alias("place", "c")).select(
        "user_id", "question_id", (F.col("place") + 1).alias("position"), "c.chunk_id", "c.note_id", "c.quote"
    )
    owners = notes.select("note_id", F.col("user_id").alias("note_owner"), "content")
    out = A.retrieval_quality(asked, quotes.join(chunks.select("chunk_id", "ordinal"), "chunk_id").join(owners, "note_id"))
    return out.select("questions", "hits", F.round("hit_rate", 6).alias("hit_rate"), F.round("verbatim_rate", 6).alias("verbatim_rate"), "leaks")


def retrieval_quality_whole_q(spark: SparkSession, d: str) -> DataFrame:
    """Whole chunk texts as questions to hybrid retrieval; quotes of the answers against the notes."""
    return whole_text_quality(M.searchable_chunks(spark, d), M.index_chunks(spark, d), M.notes(spark, d))


_WHOLE = "questions AS MATERIALIZED (SELECT user_id, chunk_id AS question_id, content AS query FROM searchable)"
QUALITY_WHOLE_SQL = Q.with_(Q.SEARCHABLE, _WHOLE, Q.KEYWORD, Q.DENSE, Q.FUSED, Q.CONTEXT) + f""",
said AS (SELECT x.*, left({Q.trim('w.content')}, 500) AS quote FROM context x JOIN windows w USING (chunk_id)),
per AS (SELECT x.user_id, x.question_id, bool_or(x.position <= 5 AND x.chunk_id = x.question_id AND contains(x.quote, left({Q.trim('a.content')}, 500))) AS hit,
    count(*) FILTER (WHERE contains(d.text, x.quote)) AS v, count(*) AS n, count(*) FILTER (WHERE d.source <> x.user_id) AS foreign_notes
  FROM said x JOIN searchable a ON a.chunk_id = x.question_id JOIN documents d ON CAST(d.doc_id AS VARCHAR) = x.note_id GROUP BY ALL)
SELECT count(*) AS questions, count(*) FILTER (WHERE p.hit) AS hits, round(count(*) FILTER (WHERE p.hit) / count(*), 6) AS hit_rate,
  round(sum(p.v) / sum(p.n), 6) AS verbatim_rate, CAST(coalesce(sum(p.foreign_notes), 0) AS BIGINT) AS leaks
FROM questions q LEFT JOIN per p USING (user_id, question_id)"""


QUERIES = {
    "search_terms": (search_terms_q, SEARCH_TERMS_SQL),
    "postings_df": (postings_df_q, POSTINGS_SQL),
    "chunk_windows": (chunk_windows_q, CHUNK_WINDOWS_SQL),
    "chunk_sections": (chunk_sections_q, CHUNK_SECTIONS_SQL),
    "searchable_chunks": (searchable_chunks_q, SEARCHABLE_SQL),
    "index_coverage": (index_coverage_q, INDEX_COVERAGE_SQL),
    "index_states": (index_states_q, INDEX_STATES_SQL),
    "index_backlog": (index_backlog_q, INDEX_BACKLOG_SQL),
    "ledger_upsert": (ledger_upsert_q, LEDGER_UPSERT_SQL),
    "due_work": (due_work_q, DUE_WORK_SQL),
    "lease_expiry": (lease_expiry_q, LEASE_EXPIRY_SQL),
    "retry_backoff": (retry_backoff_q, RETRY_BACKOFF_SQL),
    "manual_retry": (manual_retry_q, MANUAL_RETRY_SQL),
    "cascade_cleanup": (cascade_cleanup_q, CASCADE_SQL),
    "replace_chunks": (replace_chunks_q, REPLACE_SQL),
    "keyword_topk": (keyword_topk_q, KEYWORD_SQL),
    "dense_topk": (dense_topk_q, DENSE_SQL),
    "hybrid_rrf": (hybrid_rrf_q, HYBRID_SQL),
    "context_select": (context_select_q, CONTEXT_SQL),
    "scope_filter": (scope_filter_q, SCOPE_SQL),
    "fallback_answer": (fallback_answer_q, FALLBACK_SQL),
    "prompt_context": (prompt_context_q, PROMPT_SQL),
    "candidate_counts": (candidate_counts_q, COUNTS_SQL),
    "answer_metrics": (answer_metrics_q, ANSWER_METRICS_SQL),
    "model_replies": (model_replies_q, MODEL_REPLIES_SQL),
    "history_query": (history_query_q, HISTORY_SQL),
    "citation_verify": (citation_verify_q, CITATION_SQL),
    "model_judgement": (model_judgement_q, JUDGE_SQL),
    "retrieval_quality_whole": (retrieval_quality_whole_q, QUALITY_WHOLE_SQL),
}
