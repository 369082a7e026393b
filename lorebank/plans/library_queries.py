"""Registered queries: notes, gates, search, facets, organiser, basic mode, imports, vaults (with SQL twins)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebank import constants as K
from lorebank.functions import embed as E
from lorebank.functions import provenance as P
from lorebank.functions import text as X
from lorebank.functions import urls as U
from lorebank.operators import answers as A
from lorebank.operators import edits as ED
from lorebank.operators import facets as FA
from lorebank.operators import gates as G
from lorebank.operators import index as I
from lorebank.operators import organise as O
from lorebank.operators import quotes as QT
from lorebank.operators.lookback import preceding_rows
from lorebank.plans import model as M
from lorebank.plans import sqlparts as Q
from lorebank.sources import captions as CA
from lorebank.sources import feeds as FE
from lorebank.sources import library as L
from lorebank.sources import uploads as UP
from lorebank.sources import vault as V
from lorebank.sources import web as WEB

ID = ("user_id", "note_id")
NOTES = Q.with_(Q.NOTES)


def long(c: str) -> Column:
    return F.col(c).cast("long").alias(c)


def joined(c: str, sep: str = "|") -> Column:
    return F.array_join(c, sep).alias(c)


# ---- listing, search, facets --------------------------------------------------------------------


def library_scan_q(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated")
    return FA.list_notes(M.notes(spark, d)).select(*ID, "title", stamp)


LIBRARY_SCAN_SQL = NOTES + f"SELECT user_id, note_id, title, {Q.ts_text('updated_at')} AS updated FROM notes"


def library_search_q(spark: SparkSession, d: str) -> DataFrame:
    return FA.search_library(M.notes(spark, d), "  THE Er ", "en").select(*ID, "title")


LIBRARY_SEARCH_SQL = NOTES + """SELECT user_id, note_id, title FROM notes WHERE list_contains(tags, 'en')
  AND contains(lower(concat_ws(' ', title, summary, array_to_string(tags, ' '), content)), 'the er')"""


def scope_notes_q(spark: SparkSession, d: str) -> DataFrame:
    return M.notes(spark, d).where(FA.in_scope(topics=["de", "fr"], tags=["long", "d3"])).select(*ID, "topic")


SCOPE_NOTES_SQL = NOTES + "SELECT user_id, note_id, topic FROM notes WHERE topic IN ('de', 'fr') AND list_has_any(tags, ['long', 'd3'])"


def tag_facets_q(spark: SparkSession, d: str) -> DataFrame:
    return FA.tag_facets(M.notes(spark, d))


TAG_FACETS_SQL = NOTES + f"""SELECT user_id, tag, count(*) AS n FROM (SELECT user_id, unnest(list_distinct(tags)) AS tag FROM notes) GROUP BY ALL
UNION ALL SELECT user_id, '{K.ALL_TAGS}', count(*) FROM notes GROUP BY ALL"""


def topic_options_q(spark: SparkSession, d: str) -> DataFrame:
    return FA.by_locale(FA.filter_options(M.notes(spark, d)), "user_id", "kind", "value")


TOPIC_OPTIONS_SQL = NOTES + """SELECT DISTINCT user_id, 'topic' AS kind, topic AS value FROM notes
UNION SELECT DISTINCT user_id, 'tag', unnest(tags) FROM notes"""


def relation_edges_q(spark: SparkSession, d: str) -> DataFrame:
    return FA.relation_edges(M.notes(spark, d)).select("user_id", "from_note", "to_note", "to_title", long("pos"))


RELATION_EDGES_SQL = NOTES + """SELECT a.user_id, a.note_id AS from_note, b.note_id AS to_note, b.title AS to_title, a.i - 1 AS pos
FROM (SELECT *, unnest(range(1, 5)) AS i FROM notes) a JOIN notes b ON b.user_id = a.user_id AND b.note_id = a.related_note_ids[a.i]"""


def unindexed_notes_q(spark: SparkSession, d: str) -> DataFrame:
    return FA.unindexed(M.notes(spark, d), M.searchable_chunks(spark, d)).select(*ID)


UNINDEXED_SQL = Q.with_(Q.SEARCHABLE) + f"""SELECT source AS user_id, CAST(doc_id AS VARCHAR) AS note_id FROM documents
WHERE NOT {Q.blank('text')} AND CAST(doc_id AS VARCHAR) NOT IN (SELECT note_id FROM searchable)"""


# ---- normalising and gates ----------------------------------------------------------------------


def _loose(spark: SparkSession, d: str) -> DataFrame:
    """Notes with holes and overflows."""
    doc = F.col("doc_id")
    many = F.transform(F.sequence(F.lit(1), (doc % 30 + 1).cast("int")), lambda i: F.concat(F.lit(" t"), (i % 23).cast("string")))
    return M.notes(spark, d).withColumns(
        {
            "title": F.when(doc % 4 == 0, F.lit("")).when(doc % 4 == 1, F.left("content", (doc % 300).cast("int"))).otherwise(F.col("title")),
            "summary": F.when(doc % 5 != 0, F.left("content", F.lit(2100))),
            "tags": F.when(doc % 6 != 0, many),
            "topic": F.when(doc % 3 == 0, "").otherwise(F.col("topic")),
            "related_note_ids": F.transform(F.sequence(F.lit(1), (doc % 60 + 1).cast("int")), lambda i: F.concat(F.lit("n"), i.cast("string"))),
        }
    )


_LOOSE = f"""{Q.NOTES}, loose AS (SELECT * REPLACE (
  CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN left(content, doc_id % 300) ELSE title END AS title,
  CASE WHEN doc_id % 5 <> 0 THEN left(content, 2100) END AS summary,
  CASE WHEN doc_id % 6 <> 0 THEN list_transform(range(1, doc_id % 30 + 2), lambda i: ' t' || CAST(i % 23 AS VARCHAR)) END AS tags,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE topic END AS topic,
  list_transform(range(1, doc_id % 60 + 2), lambda i: 'n' || CAST(i AS VARCHAR)) AS related_note_ids) FROM notes)"""


def note_normalise_q(spark: SparkSession, d: str) -> DataFrame:
    return G.normalise_notes(_loose(spark, d), M.now()).select(
        *ID, "title", F.length("summary").cast("long").alias("n_summary"), joined("tags"), "topic", joined("related_note_ids")
    )


NOTE_NORMALISE_SQL = Q.with_(_LOOSE) + f"""SELECT user_id, note_id, coalesce(nullif(title, ''), '{K.UNTITLED_NOTE}') AS title,
  length(coalesce(summary, '')) AS n_summary, coalesce(array_to_string(tags[1:20], '|'), '') AS tags,
  coalesce(nullif(topic, ''), 'Inbox') AS topic, array_to_string(related_note_ids[1:50], '|') AS related_note_ids FROM loose"""


def note_quality_gate_q(spark: SparkSession, d: str) -> DataFrame:
    return G.check_notes(_loose(spark, d)).select(*ID, "accepted", joined("reasons", ","), joined("tags"))


NOTE_GATE_SQL = Q.with_(_LOOSE) + f""", r AS (SELECT user_id, note_id, list_filter([
    CASE WHEN length(coalesce(nullif(title, ''), '{K.UNTITLED_NOTE}')) > 200 THEN 'title' END,
    CASE WHEN length(content) > 1000000 THEN 'content' END, CASE WHEN length(summary) > 2000 THEN 'summary' END,
    CASE WHEN len(tags) > 20 THEN 'tags' END, CASE WHEN len(related_note_ids) > 50 THEN 'related_note_ids' END], lambda x: x IS NOT NULL) AS rs,
    list_transform(coalesce(tags, []), lambda t: trim(t)) AS ts FROM loose)
SELECT user_id, note_id, len(rs) = 0 AS accepted, array_to_string(rs, ',') AS reasons,
  coalesce(array_to_string(list_filter(ts, lambda x, i: list_position(ts, x) = i), '|'), '') AS tags FROM r"""


def question_quality_gate_q(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as a question with all its earlier turns of the last eight as history."""
    conv = F.col("conv_id")
    turns = preceding_rows(M.turns(spark, d), ["conv_id"], "turn", F.struct("role", "text"), 8, "history")
    rows = turns.select(
        "user_id",
        F.concat_ws(":", conv.cast("string"), F.col("turn").cast("string")).alias("question_id"),
        F.when(conv % 7 == 0, F.lit("  ")).when(conv % 7 == 1, F.repeat("text", F.lit(6))).otherwise(F.col("text")).alias("question"),
        "history",
        F.transform(F.sequence(F.lit(1), (conv % 25 + 1).cast("int")), lambda i: F.concat(F.lit("n"), i.cast("string"))).alias("scope_note_ids"),
        F.when(conv % 3 == 0, F.array(F.lit("a"), F.lit(" a "))).otherwise(F.array(F.lit("a"))).alias("scope_topics"),
        F.when(conv % 5 == 0, F.array(F.repeat(F.lit("x"), F.lit(101)))).otherwise(F.array().cast("array<string>")).alias("scope_tags"),
    )
    return G.check_questions(rows).select("user_id", "question_id", "accepted", joined("reasons", ","))


QUESTION_GATE_SQL = f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
h AS (SELECT a.conv_id, a.turn, count(*) AS k, bool_or(b.role NOT IN ('user', 'assistant')) AS bad, max(length(b.text)) AS m
  FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.n BETWEEN a.n - 8 AND a.n - 1 GROUP BY ALL),
q AS (SELECT t.*, h.*, CASE t.conv_id % 7 WHEN 0 THEN '  ' WHEN 1 THEN repeat(t.text, 6) ELSE t.text END AS question
  FROM t LEFT JOIN h ON h.conv_id = t.conv_id AND h.turn = t.turn),
r AS (SELECT 'src' || CAST(conv_id % 20 AS VARCHAR) AS user_id, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS question_id,
  list_filter([CASE WHEN length(question) > 2000 THEN 'question:too_long' END, CASE WHEN {Q.trim('question')} = '' THEN 'question:empty' END,
    CASE WHEN k > 6 THEN 'history:too_many' END, CASE WHEN bad THEN 'history:role' END, CASE WHEN m > 2000 THEN 'history:too_long' END,
    CASE WHEN conv_id % 25 + 1 > 20 THEN 'scope_note_ids:too_many' END, CASE WHEN conv_id % 3 = 0 THEN 'scope_topics:duplicate' END,
    CASE WHEN conv_id % 5 = 0 THEN 'scope_tags:invalid' END], lambda x: x IS NOT NULL) AS rs FROM q)
SELECT user_id, question_id, len(rs) = 0 AS accepted, array_to_string(rs, ',') AS reasons FROM r"""


# ---- text projections ---------------------------------------------------------------------------


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """Notes with Markdown furniture around the text."""
    doc, c = F.col("doc_id"), F.col("content")
    return M.notes(spark, d).withColumn(
        "body",
        F.when(doc % 3 == 0, F.concat(F.lit("# "), F.left(c, F.lit(30)), F.lit("\n\n"), c))
        .when(doc % 3 == 1, F.concat(F.lit("\n \n"), c, F.lit("\n```\ncode "), doc.cast("string"), F.lit("\n```\n")))
        .otherwise(F.concat(F.lit("**"), F.left(c, F.lit(20)), F.lit("** [link](http://x) "), c)),
    )


_BODIES = f"""{Q.NOTES}, bodies AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN '# ' || left(content, 30) || chr(10) || chr(10) || content
  WHEN 1 THEN chr(10) || ' ' || chr(10) || content || chr(10) || '```' || chr(10) || 'code ' || CAST(doc_id AS VARCHAR) || chr(10) || '```' || chr(10)
  ELSE '**' || left(content, 20) || '** [link](http://x) ' || content END AS body FROM notes)"""


def title_extract_q(spark: SparkSession, d: str) -> DataFrame:
    return _bodies(spark, d).select(*ID, X.title_from_body("body").alias("title_a"), X.title_with_fallback("body", "topic").alias("title_b"))


TITLE_SQL = Q.with_(_BODIES) + f"""SELECT user_id, note_id, {Q.title('body')} AS title_a,
  coalesce(nullif({Q.trim(Q.heading('body'))}, ''), topic) AS title_b FROM bodies"""


def summary_extract_q(spark: SparkSession, d: str) -> DataFrame:
    return _bodies(spark, d).select(*ID, X.summary_of("body").alias("summary"), X.first_line("body").alias("first_line"))


SUMMARY_SQL = Q.with_(_BODIES) + f"SELECT user_id, note_id, {Q.summary('body')} AS summary, left({Q.first_filled(Q.no_marks('body'))}, 48) AS first_line FROM bodies"


def plain_text_q(spark: SparkSession, d: str) -> DataFrame:
    return _bodies(spark, d).select(*ID, X.plain_text("body").alias("plain"), X.default_quote("body").alias("quote"))


_NO_TITLE = f"regexp_replace(body, '^#[{K.WS}]+[^\\n\\r]+\\r?\\n+', '')"
PLAIN_SQL = Q.with_(_BODIES) + f"""SELECT user_id, note_id,
  {Q.trim(Q.squash("regexp_replace(regexp_replace(body, '(?s)```.*?```', '', 'g'), '[#>*_\\-\\[\\]()`]', '', 'g')"))} AS plain,
  left(coalesce(nullif({Q.trim(_NO_TITLE)}, ''), {Q.trim('body')}), 220) AS quote FROM bodies"""


def content_hash_q(spark: SparkSession, d: str) -> DataFrame:
    return M.notes(spark, d).select(*ID, X.content_hash("content").alias("content_hash"))


CONTENT_HASH_SQL = "SELECT source AS user_id, CAST(doc_id AS VARCHAR) AS note_id, sha256(text) AS content_hash FROM documents"


def log_redaction_q(spark: SparkSession, d: str) -> DataFrame:
    e = M.read(spark, d, "events")
    log = F.concat_ws(" ", F.col("event_type"), F.lit("postgresql://u:p@h/db"), F.col("props"), F.lit("bearer"), F.sha2("props", 256))
    return e.select("event_id", X.redact_log(log).alias("line"))


LOG_REDACTION_SQL = "SELECT event_id, event_type || ' [database-url-redacted] ' || props || ' Bearer [redacted]' AS line FROM events"


# ---- edits --------------------------------------------------------------------------------------


def patch_merge_q(spark: SparkSession, d: str) -> DataFrame:
    """The last event of a note is its patch: views set the title, clicks the topic, errors the content."""
    e = M.read(spark, d, "events").withColumn("note_id", F.col("user_id").cast("string"))
    last = e.groupBy("note_id").agg(F.max_by(F.struct("event_type", "props"), F.struct("ts", "event_id")).alias("p"))
    lib = M.notes(spark, d)

    def field(kind: str, value: Column) -> Column:
        return F.when(F.col("p.event_type") == kind, value)

    patches = last.join(lib.select(*ID), "note_id").select(
        *ID,
        field("view", F.col("p.props")).alias("title"),
        field("click", F.lit("")).alias("topic"),
        field("error", F.col("p.props")).alias("content"),
    )
    return ED.apply_patches(lib, patches, M.now()).select(
        *ID, "title", "topic", F.sha2("content", 256).alias("hash"), "content_changed", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated")
    )


PATCH_SQL = NOTES + f""", last AS (SELECT CAST(user_id AS VARCHAR) AS note_id, arg_max(event_type, (ts, event_id)) AS e, arg_max(props, (ts, event_id)) AS p
  FROM events GROUP BY ALL)
SELECT n.user_id, n.note_id, CASE WHEN e = 'view' THEN p ELSE title END AS title, CASE WHEN e = 'click' THEN 'Inbox' ELSE topic END AS topic,
  sha256(CASE WHEN e = 'error' THEN p ELSE content END) AS hash, coalesce(e = 'error' AND p <> content, false) AS content_changed,
  {Q.ts_text(f'CASE WHEN e IS NOT NULL THEN {Q.NOW} ELSE updated_at END')} AS updated FROM notes n LEFT JOIN last l USING (note_id)"""


def tag_merge_q(spark: SparkSession, d: str) -> DataFrame:
    extra = F.array(F.lit(" long"), F.lit("new"), F.col("topic"), F.lit(" "), F.col("user_id"), F.lit("a"), F.lit("b"), F.lit("c"), F.lit("e"))
    return M.notes(spark, d).select(*ID, F.array_join(ED.merge_tags("tags", extra), "|").alias("tags"))


TAG_MERGE_SQL = NOTES + """, m AS (SELECT user_id, note_id, list_concat(tags, ['long', 'new', topic, user_id, 'a', 'b', 'c', 'e']) AS t FROM notes)
SELECT user_id, note_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i)[1:8], '|') AS tags FROM m"""


def tag_edits_q(spark: SparkSession, d: str) -> DataFrame:
    """Events edit the tags of the note with their user's number: purchases remove, all others add."""
    e = M.read(spark, d, "events").withColumn("note_id", F.col("user_id").cast("string")).drop("user_id")
    lib = M.notes(spark, d)
    tag = F.concat(F.lit("d"), (F.floor("value") % 9).cast("string"))
    edits = e.join(lib.select(*ID), "note_id").select(
        *ID, F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "remove").otherwise("add").alias("op"), tag.alias("tag")
    )
    return ED.apply_tag_edits(lib, edits).select(*ID, joined("tags"))


TAG_EDITS_SQL = NOTES + """, e AS (SELECT CAST(user_id AS VARCHAR) AS note_id, event_id AS seq, event_type = 'purchase' AS rm,
    'd' || CAST(CAST(floor(value) AS BIGINT) % 9 AS VARCHAR) AS tag FROM events),
r AS (SELECT note_id, tag, max(seq) AS r FROM e WHERE rm GROUP BY ALL),
a AS (SELECT e.note_id, e.tag, min(seq) AS a FROM e LEFT JOIN r USING (note_id, tag) WHERE NOT rm AND (r IS NULL OR seq > r) GROUP BY ALL),
cur AS (SELECT note_id, unnest(tags) AS tag, unnest(range(1, len(tags) + 1)) AS i FROM notes),
res AS (SELECT note_id, tag, CAST(i AS BIGINT) - 100 AS o FROM cur WHERE (note_id, tag) NOT IN (SELECT (note_id, tag) FROM r)
  UNION ALL SELECT a.note_id, a.tag, a.a FROM a WHERE (a.note_id, a.tag) NOT IN (SELECT (note_id, tag) FROM cur)
    OR (a.note_id, a.tag) IN (SELECT (note_id, tag) FROM r))
SELECT n.user_id, n.note_id, coalesce((SELECT string_agg(tag, '|' ORDER BY o) FROM res WHERE res.note_id = n.note_id), '') AS tags FROM notes n"""


# ---- organiser and basic mode -------------------------------------------------------------------

_RULES = (("articles", ("The ", "Der ", "La ")), ("numbers", ("1", "2")), ("long words", ("tion",)))


def tag_rules_q(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws("\n", "title", "content")
    return M.notes(spark, d).select(
        *ID, F.array_join(O.rule_tags(text, _RULES, "none"), "|").alias("tags"), O.rule_topic(text, (("t1", "Thing"), ("t2", "ung"))).alias("topic")
    )


TAG_RULES_SQL = NOTES + f"""SELECT user_id, note_id, coalesce(nullif(concat_ws('|',
  CASE WHEN contains(x, 'The ') OR contains(x, 'Der ') OR contains(x, 'La ') THEN 'articles' END,
  CASE WHEN contains(x, '1') OR contains(x, '2') THEN 'numbers' END, CASE WHEN contains(x, 'tion') THEN 'long words' END), ''), 'none') AS tags,
  CASE WHEN contains(x, 'Thing') THEN 't1' WHEN contains(x, 'ung') THEN 't2' ELSE '{K.FALLBACK_TOPIC}' END AS topic
FROM (SELECT *, title || chr(10) || content AS x FROM notes)"""


def related_notes_q(spark: SparkSession, d: str) -> DataFrame:
    return O.related_notes(M.notes(spark, d)).select(*ID, "related_id", "score", long("rank"))


_RELATED = f"""ltok AS (SELECT user_id, note_id, tok, count(*) AS tf FROM (SELECT user_id, note_id, unnest({Q.overlap("title || chr(10) || content")}) AS tok FROM notes) GROUP BY ALL),
rtok AS (SELECT DISTINCT user_id, note_id, doc_id, unnest({Q.overlap("concat_ws(' ', title, summary, array_to_string(tags, ' '))")}) AS tok FROM notes),
rel AS MATERIALIZED (SELECT * FROM (SELECT l.user_id, l.note_id, r.note_id AS related_id, CAST(sum(tf) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY l.user_id, l.note_id ORDER BY sum(tf) DESC, r.doc_id DESC) AS rank
  FROM ltok l JOIN rtok r ON r.user_id = l.user_id AND r.tok = l.tok AND r.note_id <> l.note_id
  GROUP BY l.user_id, l.note_id, r.note_id, r.doc_id HAVING sum(tf) > 1) WHERE rank <= 3)"""
RELATED_SQL = Q.with_(Q.NOTES, _RELATED) + "SELECT user_id, note_id, related_id, score, rank FROM rel"


def organise_library_q(spark: SparkSession, d: str) -> DataFrame:
    return O.organise(M.notes(spark, d)).select(
        *ID, "title_suggestion", "summary", joined("tags"), "topic",
        F.array_join(F.transform("related_notes", lambda r: F.concat(r["id"], F.lit(":"), r["reason"])), "|").alias("related"),
    )


def _mentions_sql(words: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(x, '{w}')" for w in words)


ORGANISE_SQL = Q.with_(Q.NOTES, _RELATED) + f""", rl AS (SELECT r.user_id, r.note_id,
    string_agg(r.related_id || ':和「' || n.title || '」共享主题词或使用场景。', '|' ORDER BY r.rank) AS related
  FROM rel r JOIN notes n ON n.note_id = r.related_id GROUP BY ALL)
SELECT n.user_id, n.note_id, n.title AS title_suggestion, n.summary,
  coalesce(nullif(concat_ws('|', {', '.join(f"CASE WHEN {_mentions_sql(w)} THEN '{t}' END" for t, w in K.TAG_RULES)}), ''), '{K.DEFAULT_TAG}') AS tags,
  CASE WHEN contains(x, '视频') THEN '视频素材' WHEN contains(x, '播客') THEN '播客素材' ELSE '素材库' END AS topic, coalesce(rl.related, '') AS related
FROM (SELECT *, title || chr(10) || content AS x FROM notes) n LEFT JOIN rl USING (user_id, note_id)"""


def analysis_normalise_q(spark: SparkSession, d: str) -> DataFrame:
    """Model analyses with holes: proposals for related notes include unknown ids."""
    lib, doc = M.notes(spark, d), F.col("doc_id")
    rows = lib.select(
        *ID,
        F.when(doc % 2 == 0, F.col("topic")).alias("title_suggestion"),
        F.when(doc % 3 == 0, "").otherwise(F.lit("s")).alias("summary"),
        F.transform(F.sequence(F.lit(1), (doc % 9 + 1).cast("int")), lambda i: i.cast("string")).alias("tags"),
        F.when(doc % 5 != 0, F.lit("T")).alias("topic"),
        F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.struct(F.when(i % 3 == 0, F.lit("x")).otherwise((doc + i * 20).cast("string")).alias("id"), F.when(i != 4, F.concat(F.lit("why "), i.cast("string"))).alias("reason"))).alias("related_notes"),
        F.lit(None).cast("string").alias("reasoning"),
    )
    return O.clean_analyses(rows, lib).select(*ID, "title_suggestion", "summary", joined("tags"), "topic", F.array_join(F.transform("related_notes", lambda r: F.concat_ws(":", r["id"], r["reason"])), "|").alias("related"), "reasoning")


ANALYSIS_SQL = NOTES + f""", p AS (SELECT user_id, note_id, doc_id, unnest(range(1, 10)) AS i FROM notes),
ok AS (SELECT p.user_id, p.note_id, p.i, b.note_id AS rid, row_number() OVER (PARTITION BY p.user_id, p.note_id ORDER BY p.i) AS k
  FROM p JOIN notes b ON b.user_id = p.user_id AND b.note_id = CAST(p.doc_id + p.i * 20 AS VARCHAR) WHERE p.i % 3 <> 0)
SELECT n.user_id, n.note_id, CASE WHEN doc_id % 2 = 0 THEN topic ELSE title END AS title_suggestion,
  CASE WHEN doc_id % 3 = 0 THEN coalesce(nullif(summary, ''), '{K.MISSING_SUMMARY}') ELSE 's' END AS summary,
  array_to_string(list_transform(range(1, least(doc_id % 9 + 1, 6) + 1), lambda i: CAST(i AS VARCHAR)), '|') AS tags,
  CASE WHEN doc_id % 5 <> 0 THEN 'T' ELSE 'Inbox' END AS topic,
  coalesce((SELECT string_agg(concat_ws(':', rid, CASE WHEN i <> 4 THEN 'why ' || CAST(i AS VARCHAR) END), '|' ORDER BY i) FROM ok WHERE ok.note_id = n.note_id AND k <= 5), '') AS related,
  '{K.DEFAULT_REASONING}' AS reasoning FROM notes n"""


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = M.with_scopes(M.questions(spark, d))
    lib = M.notes(spark, d)
    return q, lib, A.rank_notes(q, lib)


def note_overlap_rank_q(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d)[2].select("user_id", "question_id", "note_id", long("score"), long("position"))


_SCOPED = """sq AS (SELECT *, conv_id % 4 AS kind FROM questions),
pool AS (SELECT * FROM (SELECT q.user_id, q.question_id, q.query, n.note_id, n.doc_id, row_number() OVER (PARTITION BY q.user_id, q.question_id ORDER BY n.doc_id DESC) AS lr
  FROM sq q JOIN notes n ON n.user_id = q.user_id
  WHERE (q.kind <> 3 OR (n.doc_id - q.conv_id % 20) % 20 = 0 AND n.doc_id <= q.conv_id % 20 + 380)
    AND (q.kind NOT IN (1, 2) OR n.topic IN ('en', 'de')) AND (q.kind <> 2 OR list_has_any(n.tags, ['d1', 'long']))) WHERE lr <= 20)"""
_RANKED = f"""{Q.NOTES}, {Q.QUESTIONS}, {_SCOPED},
qt AS (SELECT user_id, question_id, unnest({Q.overlap('query')}) AS tok FROM questions),
nt AS (SELECT DISTINCT user_id, note_id, unnest({Q.overlap("concat_ws(' ', title, summary, array_to_string(tags, ' '), content)")}) AS tok FROM notes),
sc AS (SELECT p.user_id, p.question_id, p.note_id, count(*) AS s FROM pool p JOIN qt ON qt.question_id = p.question_id
  JOIN nt ON nt.user_id = p.user_id AND nt.note_id = p.note_id AND nt.tok = qt.tok GROUP BY ALL),
ranked AS MATERIALIZED (SELECT * FROM (SELECT p.user_id, p.question_id, p.note_id, coalesce(s, 0) AS score,
    row_number() OVER (PARTITION BY p.user_id, p.question_id ORDER BY coalesce(s, 0) DESC, lr) AS position
  FROM pool p LEFT JOIN sc USING (user_id, question_id, note_id)) WHERE position <= 8)"""
OVERLAP_RANK_SQL = Q.with_(_RANKED) + "SELECT user_id, question_id, note_id, score, position FROM ranked"


def basic_answer_q(spark: SparkSession, d: str) -> DataFrame:
    q, lib, ranked = _ranked(spark, d)
    return A.basic_answers(q.select("user_id", "question_id"), ranked, lib).select(
        "user_id", "question_id", "answer", joined("source_ids", ","),
        F.coalesce(F.array_join(F.transform("citations", lambda c: F.concat(c["quote"], F.lit("@"), c["source_url"])), "|"), F.lit("")).alias("cited"),
        "insufficient",
    )


BASIC_ANSWER_SQL = Q.with_(_RANKED) + f""", used AS (SELECT r.*, row_number() OVER (PARTITION BY r.question_id ORDER BY position) AS place, n.title, n.summary, n.content, n.source
  FROM ranked r JOIN notes n ON n.note_id = r.note_id WHERE score > 1),
agg AS (SELECT question_id, string_agg('从「' || title || '」看：' || coalesce(nullif(summary, ''), {Q.summary('content')}), chr(10) || chr(10) ORDER BY place) AS answer,
  string_agg(note_id, ',' ORDER BY place) AS ids,
  string_agg(left({Q.trim('content')}, 220) || '@' || CASE WHEN regexp_matches(source, '^https?://') THEN source ELSE '' END, '|' ORDER BY place) AS cited
  FROM used WHERE place <= 3 GROUP BY ALL)
SELECT q.user_id, q.question_id, coalesce(a.answer, '{K.BASIC_NO_ANSWER}') AS answer, coalesce(ids, '') AS source_ids, coalesce(cited, '') AS cited,
  a.answer IS NULL AS insufficient FROM questions q LEFT JOIN agg a USING (question_id)"""


def context_budget_q(spark: SparkSession, d: str) -> DataFrame:
    _, lib, ranked = _ranked(spark, d)
    rows = ranked.join(lib.select(*ID, "content"), list(ID))
    return A.context_budget(rows).select("user_id", "question_id", "note_id", long("position"), "chars", F.sha2("excerpt", 256).alias("excerpt_hash"))


BUDGET_SQL = Q.with_(_RANKED) + """, w AS (SELECT r.*, n.content, least(length(n.content), 5000) AS want FROM ranked r JOIN notes n ON n.note_id = r.note_id),
b AS (SELECT *, least(want, greatest(0, 20000 - coalesce(sum(want) OVER (PARTITION BY question_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS chars FROM w)
SELECT user_id, question_id, note_id, position, CAST(chars AS BIGINT) AS chars, sha256(left(content, CAST(chars AS BIGINT))) AS excerpt_hash FROM b"""


def generated_document_q(spark: SparkSession, d: str) -> DataFrame:
    conv = F.col("conv_id")
    kinds = F.array(*[F.lit(t) for t in (*K.OUTPUT_TITLES, "other")])
    ids = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: (conv % M.USERS + i * M.USERS * 2).cast("string"))
    requests = M.turns(spark, d).select("user_id", "conv_id").distinct().select(
        "user_id",
        conv.cast("string").alias("request_id"),
        F.get(kinds, (conv % 7).cast("int")).alias("output_type"),
        F.when(conv % 2 == 1, ids).otherwise(F.array().cast("array<string>")).alias("scope_note_ids"),
    )
    return O.generated_documents(requests, M.notes(spark, d)).select("user_id", "request_id", "output_type", "markdown", F.size("citations").cast("long").alias("n_citations"))


_KINDS = "[" + ", ".join(f"'{t}'" for t in (*K.OUTPUT_TITLES, "other")) + "]"
_KIND_TITLES = "[" + ", ".join(f"'{t}'" for t in (*K.OUTPUT_TITLES.values(), K.OUTPUT_DEFAULT_TITLE)) + "]"
GENERATED_SQL = NOTES + f""", req AS (SELECT DISTINCT 'src' || CAST(conv_id % 20 AS VARCHAR) AS user_id, conv_id, {_KINDS}[conv_id % 7 + 1] AS output_type FROM conversations),
pool AS (SELECT * FROM (SELECT r.*, n.note_id, n.title, n.summary, n.source, n.doc_id, concat_ws(' ', n.title, n.summary, array_to_string(n.tags, ' '), n.content) AS txt,
    row_number() OVER (PARTITION BY r.conv_id ORDER BY n.doc_id DESC) AS lr
  FROM req r JOIN notes n ON n.user_id = r.user_id WHERE r.conv_id % 2 = 0 OR ((n.doc_id - r.conv_id % 20) % 40 = 0 AND n.doc_id <= r.conv_id % 20 + 760)) WHERE lr <= 20),
s AS (SELECT *, len(list_filter({Q.overlap('output_type')}, lambda t: list_contains({Q.overlap('txt')}, t))) AS score FROM pool),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, lr) AS position FROM s),
g AS (SELECT conv_id, count(*) AS n, string_agg(CAST(position AS VARCHAR) || '. ' || title || chr(10) || '   - ' || summary, chr(10) ORDER BY position) AS a,
   string_agg('- ' || title || CASE WHEN source <> '' THEN '：' || source ELSE '' END, chr(10) ORDER BY position) AS b FROM k WHERE position <= 8 GROUP BY ALL)
SELECT r.user_id, CAST(r.conv_id AS VARCHAR) AS request_id, r.output_type, coalesce(n, 0) AS n_citations,
  '# ' || {_KIND_TITLES}[r.conv_id % 7 + 1] || chr(10) || chr(10) || '{K.OUTPUT_SOURCES_HEADING}' || chr(10) || coalesce(a, '') || chr(10) || chr(10)
   || '{K.OUTPUT_CITATIONS_HEADING}' || chr(10) || coalesce(b, '') || chr(10) AS markdown FROM req r LEFT JOIN g USING (conv_id)"""


def quote_locate_q(spark: SparkSession, d: str) -> DataFrame:
    notes = M.spread(M.read(spark, d, "documents")).select(F.col("doc_id").alias("note_id"), F.col("text").alias("content"))
    quotes = M.read(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return QT.find_quotes(notes, quotes).select("quote_id", "note_id", long("start"), long("stop"))


QUOTE_LOCATE_SQL = """SELECT item_id AS quote_id, doc_id AS note_id, instr(d.text, b.text) - 1 AS start, instr(d.text, b.text) - 1 + length(b.text) AS stop
FROM documents d JOIN benchmark b ON contains(d.text, b.text)"""


# ---- imports ------------------------------------------------------------------------------------

AT = "2024-01-08T00:00:00.000Z"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page twice: as it is, and in the platform layout with its own body node."""
    page = M.spread(M.read(spark, d, "pages"))
    html = F.col("html")
    platform = F.regexp_replace(F.regexp_replace(html, "<article>", '<div id="js_content">'), "</article>", "</div>")
    layouts = F.array(F.struct(F.lit("a").alias("v"), html.alias("html")), F.struct(F.lit("p").alias("v"), platform.alias("html")))
    return page.select("page_id", "url", F.explode(layouts).alias("x")).select(
        F.concat(F.col("x.v"), F.col("page_id").cast("string")).alias("import_id"), F.lit("u").alias("user_id"), "url", "x.html"
    )


def page_import_q(spark: SparkSession, d: str) -> DataFrame:
    return WEB.import_pages(_pages(spark, d), F.lit(AT)).select(
        "import_id", "status", "source_type", "platform", "title", "source_url", "markdown", "extracted_text", joined("warnings")
    )


def _steps(x: str, steps) -> str:
    for pattern, replacement in steps:
        rep = replacement.replace("'", "''").replace("\n", "' || chr(10) || '")
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{rep}', 'g')"
    return x


def _text_sql(x: str) -> str:
    return Q.trim(Q.squash(_steps(f"regexp_replace({_steps(x, K.HTML_NOISE)}, '<[^>]*>', ' ', 'g')", K.HTML_TO_MARKDOWN[15:21])))


def _match(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern.replace(chr(39), chr(39) * 2)}')"


_HOST = r"regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '^www\.', '')"
_PLATFORM_SQL = "CASE " + " ".join(
    f"WHEN {' OR '.join(f'contains(url, {Q.lit(p)})' for p in parts)} THEN '{name}'" for name, parts in K.PLATFORM_RULES
) + f" ELSE {_HOST} END"
_ROUTE_SQL = f"CASE WHEN {_match('url', K.VIDEO_URL)} THEN 'video' WHEN {_match('url', K.AUDIO_URL)} OR {_match('url', K.PODCAST_URL)} THEN 'podcast' ELSE 'article' END"
_PLAIN = Q.trim(Q.squash("regexp_replace(regexp_replace(md, '(?s)```.*?```', '', 'g'), '[#>*_\\-\\[\\]()`]', '', 'g')"))
_TRACE_SQL = f"""'# ' || title || chr(10) || chr(10) || '{K.TRACE_HEADING}' || chr(10) || chr(10) || '{K.TRACE_PLATFORM}' || shown || chr(10) || '{K.TRACE_ORIGIN}' || url
  || chr(10) || '{K.TRACE_METHOD}' || method || chr(10) || '{K.TRACE_RELIABILITY}{K.REL_LINK}' || chr(10) || '{K.TRACE_TIME}{AT}' || chr(10) || chr(10)"""
_IMPORTS = f"""pg AS (SELECT v || CAST(page_id AS VARCHAR) AS import_id, v, url, html, {_ROUTE_SQL} AS route, {_PLATFORM_SQL} AS platform,
    {_text_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
    regexp_extract(html, '(?is)<article(?:[\\t\\n\\f\\r ][^>]*)?>(.*)</article[\\t\\n\\f\\r ]*>', 1) AS art,
    coalesce(nullif(regexp_extract(html, '(?is)<body(?:[\\t\\n\\f\\r ][^>]*)?>(.*)</body[\\t\\n\\f\\r ]*>', 1), ''),
      regexp_extract(html, '(?is)<body(?:[\\t\\n\\f\\r ][^>]*)?>(.*)$', 1)) AS bod
  FROM pages, (VALUES ('a'), ('p')) t(v)),
tx AS (SELECT *, {Q.trim(_steps(_steps("art", K.HTML_NOISE), K.HTML_TO_MARKDOWN))} AS md,
    left({_text_sql("CASE v WHEN 'a' THEN art ELSE bod END")}, {K.PODCAST_DESCRIPTION_LIMIT}) AS about FROM pg),
st AS (SELECT *, CASE WHEN route <> 'article' THEN NULL WHEN v = 'p' AND length(md) < 40 THEN '{K.WARN_SHORT_WECHAT}'
    WHEN v = 'a' AND length(md) < 80 THEN '{K.WARN_SHORT_ARTICLE}' END AS short FROM tx),
im AS (SELECT *, CASE WHEN v = 'p' AND route = 'article' AND short IS NULL THEN '{K.WECHAT_PLATFORM}' ELSE platform END AS shown,
   CASE WHEN short IS NOT NULL THEN '{K.PENDING_METHOD}' WHEN route = 'podcast' THEN '{K.PODCAST_PAGE_METHOD}' WHEN v = 'p' THEN '{K.WECHAT_METHOD}'
     ELSE '{K.ARTICLE_METHOD}' END AS method FROM st),
imports AS MATERIALIZED (SELECT import_id, CASE WHEN short IS NOT NULL THEN 'needs-action' ELSE 'ready' END AS status,
  CASE route WHEN 'podcast' THEN 'podcast' ELSE 'article' END AS source_type, shown AS platform, title, url AS source_url,
  {_TRACE_SQL} || {Q.trim(f'''CASE WHEN short IS NOT NULL THEN '> ' || short
    WHEN route = 'podcast' THEN '{K.PODCAST_INTRO}' || chr(10) || chr(10) || coalesce(nullif(about, ''), '{K.PODCAST_NO_INTRO}') || chr(10) || chr(10) || '{K.PODCAST_NO_AUDIO_NEXT}'
    WHEN v = 'p' THEN '## 文章信息' || chr(10) || '- 平台：{K.WECHAT_PLATFORM}' || chr(10) || '- 链接：' || url || chr(10) || chr(10) || '## 正文' || chr(10) || chr(10) || md ELSE md END''')} || chr(10) AS markdown,
  CASE WHEN short IS NOT NULL THEN '' WHEN route = 'podcast' THEN about ELSE {_PLAIN} END AS extracted_text,
  CASE WHEN short IS NOT NULL THEN short WHEN route = 'podcast' THEN '{K.PODCAST_WARN_NO_AUDIO}' ELSE '' END AS warnings FROM im)"""
PAGE_IMPORT_SQL = Q.with_(_IMPORTS) + "SELECT * FROM imports"


#: Kinds of imports that the pages are turned into, each with what must come of it: status, source_type, warning.
_BRANCHES = (
    ("https://cdn.example.org/{i}/talk%20{i}.mp3", "{h}", "needs-action", "podcast", "未配置 AI Key，未执行语音转写。"),
    ("https://p.example.org/feed/{i}", '<?xml version="1.0"?><rss><channel><title>C</title><item><title>E{i}</title><description>d</description><enclosure url="https://cdn.example.org/{i}.mp3" length="1"/></item></channel></rss>', "needs-action", "podcast", "已识别播客音频，但未配置转写 API Key。"),
    ("https://p.example.org/feed/{i}", "<rss><channel><title>C</title></channel></rss>", "needs-action", "podcast", "RSS 中没有找到节目单集。"),
    ("https://youtu.be/{i}", "{h}", "needs-action", "video", "未找到字幕。"),
    ("http://10.0.0.{b}/{i}", "{h}", "failed", "article", "该链接指向受保护的网络地址。"),
    ("https://me:pw@a.example.org/{i}", "{h}", "failed", "article", "链接不能包含账号凭据。"),
    ("http://localhost/{i}", "{h}", "failed", "article", "该链接地址不可访问。"),
    ("not a link {i}", "{h}", "failed", "article", "请输入有效链接。"),
    ("https://mp.weixin.qq.com/s/{i}", "<html><title>t</title><body>x</body></html>", "needs-action", "article", "公众号页面没有暴露正文节点，可能需要登录或被平台限制。"),
    ("https://mp.weixin.qq.com/s/{i}", '<html><span class="rich_media_meta rich_media_meta_nickname">A{i}</span><section id="js_content">' + "<section><p>some words of text </p></section>" * 3 + "</section><p>noise</p></html>", "ready", "article", "作者：A{i}"),
)


def import_branches_q(spark: SparkSession, d: str) -> DataFrame:
    """Every page through every branch of the import: audio, feeds, video, refused urls, platform layouts."""
    i = F.col("page_id").cast("string")
    fill = lambda t: F.replace(F.replace(F.replace(F.lit(t), F.lit("{i}"), i), F.lit("{b}"), (F.col("page_id") % 250).cast("string")), F.lit("{h}"), F.col("html"))
    rows = F.array(*[F.struct(F.lit(k).alias("branch"), fill(u).alias("url"), fill(b).alias("html")) for k, (u, b, *_) in enumerate(_BRANCHES)])
    pages = M.spread(M.read(spark, d, "pages")).select(i.alias("page"), F.explode(rows).alias("x"))
    pages = pages.select(F.concat_ws("-", "page", "x.branch").alias("import_id"), F.lit("u").alias("user_id"), "x.url", "x.html")
    return WEB.import_pages(pages, F.lit(AT)).select("import_id", "status", "source_type", joined("warnings"), F.contains("markdown", F.lit("noise")).alias("noise"))


IMPORT_BRANCHES_SQL = "".join(
    f"{'UNION ALL ' if k else ''}SELECT page_id || '-{k}' AS import_id, '{status}' AS status, '{kind}' AS source_type, replace('{warning}', '{{i}}', page_id::VARCHAR) AS warnings, false AS noise FROM pages\n"
    for k, (_, _, status, kind, warning) in enumerate(_BRANCHES)
)


def import_notes_q(spark: SparkSession, d: str) -> DataFrame:
    imports = WEB.import_pages(_pages(spark, d), F.lit(AT))
    return L.imports_to_notes(imports, M.now()).select("note_id", "title", "summary", joined("tags"), "topic", "source")


IMPORT_NOTES_SQL = Q.with_(_IMPORTS) + f"""SELECT import_id AS note_id, title, left(extracted_text, 96) AS summary,
  CASE source_type WHEN 'podcast' THEN '播客' ELSE '文章' END || '|' || platform || '|{K.EXTERNAL_TAG}' AS tags,
  CASE source_type WHEN 'podcast' THEN '播客素材' ELSE '文章素材' END AS topic, source_url AS source FROM imports"""


def import_outcomes_q(spark: SparkSession, d: str) -> DataFrame:
    imports = WEB.import_pages(_pages(spark, d), F.lit(AT))
    return imports.groupBy("source_type", "platform", "status").agg(F.count(F.lit(1)).alias("n"))


IMPORT_OUTCOMES_SQL = Q.with_(_IMPORTS) + "SELECT source_type, platform, status, count(*) AS n FROM imports GROUP BY ALL"


def platform_route_q(spark: SparkSession, d: str) -> DataFrame:
    variants = ("{u}", "https://www.youtube.com/watch?v={i}", "https://b23.tv/{i}", "https://cdn.example.com/{i}.mp3?x=1", "https://mp.weixin.qq.com/s/{i}", "https://podcasts.apple.com/{i}")
    i, u = F.col("page_id").cast("string"), F.col("url")
    urls = F.array(*[u if v == "{u}" else F.concat(F.lit(v.split("{i}")[0]), i, F.lit(v.split("{i}")[1])) for v in variants])
    rows = M.read(spark, d, "pages").select("page_id", F.posexplode(urls).alias("v", "url"))
    return rows.select("page_id", long("v"), U.media_route("url").alias("route"), U.platform_of("url").alias("platform"),
                       U.is_short_link("url").alias("short_link"), U.pasted_platform_of("url").alias("pasted"))


PLATFORM_ROUTE_SQL = f"""WITH u AS (SELECT page_id, unnest([0, 1, 2, 3, 4, 5]) AS v, unnest([url, 'https://www.youtube.com/watch?v=' || page_id, 'https://b23.tv/' || page_id,
  'https://cdn.example.com/' || page_id || '.mp3?x=1', 'https://mp.weixin.qq.com/s/' || page_id, 'https://podcasts.apple.com/' || page_id]) AS url FROM pages)
SELECT page_id, CAST(v AS BIGINT) AS v, {_ROUTE_SQL} AS route, {_PLATFORM_SQL} AS platform, v = 2 AS short_link,
  CASE v WHEN 2 THEN 'B站' WHEN 4 THEN '微信公众号' WHEN 5 THEN '播客' ELSE CASE WHEN {_match('url', '(?i)' + K.PASTED_PLATFORM_RULES[3][1])} THEN '播客' ELSE '外部链接' END END AS pasted FROM u"""

_HYGIENE = (
    ("{u}", "ok"), ("ftp://{h}/x", "bad_scheme"), ("https://me:pw@{h}/", "credentials"), ("http://localhost:{i}/", "blocked_host"),
    ("http://{h}.local/", "blocked_host"), ("http://10.0.{b}.7/", "private_address"), ("http://8.8.{b}.8:80/", "ok"), ("http://[fd00::{b}]/", "private_address"),
    ("http://[::ffff:127.0.0.{b}]/", "private_address"), ("http://0x7f.{b}/", "private_address"), ("{h}", "bad_format"), ("https://[2606:4700::{b}]/", "ok"),
)


def url_hygiene_q(spark: SparkSession, d: str) -> DataFrame:
    page = M.read(spark, d, "pages")
    parts = {"u": F.col("url"), "h": U.host_of("url"), "i": F.col("page_id").cast("string"), "b": (F.col("page_id") % 250).cast("string")}

    def fill(template: str) -> Column:
        return F.concat(*[parts[p[1:-1]] if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w\})", template) if p])

    rows = page.select("page_id", F.posexplode(F.array(*[fill(t) for t, _ in _HYGIENE])).alias("v", "url"))
    return rows.select("page_id", long("v"), "url", U.url_verdict("url").alias("verdict"))


def _hygiene_sql(template: str) -> str:
    parts = {"u": "url", "h": "regexp_extract(url, '^https?://([^/?#:]*)', 1)", "i": "CAST(page_id AS VARCHAR)", "b": "CAST(page_id % 250 AS VARCHAR)"}
    return " || ".join(parts[p[1:-1]] if p.startswith("{") else f"'{p}'" for p in re.split(r"(\{\w\})", template) if p)


URL_HYGIENE_SQL = f"""SELECT page_id, CAST(unnest(range(0, {len(_HYGIENE)})) AS BIGINT) AS v, unnest([{', '.join(_hygiene_sql(t) for t, _ in _HYGIENE)}]) AS url,
  unnest([{', '.join(f"'{v}'" for _, v in _HYGIENE)}]) AS verdict FROM pages"""


def url_parts_q(spark: SparkSession, d: str) -> DataFrame:
    pasted = F.concat(F.lit("look: "), F.col("url"), F.lit(" 分享，谢谢"))
    return M.read(spark, d, "pages").select("page_id", U.embedded_url(pasted).alias("found"), U.host_of("url").alias("host"), U.file_name_from_url("url").alias("file"))


URL_PARTS_SQL = r"""SELECT page_id, url AS found, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host,
  regexp_extract(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1) AS file FROM pages"""


def _traced(spark: SparkSession, d: str) -> DataFrame:
    """Notes whose bodies carry provenance in different ways."""
    doc = F.col("doc_id")
    url = F.concat(F.lit("https://"), F.col("user_id"), F.lit(".example.org/p"))
    block = P.source_markdown(F.col("title"), F.col("content"), F.col("user_id"), url, F.when(doc % 8 == 0, F.lit("自动字幕")).otherwise(F.lit(K.ARTICLE_METHOD)), F.lit("article"), F.lit(AT))
    plain = F.concat(F.lit(K.TRACE_PLAIN), url, F.lit("\n"), "content")
    return M.notes(spark, d).withColumn("content", F.when(doc % 4 == 0, block).when(doc % 4 == 1, plain).otherwise(F.col("content")))


def provenance_mix_q(spark: SparkSession, d: str) -> DataFrame:
    return (
        _traced(spark, d)
        .select("user_id", P.parse_trace("content", "source").alias("t"), (P.note_source("content", "source") != "").alias("has_source"))
        .groupBy("user_id", "t.platform", "t.import_method", "t.reliability", (F.col("t.source_url") != "").alias("has_url"), "has_source")
        .agg(F.count(F.lit(1)).alias("n"))
    )


PROVENANCE_SQL = NOTES + f"""SELECT user_id, platform, import_method, reliability, has_url, has_source, count(*) AS n FROM (SELECT user_id,
  CASE WHEN doc_id % 4 = 0 THEN user_id ELSE coalesce(nullif(source, ''), '{K.UNKNOWN_SOURCE}') END AS platform,
  CASE WHEN doc_id % 8 = 0 THEN '自动字幕' WHEN doc_id % 4 = 0 THEN '{K.ARTICLE_METHOD}' ELSE '{K.MANUAL_METHOD}' END AS import_method,
  CASE WHEN doc_id % 8 = 0 THEN '{K.REL_AUTO_CAPTION}' WHEN doc_id % 4 IN (0, 1) THEN '{K.REL_LINK}' ELSE coalesce(nullif(source, ''), '{K.MANUAL_METHOD}') END AS reliability,
  doc_id % 4 = 0 OR regexp_matches(source, '^https?://') AS has_url, doc_id % 4 IN (0, 1) OR source <> '' AS has_source FROM notes) GROUP BY ALL"""


def _vtt() -> Column:
    """A caption file from a text: numbered cues, every line once tagged and once plain."""
    lines = F.split("content", "\n")
    cue = F.transform(
        lines,
        lambda x, i: F.concat(i.cast("string"), F.lit("\n00:00:01.000 --> 00:00:02.000\n<c.a>"), x, F.lit("</c>\r\n"), x, F.lit("\n")),
    )
    return F.concat(F.lit("WEBVTT\n\nNOTE made here\n\n"), F.array_join(cue, "\n"))


def caption_transcript_q(spark: SparkSession, d: str) -> DataFrame:
    return M.notes(spark, d).withColumn("vtt", _vtt()).select(*ID, CA.transcript_of("vtt").alias("transcript"))


CAPTION_SQL = f"""WITH l AS (SELECT source AS user_id, CAST(doc_id AS VARCHAR) AS note_id,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: {Q.trim('x')}), lambda x: x <> '' AND x <> 'WEBVTT' AND NOT contains(x, '-->')
    AND NOT regexp_matches(x, '^[0-9]+$') AND NOT starts_with(x, 'NOTE')) AS s,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: {Q.trim('x')}), lambda x: x <> '') AS tagged FROM documents),
c AS (SELECT user_id, note_id, list_filter(list_transform(tagged, lambda x: {Q.trim("regexp_replace(x, '<[^>]+>', '', 'g')")}), lambda x: x <> '') AS k FROM l)
SELECT user_id, note_id, coalesce(array_to_string(list_filter(k, lambda x, i: i = 1 OR x <> k[i - 1]), chr(10)), '') AS transcript FROM c"""


def _caption_table(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    lang = F.get(F.array(*[F.lit(x) for x in ("en", "zh", "de", "zh-CN", "en", "zh-Hans", "fr")]), (n % 7).cast("int"))
    return M.notes(spark, d).select(
        (F.floor(n / 4)).cast("string").alias("media_id"), lang.alias("lang"), F.when(n % 2 == 0, "manual").otherwise("automatic").alias("kind"),
        F.when(n % 5 == 0, "srv3").otherwise("vtt").alias("ext"), n.alias("pos"), F.col("content").alias("text"),
    )


def best_caption_q(spark: SparkSession, d: str) -> DataFrame:
    return CA.best_captions(_caption_table(spark, d)).select("media_id", "lang", "kind", "pos")


BEST_CAPTION_SQL = """WITH c AS (SELECT doc_id // 4 AS m, ['en', 'zh', 'de', 'zh-CN', 'en', 'zh-Hans', 'fr'][doc_id % 7 + 1] AS lang,
  CASE WHEN doc_id % 2 = 0 THEN 'manual' ELSE 'automatic' END AS kind, doc_id AS pos FROM documents WHERE doc_id % 5 <> 0)
SELECT CAST(m AS VARCHAR) AS media_id, lang, kind, pos FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY
  list_position(['zh-Hans', 'zh-CN', 'zh', 'en'], lang), kind = 'automatic', pos) AS k FROM c WHERE lang IN ('zh-Hans', 'zh-CN', 'zh', 'en')) WHERE k = 1"""


def video_captions_q(spark: SparkSession, d: str) -> DataFrame:
    table = _caption_table(spark, d)
    media = table.select("media_id").distinct().select(
        F.col("media_id").alias("import_id"), F.lit("u").alias("user_id"), F.concat(F.lit("https://youtu.be/"), "media_id").alias("url"),
        F.lit("").alias("title"), F.lit("").alias("uploader"),
    )
    return CA.caption_imports(media, table, F.lit(AT)).select("import_id", "status", "platform", "title", F.length("extracted_text").cast("long").alias("n_chars"), P.parse_trace("markdown", "platform")["reliability"].alias("reliability"))


VIDEO_CAPTIONS_SQL = f"""WITH c AS (SELECT doc_id // 4 AS m, text, ['en', 'zh', 'de', 'zh-CN', 'en', 'zh-Hans', 'fr'][doc_id % 7 + 1] AS lang, doc_id
  FROM documents WHERE doc_id % 5 <> 0),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY list_position(['zh-Hans', 'zh-CN', 'zh', 'en'], lang), doc_id % 2, doc_id) AS k FROM c
  WHERE lang IN ('zh-Hans', 'zh-CN', 'zh', 'en')) WHERE k = 1),
l AS (SELECT m, list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {Q.trim('x')}), lambda x: x <> '' AND x <> 'WEBVTT'
    AND NOT contains(x, '-->') AND NOT regexp_matches(x, '^[0-9]+$') AND NOT starts_with(x, 'NOTE')),
    lambda x: {Q.trim("regexp_replace(x, '<[^>]+>', '', 'g')")}), lambda x: x <> '') AS s FROM b),
t AS (SELECT m, array_to_string(list_filter(s, lambda x, i: i = 1 OR x <> s[i - 1]), chr(10)) AS x FROM l)
SELECT CAST(a.m AS VARCHAR) AS import_id, CASE WHEN coalesce(x, '') <> '' THEN 'ready' ELSE 'needs-action' END AS status, 'YouTube' AS platform,
  'YouTube{K.VIDEO_TITLE_SUFFIX}' AS title, length(coalesce(x, '')) AS n_chars, '{K.REL_LINK}' AS reliability
FROM (SELECT DISTINCT doc_id // 4 AS m FROM documents) a LEFT JOIN t ON t.m = a.m"""


def _xml(c: str) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def _feeds(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a feed: its lines are the items."""
    items = F.transform(
        F.split(_xml("content"), "\n"),
        lambda x, i: F.concat(
            F.lit("<item><title>Part "), i.cast("string"), F.lit("</title><description>"), x, F.lit("</description>"),
            F.when(i % 2 == 0, F.lit('<enclosure url="https://cdn.example.org/a.mp3" length="1"/>')).otherwise(F.lit("<link>https://l.example.org/</link>")),
            F.lit("</item>"),
        ),
    )
    xml = F.concat(F.lit('<rss version="2.0"><channel><title>'), _xml("title"), F.lit("</title>"), F.array_join(items, ""), F.lit("</channel></rss>"))
    return M.notes(spark, d).select(
        F.col("note_id").alias("import_id"), "user_id", F.concat(F.lit("https://f.example.org/"), "note_id", F.lit("/feed.xml")).alias("url"), xml.alias("xml")
    )


def feed_items_q(spark: SparkSession, d: str) -> DataFrame:
    return FE.feed_items(_feeds(spark, d)).select("import_id", "channel", long("pos"), "title", X.trim_ws(X.squash_ws("description")).alias("description"), "audio")


FEED_ITEMS_SQL = NOTES + f""", i AS (SELECT note_id, title, string_split(content, chr(10)) AS ls FROM notes),
u AS (SELECT note_id, title, unnest(ls) AS l, unnest(range(0, len(ls))) AS pos FROM i)
SELECT note_id AS import_id, {Q.trim(Q.squash('title'))} AS channel, pos, 'Part ' || CAST(pos AS VARCHAR) AS title, {Q.trim(Q.squash('l'))} AS description,
  CASE WHEN pos % 2 = 0 THEN 'https://cdn.example.org/a.mp3' ELSE 'https://l.example.org/' END AS audio FROM u"""


def feed_import_q(spark: SparkSession, d: str) -> DataFrame:
    return FE.feed_imports(_feeds(spark, d), F.lit(AT)).select("import_id", "status", "platform", "title", "extracted_text", joined("warnings"))


FEED_IMPORT_SQL = NOTES + f""", f AS (SELECT note_id, {Q.trim(_steps(_steps(Q.squash("string_split(content, chr(10))[1]"), K.HTML_NOISE), K.HTML_TO_MARKDOWN))} AS md FROM notes)
SELECT note_id AS import_id, 'needs-action' AS status, 'f.example.org' AS platform, 'Part 0' AS title, {_PLAIN} AS extracted_text, '{K.WARN_FEED_AUDIO}' AS warnings FROM f"""


# ---- vaults, json, uploads ----------------------------------------------------------------------


def front_matter_roundtrip_q(spark: SparkSession, d: str) -> DataFrame:
    files = _bodies(spark, d).withColumn("content", F.col("body")).select(*ID, V.to_markdown().alias("md"))
    return files.select(*ID, V.note_fields("md", F.lit("f.md")).alias("n")).select(
        *ID, "n.title", "n.summary", F.array_join("n.tags", "|").alias("tags"), "n.topic", "n.source", "n.created_at",
        F.array_join("n.related_note_ids", "|").alias("related"), X.content_hash("n.content").alias("hash"),
    )


def _unquoted(x: str) -> str:
    return f"""regexp_replace(trim('"' || replace({x}, '"', '\\"') || '"'), '^["'']|["'']$', '', 'g')"""


FRONT_MATTER_SQL = Q.with_(_BODIES) + f"""SELECT user_id, note_id, {_unquoted('title')} AS title, {_unquoted('summary')} AS summary, array_to_string(tags, '|') AS tags, topic,
  'f.md' AS source, strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z') AS created_at, array_to_string(related_note_ids, '|') AS related,
  sha256({Q.trim('body')}) AS hash FROM bodies"""


def vault_export_q(spark: SparkSession, d: str) -> DataFrame:
    return V.vault_files(M.notes(spark, d)).select(*ID, "file_name", F.sha2("markdown", 256).alias("hash"))


_ESC = """'"' || replace({x}, '"', '\\"') || '"'"""
_ESC_LIST = "'[' || coalesce(array_to_string(list_transform({x}, lambda t: '\"' || t || '\"'), ', '), '') || ']'"
VAULT_SQL = NOTES + f""", f AS (SELECT *, coalesce(nullif(left(regexp_replace(title, '[\\\\/:*?"<>|]', '-', 'g'), 60), ''), 'note') AS stem FROM notes)
SELECT user_id, note_id, stem || CASE WHEN count(*) OVER (PARTITION BY user_id, stem) > 1 THEN '-' || note_id ELSE '' END || '.md' AS file_name,
  sha256(concat_ws(chr(10), '---', 'title: ' || {_ESC.format(x='title')}, 'summary: ' || {_ESC.format(x='summary')}, 'tags: ' || {_ESC_LIST.format(x='tags')},
    'topic: ' || {_ESC.format(x='topic')}, 'source: ' || {_ESC.format(x='source')}, 'createdAt: ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z'),
    'updatedAt: ' || strftime(updated_at, '%Y-%m-%dT%H:%M:%S.000Z'), 'relatedNoteIds: ' || {_ESC_LIST.format(x='related_note_ids')}, '---', '', {Q.trim('content')}, '')) AS hash FROM f"""


def json_library_q(spark: SparkSession, d: str) -> DataFrame:
    """Notes written as JSON rows with missing fields and read back with defaults."""
    doc = F.col("doc_id")
    row = F.struct(
        F.when(doc % 9 != 0, F.col("note_id")).alias("id"), F.when(doc % 2 == 0, F.col("title")).alias("title"), "content",
        F.when(doc % 3 == 0, F.col("tags")).alias("tags"), F.when(doc % 4 == 0, F.col("topic")).alias("topic"),
        F.lit("2024-01-01T00:00:00.000Z").alias("createdAt"), F.when(doc % 5 == 0, F.lit("2024-02-01T00:00:00.000Z")).alias("updatedAt"),
    )
    raw = M.notes(spark, d).select(F.from_json(F.to_json(row), L.JSON_SCHEMA).alias("j")).select("j.*")
    return L.fill_json_rows(raw).select("note_id", "title", joined("tags"), "topic", "source", "created_at", "updated_at", X.content_hash("content").alias("hash"))


JSON_SQL = NOTES + f"""SELECT note_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(nullif(title, ''), '{K.UNTITLED_MARKDOWN}') ELSE '{K.UNTITLED_MARKDOWN}' END AS title,
  CASE WHEN doc_id % 3 = 0 THEN array_to_string(tags, '|') ELSE '' END AS tags, CASE WHEN doc_id % 4 = 0 THEN topic ELSE 'Inbox' END AS topic, '{K.LOCAL_SOURCE}' AS source,
  '2024-01-01T00:00:00.000Z' AS created_at, CASE WHEN doc_id % 5 = 0 THEN '2024-02-01T00:00:00.000Z' ELSE '2024-01-01T00:00:00.000Z' END AS updated_at,
  sha256(content) AS hash FROM notes WHERE doc_id % 9 <> 0"""

_SIGNATURES = (
    ("FFD8FFE0", "image"), ("89504E470D0A1A0A", "image"), ("474946383961", "image"), ("524946460000000057454250", "image"), ("494433", "media"), ("FFFB", "media"),
    ("524946460000000057415645", "media"), ("4F676753", "media"), ("664C6143", "media"), ("0000001866747970", "media"), ("1A45DFA3", "media"), ("25504446", ""), ("FF00", ""),
)


def upload_kinds_q(spark: SparkSession, d: str) -> DataFrame:
    """Texts behind the first bytes of known file types."""
    doc = F.col("doc_id")
    heads = F.array(*[F.lit(h) for h, _ in _SIGNATURES])
    data = F.concat(F.unhex(F.get(heads, (doc % len(_SIGNATURES)).cast("int"))), F.encode("content", "UTF-8"))
    rows = M.notes(spark, d).select(*ID, UP.file_kind(data).alias("kind"), F.when(doc % 2 == 0, "image").otherwise("media").alias("wanted"))
    return UP.check_uploads(rows)


UPLOADS_SQL = f"""WITH k AS (SELECT source AS user_id, CAST(doc_id AS VARCHAR) AS note_id,
  CASE WHEN strlen(text) + [{', '.join(str(len(h) // 2) for h, _ in _SIGNATURES)}][doc_id % {len(_SIGNATURES)} + 1] < 12 THEN '' ELSE [{', '.join(f"'{v}'" for _, v in _SIGNATURES)}][doc_id % {len(_SIGNATURES)} + 1] END AS kind,
  CASE WHEN doc_id % 2 = 0 THEN 'image' ELSE 'media' END AS wanted FROM documents) SELECT *, kind <> '' AND kind = wanted AS accepted FROM k"""


# ---- audits, embeddings -------------------------------------------------------------------------


def owner_audit_q(spark: SparkSession, d: str) -> DataFrame:
    """Ledger rows whose owner is unknown or not on the allowed domain."""
    n = F.regexp_extract("user_id", r"(\d+)$", 1).cast("int")
    owners = M.notes(spark, d).select("user_id").distinct().where(n != 3).withColumn(
        "email", F.concat("user_id", F.when(n < 15, "@lib.example").otherwise("@other.example"))
    )
    return I.orphans(M.ledger(spark, d), owners, "@lib[.]example$").select(*ID, "status")


OWNER_AUDIT_SQL = Q.with_(Q.LEDGER) + "SELECT user_id, note_id, status FROM ledger WHERE CAST(substr(user_id, 4) AS INT) = 3 OR CAST(substr(user_id, 4) AS INT) >= 15"


def hash_embed_q(spark: SparkSession, d: str) -> DataFrame:
    v = E.embed_column("content", E.hash_embedder())
    rows = M.notes(spark, d).select(*ID, v.alias("v"))
    filled = F.filter(F.transform("v", lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x"))), lambda s: s["x"] != 0)
    return rows.select(
        *ID,
        F.size(filled).cast("long").alias("n_buckets"),
        F.round(F.aggregate(filled, F.lit(0.0), lambda a, s: a + s["x"] * s["i"]), 3).alias("moment"),
        F.round(F.aggregate(filled, F.lit(0.0), lambda a, s: a + s["x"] * s["x"]), 5).alias("norm"),
    )


HASH_EMBED_SQL = Q.with_(Q.NOTES, Q.vector_cte("dvec", "notes", "note_id", "content")) + """SELECT user_id, note_id, count(*) AS n_buckets, round(sum(v * bucket), 3) AS moment,
  round(sum(v * v), 5) AS norm FROM dvec GROUP BY ALL"""


def embedding_gate_q(spark: SparkSession, d: str) -> DataFrame:
    """Replies by batches of 32 with faults: a missing reply, a duplicate, a short vector, a NaN, an index out of range."""
    v = M.read(spark, d, "embeddings").select(F.expr("vec_id div 32").alias("batch_id"), (F.col("vec_id") % 32).cast("int").alias("index"), "embedding")
    b, i = F.col("batch_id") % 7, F.col("index")
    bad = F.when((b == 3) & (i == 5), F.slice("embedding", 1, 63)).when((b == 4) & (i == 6), F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))
    times = F.when((b == 1) & (i == 2), 0).when((b == 2) & (i == 3), 2).otherwise(1)
    index = F.when((b == 5) & (i == 4), -1).otherwise(i)
    replies = v.withColumn("embedding", bad).withColumn("n", times).where("n > 0").withColumn("r", F.explode(F.sequence(F.lit(1), "n"))).select("batch_id", index.alias("index"), "embedding")
    return E.match_replies(v.select("batch_id", "index", F.lit("t").alias("text")), replies, 64).select(
        "batch_id", long("index"), "accepted", F.coalesce(F.size("embedding"), F.lit(-1)).cast("long").alias("width")
    )


EMBEDDING_GATE_SQL = """WITH m AS (SELECT vec_id // 32 AS batch_id, vec_id % 32 AS index, max(vec_id % 32) OVER (PARTITION BY vec_id // 32) AS last FROM embeddings),
v AS (SELECT *, NOT ((batch_id % 7 = 1 AND last >= 2) OR (batch_id % 7 = 2 AND last >= 3) OR (batch_id % 7 = 3 AND last >= 5)
  OR (batch_id % 7 = 4 AND last >= 6) OR (batch_id % 7 = 5 AND last >= 4)) AS accepted FROM m)
SELECT batch_id, index, accepted, CAST(CASE WHEN accepted THEN 64 ELSE -1 END AS BIGINT) AS width FROM v"""


QUERIES = {
    "library_scan": (library_scan_q, LIBRARY_SCAN_SQL),
    "library_search": (library_search_q, LIBRARY_SEARCH_SQL),
    "scope_notes": (scope_notes_q, SCOPE_NOTES_SQL),
    "tag_facets": (tag_facets_q, TAG_FACETS_SQL),
    "topic_options": (topic_options_q, TOPIC_OPTIONS_SQL),
    "relation_edges": (relation_edges_q, RELATION_EDGES_SQL),
    "unindexed_notes": (unindexed_notes_q, UNINDEXED_SQL),
    "note_normalise": (note_normalise_q, NOTE_NORMALISE_SQL),
    "note_quality_gate": (note_quality_gate_q, NOTE_GATE_SQL),
    "question_quality_gate": (question_quality_gate_q, QUESTION_GATE_SQL),
    "title_extract": (title_extract_q, TITLE_SQL),
    "summary_extract": (summary_extract_q, SUMMARY_SQL),
    "plain_text": (plain_text_q, PLAIN_SQL),
    "content_hash": (content_hash_q, CONTENT_HASH_SQL),
    "log_redaction": (log_redaction_q, LOG_REDACTION_SQL),
    "patch_merge": (patch_merge_q, PATCH_SQL),
    "tag_merge": (tag_merge_q, TAG_MERGE_SQL),
    "tag_edits": (tag_edits_q, TAG_EDITS_SQL),
    "tag_rules": (tag_rules_q, TAG_RULES_SQL),
    "related_notes": (related_notes_q, RELATED_SQL),
    "organise_library": (organise_library_q, ORGANISE_SQL),
    "analysis_normalise": (analysis_normalise_q, ANALYSIS_SQL),
    "note_overlap_rank": (note_overlap_rank_q, OVERLAP_RANK_SQL),
    "basic_answer": (basic_answer_q, BASIC_ANSWER_SQL),
    "context_budget": (context_budget_q, BUDGET_SQL),
    "generated_document": (generated_document_q, GENERATED_SQL),
    "quote_locate": (quote_locate_q, QUOTE_LOCATE_SQL),
    "page_import": (page_import_q, PAGE_IMPORT_SQL),
    "import_branches": (import_branches_q, IMPORT_BRANCHES_SQL),
    "import_notes": (import_notes_q, IMPORT_NOTES_SQL),
    "import_outcomes": (import_outcomes_q, IMPORT_OUTCOMES_SQL),
    "platform_route": (platform_route_q, PLATFORM_ROUTE_SQL),
    "url_hygiene": (url_hygiene_q, URL_HYGIENE_SQL),
    "url_parts": (url_parts_q, URL_PARTS_SQL),
    "provenance_mix": (provenance_mix_q, PROVENANCE_SQL),
    "caption_transcript": (caption_transcript_q, CAPTION_SQL),
    "best_caption": (best_caption_q, BEST_CAPTION_SQL),
    "video_captions": (video_captions_q, VIDEO_CAPTIONS_SQL),
    "feed_items": (feed_items_q, FEED_ITEMS_SQL),
    "feed_import": (feed_import_q, FEED_IMPORT_SQL),
    "front_matter_roundtrip": (front_matter_roundtrip_q, FRONT_MATTER_SQL),
    "vault_export": (vault_export_q, VAULT_SQL),
    "json_library": (json_library_q, JSON_SQL),
    "upload_kinds": (upload_kinds_q, UPLOADS_SQL),
    "owner_audit": (owner_audit_q, OWNER_AUDIT_SQL),
    "hash_embed": (hash_embed_q, HASH_EMBED_SQL),
    "embedding_gate": (embedding_gate_q, EMBEDDING_GATE_SQL),
}
