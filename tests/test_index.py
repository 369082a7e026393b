from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorebank.functions.embed import embed_column, hash_embedder, match_replies, try_embed_column, vector_is_usable
from lorebank.operators import index as I
from lorebank.operators.index import LEDGER_SCHEMA
from lorebank.plans import model as M
from lorebank.plans.retrieval_queries import due_work_q, lease_expiry_q

NOW = datetime(2024, 5, 1, 12, 0, 0)
NOTE = "user_id string, note_id string, content string"
CHUNK = "chunk_id string, user_id string, note_id string, content_hash string, index_version int"


def now():
    return F.lit("2024-05-01 12:00:00").cast("timestamp")


def sha(spark, text):
    return spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0]


def job(note, h, status, attempts=1, available=NOW, locked=None, created=NOW, user="u"):
    return (user, note, h, status, attempts, available, locked, None, created, created)


@pytest.fixture(scope="module")
def library(spark):
    contents = {"current": "one", "missing": "two", "stale": "three", "nochunk": "four", "oldver": "five", "blank": " \n", "failed": "six", "waiting": "seven"}
    h = {n: sha(spark, c) for n, c in contents.items()}
    notes = spark.createDataFrame([("u", n, c) for n, c in contents.items()], NOTE)
    ledger = spark.createDataFrame(
        [job("current", h["current"], "ready"), job("stale", "old", "ready"), job("nochunk", h["nochunk"], "ready"), job("oldver", h["oldver"], "ready"),
         job("blank", h["blank"], "ready"), job("failed", h["failed"], "failed"), job("waiting", h["waiting"], "pending")], LEDGER_SCHEMA)
    chunks = spark.createDataFrame(
        [("c1", "u", "current", h["current"], 1), ("c2", "u", "stale", "old", 1), ("c3", "u", "oldver", h["oldver"], 0)], CHUNK)
    return notes, ledger, chunks


def test_backlog(library):
    got = {r.note_id for r in I.backlog(*library).collect()}
    assert got == {"missing", "stale", "nochunk", "oldver"}


def test_coverage(library):
    r = I.coverage(*library).first()
    # content changed behind the ledger's back still counts as ready: coverage compares with the ledger hash
    assert (r.total, r.pending, r.processing, r.ready, r.failed, r.missing) == (8, 1, 0, 3, 1, 3)


def test_searchable(library):
    notes, ledger, chunks = library
    assert {r.chunk_id for r in I.searchable(chunks, ledger, notes).collect()} == {"c1", "c2"}


def test_upsert_resets_and_inserts(spark, library):
    notes, ledger, chunks = library
    merged = {r.note_id: r for r in I.ledger_upsert(ledger, I.backlog(notes, ledger, chunks), now()).collect()}
    assert len(merged) == 8
    assert merged["missing"].status == "pending" and merged["missing"].created_at == NOW
    assert merged["stale"].attempts == 0 and merged["stale"].content_hash == sha(spark, "three")
    assert merged["failed"].status == "failed"


def test_reports_of_waiting_and_stuck_work(spark):
    old = NOW - timedelta(minutes=6)
    rows = [job("due", "h", "pending"), job("older", "h", "pending", attempts=2, available=old), job("later", "h", "pending", available=NOW + timedelta(seconds=1)), job("spent", "h", "pending", attempts=4),
            job("lost", "h", "processing", locked=old), job("busy", "h", "processing", locked=NOW), job("dead", "h", "processing", attempts=4, locked=old), job("done", "h", "ready"), job("due", "h", "pending", user="v")]
    ledger = spark.createDataFrame(rows, LEDGER_SCHEMA)
    assert {tuple(r) for r in I.due_work(ledger, now()).collect()} == {("u", 2, 360, 3), ("v", 1, 0, 1)}
    assert {tuple(r) for r in I.stuck_work(ledger, now()).collect()} == {("u", 1, 1, 360, True), ("u", 4, 1, 360, False)}


def test_due_rows_are_claimed_and_dead_leases_fail_row_by_row(spark):
    old = NOW - timedelta(minutes=6)
    rows = [job("due", "h", "pending"), job("later", "h", "pending", available=NOW + timedelta(seconds=1)), job("spent", "h", "pending", attempts=4),
            job("lost", "h", "processing", locked=old), job("busy", "h", "processing", locked=NOW), job("dead", "h", "processing", attempts=4, locked=old), job("done", "h", "ready")]
    after = I.expire_leases(spark.createDataFrame(rows, LEDGER_SCHEMA), now())
    assert after.count() == len(rows) and [(r.note_id, r.locked_at) for r in after.where("status = 'failed'").collect()] == [("dead", None)]
    claimed = {r.note_id: (r.status, r.attempts, r.locked_at) for r in I.claim(I.due_rows(after, now()), now()).collect()}
    assert claimed == {"due": ("processing", 2, NOW), "lost": ("processing", 2, NOW)}


def test_queries_of_waiting_work_give_every_row_of_the_ledger(spark, sf):
    assert lease_expiry_q(spark, sf).count() == M.ledger(spark, sf).count()
    assert {"note_id", "content_hash", "status"} <= set(due_work_q(spark, sf).columns)


def test_back_off_table(spark):
    rows = [job(f"a{i}", "h", "processing", attempts=i, locked=NOW) for i in (1, 2, 3, 4)] + [job("moved", "new", "processing", locked=NOW)]
    ledger = spark.createDataFrame(rows, LEDGER_SCHEMA)
    failed = spark.createDataFrame([("u", f"a{i}", "h") for i in (1, 2, 3, 4)] + [("u", "moved", "old")], "user_id string, note_id string, content_hash string")
    got = {r.note_id: r for r in I.record_failures(ledger, failed, now()).collect()}
    for note, seconds in (("a1", 5), ("a2", 30), ("a3", 300)):
        assert got[note].status == "pending" and got[note].available_at == NOW + timedelta(seconds=seconds)
    assert got["a4"].status == "failed" and got["a4"].last_error == "Indexing failed."
    assert got["moved"].status == "processing"


def test_manual_retry_touches_only_asked_users(spark):
    ledger = spark.createDataFrame([job("a", "h", "failed", attempts=4), job("b", "h", "failed", attempts=4, user="v"), job("c", "h", "ready")], LEDGER_SCHEMA)
    got = {r.note_id: r for r in I.retry_failed(ledger, spark.createDataFrame([("u",)], "user_id string"), now()).collect()}
    assert (got["a"].status, got["a"].attempts, got["a"].retried) == ("pending", 0, True)
    assert got["b"].status == "failed" and not got["c"].retried


def test_replace_is_fenced_and_whole(spark):
    notes = spark.createDataFrame([("u", "n", "v3"), ("u", "m", "text"), ("u", "k", "")], NOTE)
    chunk = "user_id string, note_id string, content_hash string, body string"
    current = spark.createDataFrame([("u", "n", "h1", "v1"), ("u", "m", "h0", "old"), ("u", "k", "h0", "gone")], chunk)
    hm, hk = sha(spark, "text"), sha(spark, "")
    done = spark.createDataFrame([("u", "n", sha(spark, "v2")), ("u", "m", hm), ("u", "k", hk)], "user_id string, note_id string, content_hash string")
    fresh = spark.createDataFrame([("u", "n", sha(spark, "v2"), "v2"), ("u", "m", hm, "p1"), ("u", "m", hm, "p2")], chunk)
    got = {(r.note_id, r.body) for r in I.replace_chunks(current, fresh, done, notes).collect()}
    assert got == {("n", "v1"), ("m", "p1"), ("m", "p2")}


def test_cascade_and_orphans(spark, library):
    notes, ledger, chunks = library
    assert I.cascade(chunks, notes.where("note_id <> 'stale'")).count() == 2
    owners = spark.createDataFrame([("u", "a@other.example")], "user_id string, email string")
    assert I.orphans(ledger, owners, "@lib[.]example$").count() == 7
    assert I.orphans(ledger, owners, "example$").count() == 0


def test_index_rows(spark):
    notes = spark.createDataFrame([("u", "n", "# T\n\nalpha beta"), ("u", "b", " ")], NOTE)
    rows = I.index_rows(notes, hash_embedder(64)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.chunk_id, r.search_terms, r.index_version, r.heading_path) == ("n#000000", ["alpha", "beta"], 1, ["T"])
    assert len(r.embedding) == 64 and sum(x * x for x in r.embedding) == pytest.approx(1, abs=1e-6)


def plain_embedding(text, dim):
    import math
    import unicodedata

    chars = list("".join(unicodedata.normalize("NFKC", text).lower().split()))
    grams = {"".join(chars)} if len(chars) < 3 else {"".join(chars[i : i + 3]) for i in range(len(chars) - 2)}
    v = [0] * dim
    for g in grams:
        h = 2166136261
        for ch in g:
            h = ((h ^ ord(ch)) * 16777619) % 2**32
        v[h % dim] += 1
    norm = math.sqrt(sum(x * x for x in v)) or 1
    return [x / norm for x in v]


@pytest.mark.parametrize("text", ["Hello hello world", "知识库检索", "ab", "", "ﬁne ＡＢ １2 😀😀x", "naïve café"])
def test_hash_embedding_equals_plain_version(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(embed_column("t", hash_embedder(97)).alias("v")).first()["v"]
    assert got == pytest.approx(plain_embedding(text, 97), abs=1e-6)


def test_an_embedder_is_asked_for_few_texts_at_a_time(spark):
    def narrow(texts):
        if len(texts) > 256:
            raise ValueError("too many texts at once")
        return hash_embedder(8)(texts)

    texts = spark.range(1_000).coalesce(1).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"))
    got = texts.select("id", embed_column("t", narrow).alias("v"), try_embed_column("t", narrow).alias("tried"), embed_column("t", hash_embedder(8)).alias("all")).collect()
    assert len(got) == 1_000 and all(r.v == r.all and r.tried.vector == r.all and not r.tried.failed for r in got)


def test_vector_checks(spark):
    rows = [([1.0, 2.0],), ([1.0],), ([1.0, float("nan")],), ([float("inf"), 0.0],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<float>").select(vector_is_usable("v", 2)).collect()]
    assert got == [True, False, False, False, False]


def test_replies_are_accepted_as_a_whole(spark):
    asks = [(b, i, "t") for b in "abc" for i in range(2)]
    replies = [("a", 1, [1.0, 1.0]), ("a", 0, [0.0, 1.0]), ("b", 0, [1.0, 1.0]), ("c", 0, [1.0, 1.0]), ("c", 0, [1.0, 1.0])]
    got = match_replies(
        spark.createDataFrame(asks, "batch_id string, index int, text string"),
        spark.createDataFrame(replies, "batch_id string, index int, embedding array<float>"), 2,
    ).collect()
    assert {r.batch_id for r in got if r.accepted} == {"a"}
    assert {(r['index'], tuple(r.embedding)) for r in got if r.accepted} == {(0, (0.0, 1.0)), (1, (1.0, 1.0))}
    assert all(r.embedding is None for r in got if not r.accepted)


def test_sql_views(spark, library):
    from lorebank.plans.sql_views import register_views

    notes, ledger, chunks = library
    lib = notes.withColumns({"title": F.col("note_id"), "source": F.lit(""), "topic": F.lit("t"), "tags": F.array(F.lit("x")), "related_note_ids": F.array(F.lit("stale"))})
    register_views(spark, lib, ledger, chunks.withColumn("search_terms", F.array(F.lit("a"), F.lit("b"))))
    assert spark.sql("SELECT title FROM searchable_chunks ORDER BY 1").collect()[0].title == "current"
    assert spark.sql("SELECT count(*) FROM postings WHERE term = 'a'").first()[0] == 2
    assert spark.sql("SELECT missing FROM index_coverage WHERE user_id = 'u'").first()[0] == 3
    assert spark.sql("SELECT content FROM note_chunks WHERE note_id = 'failed'").first()[0] == "six"
    assert spark.sql("SELECT count(*) FROM relation_edges").first()[0] == 8
