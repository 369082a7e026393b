"""The chunk index and its ledger: building, coverage, backlog, claims and reports of waiting work, retries, replacement, cascade.

``notes``   user_id, note_id, content, …
``chunks``  chunk_id, user_id, note_id, ordinal, content, content_hash, search_terms, index_version, embedding
``ledger``  user_id, note_id, content_hash, status, attempts, available_at, locked_at, last_error, created_at, updated_at

The user id is part of every join key, together with the note id, so one user with a third of all
rows still spreads over all partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebank import constants as K
from lorebank.functions.embed import Embedder, embed_column
from lorebank.functions.text import content_hash, is_blank
from lorebank.functions.tokens import search_terms
from lorebank.operators.chunking import chunk_notes

NOTE_KEY = ["user_id", "note_id"]

#: Hashed keys (8 bytes each) up to which they are broadcast to keep chunks from a shuffle that a join would drop behind it.
KNOWN_KEYS = 2_000_000

LEDGER_SCHEMA = (
    "user_id string, note_id string, content_hash string, status string, attempts int, available_at timestamp, "
    "locked_at timestamp, last_error string, created_at timestamp, updated_at timestamp"
)


def index_rows(notes: DataFrame, embedder: Embedder | None = None, **shape: int) -> DataFrame:
    """Index rows of notes: chunk, hash of the whole note, terms, version and (optionally) vector."""
    hashed = notes.withColumn("content_hash", content_hash("content"))
    rows = (
        chunk_notes(hashed, carry=("content_hash",), **shape)
        .withColumn("search_terms", search_terms("content"))
        .withColumn("index_version", F.lit(K.INDEX_VERSION))
    )
    if embedder is not None:
        rows = rows.withColumn("embedding", embed_column("content", embedder))
    return rows


def postings(chunks: DataFrame) -> DataFrame:
    """One row per (user, term, chunk) of the current version."""
    return chunks.where(F.col("index_version") == K.INDEX_VERSION).select(
        "user_id", F.explode("search_terms").alias("term"), "note_id", "chunk_id"
    )


def searchable(chunks: DataFrame, ledger: DataFrame, notes: DataFrame, note_columns: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of the current version whose note is ready with the same content hash. Ledger and notes meet first: chunks are wide and move once."""
    ready = ledger.where(F.col("status") == "ready").select(*NOTE_KEY, "content_hash").join(notes.select(*NOTE_KEY, *note_columns), NOTE_KEY)
    current = chunks.where(F.col("index_version") == K.INDEX_VERSION).drop(*note_columns)
    key = F.xxhash64(*NOTE_KEY, "content_hash")
    known = ready.select(key.alias("_known")).distinct()
    if known.limit(KNOWN_KEYS + 1).count() <= KNOWN_KEYS:
        # only prunes: what it lets through still meets its ledger row by the whole key
        current = current.join(F.broadcast(known), key == F.col("_known"), "left_semi")
    return current.join(ready, [*NOTE_KEY, "content_hash"])


def coverage(notes: DataFrame, ledger: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per user: total, pending, processing, ready, failed, missing. One pass over all users."""
    current = (
        chunks.where(F.col("index_version") == K.INDEX_VERSION)
        .groupBy(*NOTE_KEY, "content_hash")
        .agg(F.lit(True).alias("has_chunk"))
    )
    jobs = ledger.select(*NOTE_KEY, "status", "content_hash").join(current, [*NOTE_KEY, "content_hash"], "left")
    status = F.col("status")
    covered = F.col("blank") | F.coalesce(F.col("has_chunk"), F.lit(False))
    return (
        notes.select(*NOTE_KEY, is_blank("content").alias("blank"))
        .join(jobs.drop("content_hash"), NOTE_KEY, "left")
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(status == "pending").alias("pending"),
            F.count_if(status == "processing").alias("processing"),
            F.count_if((status == "ready") & covered).alias("ready"),
            F.count_if(status == "failed").alias("failed"),
            F.count_if(status.isNull() | ((status == "ready") & ~covered)).alias("missing"),
        )
    )


def index_states(notes: DataFrame, ledger: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each note against its ledger row and all of its chunks, by the hash of its current content.

    Chunks are reduced to one narrow row per note before the join. A note is ready when its ledger row
    is ready with the current hash, every chunk has that hash and the current version, and there is at
    least one chunk unless the body is blank.
    """
    per_note = chunks.groupBy(*NOTE_KEY).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.min("content_hash").alias("low_hash"),
        F.max("content_hash").alias("high_hash"),
        F.bool_and(F.col("index_version") == K.INDEX_VERSION).alias("version_current"),
    )
    jobs = ledger.select(*NOTE_KEY, F.col("content_hash").alias("job_hash"), "status")
    now_hash = F.col("content_hash")
    chunks_current = F.col("n_chunks").isNull() | (
        (F.col("low_hash") == now_hash) & (F.col("high_hash") == now_hash) & F.col("version_current")
    )
    has_required = F.col("blank") | F.col("n_chunks").isNotNull()
    ready = (F.col("status") == "ready") & (F.col("job_hash") == now_hash) & chunks_current & has_required
    return (
        notes.select(*NOTE_KEY, content_hash("content").alias("content_hash"), is_blank("content").alias("blank"))
        .join(jobs, NOTE_KEY, "left")
        .join(per_note, NOTE_KEY, "left")
        .select(
            *NOTE_KEY,
            "content_hash",
            "job_hash",
            "status",
            F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"),
            chunks_current.alias("chunks_current"),
            F.coalesce(ready, F.lit(False)).alias("ready"),
        )
    )


def needs_queue() -> Column:
    """Over ``index_states``: not ready, and no ledger row, a different hash, or a ready row."""
    other_hash = F.col("job_hash").isNull() | (F.col("job_hash") != F.col("content_hash"))
    return ~F.col("ready") & (other_hash | (F.col("status") == "ready"))


def backlog(notes: DataFrame, ledger: DataFrame, chunks: DataFrame) -> DataFrame:
    """Notes to (re)index with the hash to index. Failed rows with an unchanged hash stay out."""
    return index_states(notes, ledger, chunks).where(needs_queue()).select(*NOTE_KEY, "content_hash")


def ledger_upsert(ledger: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Merge queued notes into the ledger: a queued note becomes pending with a clean slate."""
    new = incoming.select(*NOTE_KEY, F.col("content_hash").alias("new_hash"))
    hit = F.col("new_hash").isNotNull()

    def reset(name: str, value: Column) -> Column:
        return F.when(hit, value).otherwise(F.col(name)).alias(name)

    return ledger.join(new, NOTE_KEY, "full_outer").select(
        *NOTE_KEY,
        F.coalesce("new_hash", "content_hash").alias("content_hash"),
        reset("status", F.lit("pending")),
        reset("attempts", F.lit(0)),
        reset("available_at", now),
        reset("locked_at", F.lit(None).cast("timestamp")),
        reset("last_error", F.lit(None).cast("string")),
        F.coalesce("created_at", now).alias("created_at"),
        reset("updated_at", now),
    )


def expire_leases(ledger: DataFrame, now: Column) -> DataFrame:
    """The whole ledger, in which rows stuck in processing past the lease with no execution left have become failed."""
    dead = (F.col("status") == "processing") & (F.col("attempts") >= K.MAX_ATTEMPTS) & (F.col("locked_at") <= _lease_edge(now))
    return ledger.withColumns(
        {
            "status": F.when(dead, "failed").otherwise(F.col("status")),
            "last_error": F.when(dead, K.INDEX_ERROR).otherwise(F.col("last_error")),
            "updated_at": F.when(dead, now).otherwise(F.col("updated_at")),
            "locked_at": F.when(~dead, F.col("locked_at")),
        }
    )


def due_rows(ledger: DataFrame, now: Column) -> DataFrame:
    """All work that may run: available pending rows and expired leases, with executions left."""
    available = (F.col("status") == "pending") & (F.col("available_at") <= now)
    expired = (F.col("status") == "processing") & (F.col("locked_at") <= _lease_edge(now))
    return ledger.where((available | expired) & (F.col("attempts") < K.MAX_ATTEMPTS))


def claim(due: DataFrame, now: Column) -> DataFrame:
    """Due rows as they look once an execution has started."""
    return due.withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "locked_at": now, "updated_at": now})


def due_work(ledger: DataFrame, now: Column) -> DataFrame:
    """Per user: how many pending notes may be indexed now, how long the oldest has waited (seconds), and how many attempts they had."""
    due = ledger.where((F.col("status") == "pending") & (F.col("available_at") <= now) & (F.col("attempts") < K.MAX_ATTEMPTS))
    waited = F.unix_timestamp(now) - F.unix_timestamp("available_at")
    return due.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max(waited).alias("oldest_s"), F.sum("attempts").alias("attempts"))


def stuck_work(ledger: DataFrame, now: Column) -> DataFrame:
    """Per user and number of attempts: notes that have been processing for longer than an attempt may take, and whether an attempt is left."""
    stuck = ledger.where((F.col("status") == "processing") & (F.col("locked_at") <= _lease_edge(now)))
    held = F.unix_timestamp(now) - F.unix_timestamp("locked_at")
    return stuck.groupBy("user_id", "attempts").agg(
        F.count(F.lit(1)).alias("n"), F.max(held).alias("longest_s"), F.first(F.col("attempts") < K.MAX_ATTEMPTS).alias("attempt_left")
    )


def claimed_notes(claimed: DataFrame, notes: DataFrame) -> DataFrame:
    """Claimed rows with their note; user and note id agree and the content still has the claimed hash."""
    return (
        notes.join(claimed.select(*NOTE_KEY, F.col("content_hash").alias("claimed_hash"), "attempts"), NOTE_KEY)
        .where(content_hash("content") == F.col("claimed_hash"))
    )


def _lease_edge(now: Column) -> Column:
    return now - F.expr(f"INTERVAL {K.LEASE_SECONDS} SECONDS")


def record_failures(ledger: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """Failed executions (``user_id, note_id, content_hash``): back off by attempt, terminal on the last."""
    hit = F.col("missed").isNotNull() & (F.col("status") == "processing")
    delays = F.array(*[F.lit(d) for d in K.RETRY_DELAYS_S])
    delay = F.get(delays, F.col("attempts") - 1)
    missed = failed.select(*NOTE_KEY, "content_hash").distinct().withColumn("missed", F.lit(True))
    return ledger.join(missed, [*NOTE_KEY, "content_hash"], "left").select(
        *NOTE_KEY,
        "content_hash",
        F.when(hit & delay.isNotNull(), "pending").when(hit, "failed").otherwise(F.col("status")).alias("status"),
        "attempts",
        F.when(hit & delay.isNotNull(), F.timestamp_micros(F.unix_micros(now) + delay * 1_000_000))
        .otherwise(F.col("available_at"))
        .alias("available_at"),
        F.when(~hit, F.col("locked_at")).alias("locked_at"),
        F.when(hit, K.INDEX_ERROR).otherwise(F.col("last_error")).alias("last_error"),
        "created_at",
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def retry_failed(ledger: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Manual retry: every failed row of the given users becomes pending with a clean slate."""
    asked = users.select("user_id").distinct().withColumn("asked", F.lit(True))
    hit = F.coalesce(F.col("asked"), F.lit(False)) & (F.col("status") == "failed")
    return ledger.join(asked, "user_id", "left").select(
        *NOTE_KEY,
        "content_hash",
        F.when(hit, "pending").otherwise(F.col("status")).alias("status"),
        F.when(hit, 0).otherwise(F.col("attempts")).alias("attempts"),
        F.when(hit, now).otherwise(F.col("available_at")).alias("available_at"),
        F.when(~hit, F.col("locked_at")).alias("locked_at"),
        F.when(~hit, F.col("last_error")).alias("last_error"),
        "created_at",
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
        hit.alias("retried"),
    )


def replace_chunks(current: DataFrame, fresh: DataFrame, done: DataFrame, notes: DataFrame) -> DataFrame:
    """All chunks of every done note give way to its fresh ones; results of older content are dropped.

    ``done`` lists processed notes with the hash they were read at (notes without chunks included).
    The fence keeps only those whose note still has that content.
    """
    now = notes.select(*NOTE_KEY, content_hash("content").alias("content_hash"))
    valid = done.select(*NOTE_KEY, "content_hash").join(now, [*NOTE_KEY, "content_hash"], "left_semi")
    kept = current.join(valid.select(*NOTE_KEY), NOTE_KEY, "left_anti")
    return kept.unionByName(fresh.join(valid, [*NOTE_KEY, "content_hash"], "left_semi"))


def cascade(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Chunks or ledger rows whose note still exists."""
    return rows.join(notes.select(*NOTE_KEY), NOTE_KEY, "left_semi")


def orphans(rows: DataFrame, owners: DataFrame, allowed: str) -> DataFrame:
    """Audit: rows whose owner is missing or does not match the allowed pattern."""
    good = owners.where(F.col("email").rlike(allowed)).select("user_id")
    return rows.join(good, "user_id", "left_anti")
