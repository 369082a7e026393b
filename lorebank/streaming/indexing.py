"""Continuous index maintenance over a stream of note versions.

Storage is two append-only tables in a shared folder, one directory per micro-batch:

``chunks/batch=N``  index rows of the notes processed in batch N
``ledger/batch=N``  one row per processed note: hash, version, status

A note's current chunks are those of the batch its newest ledger row names, so a batch replaces all
chunks of a note at once by writing its ledger rows last. A batch costs what its own notes cost; old
chunks are left to :func:`compact`. A retried batch overwrites its own two directories, which makes the
result exactly-once. The checkpoint keeps the backlog across restarts.

A text that the embedder refuses does not stop its batch. All rows of a batch are computed and written in one pass; the notes that have a failed
row end ``pending`` with the time of their next attempt, or ``failed`` on the last, and their versions go to ``retry/batch=N``. Whatever
of these is due rides along with a later batch, unless a newer version has come. A row without a note id is a heartbeat: it makes a batch and nothing else.

Directory numbers never repeat. A checkpoint's micro-batches count from a base that is recorded under ``runs/`` and lies above
every stored number, so a fresh checkpoint, or an old one continued on a compacted copy, appends and overwrites nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorebank import constants as K
from lorebank.functions.embed import Embedder, try_embed_column
from lorebank.functions.text import content_hash
from lorebank.operators.blocks import checked_small
from lorebank.operators.index import NOTE_KEY, index_rows

LEDGER_ROW = (
    "user_id string, note_id string, content_hash string, version long, status string, deleted boolean, updated_at timestamp, "
    "indexed_at timestamp, attempts int, available_at timestamp, last_error string, batch long"
)


def newest_versions(versions: DataFrame) -> DataFrame:
    """The newest version of each note, of equal ones that of the larger content hash; reduces before the shuffle, so a note edited very often is cheap."""
    order = F.struct("version", content_hash(F.coalesce("content", F.lit(""))), "deleted")
    return versions.groupBy(*NOTE_KEY).agg(F.max_by(F.struct(*[c for c in versions.columns if c not in NOTE_KEY]), order).alias("v")).select(
        *NOTE_KEY, "v.*"
    )


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Newest ledger row per note."""
    try:
        rows = spark.read.schema(LEDGER_ROW).option("basePath", f"{root}/ledger").parquet(f"{root}/ledger")
    except Exception as e:  # noqa: BLE001  no batch written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER_ROW)
    fields = [f.split()[0] for f in LEDGER_ROW.split(", ") if f.split()[0] not in NOTE_KEY]
    return rows.groupBy(*NOTE_KEY).agg(F.max_by(F.struct(*fields), "batch").alias("r")).select(*NOTE_KEY, "r.*")


def read_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Current chunks: of live notes that are ready, from the batch their newest ledger row names."""
    ledger = read_ledger(spark, root).where(~F.col("deleted") & (F.col("status") == "ready")).select(*NOTE_KEY, "batch")
    chunks = spark.read.option("basePath", f"{root}/chunks").parquet(f"{root}/chunks").withColumn("batch", F.col("batch").cast("long"))
    return chunks.join(ledger, [*NOTE_KEY, "batch"]).drop("batch", "failed")


def work_of(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """Versions that need indexing: newer than the recorded one, with another content or a deletion.

    Late versions are fenced off by the version, metadata-only edits by the hash.
    """
    seen = ledger.select(*NOTE_KEY, F.col("version").alias("seen_version"), F.col("content_hash").alias("seen_hash"), F.col("deleted").alias("was_deleted"))
    fresh = newest_versions(batch).withColumn("content_hash", content_hash(F.coalesce("content", F.lit(""))))
    newer = F.col("seen_version").isNull() | (F.col("version") > F.col("seen_version"))
    changed = F.col("seen_hash").isNull() | (F.col("seen_hash") != F.col("content_hash")) | (F.col("deleted") != F.col("was_deleted"))
    return fresh.join(seen, NOTE_KEY, "left").where(newer & changed).drop("seen_version", "seen_hash", "was_deleted")


def due_versions(spark: SparkSession, root: str, ledger: DataFrame, now: Column) -> DataFrame | None:
    """Versions that failed and may be tried again, with the attempts that they had; None while nothing ever failed."""
    if not _exists(spark, f"{root}/retry"):
        return None
    waiting = ledger.where((F.col("status") == "pending") & (F.col("available_at") <= now)).select(*NOTE_KEY, "batch", "attempts")
    kept = spark.read.option("basePath", f"{root}/retry").parquet(f"{root}/retry").withColumn("batch", F.col("batch").cast("long"))
    return kept.join(waiting, [*NOTE_KEY, "batch"]).drop("batch")


def process_batch(
    batch: DataFrame, batch_id: int, root: str, embedder: Embedder | None = None, delays: Sequence[int] = K.RETRY_DELAYS_S, now: Column | None = None
) -> None:
    """Index one micro-batch and what is due of earlier failures; safe to repeat."""
    spark, now = batch.sparkSession, F.current_timestamp() if now is None else now
    ledger = read_ledger(spark, root).where(F.col("batch") < batch_id)
    fresh = work_of(batch.where(F.col("note_id").isNotNull()), ledger).withColumn("attempts", F.lit(0))
    due = due_versions(spark, root, ledger, now)
    if due is not None:
        fresh = fresh.unionByName(due.select(*fresh.columns).join(fresh.select(*NOTE_KEY), NOTE_KEY, "left_anti"))
    # Kept for the writes only; a lost executor's part is recomputed from the source.
    work = fresh.persist(StorageLevel.MEMORY_AND_DISK)
    chunks = f"{root}/chunks/batch={batch_id}"
    try:
        live = work.where(~F.col("deleted"))
        rows = index_rows(live.select(*NOTE_KEY, "content"))
        if embedder is not None:
            rows = rows.withColumn("tried", try_embed_column("content", embedder)).withColumns({"embedding": F.col("tried.vector"), "failed": F.col("tried.failed")}).drop("tried")
        else:
            rows = rows.withColumn("failed", F.lit(False))
        rows.write.mode("overwrite").parquet(chunks)
        bad = spark.read.schema(rows.schema).parquet(chunks).where("failed").select(*NOTE_KEY).distinct().withColumn("bad", F.lit(True))
        judged = work.join(bad, NOTE_KEY, "left").withColumn("attempts", F.when(F.col("bad"), F.col("attempts") + 1).otherwise(0))
        again = F.col("bad") & (F.col("attempts") <= len(delays))
        wait = F.get(F.array(*[F.lit(s) for s in delays]), F.col("attempts") - 1).cast("long") * 1_000_000
        judged.where(again).select(*[c for c in fresh.columns if c != "attempts"]).write.mode("overwrite").parquet(f"{root}/retry/batch={batch_id}")
        judged.select(
            *NOTE_KEY, "content_hash", "version",
            F.when(again, "pending").when(F.col("bad"), "failed").otherwise("ready").alias("status"),
            "deleted", "updated_at", F.when(F.col("bad").isNull(), now).alias("indexed_at"),
            "attempts",
            F.when(again, F.timestamp_micros(F.unix_micros(now) + wait)).alias("available_at"),
            F.when(F.col("bad"), K.INDEX_ERROR).alias("last_error"),
        ).write.mode("overwrite").parquet(f"{root}/ledger/batch={batch_id}")
    finally:
        work.unpersist()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def batch_base(spark: SparkSession, root: str, checkpoint: str) -> int:
    """Number of the checkpoint's batch 0 in ``root``: kept while the checkpoint lives, else above all stored numbers."""
    record = f"{root}/runs/{hashlib.sha256(checkpoint.encode()).hexdigest()}"
    if _exists(spark, f"{checkpoint}/offsets") and _exists(spark, record):
        return spark.read.parquet(record).first()["base"]
    newest = spark.read.schema(LEDGER_ROW).parquet(f"{root}/ledger").agg(F.max("batch")).first()[0] if _exists(spark, f"{root}/ledger") else None
    base = 0 if newest is None else newest + 1
    spark.createDataFrame([(base,)], "base long").coalesce(1).write.mode("overwrite").parquet(record)
    return base


def start_index_stream(
    versions: DataFrame,
    root: str,
    checkpoint: str,
    embedder: Embedder | None = None,
    every: str | None = None,
    delays: Sequence[int] = K.RETRY_DELAYS_S,
) -> StreamingQuery:
    """Keep the index current. ``versions``: user_id, note_id, version, content, deleted, updated_at.

    Without ``every`` the stream works off what is there and stops; ``every='10 seconds'`` keeps notes
    searchable within a minute.
    """
    base = batch_base(versions.sparkSession, root, checkpoint)
    writer = versions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, n: process_batch(df, base + n, root, embedder, delays)
    )
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def compact(spark: SparkSession, root: str, target: str) -> None:
    """Write the current state as one batch of a new folder, leaving superseded rows behind.

    The batch keeps the newest stored number; a target that already holds a ledger is refused.
    """
    if _exists(spark, f"{target}/ledger"):
        raise ValueError(f"{target} already holds an index")
    ledger = read_ledger(spark, root)
    stored = spark.read.option("basePath", f"{root}/chunks").parquet(f"{root}/chunks").withColumn("batch", F.col("batch").cast("long"))
    keys, live = [*NOTE_KEY, "batch"], ledger.where(~F.col("deleted") & (F.col("status") == "ready")).select(*NOTE_KEY, "batch")
    # What goes is a list of narrow keys and mostly short: then the chunks themselves need no shuffle.
    gone = checked_small(stored.select(*keys).distinct().join(live, keys, "left_anti"))
    chunks = stored.dropna(subset=NOTE_KEY).join(gone, keys, "left_anti").drop("batch", "failed")
    newest = ledger.agg(F.max("batch")).first()[0] or 0
    chunks.withColumn("failed", F.lit(False)).write.mode("error").parquet(f"{target}/chunks/batch={newest}")
    if _exists(spark, f"{root}/retry"):
        waiting = ledger.where(F.col("status") == "pending").select(*NOTE_KEY, "batch")
        kept = spark.read.option("basePath", f"{root}/retry").parquet(f"{root}/retry").withColumn("batch", F.col("batch").cast("long"))
        kept.join(waiting, [*NOTE_KEY, "batch"]).drop("batch").write.mode("error").parquet(f"{target}/retry/batch={newest}")
    ledger.drop("batch").write.mode("error").parquet(f"{target}/ledger/batch={newest}")


def freshness_stream(edits: DataFrame, indexed: DataFrame, horizon: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Two streams met: every change of a note with the time at which that version became searchable, null if not within ``horizon``.

    ``edits``: user_id, note_id, version, changed_at; ``indexed``: user_id, note_id, version, indexed_at. A changed version waits in the join's state
    until the watermark of both streams has passed its horizon; only then is it known to be missing, so state is bounded by what changed lately.
    Clocks may differ by the horizon. Write in append mode.
    """
    keys = [*NOTE_KEY, "version"]
    e = edits.select(*keys, "changed_at").withWatermark("changed_at", delay).alias("e")
    i = indexed.select(*keys, "indexed_at").withWatermark("indexed_at", delay).alias("i")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"e.{k}") == F.col(f"i.{k}"))
    near = F.expr(f"i.indexed_at BETWEEN e.changed_at - INTERVAL {horizon} AND e.changed_at + INTERVAL {horizon}")
    return e.join(i, same & near, "leftOuter").select(*[F.col(f"e.{k}").alias(k) for k in keys], "e.changed_at", "i.indexed_at")


def freshness(met: DataFrame, within_seconds: int = 60) -> DataFrame:
    """Per user: changed versions, how many became searchable within the target, later, or not within the horizon; the longest lag."""
    # a version written again is searchable from its first time on
    once = met.groupBy(*NOTE_KEY, "version").agg(F.min("changed_at").alias("changed_at"), F.min("indexed_at").alias("indexed_at"))
    lag = F.when(F.col("indexed_at").isNotNull(), F.greatest(F.unix_timestamp("indexed_at") - F.unix_timestamp("changed_at"), F.lit(0)))
    return (
        once.withColumn("lag", lag)
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("lag") <= within_seconds).alias("on_time"),
            F.count_if(F.col("lag") > within_seconds).alias("late"),
            F.count_if(F.col("indexed_at").isNull()).alias("missing"),
            F.max("lag").alias("max_lag"),
        )
    )


def job_metrics(ledger: DataFrame) -> DataFrame:
    """Metric rows by fixed categories; never any text."""
    outcome = (
        F.when(F.col("status") == "ready", "ready")
        .when(F.col("status") == "failed", "failed")
        .when(F.col("last_error").isNotNull(), "rescheduled")
        .otherwise("idle")
    )
    failure = F.when(F.col("last_error").isNotNull(), "indexing_failed")
    return (
        ledger.groupBy(outcome.alias("outcome"), failure.alias("failure_category"))
        .agg(F.count(F.lit(1)).alias("job_count"))
        .select(F.lit("knowledge_index_job").alias("event"), "outcome", "job_count", "failure_category")
    )


def append_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").parquet(path)
