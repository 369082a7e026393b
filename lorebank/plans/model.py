"""The given tables read as a knowledge library.

documents → notes; documents ⟕ labels → ledger and index states; conversations → questions;
embeddings → vectors; pages → imports; benchmark → quotes; events → edits and requests.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebank.functions.embed import embed_column, hash_embedder
from lorebank.functions.text import summary_of, title_from_body
from lorebank.functions.tokens import search_terms
from lorebank.operators import index as I
from lorebank.operators.answers import history_queries
from lorebank.session import shared_dir

USERS = 20
NOW = "2024-01-08 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a scan that has fewer splits than cores.

    A large table arrives in far more splits than cores and passes through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_stream(df: DataFrame) -> DataFrame:
    """The same for micro-batches, whose splits are not known when the stream is planned."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored library: titles, summaries and tags are derived once, on ingest."""
    return _stored(spark, sf_dir, "library", lambda: ingest(spark, sf_dir))


def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(read(spark, sf_dir, "documents"))
    doc = F.col("doc_id")
    size = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long")
    stamp = F.timestamp_seconds(F.lit(1704067200) + doc * 60)
    host = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), doc.cast("string"))
    return d.select(
        F.col("source").alias("user_id"),
        doc.cast("string").alias("note_id"),
        title_from_body("text").alias("title"),
        F.col("text").alias("content"),
        summary_of("text").alias("summary"),
        F.array(F.col("lang"), size, F.concat(F.lit("d"), (doc % 7).cast("string"))).alias("tags"),
        F.col("lang").alias("topic"),
        F.when(doc % 3 == 0, host).when(doc % 3 == 1, F.col("source")).otherwise("").alias("source"),
        F.transform(F.array(doc + 20, doc + 140, doc * 2, doc), lambda x: x.cast("string")).alias("related_note_ids"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
        "doc_id",
    )


def old_hash(text: Column) -> Column:
    """Hash of an earlier version of a note."""
    return F.sha2(F.concat(F.lit("old:"), text), 256)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger."""
    return _stored(spark, sf_dir, "ledger", lambda: ledger_rows(spark, sf_dir))


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled notes are ready (low quality ones at an older hash); others wait, run, failed or are absent."""
    docs = spread(read(spark, sf_dir, "documents")).select("doc_id", "text", "source")
    rows = docs.join(read(spark, sf_dir, "labels"), "doc_id", "left")
    doc, state = F.col("doc_id"), F.col("doc_id") % 5
    status = (
        F.when(F.col("quality").isNotNull(), "ready")
        .when(state.isin(0, 1), "pending")
        .when(state == 2, "failed")
        .when(state == 3, "processing")
    )

    def minutes(m: Column) -> Column:
        return F.timestamp_seconds(F.unix_timestamp(now()) + m * 60)

    return rows.withColumn("status", status).where(F.col("status").isNotNull()).select(
        F.col("source").alias("user_id"),
        doc.cast("string").alias("note_id"),
        F.when(F.col("quality") == 0, old_hash(F.col("text"))).otherwise(F.sha2("text", 256)).alias("content_hash"),
        "status",
        F.when(F.col("status") == "failed", 4).when(F.col("status") == "ready", 1).otherwise(doc % 6).cast("int").alias("attempts"),
        minutes(doc % 97 - 60).alias("available_at"),
        F.when(F.col("status") == "processing", minutes(-(doc % 13))).alias("locked_at"),
        F.when(F.col("status") == "failed", "Indexing failed.").alias("last_error"),
        minutes(doc % 89 - 200).alias("created_at"),
        minutes(doc % 83 - 100).alias("updated_at"),
    )


_TABLES: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table built once per session and kept in the shared folder, as an index is kept between batches."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        path = shared_dir(spark, name)
        build().write.parquet(path)
        _TABLES[key] = path
    return spark.read.parquet(_TABLES[key])


def once(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """Narrow rows that one query reads several times, worked out once and kept in the shared folder."""
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored chunk index: real chunks, terms and vectors, with hashes and versions of each state.

    Toxic notes were purged from the index; low quality notes were indexed at an older hash, as were
    some ready ones; Spanish notes carry an old index version.
    """

    def build() -> DataFrame:
        labels = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("note_id"), "quality", "toxic")
        lib = notes(spark, sf_dir).select("user_id", "note_id", "content", "topic", "tags", "doc_id")
        kept = lib.join(labels, "note_id", "left").where(F.coalesce("toxic", F.lit(0)) == 0)
        stale = (F.col("quality") == 0) | (F.col("doc_id") % 11 == 0)
        hashed = kept.withColumn(
            "content_hash",
            F.when(F.coalesce(stale, F.lit(False)), old_hash(F.col("content"))).otherwise(F.sha2("content", 256)),
        )
        rows = I.chunk_notes(hashed, carry=("content_hash", "topic", "tags"))
        return rows.withColumns(
            {
                "search_terms": search_terms("content"),
                "index_version": F.when(F.col("topic") == "es", 0).otherwise(1),
                "embedding": embed_column("content", hash_embedder()),
            }
        )

    return _stored(spark, sf_dir, "index", build)


def searchable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searchable part of the index, resolved once per batch of questions: every channel reads it several times."""
    return _stored(spark, sf_dir, "searchable", lambda: searchable_rows(spark, sf_dir))


def searchable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = notes(spark, sf_dir).select("user_id", "note_id")
    return I.searchable(index_chunks(spark, sf_dir), ledger(spark, sf_dir), lib)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").withColumn(
        "user_id", F.concat(F.lit("src"), (F.col("conv_id") % USERS).cast("string"))
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of questions, prepared once: every channel reads it several times."""
    return _stored(spark, sf_dir, "questions", lambda: question_rows(spark, sf_dir))


def question_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a question of one user, with its standalone query, terms and vector."""
    q = history_queries(turns(spark, sf_dir)).select(
        "user_id",
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        "conv_id",
        "query",
        search_terms("query").alias("search_terms"),
    )
    # embedding is heavy per byte: a fixed partition count keeps AQE from merging the work
    q = q.repartition(spark.sparkContext.defaultParallelism)
    return q.withColumn("embedding", embed_column("query", hash_embedder()))


def with_scopes(q: DataFrame) -> DataFrame:
    """Scopes by conversation: none, a topic, a tag and topic, or twenty note ids."""
    kind = F.col("conv_id") % 4
    user = F.col("conv_id") % USERS
    none = F.array().cast("array<string>")
    ids = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: (user + i * USERS).cast("string"))
    return q.withColumns(
        {
            "scope_note_ids": F.when(kind == 3, ids).otherwise(none),
            "scope_topics": F.when(kind.isin(1, 2), F.array(F.lit("en"), F.lit("de"))).otherwise(none),
            "scope_tags": F.when(kind == 2, F.array(F.lit("d1"), F.lit("long"))).otherwise(none),
        }
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as chunk vectors; the label is the library they belong to."""
    return spread(read(spark, sf_dir, "embeddings")).select(
        F.concat(F.lit("lib"), F.col("label").cast("string")).alias("user_id"), "vec_id", "embedding"
    )
