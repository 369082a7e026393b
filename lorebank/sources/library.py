"""Note tables: scan, gated append, JSON libraries and saving imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebank import constants as K
from lorebank.functions.text import or_default
from lorebank.operators.gates import check_notes

NOTE_SCHEMA = (
    "note_id string, user_id string, title string, content string, summary string, tags array<string>, topic string, "
    "source string, related_note_ids array<string>, created_at timestamp, updated_at timestamp"
)
JSON_SCHEMA = (
    "id string, title string, content string, summary string, tags array<string>, topic string, source string, "
    "createdAt string, updatedAt string, relatedNoteIds array<string>"
)


# Part of the storage layout: changing it needs a rewrite of stored tables.
USER_BUCKETS = 256


def user_bucket(user_id: Column) -> Column:
    return F.pmod(F.xxhash64(user_id), F.lit(USER_BUCKETS)).cast("int")


def read_notes(spark: SparkSession, path: str, user_id: str | None = None) -> DataFrame:
    """Stored notes; a user id prunes to that user's bucket, then by row group."""
    notes = spark.read.schema(f"{NOTE_SCHEMA}, user_bucket int").parquet(path)
    if user_id is not None:
        notes = notes.where((F.col("user_bucket") == user_bucket(F.lit(user_id))) & (F.col("user_id") == user_id))
    return notes.drop("user_bucket")


def append_notes(notes: DataFrame, path: str) -> DataFrame:
    """Append accepted notes in user buckets; the rejected ones come back with their reasons.

    Buckets keep the number of directories fixed for any number of users. Rebalancing lets AQE merge
    small buckets and split the one of a very large user before writing, so files have even sizes;
    rows are sorted by user, so a reader of one user skips the row groups of others.
    """
    checked = check_notes(notes)
    names = [f.split()[0] for f in NOTE_SCHEMA.split(", ")]
    (
        checked.where("accepted")
        .select(*names, user_bucket(F.col("user_id")).alias("user_bucket"))
        .hint("rebalance", "user_bucket")
        .sortWithinPartitions("user_bucket", "user_id", "note_id")
        .write.mode("append")
        .partitionBy("user_bucket")
        .parquet(path)
    )
    return checked.where(~F.col("accepted"))


def read_json_library(spark: SparkSession, path: str, user_id: str, multi_line: bool = True) -> DataFrame:
    """A saved JSON library: missing fields get defaults, rows without an id are dropped."""
    raw = spark.read.schema(JSON_SCHEMA).option("multiLine", str(multi_line).lower()).json(path)
    return fill_json_rows(raw).select(F.lit(user_id).alias("user_id"), "*")


def fill_json_rows(raw: DataFrame) -> DataFrame:
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    empty = F.array().cast("array<string>")
    created = or_default("createdAt", now)
    return raw.where(F.col("id").isNotNull() & (F.col("id") != "")).select(
        F.col("id").alias("note_id"),
        or_default("title", K.UNTITLED_MARKDOWN).alias("title"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("tags", empty).alias("tags"),
        or_default("topic", K.DEFAULT_TOPIC).alias("topic"),
        or_default("source", K.LOCAL_SOURCE).alias("source"),
        created.alias("created_at"),
        or_default("updatedAt", created).alias("updated_at"),
        F.coalesce("relatedNoteIds", empty).alias("related_note_ids"),
    )


def import_tags(source_type: Column, platform: Column) -> Column:
    """Tag of the source type, tag of the platform (unless unknown or pasted), and the import tag."""
    names = F.create_map(*[F.lit(x) for pair in K.SOURCE_TAGS.items() for x in pair])
    shown = F.when(~platform.isin("", K.EXTERNAL_PLATFORM, K.PASTED_PLATFORM), F.regexp_replace(platform, r"^www\.", ""))
    return F.array_distinct(F.array_compact(F.array(F.try_element_at(names, source_type), shown, F.lit(K.EXTERNAL_TAG))))


def import_topic(source_type: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in K.SOURCE_TOPICS.items() for x in pair])
    return F.try_element_at(names, source_type)


def imports_to_notes(imports: DataFrame, now: Column) -> DataFrame:
    """Import results with text become notes: summary, tags, topic and source are derived."""
    return imports.where(F.col("markdown").rlike(f"[^{K.WS}]")).select(
        "user_id",
        F.col("import_id").alias("note_id"),
        or_default("title", K.IMPORTED_TITLE).alias("title"),
        F.col("markdown").alias("content"),
        F.left("extracted_text", F.lit(K.SUMMARY_PREVIEW)).alias("summary"),
        import_tags(F.col("source_type"), F.col("platform")).alias("tags"),
        import_topic(F.col("source_type")).alias("topic"),
        or_default("source_url", F.col("platform")).alias("source"),
        F.array().cast("array<string>").alias("related_note_ids"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
