"""Library views: listing, search, scopes, facets, options and relation edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebank import constants as K
from lorebank.functions.text import is_blank, trim_ws


def list_notes(notes: DataFrame, user_id: str | None = None) -> DataFrame:
    """One user's notes, newest first, then by id. Without a user: the whole library in that order per user."""
    if user_id is None:
        return notes.orderBy("user_id", F.desc("updated_at"), "note_id")
    return notes.where(F.col("user_id") == user_id).orderBy(F.desc("updated_at"), "note_id")


def search_library(notes: DataFrame, needle: str = "", tag: str | None = None) -> DataFrame:
    """Case-insensitive substring over title, summary, tags and content, and an optional tag."""
    found = notes
    if tag is not None and tag != K.ALL_TAGS:
        found = found.where(F.array_contains("tags", tag))
    words = F.lower(trim_ws(F.lit(needle)))
    text = F.lower(F.concat_ws(" ", "title", "summary", F.concat_ws(" ", "tags"), "content"))
    return found.where((words == "") | F.contains(text, words))


def in_scope(note_ids: list[str] = (), topics: list[str] = (), tags: list[str] = ()) -> Column:
    """One scope as a filter: any of each list, all lists together; an empty list allows everything."""
    keep = F.lit(True)
    if note_ids:
        keep = keep & F.col("note_id").isin(*note_ids)
    if topics:
        keep = keep & F.col("topic").isin(*topics)
    if tags:
        keep = keep & F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))
    return keep


def tag_facets(notes: DataFrame) -> DataFrame:
    """Notes per user and tag (each note once per tag), plus the row for all notes."""
    per_tag = (
        notes.select("user_id", F.explode(F.array_distinct("tags")).alias("tag"))
        .groupBy("user_id", "tag")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    everything = notes.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.lit(K.ALL_TAGS).alias("tag"), "n")
    return everything.unionByName(per_tag)


def filter_options(notes: DataFrame) -> DataFrame:
    """Distinct non-empty topics and tags per user."""
    topics = notes.select("user_id", F.lit("topic").alias("kind"), F.col("topic").alias("value"))
    tags = notes.select("user_id", F.lit("tag").alias("kind"), F.explode("tags").alias("value"))
    return topics.unionByName(tags).where(F.col("value") != "").distinct()


def by_locale(df: DataFrame, *columns: str) -> DataFrame:
    """Order texts the way a reader of any language expects."""
    return df.orderBy(*[F.collate(c, "UNICODE") for c in columns])


def relation_edges(notes: DataFrame) -> DataFrame:
    """Related ids as edges; ids without a note of the same user are dropped."""
    ends = notes.select("user_id", F.col("note_id").alias("to_note"), F.col("title").alias("to_title"))
    return (
        notes.select("user_id", F.col("note_id").alias("from_note"), F.posexplode("related_note_ids").alias("pos", "to_note"))
        .join(ends, ["user_id", "to_note"])
    )


def unindexed(notes: DataFrame, current_chunks: DataFrame) -> DataFrame:
    """Notes with text but without a chunk of their content."""
    return notes.where(~is_blank("content")).join(
        current_chunks.select("user_id", "note_id"), ["user_id", "note_id"], "left_anti"
    )
