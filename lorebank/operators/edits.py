"""Note edits: patches, tag merging and bulk tag edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebank import constants as K
from lorebank.functions.text import content_hash, or_default, trim_ws

NOTE_KEY = ["user_id", "note_id"]
PATCHABLE = ("title", "content", "summary", "tags", "topic", "source", "related_note_ids")
_DEFAULTS = {"title": K.UNTITLED_NOTE, "topic": K.DEFAULT_TOPIC}


def apply_patches(notes: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """Present (non-null) patch fields replace the note's; the update time moves only on patched notes.

    ``content_changed`` tells which notes need a new index entry: metadata edits do not.
    """
    fields = [f for f in PATCHABLE if f in patches.columns]
    p = patches.select(*NOTE_KEY, *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(True).alias("patched"))
    joined = notes.join(p, NOTE_KEY, "left")

    def merged(f: str) -> Column:
        value = F.coalesce(f"new_{f}", f)
        return or_default(value, _DEFAULTS[f]) if f in _DEFAULTS else value

    changed = F.lit(False)
    if "content" in fields:
        changed = F.col("new_content").isNotNull() & (content_hash("new_content") != content_hash("content"))
    hit = F.coalesce("patched", F.lit(False))
    out = joined.withColumns(
        {
            "content_changed": F.coalesce(changed, F.lit(False)),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        }
    )
    # one projection: every merged field reads the values before the patch
    keep = [c for c in out.columns if not c.startswith("new_") and c != "patched"]
    return out.select(*[merged(c).alias(c) if c in fields else F.col(c) for c in keep])


def merge_tags(current: Column | str, following: Column | str) -> Column:
    """Union in order, trimmed, blanks dropped, first eight kept."""
    both = F.concat(*[F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>")) for c in (current, following)])
    return F.slice(F.array_distinct(F.filter(F.transform(both, trim_ws), lambda t: t != "")), 1, K.MERGED_TAG_LIMIT)


def clean_tag(tag: Column | str) -> Column:
    return F.regexp_replace(trim_ws(tag), "^#", "")


def apply_tag_edits(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """Ordered add/remove edits (``user_id, note_id, seq, op, tag``) applied in bulk.

    Only the state after a tag's last removal counts, so edits reduce per (note, tag) before anything
    is gathered; a note's gathered list holds distinct tags only. Tags added again move to the end.
    """
    keys = [*NOTE_KEY, "tag"]
    typed = edits.withColumn("tag", F.when(F.col("op") == "add", clean_tag("tag")).otherwise(F.col("tag"))).where(F.col("tag") != "")
    removed = typed.where(F.col("op") == "remove").groupBy(*keys).agg(F.max("seq").alias("removed_at"))
    added = (
        typed.where(F.col("op") == "add")
        .join(removed, keys, "left")
        .where(F.col("removed_at").isNull() | (F.col("seq") > F.col("removed_at")))
        .groupBy(*keys)
        .agg(F.min("seq").alias("added_at"))
    )
    per_note = (
        removed.join(added, keys, "full_outer")
        .groupBy(*NOTE_KEY)
        .agg(
            F.collect_set(F.when(F.col("removed_at").isNotNull(), F.col("tag"))).alias("dropped"),
            F.array_sort(
                F.collect_set(F.when(F.col("added_at").isNotNull(), F.struct("added_at", "tag")))
            ).alias("gained"),
        )
    )
    empty = F.array().cast("array<string>")
    return (
        notes.join(per_note, NOTE_KEY, "left")
        .withColumn(
            "tags",
            F.array_distinct(
                F.concat(
                    F.array_except("tags", F.coalesce("dropped", empty)),
                    F.coalesce(F.transform("gained", lambda g: g["tag"]), empty),
                )
            ),
        )
        .drop("dropped", "gained")
    )
