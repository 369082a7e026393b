"""Scopes of questions as sets of notes, resolved once per distinct scope and ahead of every channel.

A scope lists note ids, topics and tags; each list that is not empty must be met, by one of its entries. Questions of one user that share a scope
share its set, so the work follows the number of different scopes. Lists are exploded and equi-joined; a note is in the set when it
meets as many lists as the scope has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LISTS = ("scope_note_ids", "scope_topics", "scope_tags")


def with_scope_id(questions: DataFrame) -> DataFrame:
    """``scope_id``: a name of the scope; ``all`` without one. Order and repetitions inside a list do not matter."""
    if LISTS[0] not in questions.columns:
        return questions.withColumn("scope_id", F.lit("all"))
    sets = [F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))) for c in LISTS]
    named = F.sha2(F.to_json(F.struct(*[s.alias(c) for s, c in zip(sets, LISTS)])), 256)
    empty = sum((F.size(s) for s in sets), F.lit(0)) == 0
    return questions.withColumn("scope_id", F.when(empty, "all").otherwise(named))


def scope_members(questions: DataFrame, notes: DataFrame) -> DataFrame:
    """``user_id, scope_id, note_id`` of every scope that the questions name (not of ``all``).

    ``notes``: user_id, note_id, topic, tags.
    """
    scopes = with_scope_id(questions).where("scope_id <> 'all'").select("user_id", "scope_id", *LISTS).dropDuplicates(["user_id", "scope_id"])
    needed = scopes.select("user_id", "scope_id", sum((F.when(F.size(c) > 0, 1).otherwise(0) for c in LISTS), F.lit(0)).alias("needed"))
    sides = (
        ("scope_note_ids", notes.select("user_id", "note_id", F.col("note_id").alias("entry"))),
        ("scope_topics", notes.select("user_id", "note_id", F.col("topic").alias("entry"))),
        ("scope_tags", notes.select("user_id", "note_id", F.explode(F.array_distinct("tags")).alias("entry"))),
    )
    met = None
    for n, (column, side) in enumerate(sides):
        entries = scopes.select("user_id", "scope_id", F.explode(F.array_distinct(column)).alias("entry"))
        part = entries.join(side, ["user_id", "entry"]).select("user_id", "scope_id", "note_id", F.lit(1 << n).alias("list"))
        met = part if met is None else met.unionByName(part)
    # several tags of one note meet one list
    counted = met.groupBy("user_id", "scope_id", "note_id").agg(F.bit_count(F.bit_or("list")).alias("met"))
    return counted.join(needed, ["user_id", "scope_id"]).where(F.col("met") == F.col("needed")).select("user_id", "scope_id", "note_id")


def in_scopes(questions: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions and rows (chunks or notes, with note_id, topic, tags) keyed by (user, scope): a row is copied into each scope asked for that holds it."""
    asked = with_scope_id(questions)
    if LISTS[0] not in questions.columns:
        return asked, rows.withColumn("scope_id", F.lit("all"))
    notes = rows.select("user_id", "note_id", "topic", "tags").dropDuplicates(["user_id", "note_id"])
    open_users = asked.where("scope_id = 'all'").select("user_id").distinct()
    free = rows.join(open_users, "user_id", "left_semi").withColumn("scope_id", F.lit("all"))
    scoped = rows.join(scope_members(questions, notes), ["user_id", "note_id"])
    return asked, free.unionByName(scoped.select(*free.columns))
