"""Deterministic organiser: tags, topic, related notes, analysis clean-up, generated documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebank import constants as K
from lorebank.functions.provenance import note_source
from lorebank.functions.text import or_default, summary_of, title_with_fallback
from lorebank.functions.tokens import overlap_tokens
from lorebank.operators.answers import listed_note, listing_key, note_citation, rank_notes
from lorebank.operators.overlap import overlap_topk


_RELATED = "array<struct<id:string,reason:string>>"


def _mentions(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def rule_tags(text: Column, rules=K.TAG_RULES, default: str = K.DEFAULT_TAG) -> Column:
    """Tags whose words occur in the text (case-sensitive), in rule order; the default when none does."""
    found = F.array_compact(F.array(*[F.when(_mentions(text, words), F.lit(tag)) for tag, words in rules]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def rule_topic(text: Column, rules=K.TOPIC_RULES, default: str = K.FALLBACK_TOPIC) -> Column:
    topic = None
    for name, word in rules:
        hit = F.contains(text, F.lit(word))
        topic = F.when(hit, name) if topic is None else topic.when(hit, name)
    return topic.otherwise(default)


def related_notes(notes: DataFrame, of: DataFrame | None = None, keep: int = K.RELATED_KEEP) -> DataFrame:
    """For each note the three others sharing most tokens (more than one), newest first on equal scores.

    ``of`` limits the left side to new or changed notes; by default every note asks. Left tokens come
    from title and content with repetitions, right tokens from title, summary and tags. The listing key, which
    ends with the note id, is the right id: it orders equal scores.
    """
    left = (notes if of is None else of).select(
        "user_id", F.col("note_id").alias("id"), overlap_tokens(F.concat_ws("\n", "title", "content")).alias("tokens")
    )
    right = notes.select(
        "user_id", listing_key().alias("id"), F.col("note_id").alias("own"), overlap_tokens(F.concat_ws(" ", "title", "summary", F.concat_ws(" ", "tags"))).alias("tokens")
    )
    top = overlap_topk(left, right, ["user_id"], keep, above=1, right_block=131_072)  # right rows are short, left ones are what copies cost
    return top.select("user_id", F.col("left_id").alias("note_id"), listed_note("right_id").alias("related_id"), "score", "rank")


def organise(notes: DataFrame) -> DataFrame:
    """Title, summary, tags, topic and related notes for every note (at most three related, so a list is safe)."""
    text = F.concat_ws("\n", "title", "content")
    titles = notes.select("user_id", F.col("note_id").alias("related_id"), F.col("title").alias("related_title"))
    reason = F.concat(F.lit(K.RELATED_REASON[0]), "related_title", F.lit(K.RELATED_REASON[1]))
    related = (
        related_notes(notes)
        .join(titles, ["user_id", "related_id"])
        .groupBy("user_id", "note_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", F.col("related_id").alias("id"), reason.alias("reason")))).alias("related"))
    )
    return notes.join(related, ["user_id", "note_id"], "left").select(
        "user_id",
        "note_id",
        title_with_fallback("content", "title").alias("title_suggestion"),
        summary_of("content").alias("summary"),
        rule_tags(text).alias("tags"),
        rule_topic(text).alias("topic"),
        F.coalesce(
            F.transform("related", lambda r: F.struct(r["id"].alias("id"), r["reason"].alias("reason"))),
            F.array().cast(_RELATED),
        ).alias("related_notes"),
        F.lit(K.FALLBACK_REASONING).alias("reasoning"),
    )


def clean_analyses(analyses: DataFrame, notes: DataFrame) -> DataFrame:
    """Model analyses (title_suggestion, summary, tags, topic, related_notes, reasoning) made trustworthy.

    Defaults are filled, six tags are kept, and related notes (id and reason) must be notes of the same user (first five).
    """
    lib = notes.select("user_id", "note_id", F.col("title").alias("note_title"), F.col("summary").alias("note_summary"), "content")
    proposed = analyses.select("user_id", "note_id", F.posexplode("related_notes").alias("pos", "r")).select(
        "user_id", "note_id", "pos", F.col("r.id").alias("related_id"), F.col("r.reason").alias("reason")
    )
    existing = proposed.join(
        notes.select("user_id", F.col("note_id").alias("related_id")), ["user_id", "related_id"], "left_semi"
    )
    first = Window.partitionBy("user_id", "note_id").orderBy("pos")
    related = (
        existing.withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= K.ANALYSIS_RELATED)
        .groupBy("user_id", "note_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", F.col("related_id").alias("id"), "reason"))).alias("related"))
    )
    return (
        analyses.join(lib, ["user_id", "note_id"])
        .join(related, ["user_id", "note_id"], "left")
        .select(
            "user_id",
            "note_id",
            or_default("title_suggestion", title_with_fallback("content", "note_title")).alias("title_suggestion"),
            or_default("summary", or_default("note_summary", K.MISSING_SUMMARY)).alias("summary"),
            F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, K.ANALYSIS_TAGS).alias("tags"),
            or_default("topic", K.DEFAULT_TOPIC).alias("topic"),
            F.coalesce(F.transform("related", lambda r: F.struct(r["id"].alias("id"), r["reason"].alias("reason"))), F.array().cast(_RELATED)).alias("related_notes"),
            or_default("reasoning", K.DEFAULT_REASONING).alias("reasoning"),
        )
    )


def generated_documents(requests: DataFrame, notes: DataFrame) -> DataFrame:
    """One Markdown document per request from its best eight notes.

    ``requests``: user_id, request_id, output_type, scope_note_ids (empty = all notes). Notes are
    ranked by overlap with the output type among the newest twenty in scope.
    """
    empty = F.array().cast("array<string>")
    asked = requests.select(
        "user_id",
        F.col("request_id").alias("question_id"),
        F.col("output_type").alias("query"),
        F.coalesce("scope_note_ids", empty).alias("scope_note_ids"),
        empty.alias("scope_topics"),
        empty.alias("scope_tags"),
    )
    chosen = rank_notes(asked, notes).join(
        notes.select("user_id", "note_id", "title", "summary", "content", "source"), ["user_id", "note_id"]
    )
    origin = note_source("content", "source")
    listed = F.concat(
        F.col("position").cast("string"), F.lit(". "), "title", F.lit("\n   - "), or_default("summary", summary_of("content"))
    )
    cited = F.concat(F.lit("- "), "title", F.when(origin != "", F.concat(F.lit("："), origin)).otherwise(""))
    grouped = (
        chosen.groupBy("user_id", F.col("question_id").alias("request_id"))
        .agg(
            F.array_sort(
                F.collect_list(F.struct("position", listed.alias("listed"), cited.alias("cited"), note_citation().alias("citation")))
            ).alias("rows")
        )
    )
    names = F.create_map(*[F.lit(x) for pair in K.OUTPUT_TITLES.items() for x in pair])
    title = F.coalesce(F.try_element_at(names, F.col("output_type")), F.lit(K.OUTPUT_DEFAULT_TITLE))
    rows = F.coalesce("rows", F.array().cast(grouped.schema["rows"].dataType))
    return requests.join(grouped, ["user_id", "request_id"], "left").select(
        "user_id",
        "request_id",
        "output_type",
        F.concat(
            F.lit("# "), title, F.lit(f"\n\n{K.OUTPUT_SOURCES_HEADING}\n"),
            F.array_join(F.transform(rows, lambda r: r["listed"]), "\n"),
            F.lit(f"\n\n{K.OUTPUT_CITATIONS_HEADING}\n"),
            F.array_join(F.transform(rows, lambda r: r["cited"]), "\n"), F.lit("\n"),
        ).alias("markdown"),
        F.transform(rows, lambda r: r["citation"]).alias("citations"),
    )
