"""Quality gates: every rule becomes a reason, rows keep their cleaned values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebank import constants as K
from lorebank.functions.text import or_default, trim_ws


def _text(c: str, default: str = "") -> Column:
    return or_default(c, default) if default else F.coalesce(F.col(c), F.lit(""))


def _reasons(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]))


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _clean(values: Column) -> Column:
    """Trimmed, blanks dropped, first-seen order, no duplicates."""
    return F.array_distinct(F.filter(F.transform(values, trim_ws), lambda t: t != ""))


def _longer(values: Column, limit: int) -> Column:
    return F.exists(values, lambda t: F.length(t) > limit)


def check_notes(notes: DataFrame) -> DataFrame:
    """Field limits of notes. Adds ``reasons`` and ``accepted``; texts get defaults, lists are cleaned."""
    tags, related = _list("tags"), _list("related_note_ids")
    title, topic = _text("title", K.UNTITLED_NOTE), _text("topic", K.DEFAULT_TOPIC)
    reasons = _reasons(
        (F.length(title) > K.TITLE_LIMIT, "title"),
        (F.length(_text("content")) > K.CONTENT_LIMIT, "content"),
        (F.length(_text("summary")) > K.SUMMARY_LIMIT, "summary"),
        ((F.size(tags) > K.TAG_COUNT_LIMIT) | _longer(tags, K.TAG_LENGTH_LIMIT), "tags"),
        (F.length(topic) > K.TOPIC_LIMIT, "topic"),
        (F.length(_text("source")) > K.SOURCE_LIMIT, "source"),
        ((F.size(related) > K.RELATED_COUNT_LIMIT) | _longer(related, K.RELATED_LENGTH_LIMIT), "related_note_ids"),
    )
    return notes.withColumns(
        {
            "reasons": reasons,
            "accepted": F.size(reasons) == 0,
            "title": title,
            "content": _text("content"),
            "summary": _text("summary"),
            "tags": _clean(tags),
            "topic": topic,
            "source": _text("source"),
            "related_note_ids": _clean(related),
        }
    )


def _scope_rules(c: str) -> tuple[tuple[Column, str], ...]:
    values = _list(c)
    kept = F.filter(F.transform(values, trim_ws), lambda t: t != "")
    return (
        (F.size(values) > K.SCOPE_COUNT_LIMIT, f"{c}:too_many"),
        (_longer(values, K.SCOPE_LENGTH_LIMIT), f"{c}:invalid"),
        (F.size(F.array_distinct(kept)) != F.size(kept), f"{c}:duplicate"),
    )


def check_questions(questions: DataFrame) -> DataFrame:
    """Limits of questions, their history and scope. Needs question, history, scope_* columns."""
    history = F.col("history")
    reasons = _reasons(
        (F.length(F.coalesce("question", F.lit(""))) > K.QUESTION_LIMIT, "question:too_long"),
        (trim_ws(F.coalesce("question", F.lit(""))) == "", "question:empty"),
        (F.size(history) > K.HISTORY_LIMIT, "history:too_many"),
        (F.exists(history, lambda h: ~F.coalesce(h["role"].isin("user", "assistant"), F.lit(False))), "history:role"),
        (F.exists(history, lambda h: F.length(h["text"]) > K.HISTORY_TEXT_LIMIT), "history:too_long"),
        *_scope_rules("scope_note_ids"),
        *_scope_rules("scope_topics"),
        *_scope_rules("scope_tags"),
    )
    return questions.withColumns(
        {"reasons": reasons, "accepted": F.size(reasons) == 0, "question": trim_ws("question")}
    )


def normalise_notes(notes: DataFrame, now: Column) -> DataFrame:
    """Loose rows coerced to the note schema: defaults filled, lists cut to their limits."""
    return notes.withColumns(
        {
            "title": _text("title", K.UNTITLED_NOTE),
            "content": _text("content"),
            "summary": _text("summary"),
            "tags": F.slice(_list("tags"), 1, K.TAG_COUNT_LIMIT),
            "topic": _text("topic", K.DEFAULT_TOPIC),
            "source": _text("source"),
            "related_note_ids": F.slice(_list("related_note_ids"), 1, K.RELATED_COUNT_LIMIT),
            "created_at": F.coalesce("created_at", now),
            "updated_at": F.coalesce("updated_at", now),
        }
    )
