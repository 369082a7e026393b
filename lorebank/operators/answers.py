"""Question texts, grounded answers, citation checks and basic (whole-note) mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebank import constants as K
from lorebank.functions.columns import let
from lorebank.functions.provenance import note_source
from lorebank.functions.text import default_quote, is_blank, or_default, summary_of, trim_ws
from lorebank.functions.tokens import overlap_tokens
from lorebank.operators.lookback import preceding_rows
from lorebank.operators.scopes import in_scopes

QUESTION = ["user_id", "question_id"]


# ---- question text ------------------------------------------------------------------------------


def history_queries(turns: DataFrame) -> DataFrame:
    """Every user turn of a conversation as a standalone question.

    The six turns before it are its history; only then are roles and blanks filtered, and the question
    goes last. Very long conversations are split, see :func:`preceding_rows`.
    """
    said = F.struct("role", trim_ws("text").alias("text"))
    return (
        preceding_rows(turns, ["conv_id"], "turn", said, K.HISTORY_LIMIT, "history")
        .where((F.col("role") == "user") & ~is_blank("text"))
        .withColumn(
            "query",
            F.concat_ws(
                "\n",
                F.transform(
                    F.filter("history", lambda h: (h["role"] == "user") & (h["text"] != "")), lambda h: h["text"]
                ),
                trim_ws("text"),
            ),
        )
    )


# ---- citations ----------------------------------------------------------------------------------


def http_or_empty(url: Column) -> Column:
    return F.when(url.rlike(K.HTTP_URL), url).otherwise("")


def trusted_citation(quote: Column) -> Column:
    """Public citation of a context row."""
    return F.struct(
        F.col("chunk_id"),
        F.col("note_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        quote.alias("quote"),
        http_or_empty(F.coalesce("source", F.lit(""))).alias("source_url"),
    )


def note_citation() -> Column:
    """Public citation of a whole note."""
    return F.struct(
        F.col("note_id"),
        F.col("title"),
        default_quote("content").alias("quote"),
        http_or_empty(note_source("content", "source")).alias("source_url"),
    )


def check_chunk_citations(proposed: DataFrame, context: DataFrame) -> DataFrame:
    """Proposals whose chunk is in the question's context, whose note agrees and whose quote is verbatim.

    ``proposed``: user_id, question_id, pos, chunk_id, note_id, quote. The first 12 valid, distinct
    (chunk, quote) rows are kept in proposal order.
    """
    keys = [*QUESTION, "chunk_id", "note_id"]
    usable = proposed.where(
        F.col("quote").isNotNull() & ~is_blank("quote") & (F.length("quote") <= K.QUOTE_LIMIT)
    )
    found = usable.join(context.select(*keys, "title", "source", "content"), keys).where(
        F.contains("content", "quote")
    )
    once = found.groupBy(*keys, "quote").agg(
        F.min("pos").alias("pos"), F.first("title").alias("title"), F.first("source").alias("source")
    )
    order = Window.partitionBy(*QUESTION).orderBy("pos")
    return (
        once.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= K.CITATION_LIMIT)
        .withColumn("source_url", http_or_empty(F.coalesce("source", F.lit(""))))
        .drop("source")
    )


def check_note_citations(proposed: DataFrame, ranked_notes: DataFrame) -> DataFrame:
    """Note-level rule: the first 12 raw proposals, quote trimmed and cut to 500, duplicates kept."""
    order = Window.partitionBy(*QUESTION).orderBy("pos")
    first = (
        proposed.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= K.CITATION_LIMIT)
        .withColumn("quote", F.left(trim_ws("quote"), F.lit(K.QUOTE_LIMIT)))
        .where(F.col("quote") != "")
    )
    keys = [*QUESTION, "note_id"]
    return (
        first.join(ranked_notes.select(*keys, "title", "source", "content"), keys)
        .where(F.contains("content", "quote"))
        .withColumn("source_url", http_or_empty(note_source("content", "source")))
        .select(*keys, "pos", "title", "quote", "source_url")
    )


def locate_quote(content: Column | str, quote: Column | str) -> Column:
    """``struct<start, stop>`` of the first occurrence, null when the quote is not in the text."""
    c = F.col(content) if isinstance(content, str) else content
    q = F.col(quote) if isinstance(quote, str) else quote
    at = F.instr(c, q)
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(q)).alias("stop")))


# ---- answers over a context ---------------------------------------------------------------------


def _in_order(items: Column) -> Column:
    return F.array_sort(F.collect_list(items))


def answer_quote(content: Column | str) -> Column:
    """What an answer quotes of a chunk."""
    return F.left(trim_ws(content), F.lit(K.QUOTE_LIMIT))


def fallback_answers(questions: DataFrame, context: DataFrame) -> DataFrame:
    """One answer per question from its context (at most 8 rows per question, so a list is safe).

    Questions with an empty context get the fixed insufficient text. A context may bring its ``quote`` (:func:`answer_quote`) instead of the whole content.
    """
    quote = F.col("quote") if "quote" in context.columns else answer_quote("content")
    # lines are put together behind the shuffle, which so carries each quote once
    rows = context.where(quote != "").select(
        *QUESTION, "position", trusted_citation(quote).alias("citation"), F.col("title").isNotNull().alias("titled")
    )
    grouped = rows.groupBy(*QUESTION).agg(_in_order(F.struct("position", "citation", "titled")).alias("rows"))
    joined = questions.join(grouped, QUESTION, "left")

    def line(r: Column) -> Column:
        return F.when(r["titled"], F.concat(r["citation"]["title"], F.lit(": "), r["citation"]["quote"]))

    cited = F.coalesce(F.transform("rows", lambda r: r["citation"]), F.array().cast("array<struct<chunk_id:string,note_id:string,title:string,quote:string,source_url:string>>"))
    return joined.select(
        *questions.columns,
        F.coalesce(F.array_join(F.transform("rows", line), "\n\n"), F.lit(K.NO_EVIDENCE)).alias("answer"),
        F.array_distinct(F.transform(cited, lambda c: c["note_id"])).alias("source_ids"),
        cited.alias("citations"),
        F.col("rows").isNull().alias("insufficient"),
        F.lit("fallback").alias("mode"),
    )


def judge_model_outputs(outputs: DataFrame, citations: DataFrame) -> DataFrame:
    """Model replies after the citation check: insufficient when flagged, uncited or empty."""
    cited = citations.groupBy(*QUESTION).agg(
        _in_order(F.struct("position", "chunk_id", "note_id", "title", "quote", "source_url")).alias("citations")
    )
    answer = trim_ws(F.coalesce("knowledge_answer", F.lit("")))
    n = F.coalesce(F.size("citations"), F.lit(0))
    return (
        outputs.join(cited, QUESTION, "left")
        .withColumn("n_citations", F.when(F.col("citations").isNull(), 0).otherwise(n))
        .withColumn("insufficient", F.coalesce("insufficient", F.lit(False)) | (F.col("n_citations") == 0) | (answer == ""))
        .withColumn(
            "general_supplement", F.when(F.col("insufficient"), F.coalesce("general_supplement", F.lit(""))).otherwise("")
        )
        .withColumn("knowledge_answer", or_default(answer, K.NO_MODEL_ANSWER))
        .withColumn(
            "source_ids",
            F.coalesce(F.array_distinct(F.transform("citations", lambda c: c["note_id"])), F.array().cast("array<string>")),
        )
        .withColumn("mode", F.lit("model"))
    )


def prompt_contexts(context: DataFrame) -> DataFrame:
    """Context of each question as one JSON list, chunk texts wrapped in untrusted-text marks."""
    item = F.struct(
        "position",
        F.col("chunk_id").alias("chunkId"),
        F.col("note_id").alias("noteId"),
        "title",
        F.col("heading_path").alias("headingPath"),
        F.concat(F.lit(K.UNTRUSTED_OPEN), "content", F.lit(K.UNTRUSTED_CLOSE)).alias("content"),
    )
    return context.groupBy(*QUESTION).agg(
        F.to_json(F.transform(_in_order(item), lambda r: r.dropFields("position"))).alias("chunks_json"),
        F.count(F.lit(1)).alias("n_chunks"),
    )


# ---- basic mode ---------------------------------------------------------------------------------


def listing_key() -> Column:
    """Sortable text for newest first, then note id."""
    age = F.lit(2**62) - F.unix_micros("updated_at")
    return F.concat(F.lpad(age.cast("string"), 19, "0"), F.lit("|"), F.col("note_id"))


def note_search_text() -> Column:
    return F.concat_ws(" ", "title", "summary", F.concat_ws(" ", "tags"), "content")


def listed_note(listing: Column | str) -> Column:
    """The note id of a listing key."""
    c = F.col(listing) if isinstance(listing, str) else listing
    return F.substr(c, F.lit(21))


def recent_notes(questions: DataFrame, notes: DataFrame, k: int = K.BASIC_SCAN) -> DataFrame:
    """The first k notes in listing order inside each question's scope: user, question, note, listing rank.

    Questions of a user with one scope share one list; lists are cut at k before they meet their questions.
    """
    asked, rows = in_scopes(questions, notes.select("user_id", "note_id", "topic", "tags", listing_key().alias("listing")))
    newest = Window.partitionBy("user_id", "scope_id").orderBy("listing")
    listed = rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= k)
    return asked.select(*QUESTION, "scope_id").join(listed.select("user_id", "scope_id", "note_id", "rank"), ["user_id", "scope_id"]).drop("scope_id")


def shared_tokens(asked: Column, token_set: Column) -> Column:
    """How many of the asked tokens, repetitions counted, occur in a token set."""
    return let(
        F.array_intersect(asked, token_set), lambda common: F.size(F.filter(asked, lambda t: F.array_contains(common, t)))
    )


def rank_notes(questions: DataFrame, notes: DataFrame, scan: int = K.BASIC_SCAN, keep: int = K.BASIC_KEEP) -> DataFrame:
    """Overlap of question and note among the newest ``scan`` notes; best ``keep``, zero scores included.

    ``questions`` needs ``query``. Token sets are intersected per candidate row; at most ``scan``
    candidates exist per question.
    """
    candidates = recent_notes(questions, notes, scan)
    # Tokens only of notes that are somebody's candidate, each note once.
    wanted = candidates.select("user_id", "note_id").distinct()
    tokens = notes.join(wanted, ["user_id", "note_id"], "left_semi").select(
        "user_id", "note_id", F.array_distinct(overlap_tokens(note_search_text())).alias("note_tokens")
    )
    asked = questions.select(*QUESTION, overlap_tokens("query").alias("q_tokens"))
    # Comparing token lists is heavy per byte: a fixed partition count keeps AQE from merging the work.
    tasks = int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = (
        candidates.repartition(tasks, *QUESTION)
        .join(asked.repartition(tasks, *QUESTION), QUESTION)
        .join(tokens, ["user_id", "note_id"])
        .select(
            *QUESTION,
            "note_id",
            F.col("rank").alias("listing_rank"),
            shared_tokens(F.col("q_tokens"), F.col("note_tokens")).alias("score"),
        )
    )
    order = Window.partitionBy(*QUESTION).orderBy(F.desc("score"), F.asc("listing_rank"))
    return scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= keep)


def basic_answers(questions: DataFrame, ranked: DataFrame, notes: DataFrame, keep: int = K.BASIC_ANSWER) -> DataFrame:
    """Answer from the best three ranked notes with more than one shared token, or the fixed text."""
    order = Window.partitionBy(*QUESTION).orderBy("position")
    used = (
        ranked.where(F.col("score") > 1)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= keep)
        .join(notes.select("user_id", "note_id", "title", "summary", "content", "source"), ["user_id", "note_id"])
    )
    line = F.concat(F.lit(K.BASIC_LINE[0]), "title", F.lit(K.BASIC_LINE[1]), or_default("summary", summary_of("content")))
    grouped = used.groupBy(*QUESTION).agg(
        _in_order(F.struct("place", line.alias("line"), note_citation().alias("citation"))).alias("rows")
    )
    return questions.join(grouped, QUESTION, "left").select(
        *questions.columns,
        F.coalesce(F.array_join(F.transform("rows", lambda r: r["line"]), "\n\n"), F.lit(K.BASIC_NO_ANSWER)).alias("answer"),
        F.coalesce(
            F.transform("rows", lambda r: r["citation"]["note_id"]), F.array().cast("array<string>")
        ).alias("source_ids"),
        F.transform("rows", lambda r: r["citation"]).alias("citations"),
        F.col("rows").isNull().alias("insufficient"),
    )


def context_budget(ranked: DataFrame) -> DataFrame:
    """Characters each ranked note may use: 5 000 per note, 20 000 per question in rank order.

    ``ranked``: user_id, question_id, note_id, position, content.
    """
    before = Window.partitionBy(*QUESTION).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    want = F.least(F.length("content"), F.lit(K.CONTEXT_NOTE_CHARS))
    spent = F.coalesce(F.sum(want).over(before), F.lit(0))
    return ranked.withColumn(
        "chars", F.least(want, F.greatest(F.lit(0), F.lit(K.CONTEXT_TOTAL_CHARS) - spent)).cast("long")
    ).withColumn("excerpt", F.left("content", F.col("chars").cast("int")))


# ---- quality ------------------------------------------------------------------------------------


def retrieval_quality(expected: DataFrame, citations: DataFrame, first: int = 5) -> DataFrame:
    """Hit rate, verbatim share and leaks over all questions.

    ``expected``: user_id, question_id, expected_note, expected_ordinal, expected_quote.
    ``citations``: user_id, question_id, position, note_id, note_owner, ordinal, quote, content.
    """
    # note texts are compared where they are: behind the join by question a quote needs only the outcome
    marked = (
        citations.withColumn("verbatim", F.contains("content", "quote")).drop("content")
        .join(expected, QUESTION)
        .withColumn(
            "hit",
            (F.col("position") <= first)
            & (F.col("note_id") == F.col("expected_note"))
            & (F.col("ordinal") == F.col("expected_ordinal"))
            & F.contains("quote", "expected_quote"),
        )
        .groupBy(*QUESTION)
        .agg(
            F.bool_or("hit").alias("hit"),
            F.count_if("verbatim").alias("verbatim"),
            F.count_if(F.col("note_owner") != F.col("user_id")).alias("leaks"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return (
        expected.select(*QUESTION)
        .join(marked, QUESTION, "left")
        .agg(
            F.count(F.lit(1)).alias("questions"),
            F.count_if(F.col("hit")).alias("hits"),
            (F.count_if(F.col("hit")) / F.count(F.lit(1))).alias("hit_rate"),
            (F.sum("verbatim") / F.sum("n")).alias("verbatim_rate"),
            F.coalesce(F.sum("leaks"), F.lit(0)).alias("leaks"),
        )
    )
