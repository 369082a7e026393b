"""Markdown vaults: front matter, a directory of files as notes, and notes back to files."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebank import constants as K
from lorebank.functions.text import col_of, file_name_of, or_default, title_from_body, trim_ws

_FRONT = r"(?s)^---\n(.*?)\n---\n?"


def _scalar(value: Column) -> Column:
    return F.regexp_replace(trim_ws(value), r"""^["']|["']$""", "")


def _list(value: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(value, r"^\[", ""), r"\]$", "")
    items = F.filter(F.transform(F.split(inner, ","), _scalar), lambda x: x != "")
    return F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(items)


def front_matter(markdown: Column | str) -> Column:
    """``struct<title, summary, topic, source, created_at, tags, related_note_ids>``; absent fields are null.

    Lines split at their first colon, the last line of a name wins.
    """
    md = col_of(markdown)
    lines = F.split(F.regexp_extract(md, _FRONT, 1), "\n")

    def field(name: str) -> Column:
        own = F.filter(lines, lambda line: trim_ws(F.get(F.split(line, ":", 2), F.lit(0))) == name)
        return F.when(md.rlike(_FRONT), trim_ws(F.regexp_extract(F.try_element_at(own, F.lit(-1)), r"(?s)^[^:]*:(.*)$", 1)))

    return F.struct(
        *[_scalar(field(n)).alias(a) for n, a in (("title", "title"), ("summary", "summary"), ("topic", "topic"), ("source", "source"), ("createdAt", "created_at"))],
        _list(field("tags")).alias("tags"),
        _list(field("relatedNoteIds")).alias("related_note_ids"),
    )


def note_fields(markdown: Column | str, file_name: Column | str) -> Column:
    """Note fields of one Markdown file; the file name is the source."""
    md = col_of(markdown)
    meta = front_matter(md)
    body = trim_ws(F.regexp_replace(md, _FRONT, ""))
    return F.struct(
        F.coalesce(meta["title"], title_from_body(body)).alias("title"),
        body.alias("content"),
        F.coalesce(meta["summary"], F.lit("")).alias("summary"),
        meta["tags"].alias("tags"),
        F.coalesce(meta["topic"], F.lit(K.DEFAULT_TOPIC)).alias("topic"),
        col_of(file_name).alias("source"),
        meta["created_at"].alias("created_at"),
        meta["related_note_ids"].alias("related_note_ids"),
    )


def _decoded(c: str) -> Column:
    """File names arrive percent-encoded; a plus sign stands for itself."""
    return F.url_decode(F.replace(F.col(c), F.lit("+"), F.lit("%2B")))


def read_vault(spark: SparkSession, path: str, user_id: str) -> DataFrame:
    """All ``*.md`` files under a directory, one note per file."""
    files = (
        spark.read.option("pathGlobFilter", "*.md")
        .option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select("value", _decoded("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"))
    )
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return files.select(
        F.lit(user_id).alias("user_id"),
        F.concat(F.lit("md-"), F.sha2("path", 256)).alias("note_id"),
        note_fields("value", "file").alias("n"),
    ).select("user_id", "note_id", "n.*").withColumn("created_at", F.coalesce("created_at", now)).withColumn("updated_at", now)


def _quoted(value: Column) -> Column:
    text = F.coalesce(value, F.lit(""))
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))


def _quoted_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, _quoted), ", "), F.lit("]"))


def to_markdown() -> Column:
    """A note as a Markdown file: front matter, blank line, body."""

    def stamp(c: str) -> Column:
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    return F.concat(
        F.concat_ws(
            "\n",
            F.lit("---"),
            F.concat(F.lit("title: "), _quoted(F.col("title"))),
            F.concat(F.lit("summary: "), _quoted(F.col("summary"))),
            F.concat(F.lit("tags: "), _quoted_list(F.col("tags"))),
            F.concat(F.lit("topic: "), _quoted(F.col("topic"))),
            F.concat(F.lit("source: "), _quoted(F.col("source"))),
            F.concat(F.lit("createdAt: "), stamp("created_at")),
            F.concat(F.lit("updatedAt: "), stamp("updated_at")),
            F.concat(F.lit("relatedNoteIds: "), _quoted_list(F.col("related_note_ids"))),
            F.lit("---"),
        ),
        F.lit("\n\n"),
        trim_ws("content"),
        F.lit("\n"),
    )


def vault_files(notes: DataFrame) -> DataFrame:
    """``user_id, note_id, file_name, markdown``; titles that collide within a user carry the note id.

    The collision count pre-aggregates per (user, name); the join back streams the notes, so a name
    shared by very many notes costs no group.
    """
    named = notes.select("user_id", "note_id", file_name_of("title").alias("stem"), to_markdown().alias("markdown"))
    shared = (
        notes.select("user_id", file_name_of("title").alias("stem"))
        .groupBy("user_id", "stem")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )
    name = F.concat("stem", F.when(F.col("n").isNotNull(), F.concat(F.lit("-"), "note_id")).otherwise(""), F.lit(".md"))
    return named.join(shared, ["user_id", "stem"], "left").select("user_id", "note_id", name.alias("file_name"), "markdown")


def write_vault(files: DataFrame, root: str) -> DataFrame:
    """Write one file per row under ``root/<user>/`` from the tasks; returns a lazy table of written files.

    Files are named by content key, so a retried task rewrites the same file. A path without a scheme names each executor's own disk: only a ``local``
    master may use one.
    """
    master = files.sparkSession.sparkContext.master
    if "://" not in root and master != "local" and not master.startswith("local["):
        raise ValueError(f"{root} needs a scheme that all executors share (master {master})")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        filesystem, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        made = set()
        for batch in batches:
            sizes = []
            for user, name, text in zip(batch["user_id"], batch["file_name"], batch["markdown"], strict=True):
                folder = posixpath.join(base, user)
                if folder not in made:
                    filesystem.create_dir(folder, recursive=True)
                    made.add(folder)
                data = text.encode("utf-8")
                with filesystem.open_output_stream(posixpath.join(folder, name)) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"user_id": batch["user_id"], "file_name": batch["file_name"], "n_bytes": sizes})

    return files.select("user_id", "file_name", "markdown").mapInPandas(write, "user_id string, file_name string, n_bytes long")
