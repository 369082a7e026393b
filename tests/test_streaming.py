import os
import random
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorebank.functions.embed import hash_embedder
from lorebank.plans.stream_queries import stream_index_q
from lorebank.streaming import edits as SE
from lorebank.streaming import indexing as SI
from lorebank.streaming import quotas as SQ
from lorebank.streaming import retry as SR

T0 = datetime(2024, 1, 1, 12, 0, 0)
VERSION = "user_id string, note_id string, version long, content string, deleted boolean, updated_at timestamp"


def drop(spark, folder, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def version(note, n, content, deleted=False):
    return ("u", note, n, content, deleted, T0 + timedelta(minutes=n))


def test_index_stream_survives_restarts_and_fences_late_versions(spark, tmp_path):
    inbox, root, check = (str(tmp_path / x) for x in ("in", "root", "check"))

    def step(name, rows):
        drop(spark, inbox, rows, VERSION, name)
        source = spark.readStream.schema(VERSION).option("recursiveFileLookup", "true").parquet(inbox)
        SI.start_index_stream(source, root, check, hash_embedder(32)).awaitTermination()
        chunks = {(r.note_id, r.content) for r in SI.read_chunks(spark, root).collect()}
        return chunks, {r.note_id: r for r in SI.read_ledger(spark, root).collect()}

    chunks, ledger = step("1", [version("a", 1, "one"), version("a", 2, "two"), version("b", 1, "bee"), version("blank", 1, " ")])
    assert chunks == {("a", "two"), ("b", "bee")}
    assert ledger["blank"].status == "ready" and ledger["a"].version == 2
    # a late version, a metadata-only edit and a new note
    chunks, ledger = step("2", [version("a", 1, "late"), version("b", 5, "bee"), version("c", 1, "sea")])
    assert chunks == {("a", "two"), ("b", "bee"), ("c", "sea")}
    assert ledger["b"].version == 1 and ledger["b"].batch == 0
    chunks, ledger = step("3", [version("b", 6, "", deleted=True), version("c", 2, "x y z")])
    assert chunks == {("a", "two"), ("c", "x y z")}
    assert ledger["b"].deleted

    target = str(tmp_path / "compact")
    SI.compact(spark, root, target)
    assert {(r.note_id, r.content) for r in SI.read_chunks(spark, target).collect()} == chunks
    with pytest.raises(ValueError):
        SI.compact(spark, root, target)

    # a fresh checkpoint on the compacted copy, then the same one again: nothing stored is overwritten
    for name, rows in (("4", [version("d", 1, "dee")]), ("5", [version("e", 1, "eye")])):
        drop(spark, str(tmp_path / "in2"), rows, VERSION, name)
        source = spark.readStream.schema(VERSION).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in2"))
        SI.start_index_stream(source, target, str(tmp_path / "fresh")).awaitTermination()
    assert {(r.note_id, r.content) for r in SI.read_chunks(spark, target).collect()} == chunks | {("d", "dee"), ("e", "eye")}
    assert len({r.batch for r in SI.read_ledger(spark, target).collect()}) == 3


JOB_EVENT = "user_id string, note_id string, content_hash string, ts timestamp, event string"
F_, OK, Q_, R_ = "failed", "ok", "queued", "retry"


def job_changes(spark, folder, batches, delay="365 days"):
    """Changes of the retry stream over micro-batches of (note, second, event, hash) rows; a clock far ahead ends it."""
    batches = [*batches, [("", 400 * 86_400 + 10**6, "clock", "")]]
    for i, rows in enumerate(batches):
        drop(spark, f"{folder}/in", [("u", n, h, T0 + timedelta(seconds=t), e) for n, t, e, h in rows], JOB_EVENT, f"{i:02d}")
        time.sleep(0.02)  # files are read by their age
    source = spark.readStream.schema(JOB_EVENT).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    name = "jobs_" + os.path.basename(folder).replace("-", "_")
    q = SR.retry_stream(source, delay).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/c").start()
    q.awaitTermination()
    return spark.table(name)


def job_by_hand(events):
    """The rules of a note's job read one after another: hash, failures since the last fresh start, status, next attempt, announced attempts."""
    h, n, status, due, told = None, 0, None, None, []
    for t, e, eh in sorted(events, key=lambda x: (x[0], [Q_, R_, OK, F_].index(x[1]), x[2])):
        if status == "pending" and due is not None and due <= t:
            told.append(due)
            due = None
        if e == Q_ or (e == R_ and status == "failed"):
            h, n, status, due = eh if e == Q_ else h, 0, "pending", t
        elif e in (OK, F_) and status != "failed" and h in (None, eh):
            h = eh
            if e == OK:
                n, status, due = 0, "ready", None
            else:
                n += 1
                status, due = ("pending", t + (5, 30, 300)[n - 1]) if n < 4 else ("failed", None)
    if status == "pending" and due is not None:
        told.append(due)
    return h, n, status, told


def test_jobs_start_afresh_after_success_queueing_and_manual_retry(spark, tmp_path):
    plans = {
        "ok": [F_, F_, F_, OK, F_],
        "spent": [F_, F_, F_, F_, F_, OK],
        "queued": [F_, F_, F_, Q_, F_],
        "by hand": [F_, F_, F_, F_, R_, F_],
        "not failed": [F_, F_, R_, F_],
    }
    rows = [(note, 1000 * i, e, "h") for note, events in plans.items() for i, e in enumerate(events)]
    rows += [("stale", 0, Q_, "new"), ("stale", 10, F_, "old"), ("stale", 20, OK, "new"), ("stale", 30, F_, "old")]
    changes = job_changes(spark, str(tmp_path), [rows])
    got = {r.note_id: (r.attempts, r.status) for r in SR.latest_jobs(changes).collect()}
    assert got == {"ok": (1, "pending"), "spent": (4, "failed"), "queued": (1, "pending"), "by hand": (1, "pending"), "not failed": (3, "pending"), "stale": (0, "ready")}
    due = sorted((r.at - T0).total_seconds() for r in changes.where("due AND note_id = 'spent'").collect())
    assert due == [5, 1030, 2300]


@pytest.mark.parametrize("seed", [1, 2])
def test_jobs_do_not_depend_on_batching(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"n{i % 12}", rng.randrange(2000), rng.choice([F_, F_, F_, OK, Q_, R_]), rng.choice("ab")) for i in range(240)]
    changes = job_changes(spark, str(tmp_path), [rows[a : a + 60] for a in range(0, 240, 60)])
    told = {}
    for r in changes.where("due").collect():
        told.setdefault(r.note_id, []).append((r.at - T0).total_seconds())
    got = {r.note_id: (r.content_hash, r.attempts, r.status, sorted(told.get(r.note_id, []))) for r in SR.latest_jobs(changes).collect()}
    want = {n: job_by_hand([r[1:] for r in rows if r[0] == n]) for n in {r[0] for r in rows}}
    assert got == {n: w for n, w in want.items() if w[2]}


def test_due_attempts_come_without_new_events_and_late_events_are_dropped(spark, tmp_path):
    first, clock = [("n", 0, F_, "h")], lambda t: [("", t, "clock", "")]
    changes = job_changes(spark, str(tmp_path), [first, clock(3), clock(100), clock(101), [("n", 50, OK, "h")]], "1 second")
    assert [(r.step, r.due, r.status, (r.at - T0).total_seconds()) for r in changes.orderBy("step").collect()] == [(1, False, "pending", 0), (2, True, "pending", 5)]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    batch = spark.createDataFrame([version("a", 1, "one")], VERSION)
    SI.process_batch(batch, 0, root)
    SI.process_batch(batch, 0, root)
    assert SI.read_chunks(spark, root).count() == 1
    SI.process_batch(batch, 1, root)
    assert SI.read_chunks(spark, root).count() == 1 and SI.read_ledger(spark, root).first().batch == 0


def test_a_text_that_cannot_be_embedded_fails_alone(spark, tmp_path):
    root = str(tmp_path)

    def embedder(texts):
        if texts.str.contains("bad").any():
            raise ValueError("no")
        return hash_embedder(8)(texts)

    def step(n, second, *rows):
        rows = rows or [(None,) * 6]
        SI.process_batch(spark.createDataFrame(rows, VERSION), n, root, embedder, now=F.lit(T0 + timedelta(seconds=second)))
        ledger = {r.note_id: (r.status, r.attempts, r.available_at and (r.available_at - T0).total_seconds(), r.last_error) for r in SI.read_ledger(spark, root).collect()}
        assert {r.note_id for r in SI.read_chunks(spark, root).collect()} == {n for n, r in ledger.items() if r[0] == "ready"}
        return ledger

    assert step(0, 0, version("a", 1, "good"), version("b", 1, "bad"), version("c", 1, "bad too"), version("d", 1, "fine")) == {
        "a": ("ready", 0, None, None), "d": ("ready", 0, None, None), "b": ("pending", 1, 5, "Indexing failed."), "c": ("pending", 1, 5, "Indexing failed.")
    }
    assert step(1, 3)["b"][1] == 1  # not due yet
    assert step(2, 5, version("c", 2, "readable"))["b"] == ("pending", 2, 35, "Indexing failed.")
    ledger = step(3, 40)
    assert ledger["b"] == ("pending", 3, 340, "Indexing failed.") and ledger["c"] == ("ready", 0, None, None)
    target = f"{root}/compact"
    SI.compact(spark, root, target)
    assert {r.note_id for r in SI.read_chunks(spark, target).collect()} == {"a", "c", "d"}
    root = target
    assert step(4, 400)["b"] == ("failed", 4, None, "Indexing failed.")
    assert step(5, 9000)["b"][1] == 4 and step(6, 9000, version("b", 3, "good at last"))["b"] == ("ready", 0, None, None)


def test_freshness_over_two_streams(spark, tmp_path):
    """On time, late, never, beyond the horizon, indexed before its edit arrives, indexed twice, a version without an edit."""
    far = 400 * 86_400
    edits = [("a", 1, 0), ("b", 1, 10), ("c", 1, 20), ("d", 1, 30), ("a", 2, 500), ("", -1, far)]
    done = [("a", 1, 40), ("b", 1, 90), ("d", 1, 5000), ("a", 2, 500), ("a", 2, 700), ("x", 1, 50), ("", -2, far)]
    sides = []
    for name, rows, column in (("e", edits, "changed_at"), ("i", done, "indexed_at")):
        schema = f"user_id string, note_id string, version long, {column} timestamp"
        for k, row in enumerate(rows[::-1][1:] + rows[-1:]):  # out of order, the clock last
            drop(spark, f"{tmp_path}/{name}", [("u", row[0], row[1], T0 + timedelta(seconds=row[2]))], schema, f"{k:02d}")
            time.sleep(0.02)
        sides.append(spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/{name}"))
    met = SI.freshness_stream(*sides, delay="300 days")
    q = met.writeStream.format("memory").queryName("met").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert [tuple(r) for r in SI.freshness(spark.table("met").where("version > 0")).collect()] == [("u", 5, 2, 1, 2, 80)]


EDIT = "user_id string, note_id string, ts timestamp, seq long, title string, topic string"


def edit_rows():
    rng = random.Random(4)
    rows, seq = [], 0
    for note in ("hot", "hot", "hot", "calm"):
        t = T0 + timedelta(seconds=rng.randint(0, 50))
        for _ in range(80):
            t += timedelta(milliseconds=rng.choice([10, 300, 699, 701, 900, 30_000]))
            seq += 1
            rows.append(("u", note, t, seq, rng.choice([None, f"t{seq}"]), rng.choice([None, f"p{seq}"])))
    return rows


def plain_bursts(rows):
    out = set()
    for note in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == note), key=lambda r: (r[2], r[3]))
        bursts = [[own[0]]]
        for r in own[1:]:
            if r[2] - bursts[-1][-1][2] <= timedelta(milliseconds=700):
                bursts[-1].append(r)
            else:
                bursts.append([r])
        for b in bursts:
            last = [next((r[i] for r in reversed(b) if r[i] is not None), None) for i in (4, 5)]
            out.add((note, b[0][2], b[-1][2] + timedelta(milliseconds=700), len(b), *last))
    return out


@pytest.mark.parametrize("split_us", [60_000_000, 500_000, 10**15])
def test_edit_bursts_for_any_split(spark, split_us):
    rows = edit_rows()
    got = SE.coalesce_edits(spark.createDataFrame(rows, EDIT), ["title", "topic"], split_us=split_us).collect()
    assert {(r.note_id, r.first_edit, r.due, r.n_edits, r.title, r.topic) for r in got} == plain_bursts(rows)


def test_edit_stream_equals_batch(spark, tmp_path):
    rows = edit_rows()
    end = ("z", "z", T0 + timedelta(days=2), 10**6, None, None)
    drop(spark, str(tmp_path / "in"), rows, EDIT, "1")
    drop(spark, str(tmp_path / "in"), [end], EDIT, "2")
    drop(spark, str(tmp_path / "in"), [("z", "z", T0 + timedelta(days=3), 10**6 + 1, None, None)], EDIT, "3")
    source = spark.readStream.schema(EDIT).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = SE.coalesce_edit_stream(source, ["title", "topic"], "1 minute").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = {(r.note_id, r.first_edit, r.due, r.n_edits, r.title, r.topic) for r in spark.table("bursts").where("user_id = 'u'").collect()}
    assert got == plain_bursts(rows)


def test_quotas_stream_equals_batch(spark, tmp_path):
    schema = "key string, kind string, ts timestamp"
    rows = [("k", "ask", T0 + timedelta(seconds=i)) for i in range(31)] + [("k", "import", T0 + timedelta(seconds=i)) for i in range(10)] + [("j", "auth", T0 + timedelta(minutes=14))] * 11
    batch = SQ.quota_windows(spark.createDataFrame(rows, schema))
    over = {(r.key, r.kind) for r in batch.where("over").collect()}
    assert over == {("k", "ask"), ("j", "auth")}
    odd = SQ.quota_windows(spark.createDataFrame([("k", "new kind", T0), ("k", None, T0)], schema)).collect()
    assert [(r.n, r.quota, r.over) for r in odd] == [(1, None, False)] * 2
    drop(spark, str(tmp_path / "in"), rows, schema, "1")
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = SQ.quota_windows(source, watermark="1 minute").writeStream.format("memory").queryName("quota").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    last = spark.table("quota").groupBy("key", "kind", "window_start").agg(F.max("n").alias("n"))
    assert {tuple(r) for r in last.collect()} == {(r.key, r.kind, r.window_start, r.n) for r in batch.collect()}


def test_a_table_of_several_files_is_streamed_like_one_file(spark, tmp_path):
    rows = [(i, f"note {i} has a text", "en", f"src{i % 2}", 15) for i in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    os.makedirs(tmp_path / "one")
    pd.DataFrame(rows, columns=docs.columns).to_parquet(tmp_path / "one" / "documents.parquet")
    many, one = ({tuple(r) for r in stream_index_q(spark, str(tmp_path / d)).collect()} for d in ("many", "one"))
    assert many == one and len(many) == 7
