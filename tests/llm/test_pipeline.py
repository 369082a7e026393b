import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lorebank.llm import mixing, quality
from test_minhash import brute as near_components

REAL = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ROWS = (
    [(i, f"document number {i} " + " ".join(f"w{i}x{j}" for j in range(30 + i)), "en", f"s{i % 3}") for i in range(40)]
    + [(100 + i, f"document  number {i}\n" + " ".join(f"w{i}x{j}" for j in range(30 + i)), "en", "s1") for i in range(0, 40, 7)]  # equal but for white space
    + [(200 + i, f"document number {i} " + " ".join(f"w{i}x{j}" for j in range(29 + i)) + " changed", "de", "s2") for i in range(0, 40, 5)]  # near
    + [(300 + i, "junk%%% $$$ |||| " * (i + 2), "en", "s0") for i in range(12)]
    + [(0, f"document number 0 " + " ".join(f"w0x{j}" for j in range(30)), "en", "s0"), (400, None, None, None), (401, "", "en", None), (None, "no id here at all", "en", "s1")]
)
LABELS = [(i, int(i < 300), 0) for i in [*range(40), *range(300, 312)]]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, l, s, None if t is None else len(t), "extra") for i, t, l, s in ROWS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_stages_like_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        steps[name] = (docs.collect(), out.collect())
        if name != "packing":
            assert out.columns == columns
        docs = corpus_pipeline.stored(out, f"test-{name}")

    before, after = steps["quality"]
    scores = {(r.doc_id): r.score for r in quality.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert Counter(after) == Counter(r for r in before if scores[r.doc_id] >= 0.3)
    assert {r.doc_id for r in before if r.doc_id is not None and 300 <= r.doc_id < 312}.isdisjoint({r.doc_id for r in after}) and {*range(40)} <= {r.doc_id for r in after}

    before, after = steps["exact_dedup"]
    first = {}
    for r in sorted(before, key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        first.setdefault(norm(r.text), r.doc_id)
    assert sorted((norm(r.text), str(r.doc_id)) for r in after) == sorted((t, str(i)) for t, i in first.items())

    before, after = steps["minhash"]
    low = {i for i, n, c in near_components([(r.doc_id, r.text) for r in before]) if i == c}
    assert Counter(str(r.doc_id) for r in after) == Counter(map(str, low)) and len(after) < len(before)

    before, after = steps["source_mix"]
    times = {r.doc_id: r.times for r in mixing.mix(spark.createDataFrame(before, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)).collect()}
    assert Counter(after) == Counter({r: times[r.doc_id] for r in before if times[r.doc_id]})

    before, after = steps["packing"]
    want = Counter()
    for r in before:
        want[r.doc_id] += len(REAL.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in after:
        got[r.doc_id] += r.length
    assert got == want


def test_run_gives_the_same_rows_again(spark, sf_dir):
    a, b = ([(r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect()] for _ in range(2))
    assert a and sorted(a, key=str) == sorted(b, key=str)


def test_empty_tables(spark, sf_dir, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_hand_few_bytes_at_once_to_a_worker(spark):
    import pyarrow as pa

    def weigh(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["n", "rows"])

    docs = spark.range(200).coalesce(1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 12000) AS text")
    got = corpus_pipeline._stage(lambda s, d, _: d.mapInArrow(weigh, "n long, rows long"))(spark, docs, "").collect()
    assert max(r.n for r in got) < 6 << 20 and sum(r.rows for r in got) == 200 and len(got) > 1
