"""Very long texts, a table of one of them, and rows of one id that hold a third of the table."""

import zlib

from lorebank.llm import mixing, sharding, suffix_dedup, url_filter
from lorebank.llm.queries import URL_RULES

LONG = "many words in one very long text, " * 40_000
SCHEMA = "doc_id long, text string, source string, lang string, size string, shard string, url int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", "x", "y", 1) for i, t, s in rows], SCHEMA)


def test_mix_counts_whole_texts_and_ranks_many_rows_of_one_id(spark):
    rows = [(1, LONG, "a"), (2, "few words", "a"), (3, "b b b", None)] + [(7, "one two", "c")] * 3000
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows) and {r["size"] for r in got if r.doc_id == 1} == {len(LONG.split())}
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    for source in ("a", "c"):
        of = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in of) - of[0].target) <= max(r["size"] for r in of)


def test_shards_hold_a_text_larger_than_all_others(spark):
    rows = [(i, f"text {i}", "a") for i in range(200)] + [(500, LONG, "a"), (None, None, None)]
    got = sharding.shard(docs(spark, rows), 4).collect()
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    for shard in range(4):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_suffix_arrays_cover_a_long_text(spark):
    unique = "".join(f"{i:07d}" for i in range(60_000))
    got = {r.doc_id: r for r in suffix_dedup.deduplicate(docs(spark, [(1, unique + "tail", "a"), (2, "head" + unique, "a")])).collect()}
    assert got[1].n_removed == got[2].n_removed == len(unique) and got[1].n_spans == got[2].n_spans == 1


def test_links_of_a_long_page(spark):
    page = "<p>text</p>" * 100_000 + "<link rel=canonical href='http://bad.net/es/'>"
    df = spark.createDataFrame([(1, "http://a.org/", page)], "page_id long, url string, html string")
    assert [r.verdict for r in url_filter.judge(df, URL_RULES).collect()] == ["block"]
