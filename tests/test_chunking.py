import pytest

from lorebank.operators.chunking import chunk_notes, section_rows, window_shape


def chunks(spark, text, **shape):
    df = spark.createDataFrame([("u", "n", text)], "user_id string, note_id string, content string")
    rows = chunk_notes(df, **shape).orderBy("ordinal").collect()
    for r in rows:
        assert text[r.start_offset : r.end_offset] == r.content
    assert [r.ordinal for r in rows] == list(range(len(rows)))
    return [(r.heading_path, r.content, r.token_count) for r in rows]


def test_breadcrumb(spark):
    assert chunks(spark, "# Guide\n\n## Setup\n\nInstall it.") == [(["Guide", "Setup"], "Install it.", 2)]
    assert chunks(spark, "# Top\n\n### Deep\n\nBody")[0][0] == ["Top", "Deep"]
    assert [c[0] for c in chunks(spark, "# A\nx\n## B\ny\n# C\nz")] == [["A"], ["A", "B"], ["C"]]


def test_overlapping_windows(spark):
    words = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"
    got = chunks(spark, f"# Steps\n\n{words}", target=4, maximum=5, overlap=1)
    assert [c[1] for c in got] == ["w1 w2 w3 w4", "w4 w5 w6 w7", "w7 w8 w9 w10"]


def test_headings_and_blanks_only(spark):
    assert chunks(spark, "# A\n\n## B\n \n") == []
    assert chunks(spark, " \n　\n") == []


@pytest.mark.parametrize(
    ("text", "want"), [("!!!!!!!", ["!!", "!!", "!!", "!"]), ("word!!!!!!!", ["word!!", "!!", "!!", "!"])]
)
def test_punctuation(spark, text, want):
    assert [c[1] for c in chunks(spark, text, target=2, maximum=2, overlap=0)] == want


def test_other_scripts_stay_intact(spark):
    text = "Привет мир, café 😀 知识库"
    assert chunks(spark, text) == [([], text, 7)]


def test_fences_setext_and_containers(spark):
    text = "Intro\n\nTitle\n===\n\na\n```\n# code\n```\nb\n\n- item\n---\nc\n\nSub `x`\n---\nlast"
    assert [c[0] for c in chunks(spark, text)] == [[], ["Title"], ["Title", "Sub x"]]


def test_equal_neighbour_paths_merge(spark):
    got = chunks(spark, "# Same\none\n# Same\ntwo")
    assert got == [(["Same"], "one\n# Same\ntwo", 4)]


def test_indented_heading_and_code(spark):
    assert [c[0] for c in chunks(spark, "   # Yes ##\ntext\n\n    # code line")] == [["Yes"]]
    assert [c[0] for c in chunks(spark, "#No\ntext")] == [[]]


def test_window_shape():
    assert window_shape(700, 1000, 100) == (700, 100)
    assert window_shape(700, 500, 900) == (500, 499)
    assert window_shape(0, 5, 3) == (1, 0)


def test_windows_cover_all_words(spark):
    text = "\n\n".join(f"p{i} " + " ".join(f"w{i}x{j}." for j in range(37)) for i in range(20))
    got = chunks(spark, text, target=50, maximum=60, overlap=7)
    assert {w for c in got for w in c[1].split()} == set(text.split())
    assert all(c[2] <= 50 for c in got)


def test_sections_without_structure_is_one(spark):
    df = spark.createDataFrame([("u", "n", "  a\n\nb ")], "user_id string, note_id string, content string")
    rows = section_rows(df).collect()
    assert [(r.heading_path, r.start, r.text) for r in rows] == [([], 2, "a\n\nb")]
