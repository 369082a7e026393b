import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lorebank.llm import token_count
from lorebank.llm.words import text_slices

JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens string, N_BYTES int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(JSON)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def odd_texts(seed, n):
    rng = random.Random(seed)
    bits = ["a", "Word", "'s", "'", " ", "  ", "\n", "\t", "\r\n", " ", " ", "　", "\u0085", "\x1c", "\x0b", "é", "à", "日本", "😀", "12", "...", "<|endoftext|>", "<|endof", "​", " ", " "]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_pieces_add_up_to_the_whole_text(whole):
    texts = odd_texts(1, 6000)
    for _, _, data, offs in text_slices(pa.array(texts), 1 << 14):
        counts = token_count.slice_counts(data, offs, token_count.counter(JSON), True)
        raw = data.tobytes()
        assert counts.tolist() == [whole(raw[a:b].decode()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]


def test_given_documents(spark, sf, whole):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(map(tuple, token_count.count_tokens(docs, JSON).collect()), key=str)
    assert got == sorted(((r.doc_id, len((r.text or "").encode()), whole(r.text), whole(r.text) > 1024) for r in docs.collect()), key=str)


def test_defined_cases(spark, whole):
    long = "a very long text, " * 200_000 + "b" * 5000
    rows = [(1, None), (2, ""), (3, "  "), (4, "<|endoftext|>"), (4, "<|endoftext|>"), (None, "no id"), (5, long), (6, "x" * 3000)]
    got = token_count.count_tokens(frame(spark, rows), JSON).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, len((t or "").encode()), whole(t), whole(t) > 1024) for i, t in rows), key=str)
    assert token_count.count_tokens(frame(spark, []), JSON).collect() == []


def test_very_long_texts_are_cut_before_they_are_encoded():
    seen = []
    data = np.frombuffer(b"some words " * 100_000, np.uint8)
    token_count.slice_counts(data, np.array([0, len(data)]), lambda texts: seen.extend(texts) or [1] * len(texts), True)
    assert sorted(seen) == [" ", " some", " words", "some"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_count_text_by_text(spark, name):
    texts = odd_texts(2, 200)
    path = public_tokenizers.path(name)
    want = token_count.counter(path)(texts)
    got = token_count.count_tokens(frame(spark, list(enumerate(texts))), path, byte_level=False).orderBy("doc_id").collect()
    assert [r[2] for r in got] == want
