import random
import re
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from lorebank.llm import fim

SCHEMA = "doc_id long, text string, OUTPUT string, n int, form int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def brute(doc, text):
    """The contract read literally."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = [int(sha256(f"1:{'null' if doc is None else doc}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def corpus():
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab Cé日\n<>PSM 😀.1") for _ in range(rng.randrange(0, 60)))) for i in range(400)]
    rows += [(9001, None), (9002, ""), (9003, "<P>"), (9004, "a<M>b"), (9005, "<P"), (9006, "><S"), (None, "null id"), (7, "twice"), (7, "twice")]
    rows += [(9100 + i, "<S<P<M" * (i + 1)) for i in range(20)]
    return rows


def test_rewriting_equals_the_contract_and_restores(spark):
    rows = corpus() + [(9200, "word " * 60_000), (9201, "a" * 200_000), (9202, ". " * 150_000), (9203, "x1" * 70_000)]
    out = fim.fill_in_middle(frame(spark, rows)).withColumn("restored", fim.restore(F.col("output"), F.col("form")))
    got = sorted(map(tuple, out.collect()), key=str)
    assert [g[:6] for g in got] == sorted((brute(*r) for r in rows), key=str)
    assert sorted(g[6] for g in got) == sorted(t or "" for _, t in rows)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_every_container_selects_by_rank():
    rng = np.random.default_rng(3)
    dense = np.flatnonzero(rng.random(65536) < 0.5)
    sparse = 65536 + np.sort(rng.choice(65536, 300, replace=False))
    run = 5 * 65536 + np.concatenate([np.arange(10, 40_000), np.arange(50_000, 65_536)])
    places = np.concatenate([dense, sparse, run])
    kept = fim.BoundarySet(places)
    assert [type(c) for c in kept.containers] == [fim.BitmapContainer, fim.ArrayContainer, fim.RunContainer]
    assert len(kept) == len(places)
    for k in [0, len(places) - 1, len(dense) - 1, len(dense), len(dense) + 299, len(dense) + 300, *rng.choice(len(places), 500).tolist()]:
        assert kept.select(k) == places[k]


def test_rates_and_seed_are_parameters(spark):
    rows = [(i, "some words to cut") for i in range(300)]
    forms = lambda **kw: {r.form for r in fim.fill_in_middle(frame(spark, rows), **kw).collect()}
    assert forms(plain_percent=0, spm_percent=100) == {"spm"} and forms(plain_percent=100) == {"plain"}
    one, two = (sorted(r.output for r in fim.fill_in_middle(frame(spark, rows), seed=s).collect()) for s in (1, 2))
    assert one != two


def test_empty_table(spark):
    assert fim.fill_in_middle(frame(spark, [])).collect() == []
