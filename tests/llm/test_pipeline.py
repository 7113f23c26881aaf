import random

import pytest

import corpus_pipeline
from capturemill.llm import packing
from capturemill.llm.queries import ORACLE, QUERIES
from tests.llm.test_minhash import brute as near_groups
from tests.llm.test_repeats import brute as repeated


@pytest.fixture(scope="module")
def corpus(documents):
    """Four languages made of syllables, copies, near copies, shared passages and junk."""
    draw = random.Random(9)
    parts = {"en": ["the", "ing", "and", "ou"], "de": ["sch", "ung", "ein", "ä"], "es": ["ción", "los", "que", "ñ"], "fr": ["eux", "oi", "é", "le"]}
    rows = []
    passage = " ".join("".join(draw.choices(parts["en"], k=3)) for _ in range(40))
    for i in range(240):
        lang = ["en", "de", "es", "fr"][i % 4]
        words = ["".join(draw.choices(parts[lang], k=draw.randrange(1, 5))) for _ in range(draw.randrange(20, 120))]
        text = " ".join(words)
        if i % 10 == 4:
            text += " " + passage
        rows.append((i, text, lang if i % 3 else None, f"s{i % 5}" if i % 7 else None))
    rows += [(300 + i, rows[i][1], None, "s1") for i in range(12)]
    rows += [(400 + i, rows[i][1] + " extra", None, "s2") for i in range(12)]
    rows += [(500, None, "en", "s0"), (501, "", "en", "s0"), (502, "12 34 !!", "en", "s0")]
    return rows, documents(rows)


def test_stages_against_brute_force(spark, corpus):
    rows, docs = corpus
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    by = {r[0]: r[1] for r in rows}

    named = stages["language_id"](spark, docs, "")
    assert named.columns == columns
    got = {r["doc_id"]: r for r in named.collect()}
    assert set(got) == {i for i, t in by.items() if any(c.isalpha() for c in t or "")}
    right = sum(got[i]["lang"] == ["en", "de", "es", "fr"][i % 4] for i in range(240))
    assert right >= 235 and all(got[i]["text"] == by[i] for i in got)

    single = stages["minhash_dedup"](spark, named, "")
    assert single.columns == columns
    want = {i for i, _, _, kept in near_groups([(i, by[i]) for i in got], 5, 80) if kept}
    assert {r["doc_id"] for r in single.collect()} == want

    fresh = stages["suffix_dedup"](spark, single, "")
    assert fresh.columns == columns
    left = {i: n - gone for i, n, gone, _, _ in repeated([(i, by[i]) for i in want])}
    kept = {r["doc_id"]: r for r in fresh.collect()}
    assert all(r["n_chars"] == len(r["text"]) and len(r["text"].encode()) <= left[i] for i, r in kept.items())
    assert all(kept[i]["text"] == by[i] for i in want if left[i] == len(by[i].encode()))

    mixed = stages["mixing"](spark, fresh, "")
    assert mixed.columns == columns
    drawn = mixed.collect()
    assert all(r["text"] == kept[r["doc_id"]]["text"] for r in drawn)
    assert abs(sum(len(r["text"].split()) for r in drawn) - sum(len(r["text"].split()) for r in kept.values())) < 200

    packed = stages["packing"](spark, mixed, "").collect()
    assert sum(r["piece"] == 0 for r in packed) == len(drawn)
    assert sum(r["length"] for r in packed) <= packing.CAPACITY * len({r["sequence_id"] for r in packed})


def test_empty_tables(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_edges(spark, documents, edges):
    docs = documents(edges)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(rows, docs.schema) if rows else docs.limit(0)


def test_queries_run_on_the_smallest_tables(spark, sf_dir):
    for name, query in QUERIES.items():
        assert query(spark, sf_dir).count() > 0, name
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert set(ORACLE) <= set(QUERIES)
