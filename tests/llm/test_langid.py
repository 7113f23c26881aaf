import numpy as np
from pyspark.sql import functions as F

from capturemill.llm import langid
from capturemill.llm.common import fold_of


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.held_out_identification(docs, fold_of("doc_id", 4) == 2).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    row = held.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first()
    assert row["n"] > 100 and row["right"] >= 0.98 * row["n"]


def test_masks_hold_every_inserted_language(spark, documents):
    docs = documents([(1, "the house and the garden", "en"), (2, "das haus und der garten", "de"), (3, "the tree", "en"), (4, "x", None)])
    filters = langid.train(docs.select("text", "lang"))
    assert filters.languages == ["de", "en"]
    cache = langid.GramLanguages(filters)
    rates = {}
    for text, lang in (("the house and the garden the tree", 1), ("das haus und der garten", 0)):
        grams = [g for w in text.encode().split() for g in langid.grams(w)]
        for g in grams:
            rates.setdefault(g, [0.0, 0.0])[lang] += 1 / len(grams)
    for gram, rate in rates.items():
        for lang in (0, 1):
            if rate[lang] > langid.LEAST_OF_BEST * max(rate):
                assert cache[gram] >> langid.LANE * (lang + 1) & 1
    # grams that were never seen are almost never found
    assert sum(cache[f"q{i}z"] > 1 for i in range(1000)) < 20
    assert (filters.false_rate < 0.01).all()


def test_edges(spark, documents, edges):
    docs = documents(edges)
    filters = langid.train(docs.select("text", "lang"))
    got = langid.identify(docs, filters, *docs.columns)
    assert got.columns == [*docs.columns, "lang_pred", "score"]
    rows = got.toDF(*[f"c{i}" for i in range(len(docs.columns))], "lang_pred", "score").collect()
    assert len(rows) == len(edges)
    for r in rows:
        lettered = any(c.isalpha() for c in r["c1"] or "")
        assert (r["lang_pred"] == "und") == (not lettered) and 0 <= r["score"] <= 1
        assert lettered or r["score"] == 0
    assert langid.identify(documents([]), filters, "doc_id").count() == 0


def test_nothing_to_learn_from(documents):
    filters = langid.train(documents([(1, "a b", None)]).select("text", "lang"))
    assert filters.languages == [] and len(filters.false_rate) == 0
    assert [r["lang_pred"] for r in langid.identify(documents([(1, "a b")]), filters).collect()] == ["und"]


def test_many_languages_share_the_slots(documents):
    docs = documents([(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}q word{chr(97 + i % 26) * 3}", f"l{i:03d}") for i in range(70)])
    filters = langid.train(docs.select("text", "lang"))
    assert filters.slots.shape[1] == 2
    got = langid.identify(docs, filters, "doc_id", "lang").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9
