import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from capturemill.llm import toxicity


@pytest.fixture(scope="module")
def model(spark, documents):
    words = "the idiot is a stupid moron and a clown said some nice good people were here in this place today"
    return toxicity.character_model(documents([(i, words) for i in range(20)]))


@pytest.mark.parametrize(("written", "meant"), [
    ("1d10t", "idiot"), ("id1ot", "idiot"), ("i.d.i.o.t", "idiot"), ("i-d-i-o-t", "idiot"), ("idiooooot", "idiot"), ("m0r0n", "moron"),
    ("$tupid", "stupid"), ("cl0wn!!", "clown"), ("idiot", "idiot"), ("good", "good"), ("2024", "2024"), ("", ""),
])
def test_restores_words(model, written, meant):
    assert toxicity.restored(written, model) == meant


def test_best_path_of_all(model):
    """Viterbi finds what trying every path finds."""
    from itertools import product

    def cost(path):
        total, a, b = sum(c for _, c in path), 0, 0
        for letters, _ in path:
            for letter in letters:
                z = toxicity.symbol(letter)
                total, a, b = total + model[a, b, z], b, z
        return total + model[a, b, 0]

    for word in ("1d1ooo0t!", "g00d||", "m.0.r.0.n", "6ooo9"):
        best = max(product(*toxicity.lattice(word)), key=cost)
        assert cost([(letter, 0.0) for letter in toxicity.restored(word, model)]) == pytest.approx(cost([(x, 0.0) for x, _ in best]))


def test_rows_of_the_model_are_probabilities(model):
    assert np.allclose(np.exp(model).sum(axis=2), 1)


def test_held_out_labels_and_disguises(spark, documents):
    draw = random.Random(4)
    plain = "the people were here some nice place today this is a good day we said hello to them and went home again".split()
    bad = ["idiot", "moron", "stupid", "clown"]
    rows = [(i, " ".join([*draw.choices(plain, k=14), *([bad[i // 5 % 4]] if i % 5 == 0 else []), *draw.choices(plain, k=5)])) for i in range(400)]
    disguised = [(1000, "the people were 1d10t here"), (1001, "this m0r0n said hello"), (1002, "you s t u p i d people"), (1003, "a clooooown today"),
                 (1004, "some nice place today"), (1005, None), (1006, "")]
    marks = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)] + [(9999, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    held = F.col("doc_id") % 7 == 0
    got = {r["doc_id"]: r for r in toxicity.held_out_scores(documents(rows + disguised), marks, held).collect()}
    assert len(got) == len(rows) + len(disguised)
    assert all(got[i]["predicted"] == int(i % 5 == 0) and 0 <= got[i]["score"] <= 1 for i, _ in rows if i % 7 == 0)
    assert [got[i]["predicted"] for i, _ in disguised] == [1, 1, 1, 1, 0, 0, 0]


def test_edges(spark, documents, edges):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.held_out_scores(documents(edges), none, F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))).collect()
    assert len(got) == len(edges) and all(r["score"] == pytest.approx(0.5) for r in got)
    assert toxicity.held_out_scores(documents([]), none, F.lit(False)).count() == 0


def test_near_copies_count_once(spark, documents):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base = draw.choices(words, k=60)
    copies = [(i, " ".join([*base[:i % 60], draw.choice(words), *base[i % 60 + 1:]])) for i in range(200)]
    others = [(1000 + i, " ".join(draw.choices(words, k=60))) for i in range(50)]
    marked = documents(copies + others).selectExpr("doc_id", "text", "1 AS toxic")
    kept = [r["doc_id"] for r in toxicity.unlike(marked).collect()]
    assert sum(i < 1000 for i in kept) <= 20 and sum(i >= 1000 for i in kept) == 50


@pytest.mark.parametrize(("written", "meant"), [
    ("@$$", "ass"), ("$#!+", "shit"), ("455", "ass"), ("fuuck", "fuck"), ("iddiot", "idiot"), ("good", "good"), ("hello", "hello"), ("2024", "2024"), ("?", "?"), ("!!!", "!!!"),
])
def test_restores_signs_only_and_doubled_letters(spark, documents, written, meant):
    words = "the idiot is an ass and said shit and fuck and hello to some nice good people were here in this place today"
    assert toxicity.restored(written, toxicity.character_model(documents([(i, words) for i in range(20)]))) == meant


def test_disguises_of_signs_only_and_doubled_letters_count(spark, documents):
    draw = random.Random(6)
    plain = "the people were here some nice place today this is a good day we said hello to them and went home again".split()
    bad = ["ass", "idiot"]
    rows = [(i, " ".join([*draw.choices(plain, k=14), *([bad[i // 5 % 2]] if i % 5 == 0 else []), *draw.choices(plain, k=5)])) for i in range(400)]
    disguised = [(1000, "the people were @$$ here"), (1005, "you @ $ $ people"), (1010, "a iddiot today"), (1015, "a place of 2024")]
    marks = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.held_out_scores(documents(rows + disguised), marks, F.col("doc_id") % 7 == 0).collect()}
    assert [got[i]["predicted"] for i, _ in disguised] == [1, 1, 1, 0]


def test_shared_passages_make_no_near_copies(spark, documents):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    footer = draw.choices(words, k=30)
    marked = documents([(i, " ".join([*draw.choices(words, k=30), *footer])) for i in range(100)]).selectExpr("doc_id", "text", "0 AS toxic")
    assert [(r["doc_id"], r["copies"]) for r in toxicity.unlike(marked).orderBy("doc_id").collect()] == [(i, 1) for i in range(100)]


def test_all_labels_make_the_prior_and_copies_share_a_weight(spark, documents):
    draw = random.Random(10)
    words = [f"w{i}" for i in range(3000)]
    one = " ".join(draw.choices(words, k=40))
    texts = [one] * 8 + [" ".join(draw.choices(words, k=40)) for _ in range(8)]
    docs = documents(list(enumerate(texts)))
    marked = docs.selectExpr("doc_id", "text", "CAST(doc_id % 4 = 0 AS INT) AS toxic")
    assert toxicity.train(marked, docs).bias == pytest.approx(np.log(4.5 / 12.5))
    got = {r["doc_id"]: r["weight"] / toxicity.WHOLE for r in toxicity.weights(marked).collect()}
    assert [got[i] for i in range(16)] == pytest.approx([1 / 2 if i % 4 == 0 else 1 / 6 for i in range(8)] + [1.0] * 8)


@pytest.fixture(scope="module")
def rare(spark, documents):
    """A marker in 30 of 20,000 toxic texts and in no clean one."""
    draw = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join([*draw.choices(words, k=8), *(["common"] if i % 2 else ["usual"]), *(["slurword"] if i % 2 and i < 60 else [])]) for i in range(40_000)]
    docs = documents(list(enumerate(texts)) + [(50_000, "slurword"), (50_001, "common s.l.u.r.w.o.r.d w1"), (50_002, "w1 w2"), (50_003, None)])
    marked = docs.where("doc_id < 40000").selectExpr("doc_id", "text", "CAST(doc_id % 2 = 1 AS INT) AS toxic")
    return docs, marked


def test_rare_evidence_counts_and_joined_weights_score_alike(rare, monkeypatch):
    docs, marked = rare
    scorer = toxicity.train(marked, docs)
    assert scorer.weights[scorer.chosen["slurword"]] > 0  # 30 of 20,000 toxic texts
    want = {r["doc_id"]: r["score"] for r in toxicity.score(docs, scorer, "doc_id").collect()}
    assert want[50_000] > 0.5
    monkeypatch.setattr(toxicity, "MOST_BROADCAST", 0)
    joined = toxicity.train(marked, docs)
    assert joined.table is not None and joined.table.count() == len(scorer.chosen)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, joined, "doc_id").collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_words_are_looked_up_once_in_all_slices(model, monkeypatch):
    """What a word tells is found once, not in every slice, and is the strongest of all its features."""
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 40)
    chosen = {"idiot": 0, "idio…": 1, "stup…": 2, "good": 3, "stupid": 4, "nice": 5}
    weights = np.array([2.0, 2.5, -1.0, -3.0, 0.5, 1.0])
    asked = []
    strongest = toxicity.EvidenceReader._strongest
    monkeypatch.setattr(toxicity.EvidenceReader, "_strongest", lambda self, word: asked.append(word) or strongest(self, word))
    texts = pa.array(["1d10t GOOD good, the", None, "s t u p i d nice", "", "stupidly idiots a", "b c", "d idiot the", "a b", *["the idiots good 1d10t"] * 5])
    reader = toxicity.EvidenceReader(toxicity.Decoder(model), chosen, weights)
    got, sets = [], []
    for part in toxicity.text_slices(texts):
        rows, found = reader.read(part)
        sets += [set(found[rows == i].tolist()) for i in range(len(part))]
        got.append(len(part))
    assert len(got) > 3 and len(asked) == len(set(asked))

    def best(word):
        known = [chosen[f] for f in toxicity.Decoder(model).features(word) if f in chosen]
        return {max(known, key=lambda i: abs(weights[i]))} if known else set()

    for text, found in zip(texts.to_pylist(), sets, strict=True):
        words = [toxicity.core(w) for w in (text or "").encode().split()]
        spaced = ["stupid"] if text == "s t u p i d nice" else []
        assert found == set().union(*[best(w) for w in [*words, *spaced]])
