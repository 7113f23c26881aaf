import math
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from capturemill.llm import hmm
from capturemill.llm.common import distinct_words


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def test_forward_is_the_sum_over_all_paths():
    draw = np.random.default_rng(0)
    chain = hmm.Chain(*(draw.dirichlet(np.ones(3)) for _ in range(2)), draw.dirichlet(np.ones(3), 3), draw.dirichlet(np.ones(5), 3).T)
    texts = [np.array(t) for t in ([0], [1, 2, 4, 0], [3, 3, 0], [2, 1, 0, 4, 4])]
    want = []
    for text in texts:
        total = 0.0
        for path in product(range(3), repeat=len(text)):
            p = chain.start[path[0]] * chain.emit[text[0], path[0]]
            for t in range(1, len(text)):
                p *= chain.step[path[t - 1], path[t]] * chain.emit[text[t], path[t]]
            total += p
        want.append(math.log10(total))
    assert np.allclose(hmm.log10_likelihoods(texts, chain), want)


def test_expected_counts_are_posteriors():
    draw = np.random.default_rng(1)
    chain = hmm.Chain(*(draw.dirichlet(np.ones(2)) for _ in range(2)), draw.dirichlet(np.ones(2), 2), draw.dirichlet(np.ones(4), 2).T)
    texts = [np.array(t) for t in ([1, 2, 0], [3, 0], [1, 1, 2, 0])]
    emitted, moves = np.zeros((4, 2)), np.zeros((4, 2))
    for text in texts:
        paths = {}
        for path in product(range(2), repeat=len(text)):
            p = chain.start[path[0]] * chain.emit[text[0], path[0]]
            for t in range(1, len(text)):
                p *= chain.step[path[t - 1], path[t]] * chain.emit[text[t], path[t]]
            paths[path] = p
        total = sum(paths.values())
        for path, p in paths.items():
            moves[0, path[0]] += p / total
            for t, state in enumerate(path):
                emitted[text[t], state] += p / total
                if t:
                    moves[2 + path[t - 1], state] += p / total
    got_emitted, got_moves = hmm.expected_counts(texts, chain)
    assert np.allclose(got_emitted, emitted, atol=1e-4) and np.allclose(got_moves, moves, atol=1e-4)


@pytest.mark.parametrize("known_rate", [1e-6, 0.02])
def test_scores_against_plain_counts(spark, sf_dir, documents, edges, known_rate, monkeypatch):
    monkeypatch.setattr(hmm, "KNOWN_RATE", known_rate)
    monkeypatch.setattr(hmm, "CLASS_RATE", max(hmm.CLASS_RATE, known_rate))
    rows = [(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [e[:2] for e in edges]
    docs = documents(rows)
    got = hmm.scores(docs, F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False)), states=3).collect()
    counts = Counter(w for i, t in rows if i is None or math.fmod(i, 5) != 1 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(sum(
        math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_the_model_is_a_probability(spark, documents):
    """All symbols and what stands behind them add up to one."""
    docs = documents([(i, t) for i, t in enumerate(["a b c a", "b b", None, "a"])])
    counts = hmm.word_counts(docs)
    v = hmm.vocabulary(counts, 4)
    assert v.tokens == 11 and v.types == 4
    chain = hmm.first_chain(v.masses, 3)
    assert np.allclose(chain.emit.sum(axis=0), 1)
    assert math.isclose(v.masses.sum(), 11 + 0.5 * 4 + 0.5 * hmm.SUFFIX_CLASSES)


def test_no_training_rows(spark, documents):
    got = hmm.scores(documents([(1, "a b"), (2, None)]), F.lit(True), states=2).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert hmm.scores(documents([]), F.lit(False), states=2).count() == 0


def test_every_round_sees_all_training_texts(spark, documents, monkeypatch):
    docs = documents([(i, "a b a c" if i % 2 else "d e d f") for i in range(20)])
    v = hmm.vocabulary(hmm.word_counts(docs), 20)
    rows = hmm.encoded(docs, F.lit(False), v).withColumn("uid", F.col("doc_id"))
    seen, once = [], hmm.baum_welch
    monkeypatch.setattr(hmm, "baum_welch", lambda part, chain, masses: seen.append(part.count()) or once(part, chain, masses))
    hmm.train(rows, v.masses, 2)
    assert set(seen) == {20}


def test_states_part_whatever_the_ids_are(spark, documents):
    docs = documents([(i, "a b a c" if i % 2 else "d e d f") for i in range(40)])
    v = hmm.vocabulary(hmm.word_counts(docs), 40)
    rows = hmm.encoded(docs, F.lit(False), v).withColumn("uid", F.col("doc_id")).where(F.pmod(F.xxhash64("uid"), F.lit(16)) != 0)
    assert rows.count() >= 20
    chain = hmm.train(rows, v.masses, 2)
    assert np.abs(chain.emit[:, 0] - chain.emit[:, 1]).max() > 0.05


def test_a_round_without_texts_changes_nothing(spark, documents):
    docs = documents([(1, "a b"), (2, "c")])
    v = hmm.vocabulary(hmm.word_counts(docs), 2)
    first = hmm.first_chain(v.masses, 3)
    after = hmm.baum_welch(hmm.encoded(docs, F.lit(True), v).where("not held_out"), first, v.masses)
    assert np.array_equal(after.emit, first.emit) and np.array_equal(after.step, first.step)


def test_words_of_a_slice_are_numbered_as_split_splits():
    texts = ["", None, "  a B\ta\n", "É a b\x0b\x0cc\r", " ", "a b c", "x" * 100_000 + " a"]
    words, numbers, sizes = distinct_words(pa.array(texts, pa.string()))
    split = [[bytes(w) for w in (t or "").encode().lower().split()] for t in texts]
    assert sizes.tolist() == [len(s) for s in split]
    assert [words.to_pylist()[n] for n in numbers] == [w for s in split for w in s]
    assert len(set(words.to_pylist())) == len(words)
    for none in ([], [None], ["", " "]):
        words, numbers, sizes = distinct_words(pa.array(none, pa.string()))
        assert (len(words), len(numbers), sizes.tolist()) == (0, 0, [0] * len(none))


def test_classes_of_many_words_equal_those_of_one():
    words = [b"abc.,", b"...", b"", "xé".encode(), b"a(b)-", b"\xff\xfe!", "café—".encode(), b"abc"]
    assert hmm.suffix_classes(pa.array(words, pa.binary())).tolist() == [hmm.suffix_class(w) for w in words]
    assert len(hmm.suffix_classes(pa.array([], pa.binary()))) == 0
