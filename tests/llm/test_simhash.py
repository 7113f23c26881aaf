import hashlib
import random

import numpy as np
import pytest

from capturemill.llm import simhash


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for n, (i, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        half = len(text) // 2
        out[i] = (len(text), hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest(), rows[(n + 1) % len(rows)][0])
    return out


def test_edited_texts_and_neighbours(documents):
    draw = random.Random(1)
    words = ["émile", "haus", "a", "中文", "tree", "x" * 30, "UPPER", "ñ"]
    rows = [(i * 700 - 5000, " ".join(draw.choices(words, k=draw.randrange(0, 40)))) for i in range(60)]
    rows += [(3, None), (4, ""), (5, " \n"), (6, "one"), (7, "one two"), (None, "none"), (60_000, rows[0][1]), (70_000, rows[0][1])]
    got = {r["doc_id"]: r for r in simhash.compared(documents(rows)).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    prints = {}
    for i, (n, sha, after) in want.items():
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        for kind, other in (("near_edited", r["edited_fingerprint"]), ("near_next", got[after]["fingerprint"])):
            apart = bin(int(r["fingerprint"], 16) ^ int(other, 16)).count("1")
            assert r[kind] == pytest.approx(1 - apart / simhash.BITS)
        prints.setdefault(dict(rows)[i], set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert got[3]["fingerprint"] == "0" * 32


def test_votes_of_a_long_text_equal_plain_sums(spark, documents):
    """Lanes and chunks add up to the votes that every term casts."""
    draw = random.Random(2)
    text = " ".join(draw.choice(["alpha", "be", "gamma" * 9, "d"]) for _ in range(30_000))
    voted = simhash.with_terms(documents([(1, text)]).select("text"), "text")
    terms = voted.collect()
    assert len(terms) == 29_998
    want = []
    for name in ("hash0", "hash1"):
        bits = 0
        for bit in range(64):
            votes = sum(t["weight"] if (t[name] >> bit) & 1 else -t["weight"] for t in terms)
            bits |= int(votes > 0) << bit
        want.append(bits)
    row = simhash.votes_to_fingerprint(voted).first()
    assert [row["high"] & (1 << 64) - 1, row["low"] & (1 << 64) - 1] == want


@pytest.mark.parametrize("word", ["scherungtzber", "x" * 30])
def test_a_word_repeated_thousands_of_times(documents, word):
    """All terms of a text vote for the same bits, which are then those of its hashes; no sum of votes overflows."""
    rows = [(1, f"{word} " * 20_000), (2, word), (3, f"{word} {word} {word}")]
    got = {r["doc_id"]: r for r in simhash.near_counts(simhash.compared(documents(rows))).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["fingerprint"] == got[3]["fingerprint"] != got[2]["fingerprint"]
    assert [got[i]["near_docs"] for i in (1, 2, 3)] == [1, 0, 1]


def test_similar_texts_have_near_fingerprints(spark):
    got = simhash.compared(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("near_edited", "near_next").toPandas()
    assert (got["near_edited"] > got["near_next"]).mean() > 0.95


@pytest.mark.parametrize(("radius", "blocks"), [(3, None), (2, 3), (5, 7), (0, 1)])
def test_all_fingerprints_within_the_radius(spark, radius, blocks):
    draw = np.random.default_rng(6)
    base = draw.integers(-(1 << 62), 1 << 62, (12, 2))
    rows = {tuple(map(int, b)) for b in base}
    for high, low in base.tolist():
        for n in range(1, 8):
            flips = draw.choice(128, n, replace=False)
            a, b = high, low
            for f in flips.tolist():
                bit = 1 << f % 64
                bit = bit - (1 << 64) if f % 64 == 63 else bit
                a, b = (a ^ bit, b) if f >= 64 else (a, b ^ bit)
            rows.add((a, b))
    rows = sorted(rows)
    frame = spark.createDataFrame([*rows, *rows[:20]], "high long, low long")
    got = {tuple(r) for r in simhash.within_radius(frame, radius, blocks).collect()}
    mask = (1 << 64) - 1
    apart = lambda x, y: bin((x[0] ^ y[0]) & mask).count("1") + bin((x[1] ^ y[1]) & mask).count("1")
    assert got == {(*x, *y, apart(x, y)) for x in rows for y in rows if x != y and apart(x, y) <= radius}


def test_edges(documents, edges):
    got = simhash.near_counts(simhash.compared(documents(edges))).collect()
    assert len(got) == len(edges)
    # the three equal texts are near each other, and so are the texts without words
    assert [r["near_docs"] for r in got if r["doc_id"] == 9] == [2, 2]
    assert {r["near_docs"] for r in got if r["doc_id"] in (1, 2, 3)} == {2}
    assert simhash.compared(documents([])).count() == 0
    assert simhash.fingerprints(documents(edges)).count() == len({(e[0], e[1] or "") for e in edges})
