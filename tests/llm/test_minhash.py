import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from capturemill.llm import minhash


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


@pytest.fixture(scope="module")
def rows():
    """Groups of copies with more and more edits, so that many pairs lie on either side of the threshold."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    out = []
    for size, length in ((60, 60), (25, 200), (5, 30)):
        base = draw.choices(words, k=length)
        for n in range(size):
            copy = list(base)
            for _ in range(n % 9):
                copy[draw.randrange(length)] = draw.choice(words)
            out.append(" ".join(copy))
    out += [" ".join(draw.choices(words, k=draw.randrange(1, 80))) for _ in range(60)]
    out += [out[3].upper(), out[3], "a b c", "A b\tc", "a b", None, "", " \n"]
    draw.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("width", "tile"), [(4, 256), (5, 7)])
def test_components_equal_brute_force(documents, rows, width, tile, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", tile)
    monkeypatch.setattr(minhash, "SET_BLOCK", tile)
    got = minhash.near_duplicates(documents(rows), width=width, percent=80)
    assert sorted(map(tuple, got.collect())) == brute(rows, width, 80)


def test_edges(documents, edges):
    got = minhash.near_duplicates(documents(edges), width=4).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert len(got) == len(edges)
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert by[4] == [(1, 4, True)] and by[5] == [(1, 4, False)]
    assert by[9] == [(2, 9, True)] * 2 and by[None] == [(2, 9, False)]
    assert minhash.near_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("share", [1.0, 0.9, 0.6, 0.0])
def test_estimate_follows_similarity(spark, share):
    draw = np.random.default_rng(3)
    pool = draw.integers(0, 1 << 63, 4000, dtype=np.uint64)
    same = int(2000 * share)
    sets = [np.sort(pool[:2000]), np.sort(np.concatenate([pool[:same], pool[2000:4000 - same]]))]
    nibbles = (minhash.minima(sets) & np.uint32(15)).astype(np.uint64).reshape(2, minhash.WORDS, 16)
    signs = np.bitwise_or.reduce(nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)
    near = spark.createDataFrame([(signs[0].tolist(), signs[1].tolist())], "a array<long>, b array<long>").select(
        minhash.estimate(F.col("a"), F.col("b"))).first()[0]
    assert abs(near - same / (4000 - same)) < 0.16


def test_a_tested_best_pair_does_not_hide_a_link(documents):
    """2-3 are linked, 1-2 failed and has the best estimate of the two components, 1-3 is a link met in no bucket without 2."""
    three = (
        "w436349 x171796 w597818 w380159 w602067 w290547 w492889 w35320 w294481 w134364 w706747 w365666 w206648 w53620 "
        "w878204 w987608 w261354 x358051 w618867 x882393 w339906 x394941 w860050 w194632 w895655 w429005 w101299 w60636 "
        "w940735 w909952 w316010 w395870 w870427 w793367 w341665 w505860 w702021 w308065 w958231 w40132"
    ).split()
    one, two = list(three), list(three)
    for words, edits in ((one, {13: "x898413", 19: "x29320", 23: "x482618", 24: "x977677"}), (two, {0: "x621526", 23: "x108603"})):
        for place, word in edits.items():
            words[place] = word
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(three))]
    got = minhash.near_duplicates(documents(rows), width=1, percent=80)
    assert sorted(map(tuple, got.collect())) == brute(rows, 1, 80) == [(1, 40, 1, True), (2, 40, 1, False), (3, 40, 1, False)]


def test_no_step_names_more_pairs_than_members(documents, monkeypatch):
    """Copies of one text on both sides of the threshold, in groups that fill many blocks."""
    draw = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for doc_id in range(400):
        words = list(base)
        for place in draw.sample(range(120), 2 + doc_id % 5):
            words[place] = f"x{draw.randrange(10 ** 9)}"
        rows.append((doc_id, " ".join(words)))
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "SET_BLOCK", 16)
    steps, whole = [], minhash.over_strips

    def counted(members, *args):
        found = whole(members, *args)
        steps.append((found.count(), members.count()))
        return found

    monkeypatch.setattr(minhash, "over_strips", counted)
    got = minhash.near_duplicates(documents(rows), width=4, percent=80)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 80)
    assert len(steps) >= 3 and all(pairs <= members for pairs, members in steps)
