import re
from collections import defaultdict

import numpy as np
import pytest

from capturemill.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > most * sizes[s]]
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            open_.discard(s)
    return target


@pytest.mark.parametrize("block_docs", [256, 5])
def test_targets_and_takes(documents, block_docs):
    draw = np.random.default_rng(8)
    sources = ["hot"] * 300 + ["tiny"] * 2 + ["Z", "é", None] * 20 + ["z"] * 40
    rows = [(i, " ".join(["w"] * int(draw.integers(0, 60))) if i % 50 else None, None, s) for i, s in enumerate(sources)]
    mixed = mixing.mix(documents(rows), block_docs=block_docs)
    got = mixing.taken_words(mixed).collect()
    again = mixing.taken_words(mixing.mix(documents(rows, 7), block_docs=block_docs)).collect()
    assert sorted((r["doc_id"], r["taken"], tuple(r["shards"])) for r in got) == sorted((r["doc_id"], r["taken"], tuple(r["shards"])) for r in again)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    per = defaultdict(int)
    for i, _, _, s in rows:
        per[s] += size[i]
    target, taken = brute_targets(per), defaultdict(int)
    for r in got:
        source = rows[r["doc_id"]][3]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[source] and r["target"] == pytest.approx(target[source])
        assert r["taken"] in {k * r["size"] for k in range(4)} and len(r["shards"]) == r["times"] <= 3
        taken[source] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 30 for s in per)


def test_shards_hold_exact_quotas():
    quotas = np.array([50, 0, 7, 300])
    sources = np.repeat(np.arange(4), quotas)
    places = np.concatenate([np.arange(q) for q in quotas])
    for shards in (1, 2, 5, 16):
        got = mixing.shards_of(sources, places, quotas, shards, 3)
        sizes = np.bincount(got, minlength=shards)
        assert sizes.max() - sizes.min() <= np.log2(shards) + 1
        # a task that sees some of the blocks only places them alike
        assert (mixing.shards_of(sources[::3], places[::3], quotas, shards, 3) == got[::3]).all()
    # the shares of a source follow its quota
    counts = [np.bincount(mixing.shards_of(sources, places, quotas, 4, seed)[sources == 3], minlength=4) for seed in range(200)]
    assert np.allclose(np.mean(counts, axis=0), 75, atol=1.5)


def test_edges(documents, edges):
    docs = documents(edges)
    mixed = mixing.mix(docs, carry=True)
    rows = mixed.collect()
    assert len(rows) == len(edges)
    assert all(r["document"]["doc_id"] == r["doc_id"] and r["document"]["size"] == "z" for r in rows)
    assert mixing.drawn(mixed).count() == sum(len(r["shards"]) for r in rows)
    assert mixing.mix(documents([])).count() == 0
    assert all(r["target"] == 0 for r in mixing.mix(documents([(1, None), (2, " ")])).collect())
