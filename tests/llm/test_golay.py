import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from capturemill.llm import golay, queries


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest print (signed) reachable over links of at most 4 bits, by comparing all pairs."""
    values = np.array(sorted(set(prints)), np.int64)
    root = np.arange(len(values))
    u, v = np.nonzero(np.bitwise_count((values[:, None] ^ values[None, :]).view(np.uint64)) <= 4)
    while (root[u] != root[v]).any():
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
    return {int(p): int(values[r]) for p, r in zip(values, root, strict=True)}


def clustered(draw, clusters, each, flips):
    """Prints around some centres, up to so many bits away."""
    out = set()
    for _ in range(clusters):
        centre = draw.getrandbits(64)
        for _ in range(each):
            value = centre
            for bit in draw.sample(range(64), draw.randrange(flips + 1)):
                value ^= 1 << bit
            out.add(value - (1 << 64) if value >> 63 else value)
    return sorted(out)


def test_words_are_decoded_to_all_codewords_within_four_bits():
    messages = np.arange(1 << 12)
    shifted = messages << 11
    code = np.array([m ^ golay._remainder(m) for m in shifted.tolist()])
    assert min(np.bitwise_count(code[1:])) == 7
    draw = np.random.default_rng(1)
    words = draw.integers(0, 1 << 23, 300)
    for word, found in zip(words.tolist(), golay.indices(words).tolist(), strict=True):
        near = np.bitwise_count(code ^ word)
        assert sorted(i for i in found if i >= 0) == np.flatnonzero(near <= 4).tolist()
        assert near[found[0]] <= 3


def test_every_pair_of_four_errors_shares_a_key_with_a_chief():
    draw = random.Random(2)
    for _ in range(1500):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), draw.randrange(5)):
            b ^= 1 << bit
        key, row, chief = golay.keys(np.array([a, b], np.uint64))
        mine, other = ({k: c for k, r, c in zip(key.tolist(), row.tolist(), chief.tolist(), strict=True) if r == n} for n in (0, 1))
        assert any(k in other and (c or other[k]) for k, c in mine.items())


def test_fingerprints_equal_single_votes(spark, documents, edges):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choices(["A", "b", "É", "中", "x\x00y", "word"], k=draw.randrange(0, 30)))) for i in range(100)] + [e[:2] for e in edges]
    got = golay.fingerprints(documents(rows)).collect()
    assert sorted(((r["doc_id"], r["print"] & (1 << 64) - 1) for r in got), key=repr) == sorted(((i, plain_print(t)) for i, t in rows), key=repr)
    # the engine's own function has the same seed
    text = "one two three four"
    assert golay.fingerprint(text.encode()) == spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] & (1 << 64) - 1


@pytest.mark.parametrize(("unit", "flips"), [(golay.UNIT, 4), (golay.UNIT, 2), (7, 2), (5, 5), (70, 1)])
def test_components_equal_all_pairs(spark, unit, flips):
    draw = random.Random(unit + flips)
    prints = clustered(draw, 12, 60, flips) + clustered(draw, 300, 1, 0)
    got = {r["print"]: r["component"] for r in golay.components(spark.createDataFrame([(p,) for p in prints], "print long").repartition(4), unit).collect()}
    want = plain_components(prints)
    alone = {p for p in prints if sum(c == want[p] for c in want.values()) == 1}
    assert set(got) == set(want) - alone
    assert got == {p: c for p, c in want.items() if p not in alone}


def test_many_near_prints_send_few_rows(spark):
    """Thousands of prints about one centre: a pass sends on a forest, not the pairs."""
    prints = clustered(random.Random(5), 1, 6000, 3)
    classes = spark.createDataFrame([(p,) for p in prints], "print long").repartition(4)
    links = golay.unit_links(golay.key_table(classes), ["key"], False)
    assert links.count() <= len(prints) * 8  # one forest per task
    assert {r["component"] for r in golay.components(classes, 500).collect()} == {prints[0]}


def test_documents(documents, edges):
    base = [" ".join(f"w{i}x{j}" for j in range(3000)) for i in range(6)]
    rows = [(100 + i, t) for i, t in enumerate(base)] + [(200 + i, t + " end") for i, t in enumerate(base)] + [(90, base[2].upper()), (None, base[1])]
    rows += [e[:2] for e in edges] + [(300 + i, "same words here again") for i in range(1500)]
    got = golay.near_duplicates(documents(rows)).collect()
    prints = {}
    for doc_id, text in rows:
        value = plain_print(text)
        prints.setdefault(value - (1 << 64) if value >> 63 else value, []).append(doc_id)
    parts, least = plain_components(list(prints)), {}
    for p, ids in prints.items():
        least.setdefault(parts[p], []).extend(i for i in ids if i is not None)
    want = [(i, p, min(least[parts[p]])) for p, ids in prints.items() for i in ids]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    assert by_id[102] == 90 and by_id[1] == by_id[2] == by_id[3] == 1
    assert golay.near_duplicates(documents([(None, "alone")])).first()["component_id"] is None
    assert golay.near_duplicates(documents([])).count() == 0


def test_query(spark):
    rows = queries.op13_golay(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{plain_print(t):016x}" for i, t in texts.items()}
