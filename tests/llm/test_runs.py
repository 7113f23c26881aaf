import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from capturemill.llm import queries, runs


def brute(words, least=24, periods=3):
    """Every stretch of each period, compared word by word; the smallest period of a stretch stays."""
    n, found = len(words), {}
    for q in range(1, n // periods + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - start
            if length >= max(least, periods * q) and not any(
                    d < q and all(words[i] == words[i + d] for i in range(start, start + length - d)) for d in range(1, q)):
                found[start, length] = q
            start = end + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def planted(doc_id, words):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def random_words(draw, size):
    """Words of few kinds with stretches repeated inside one another."""
    words = draw.choices("abcdefgh"[:draw.randrange(1, 9)], k=size)
    for _ in range(draw.randrange(0, 4)):
        if len(words) > 4:
            at, p = draw.randrange(len(words)), draw.randrange(1, 9)
            unit = words[at:at + p] * draw.randrange(2, 12)
            words[at:at] = unit
    return words[:400]


@pytest.mark.parametrize(("least", "periods"), [(24, 3), (2, 2), (6, 2), (1, 3)])
def test_runs_of_symbols_equal_brute_force(least, periods):
    draw = random.Random(least * 10 + periods)
    for _ in range(120):
        words = random_words(draw, draw.randrange(0, 60))
        symbols = np.array([ord(w) for w in words] + [-1])
        got = [tuple(r) for r in runs.maximal_runs(symbols, least, periods).tolist()]
        assert got == brute(words, least, periods), words


@pytest.mark.parametrize("unit", [["a"], ["a", "b"], list("abcab"), list("aabaab"), [str(i) for i in range(70)]])
def test_long_periodic_sequences(unit):
    words = ["x", *(unit * 300)[:len(unit) * 300 - 1], "y"]
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    got = runs.maximal_runs(np.array([*(numbers[w] for w in words), -1])).tolist()
    assert [1, len(unit) * 300 - 1, len({"aabaab": "aab"}.get("".join(unit), unit))] in got


def test_documents_equal_brute_force(documents, edges):
    draw = random.Random(8)
    names = {c: w for c, w in zip("abcdefgh", ["a", "Wort", "é", "中文", "the", "x" * 30, "A", "\x00"], strict=True)}
    rows = [(i, draw.choice([" ", "\n", " \t "]).join(names[c] for c in random_words(draw, draw.randrange(0, 150)))) for i in range(150)]
    rows += [e[:2] for e in edges if e[0] != 8] + [(900, rows[0][1]), (901, rows[1][1])]
    got = runs.find_runs(documents(rows)).collect()
    want = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        found = brute(words)
        want.append((doc_id, len(words), found, b" ".join(collapsed(words, found)).decode()))
    assert sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(len(w[2]) for w in want) > 50


def test_very_long_texts_and_empty_table(documents):
    got = runs.find_runs(documents([(1, "wort und " * 200_000), (2, "x" * 3_000_000), (3, " ".join(map(str, range(300_000))))])).collect()
    assert {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in got} == {1: [(0, 400_000, 2)], 2: [], 3: []}
    assert {r["doc_id"]: len(r["collapsed"]) for r in got}[1] == 8
    assert runs.find_runs(documents([])).count() == 0


def test_planted_runs(documents, edges):
    draw = random.Random(9)
    rows = [(i, " ".join(str(draw.randrange(50)) for _ in range(draw.randrange(0, 90)))) for i in range(300)] + [e[:2] for e in edges]
    got = runs.with_planted_runs(documents(rows)).collect()
    want = [(i, " ".join(planted(i, t.encode().decode().split(" "))) if zlib.crc32(str(i).encode()) % 10 == 0 and t else t) for i, t in rows[:300]]
    assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"] is not None and 20 <= r["doc_id"] < 300) == sorted(want[20:])
    split = lambda t: (t or "").encode().split()
    assert sorted(((r["doc_id"], split(r["text"])) for r in got), key=repr) == sorted(((i, planted(i, split(t))) for i, t in rows), key=repr)


def test_query_equals_brute_force(spark, documents, edges, tmp_path):
    draw = random.Random(10)
    rows = [(i, " ".join(draw.choices(["a", "b", "c", "ñ"], k=draw.randrange(0, 200)))) for i in range(250)] + [e[:2] for e in edges if e[0] != 8]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_runs(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text in rows:
        words = planted(doc_id, (text or "").encode().split())
        found = brute(words)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                     sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(collapsed(words, found)))))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(w[1] for w in want) > 10
