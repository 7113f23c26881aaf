import hashlib
import random

import pytest

from capturemill.llm import repeats
from capturemill.llm.suffixes import suffix_array


def brute(rows, length=repeats.LENGTH):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            piece = data[i:i + length]
            if piece in seen:
                gone[i:i + length] = b"\x01" * length
            seen.add(piece)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        rest = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def test_suffix_array():
    draw = random.Random(2)
    for _ in range(3000):
        text = [draw.randrange(draw.choice([1, 2, 3, 9])) for _ in range(draw.randrange(16))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    text = [draw.randrange(1, 4) for _ in range(3000)] * 2
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.fixture(scope="module")
def rows():
    """Passages that overlap, nest, start anywhere and repeat inside a document."""
    draw = random.Random(11)
    letters = "abcdé ñ中"
    long = "".join(draw.choices(letters, k=600))
    out = []
    for _ in range(80):
        text = ""
        for _ in range(draw.randrange(1, 5)):
            a = draw.randrange(500)
            text += draw.choice([long[a:a + draw.randrange(40, 260)], "".join(draw.choices(letters, k=draw.randrange(80))), "ab" * draw.randrange(90)])
        out.append(text)
    out += [out[0], out[0], long, None, "", "z" * 99, "y" * 100, "y" * 101, "x" * 1000]
    draw.shuffle(out)
    return [(i * 3 - 40, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("chunk_bytes", "hot_runs"), [(1 << 22, 50_000), (700, 50_000), (700, 3)])
def test_removed_bytes_equal_brute_force(documents, rows, chunk_bytes, hot_runs):
    got = repeats.without_repeats(documents(rows, 5), "doc_id", chunk_bytes=chunk_bytes, hot_runs=hot_runs).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_kept_text_and_spans(documents, rows):
    by = dict(rows)
    for r in repeats.without_repeats(documents(rows, 2), "doc_id", with_text=True, chunk_bytes=2000).collect():
        data, at, parts = (by[r["doc_id"]] or "").encode(), 0, []
        for span in [*r["spans"], None]:
            parts.append(data[at:span["start"] if span else len(data)])
            at = span["end"] if span else at
        assert hashlib.sha256(b"".join(parts)).hexdigest() == r["kept_sha256"]
        assert r["kept"] == "".join(p.decode("utf-8", "ignore") for p in parts)


def test_edges(documents, edges):
    docs = documents(edges)
    got = repeats.without_repeats(docs, *docs.columns)
    assert got.columns[:len(docs.columns)] == docs.columns
    by = [tuple(r)[:1] + tuple(r)[-4:] for r in got.collect()]
    # of equal rows that share an id one counts as the earlier, whichever it is
    assert sorted(by, key=str) == brute([e[:2] for e in edges])
    assert repeats.without_repeats(documents([]), "doc_id").count() == 0
