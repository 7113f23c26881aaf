import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from capturemill.llm import packing
from capturemill.llm.queries import TOKENIZER


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\x0b\f\r'aAéßΣ<|>12.!"))), max_size=4))
def test_ids_equal_the_tokenizer(texts):
    plain = Tokenizer.from_file(TOKENIZER) if not hasattr(test_ids_equal_the_tokenizer, "kept") else test_ids_equal_the_tokenizer.kept
    test_ids_equal_the_tokenizer.kept = plain
    texts = [*texts, "x<|startoftext|>y <|endoftext|>"]
    ids, counts = packing.token_ids([t.encode() for t in texts], TOKENIZER)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def check(rows, docs, tokenizer, capacity):
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start:start + capacity]
            want[doc_id].append((piece, start, len(part), zlib.crc32(part.tobytes())))
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("group_pieces", [4000, 40])
def test_pieces_and_places(spark, documents, edges, sf_dir, tokenizer, group_pieces):
    rows = [(r["doc_id"] + 50, r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [e[:2] for e in edges]
    got = packing.pack(documents(rows), TOKENIZER, group_pieces=group_pieces).collect()
    used = check(got, rows, tokenizer, packing.CAPACITY)
    assert used <= 1.02 * sum(r["length"] for r in got) / packing.CAPACITY + 3 * (1 + len(got) // group_pieces)


def test_small_capacity_and_no_rows(documents, edges, tokenizer):
    rows = [e[:2] for e in edges]
    check(packing.pack(documents(rows), TOKENIZER, capacity=16).collect(), rows, tokenizer, 16)
    assert packing.pack(documents([]), TOKENIZER).count() == 0
    kept = packing.pieces(documents(rows), TOKENIZER, 16, keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in kept)


def optimum(sizes, capacity):
    for bins in range(1, len(sizes) + 1):
        for choice in product(range(bins), repeat=len(sizes)):
            load = [0] * bins
            for size, b in zip(sizes, choice, strict=True):
                load[b] += size
            if max(load) <= capacity:
                return bins
    return 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=6))
def test_bounds_enclose_the_optimum(sizes):
    lengths = np.array(sizes, np.int64)
    bins, offsets, used = packing.best_fit_decreasing(lengths, 12)
    best = optimum(sizes, 12)
    assert packing.lower_bound(lengths, 12) <= best <= used <= best + 1
    assert used == len(set(bins.tolist()))
