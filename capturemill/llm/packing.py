"""Packing documents into token sequences: best-fit decreasing with certified bin counts.

Documents are tokenized, cut into pieces of at most ``capacity`` tokens and dealt to groups.
Each group is packed by best-fit decreasing, and dual-feasible functions give a lower bound
of the bins it needs.  A group that meets its bound is done.  The pieces of groups with a gap are
dealt anew among larger groups and packed again, as long as that saves bins.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturemill.llm.common import byte_texts, gather_runs, number_words, releasing, saved, slices

CAPACITY = 2048
# Text bytes a task tokenizes at a time.
SLICE_BYTES = 4 << 20
# Words a Python worker remembers, and words in a line to encode.
MOST_WORDS, LINE_WORDS = 1_000_000, 1_000
# Texts a task gets at a time.
TEXT_ROWS = 2_000
SEPARATOR = "<|startoftext|>"
GROUP_PIECES = 4000
ROUNDS = 3

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = f"{PIECES}, uid bigint, bin bigint, offset bigint, bins bigint, bound bigint"


class WordTokens(dict):
    """Words met by a Python worker, numbered, with their token ids; cleared at ``MOST_WORDS``.

    The tokenizer never joins characters across white space, so the ids of a text are those of
    its words, and each word is encoded once.  New words are encoded in long lines, set apart by
    a special token whose id no ordinary word can give.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fresh: list[bytes] = []
        self.flat, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, and how many each text has."""
        if len(self) > MOST_WORDS:
            self.clear()
            self.flat, self.lengths = self.flat[:0], self.lengths[:0]
        words, sizes = number_words(texts, self)
        if self.fresh:
            flat, lengths = self._encoded([w.decode("utf-8", "replace") for w in self.fresh])
            self.flat, self.lengths = np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths])
            self.fresh = []
        first = np.cumsum(self.lengths) - self.lengths
        each = self.lengths[words]
        ends = np.concatenate([[0], np.cumsum(each)])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[gather_runs(first[words], each)], np.diff(ends[bounds])

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [w for w in words if "<|" not in w]
        lines = [f" {SEPARATOR} ".join([*plain[i:i + LINE_WORDS], ""]) for i in range(0, len(plain), LINE_WORDS)]
        parts = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        marks = np.flatnonzero(flat == self.tokenizer.token_to_id(SEPARATOR))
        lengths = np.diff(np.concatenate([[-1], marks])) - 1
        flat = np.delete(flat, marks)
        if len(plain) == len(words):
            return flat, lengths
        # words that may spell a special token are encoded one by one
        pieces, out = iter(np.split(flat, np.cumsum(lengths)[:-1])), []
        for word in words:
            out.append(next(pieces) if "<|" not in word else np.array(
                self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32))
        return np.concatenate(out), np.array([len(o) for o in out], np.int64)


@functools.lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def token_ids(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    return word_tokens(path).ids(texts)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: its ids, then id 0, cut at ``capacity``.

    A null text is empty; repeated rows and ids are documents of their own.
    ``keep_ids`` adds the ids as an array.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = byte_texts(batch["text"]), batch["doc_id"]
            for low, high in slices(map(len, texts), SLICE_BYTES):
                ids, counts = token_ids(texts[low:high], tokenizer)
                rows, at = [], 0
                for n, count in enumerate(counts.tolist()):
                    one = np.zeros(count + 1, "<u4")
                    one[:count] = ids[at:at + count]
                    at += count
                    for piece, start in enumerate(range(0, count + 1, capacity)):
                        part = one[start:start + capacity]
                        rows.append((low + n, piece, start, len(part), zlib.crc32(part), part.tolist() if keep_ids else None))
                which, piece, start, length, crc, kept = zip(*rows, strict=True)
                columns = [names.take(pa.array(which)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                columns += [pa.array(kept, pa.list_(pa.int64()))] if keep_ids else []
                yield pa.RecordBatch.from_arrays(columns, names=[*NAMES, "ids"][:len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        releasing(cut), PIECES + (", ids array<bigint>" if keep_ids else ""))


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins.  Bit s of ``free`` is set if a bin has s left."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = used = 0
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        fits = free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            place = open_bins[space].pop()
            if not open_bins[space]:
                free ^= 1 << space
        else:
            space, place, used = capacity, used, used + 1
        bins[i], offsets[i] = place, capacity - space
        left = space - size
        if left:
            if not open_bins[left]:
                free |= 1 << left
            open_bins[left].append(place)
    return bins, offsets, used


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound that two families of dual-feasible functions give on the number of bins.

    A function f with f(x1) + ... + f(xn) <= 1 wherever x1 + ... + xn <= capacity proves that
    at least the sum of f over all pieces, rounded up, is needed.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[:capacity + 1]
    x = np.arange(capacity + 1)
    whole = -(-int((count * x).sum()) // capacity)
    best = whole
    # pieces over capacity - e count as full, those under e as nothing
    for e in np.flatnonzero(count[:capacity // 2 + 1]).tolist():
        value = np.where(x > capacity - e, capacity, np.where(x < e, 0, x))
        best = max(best, -(-int((count * value).sum()) // capacity))
    # multiples of capacity / (k + 1) count in full, others are rounded down to steps of 1 / k
    for k in range(1, 33):
        steps, rest = np.divmod((k + 1) * x, capacity)
        exact = rest == 0
        # value * k * capacity, in whole numbers
        value = np.where(exact, x * k, steps * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def _pack_groups(rows: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("uid", ignore_index=True)
        lengths = part["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        # the first piece of a bin names its sequence
        first = np.full(used, np.iinfo(np.int64).max)
        np.minimum.at(first, bins, part["uid"].to_numpy())
        return part.drop(columns="deal").assign(
            bin=first[bins], offset=offsets, bins=used, bound=lower_bound(lengths, capacity))

    dealt = rows.select(*NAMES, "uid", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)).alias("deal"))
    return dealt.groupBy("deal").applyInPandas(pack, PACKED)


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS,
) -> DataFrame:
    """Every piece with its sequence and its place there.

    Groups hold about ``group_pieces`` pieces, dealt by hash, whatever the sources are; with every
    round they hold twice as many.  A full piece is a sequence of its own.  ``certified`` tells
    that the group of the piece uses as few sequences as its bound allows.  An empty table gives no rows.
    """
    numbered = saved(pieces(docs, tokenizer, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces", TEXT_ROWS)
    full = numbered.where(F.col("length") == capacity).select(
        *NAMES, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    rows = numbered.where(F.col("length") < capacity)
    done: list[DataFrame] = []
    before: tuple[DataFrame, int] | None = None
    for turn in range(rounds):
        count = rows.count()
        groups = max(1, -(-count // (group_pieces << turn)))
        packed = saved(_pack_groups(rows, groups, turn, capacity), "packed")
        used = packed.select(F.count_distinct("bin")).first()[0]
        if before is not None and used >= before[1]:
            break
        met = F.col("bins") == F.col("bound")
        done.append(packed.where(met))
        rows = packed.where(~met)
        used = rows.select(F.count_distinct("bin")).first()[0]
        before = (rows, used)
        if used == 0 or groups == 1:
            break
    if before is not None:
        done.append(before[0])
    out = full
    for part in done:
        out = out.unionByName(part.select(
            *NAMES, F.col("bin").alias("sequence_id"), "offset", (F.col("bins") == F.col("bound")).alias("certified")))
    return out
