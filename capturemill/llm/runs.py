"""Maximal periodic runs of words, by the branching-tandem test on enhanced suffix arrays.

A square is a stretch of words followed by itself; it branches if the word after it differs from the one a period
earlier.  Two suffixes ``d`` words apart start a branching square of period ``d`` if they lie in different children
of an LCP interval of depth ``d``.  So for each interval the suffixes of all children but the largest look up the ranks
of the suffixes ``d`` words before and after them, which is n log n lookups; intervals and their children are read from the LCP
array and no tree is built.  A branching square is rotated to the left as long as the words agree: its last rotation
begins the run, the square ends it.  Squares of a multiple of the period lie in the same stretch and are merged into
the run of the smallest period.

Every eight consecutive words of a run occur at least twice in its document: as a run has ``max(24, 3 * period)`` words or more,
each of its eight-word windows has another one period away.  Stretches without such windows are left out beforehand, so most
documents need no suffix array.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturemill.llm.common import WordNumbers, byte_texts, gather_runs, number_words, releasing, slices

LEAST_WORDS, LEAST_PERIODS = 24, 3
# Windows of this many words repeat inside any run: length - 2 * period + 1 is 9 at least.
WINDOW = 8
SLICE_BYTES = 2 << 20
# Words compared per step of a rotation.
STRIDE = 32

_DRAW = np.random.default_rng(20_240_912)
FACTORS = _DRAW.integers(0, 1 << 63, WINDOW + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

COLUMNS = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


class Intervals(NamedTuple):
    """Children of all LCP intervals of positive depth: ranks first..last - 1 of a child, low..high of its interval."""

    depth: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    last: np.ndarray


def ranks(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of all suffixes, and the ranks by their first 1, 2, 4, ... symbols.

    Prefix doubling sorts only suffixes that are not alone yet.  The last symbol must occur once.
    """
    n = len(symbols)
    active = np.argsort(symbols, kind="stable")
    index = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = symbols[active[1:]] != symbols[active[:-1]]
    rank = np.empty(n, np.int64)
    rank[active] = np.maximum.accumulate(np.where(new, index, 0))
    alone = new & np.append(new[1:], True)
    active, levels, depth = active[~alone], [rank.astype(np.int32)], 1
    while len(active):
        key = rank[active] * n + rank[active + depth]
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        base, index = rank[active], np.arange(len(active))
        new, group = np.ones(len(active), bool), np.ones(len(active), bool)
        new[1:] = key[1:] != key[:-1]
        group[1:] = base[1:] != base[:-1]
        rank[active] = base + np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
        active = active[~(new & np.append(new[1:], True))]
        levels.append(rank.astype(np.int32))
        depth *= 2
    return rank, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in order; -1 for the first."""
    a, b = order[:-1].copy(), order[1:].copy()
    start, last = b.copy(), len(order) - 1
    for level in range(len(levels) - 1, -1, -1):
        ranked = levels[level]
        same = (ranked[np.minimum(a, last)] == ranked[np.minimum(b, last)]) & (a <= last) & (b <= last)
        a += same << level
        b += same << level
    return np.concatenate([[-1], b - start])


def intervals(lcp: np.ndarray) -> Intervals:
    """All children of the LCP intervals, by the nearest smaller values on both sides."""
    n = len(lcp)
    values = [*lcp.tolist(), -1]
    smaller_before, smaller_after = [0] * n, [n] * n
    stack: list[int] = []
    for at, value in enumerate(values):
        while stack and values[stack[-1]] > value:
            smaller_after[stack.pop()] = at
        if at < n:
            # an equal value hands its own smaller neighbour on
            smaller_before[at] = (smaller_before[stack[-1]] if values[stack[-1]] == value else stack[-1]) if stack else 0
            stack.append(at)
    edge = np.flatnonzero(lcp > 0)
    low = np.array(smaller_before, np.int64)[edge]
    high = np.array(smaller_after, np.int64)[edge] - 1
    depth = lcp[edge]
    # boundaries of an interval follow each other, and end where the next one begins
    order = np.lexsort((edge, depth, low))
    edge, low, high, depth = edge[order], low[order], high[order], depth[order]
    head = np.ones(len(edge), bool)
    head[1:] = (low[1:] != low[:-1]) | (depth[1:] != depth[:-1])
    last = np.where(np.append(head[1:], True), high + 1, np.append(edge[1:], 0))
    number = np.cumsum(head) - 1
    first = np.concatenate([low[head], edge])
    last = np.concatenate([edge[head], last])
    owner = np.concatenate([number[head], number])
    order = np.lexsort((last - first, owner))  # the largest child of an interval comes last
    keep = order[np.append(owner[order][1:] == owner[order][:-1], False)] if len(order) else order
    of = owner[keep]
    return Intervals(depth[head][of], low[head][of], high[head][of], first[keep], last[keep])


def branching_squares(order: np.ndarray, rank: np.ndarray, inside: Intervals) -> np.ndarray:
    """Distinct (start, period) of all branching squares."""
    n = len(order)
    size = inside.last - inside.first
    at = order[gather_runs(inside.first, size)]
    depth, low, high, first, last = (np.repeat(c, size) for c in inside)
    found = []
    for step in (depth, -depth):
        other = at + step
        seen = (other >= 0) & (other < n)
        place = rank[np.where(seen, other, 0)]
        seen &= (place >= low) & (place <= high) & ((place < first) | (place >= last))
        found.append(np.stack([np.minimum(at, other)[seen], depth[seen]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def rotated(symbols: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Words by which each square can be rotated to the left."""
    start, period = squares[:, 0], squares[:, 1]
    moved = np.zeros(len(squares), np.int64)
    active = np.arange(len(squares))
    back = np.arange(1, STRIDE + 1)
    while len(active):
        at = (start[active] - moved[active])[:, None] - back
        same = (at >= 0) & (symbols[np.maximum(at, 0)] == symbols[np.maximum(at, 0) + period[active][:, None]])
        whole = same.all(axis=1)
        moved[active] += np.where(whole, STRIDE, np.argmin(same, axis=1))
        active = active[whole]
    return moved


def maximal_runs(symbols: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``max(least, periods * period)`` symbols or more, by start and period.

    The last symbol must occur once.  About 250 bytes are held per symbol.
    """
    rank, levels = ranks(symbols)
    order = np.empty(len(rank), np.int64)
    order[rank] = np.arange(len(rank))
    runs = merged(symbols, branching_squares(order, rank, intervals(common_prefixes(order, levels))))
    runs = runs[runs[:, 1] >= np.maximum(least, periods * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def merged(symbols: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Runs (start, length, period) of some branching squares.

    Of the squares that share an end the shortest is rotated first; longer ones of a multiple of its period lie in
    the same run and need no rotation of their own.
    """
    end = squares[:, 0] + 2 * squares[:, 1]
    order = np.lexsort((squares[:, 1], end))
    squares, end = squares[order], end[order]
    found = [np.zeros((0, 3), np.int64)]
    while len(squares):
        head = np.ones(len(end), bool)
        head[1:] = end[1:] != end[:-1]
        shortest, of = squares[head], np.cumsum(head) - 1
        start = shortest[:, 0] - rotated(symbols, shortest)
        found.append(np.stack([start, end[head] - start, shortest[:, 1]], axis=1))
        left = (squares[:, 0] < start[of]) | (squares[:, 1] % shortest[of, 1] > 0)
        squares, end = squares[left], end[left]
    return np.concatenate(found)


def repeated_stretches(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words whose windows all occur twice in their document, long enough for a run.

    ``hashes`` are the words of all documents one after the other, ``sizes`` their numbers.  Windows are compared by
    64-bit hashes; a collision costs time, never a run.
    """
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = len(hashes) - WINDOW + 1
    if count < 1:
        return empty
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = owner[:count].astype(np.uint64) * FACTORS[-1]
    for i in range(WINDOW):
        total += hashes[i:i + count] * FACTORS[i]
    total = (total ^ (total >> np.uint64(31))) * FACTORS[-2]
    places = np.flatnonzero(owner[:count] == owner[WINDOW - 1:])  # windows within one document
    order = places[np.argsort(total[places], kind="stable")]
    same = total[order[1:]] == total[order[:-1]]
    twice = np.zeros(count + 1, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.diff(twice.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + WINDOW - 1
    long = ends - starts >= LEAST_WORDS
    return starts[long], ends[long]


def runs_of_texts(words: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Runs of each document of a slice; ``words`` are numbers, equal for equal words, ``hashes`` of any kind."""
    starts, ends = repeated_stretches(hashes, sizes)
    out = [np.zeros((0, 3), np.int64)] * len(sizes)
    if not len(starts):
        return out
    bounds = np.cumsum([0, *sizes])
    owner = np.searchsorted(bounds, starts, side="right") - 1
    lengths = ends - starts
    # symbols differ between documents, and a symbol of its own ends each stretch
    at = gather_runs(starts, lengths)
    coded = words[at] + np.repeat(owner, lengths) * (int(words.max()) + 1)
    breaks = np.cumsum(lengths)
    symbols = np.insert(coded, breaks, -1 - np.arange(len(breaks)))
    runs = maximal_runs(symbols)
    begins = np.concatenate([[0], breaks[:-1] + np.arange(1, len(breaks))])
    stretch = np.searchsorted(begins, runs[:, 0], side="right") - 1
    runs[:, 0] += starts[stretch] - begins[stretch] - bounds[owner[stretch]]
    edges = np.searchsorted(owner[stretch], np.arange(len(sizes) + 1))
    for i in np.unique(owner[stretch]).tolist():
        out[i] = runs[edges[i]:edges[i + 1]]
    return out


def kept_words(size: int, runs: np.ndarray) -> np.ndarray:
    """Which words of a document no run repeats: those outside of runs, and the first period of each unless another run drops it."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) == 0


def find_runs(docs: DataFrame) -> DataFrame:
    """Every row of (doc_id, text) with its runs of words: (doc_id, n_words, runs, collapsed).

    ``runs`` holds (start, length, period) by start and period, starts counted in words from 0.  ``collapsed`` joins
    the words that stay by one space: a word goes if a run contains it after the run's first period.  A null text is empty;
    texts without words have no runs and collapse to empty text.  Rows are taken one by one, so repeated rows and null ids
    all stay.  Other columns are not looked at.  A document is held by one task, its repeated stretches at about 250 bytes a word.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch["text"])
            for low, high in slices(map(len, texts), SLICE_BYTES):
                split = [t.split() for t in texts[low:high]]
                numbers = WordNumbers()
                words, sizes = number_words(texts[low:high], numbers)
                hashes = (np.arange(1, len(numbers) + 1, dtype=np.uint64) * FACTORS[-2])[words]
                found = runs_of_texts(words, hashes ^ (hashes >> np.uint64(29)), sizes)
                collapsed = []
                for tokens, runs in zip(split, found, strict=True):
                    if len(runs):
                        tokens = [w for w, kept in zip(tokens, kept_words(len(tokens), runs).tolist(), strict=True) if kept]
                    collapsed.append(b" ".join(tokens))
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(low, high - low), pa.array(sizes, pa.int64()), _run_lists(found),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(search), COLUMNS)


def _run_lists(found: list[np.ndarray]) -> pa.Array:
    rows = np.concatenate(found)
    fields = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), fields)


def greatest_run(runs: Column) -> Column:
    """The run of greatest exact length / period, the first of these by start and period; null without runs."""
    higher = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, run: F.when(higher(run, best), run).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where one document in ten repeats a stretch of its words from some place on.

    With h the crc32 of the id as text (a null id counts as empty text) and g = floor(h / 10), documents with h % 10 = 0
    and n > 0 words get the words a, ..., a + p - 1 again and again from word a = g % n on, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    trimmed = F.btrim("text", F.lit(" \t\n\u000b\f\r"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(
        (h % 10 == 0) & (trimmed != ""), F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), left)), " ")
    return rows.select("doc_id", F.when(F.col("words").isNotNull(), planted).otherwise(F.col("text")).alias("text"))
