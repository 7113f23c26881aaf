"""Hidden Markov language model: Baum-Welch over the whole corpus, exact scaled forward scores.

Words that make up ``CLASS_RATE`` of the training tokens, and the end of a text, are symbols of their own;
any other word belongs to a class by its last bytes and is drawn from its class in proportion to its
count + 0.5, where each class keeps 0.5 for words never seen.  So the model is a probability over all
texts, and the hidden chain sees a bounded alphabet.

Counts of words that are not frequent never reach the driver: each text keeps the hashes of its rare words,
which are joined with the counts.  No rare word makes up ``KNOWN_RATE`` of the tokens, so no key of that join is hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturemill.llm.common import distinct_words, gather_runs, releasing, saved, slices

STATES = 8
# At most 60,000 words are symbols and at most 1,000,000 are known to every task, whatever the corpus is.
CLASS_RATE, KNOWN_RATE = 1 / 60_000, 1e-6
SUFFIX_BYTES, SUFFIX_CLASSES = 3, 2048
ENDING_SIGNS = ".,;:!?\"'()|-"  # not part of a word's ending
END = 0
WINDOW = 256
# Windows a task handles side by side.
SIDE_BY_SIDE = 1024
ROUNDS = 12
SMOOTHING = 20.0
SLICE_BYTES = 8 << 20
MOST_WORDS = 1_000_000
SEED = 42
LN10 = math.log(10)


def suffix_class(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word.rstrip(ENDING_SIGNS.encode())[-SUFFIX_BYTES:]) % SUFFIX_CLASSES


def suffix_classes(words: pa.Array) -> np.ndarray:
    """``suffix_class`` of every word; each ending is hashed once."""
    endings = pc.binary_slice(pc.ascii_rtrim(words.cast(pa.string(), safe=False), ENDING_SIGNS).cast(pa.binary()), -SUFFIX_BYTES, None).dictionary_encode()
    return np.array([suffix_class(e) for e in endings.dictionary.to_pylist()], np.int64)[endings.indices.to_numpy()]


def word_hash(word: bytes) -> int:
    """The hash that Spark's xxhash64 gives for the word."""
    h = xxhash.xxh64_intdigest(word, SEED)
    return h - (1 << 64) if h >> 63 else h


def text_bytes(texts: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over whole texts, A-Z lower-cased; each task sums up first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for low, high in slices(text_bytes(batch["text"]), SLICE_BYTES):
                words, numbers, _ = distinct_words(batch["text"].slice(low, high - low))
                held.append(pa.table({"word": words, "n": np.bincount(numbers, minlength=len(words))}))
                rows += len(words)
                if rows > MOST_WORDS:
                    held = [summed(held)]
                    rows = len(held[0])
                    if 2 * rows > MOST_WORDS:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from summed(held).to_batches()

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    return docs.select("text").mapInArrow(releasing(count), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def class_masses(counts: DataFrame) -> DataFrame:
    """(suffix class, sum of count + 0.5) over words that are no symbols."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SUFFIX_CLASSES)
        for batch in batches:
            total += np.bincount(suffix_classes(batch["word"]), weights=batch["n"].to_numpy() + 0.5, minlength=SUFFIX_CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SUFFIX_CLASSES)), pa.array(total)], names=["class", "mass"])

    return counts.select("word", "n").mapInArrow(releasing(add), "class bigint, mass double").groupBy("class").agg(F.sum("mass").alias("mass"))


@dataclass
class Vocabulary:
    tokens: int  # N
    types: int  # V
    known: dict[bytes, tuple[int, int]]  # frequent word: its count and symbol
    masses: np.ndarray  # count + 0.5 behind every symbol: the end, words, suffix classes
    words: int  # symbols that are words


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    row = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens = (row["n"] or 0) + texts
    types = row["v"] + (1 if texts else 0)
    frequent = counts.where(F.col("n") >= KNOWN_RATE * tokens).toPandas().sort_values("word", ignore_index=True)
    symbols = frequent["n"].to_numpy() >= CLASS_RATE * tokens
    number = np.where(symbols, np.cumsum(symbols), 0)
    words = int(symbols.sum())
    known = {}
    for word, n, own in zip(frequent["word"], frequent["n"].tolist(), number.tolist(), strict=True):
        word = bytes(word)
        known[word] = (n, own or 1 + words + suffix_class(word))
    rest = class_masses(counts.where(F.col("n") < CLASS_RATE * tokens)).toPandas()
    masses = np.full(1 + words + SUFFIX_CLASSES, 0.5)
    masses[END] = texts + 0.5
    masses[1:words + 1] = frequent["n"].to_numpy()[symbols] + 0.5
    masses[1 + words + rest["class"].to_numpy(np.int64)] += rest["mass"].to_numpy()
    return Vocabulary(tokens, types, known, masses, words)


ENCODED = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, within double, symbols binary, "
           "rare array<bigint>, times array<int>")


def encoded(docs: DataFrame, held_out: Column, vocabulary: Vocabulary) -> DataFrame:
    """Each text as symbols, with what its frequent words add to the scores and the hashes of its rare words.

    ``base`` and ``within`` still lack log10(count + 0.5) of the rare words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        whole = math.log10(v.tokens + 0.5 * (v.types + 1)) if v.tokens else math.log10(0.5)
        masses = np.log10(v.masses)
        end_count = v.masses[END] - 0.5
        known_words = pa.array(list(v.known), pa.binary())
        # the last place is that of all other words
        known_counts = np.array([n for n, _ in v.known.values()] + [0], np.int64)
        known_symbols = np.array([symbol for _, symbol in v.known.values()] + [0], np.int64)
        for batch in batches:
            for low, high in slices(text_bytes(batch["text"]), SLICE_BYTES):
                vocabulary, words, sizes = distinct_words(batch["text"].slice(low, high - low))
                texts = len(sizes)
                place = pc.index_in(vocabulary, value_set=known_words)
                strange = place.is_null().to_numpy(zero_copy_only=False)
                place = place.fill_null(len(known_words)).to_numpy()
                count, symbol, hashes = known_counts[place], known_symbols[place], np.zeros(len(place), np.int64)
                others = vocabulary.filter(pa.array(strange))
                symbol[strange] = 1 + v.words + suffix_classes(others)
                hashes[strange] = np.fromiter(map(word_hash, others.to_pylist()), np.int64, len(others))
                is_known = count > 0
                log_count = np.where(is_known, np.log10(np.maximum(count, 1) + 0.5), 0.0)
                inside = np.where(symbol > v.words, log_count - masses[symbol], 0.0)
                text = np.repeat(np.arange(texts), sizes)
                base = np.bincount(text, weights=log_count[words], minlength=texts) + math.log10(end_count + 0.5) - whole * (sizes + 1)
                known = is_known[words]
                n_known = np.bincount(text[known], minlength=texts) + (end_count > 0)
                unknown, times = np.unique(text[~known] * len(vocabulary) + words[~known], return_counts=True)
                rare_ends = np.searchsorted(unknown, np.arange(texts + 1) * len(vocabulary))
                chained = np.insert(symbol[words], np.cumsum(sizes), END).astype("<u2")
                chain_ends = np.concatenate([[0], np.cumsum(2 * (sizes + 1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(low, texts), batch["held_out"].slice(low, texts), pa.array(sizes + 1), pa.array(n_known, pa.int64()),
                    pa.array(base, pa.float64()), pa.array(np.bincount(text, weights=inside[words], minlength=texts), pa.float64()),
                    pa.Array.from_buffers(pa.binary(), texts, [None, pa.py_buffer(chain_ends), pa.py_buffer(chained)]),
                    pa.ListArray.from_arrays(rare_ends.astype(np.int32), hashes[unknown % max(len(vocabulary), 1)]),
                    pa.ListArray.from_arrays(rare_ends.astype(np.int32), times.astype(np.int32)),
                ], names=[part.split()[0] for part in ENCODED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(releasing(encode), ENCODED)


@dataclass
class Chain:
    start: np.ndarray  # of a text
    middle: np.ndarray  # of a training window inside a text
    step: np.ndarray
    emit: np.ndarray  # (symbols, states)


def first_chain(masses: np.ndarray, states: int, seed: int = 1) -> Chain:
    """Sticky states whose emissions are the symbol shares, each disturbed in its own way."""
    draw = np.random.default_rng(seed)
    emit = masses[:, None] * np.exp(draw.normal(size=(len(masses), states)))
    even = np.full(states, 1.0 / states)
    step = np.full((states, states), 0.05 / max(states - 1, 1))
    np.fill_diagonal(step, 0.95 if states > 1 else 1.0)
    return Chain(even, even, step, emit / emit.sum(axis=0))


def expected_counts(symbols: list[np.ndarray], chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    """Expected emissions (symbols, states), and rows for the starts, the middles and the steps of the states."""
    states = chain.step.shape[0]
    emit, step = chain.emit.astype(np.float32), chain.step.astype(np.float32)
    back_step, ones = np.ascontiguousarray(step.T), np.ones(states, np.float32)
    flat = np.concatenate(symbols).astype(np.int64)
    lengths = np.array([len(s) for s in symbols])
    begins = np.cumsum(lengths) - lengths
    parts = -(-lengths // WINDOW)
    inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(begins, parts) + inside * WINDOW
    sizes = np.minimum(np.repeat(lengths, parts) - inside * WINDOW, WINDOW)
    order = np.argsort(-sizes, kind="stable")
    emitted = np.zeros((states, len(emit)))
    moves = np.zeros((2 + states, states))
    for low in range(0, len(order), SIDE_BY_SIDE):
        chosen = order[low:low + SIDE_BY_SIDE]
        start, size, head = starts[chosen], sizes[chosen], inside[chosen] == 0
        most = int(size[0])
        active = np.searchsorted(-size, -np.arange(most), side="left")
        # Column edges[t] + i is the t-th symbol of the i-th window: a step of all windows is a run of columns.
        edges = np.concatenate([[0], np.cumsum(active)])
        seen = flat[start[gather_runs(np.zeros(most, np.int64), active)] + np.repeat(np.arange(most), active)]
        likely = np.ascontiguousarray(emit.take(seen, axis=0).T)
        forward = np.empty_like(likely)
        for t in range(most):
            now = slice(edges[t], edges[t + 1])
            alpha = forward[:, now]
            if t:
                np.matmul(back_step, forward[:, edges[t - 1]:edges[t - 1] + active[t]], out=alpha)
            else:
                alpha[:] = np.where(head, chain.start[:, None], chain.middle[:, None])
            alpha *= likely[:, now]
            scale = 1 / np.maximum(ones @ alpha, np.float32(1e-30))
            alpha *= scale
            likely[:, now] *= scale
        beta = np.ones((states, active[-1]), np.float32)
        pairs = np.zeros((states, states), np.float32)
        for t in range(most - 1, -1, -1):
            now = slice(edges[t], edges[t + 1])
            if t:
                back = likely[:, now] * beta
                pairs += forward[:, edges[t - 1]:edges[t - 1] + active[t]] @ back.T
                wider = np.ones((states, active[t - 1]), np.float32)
                np.matmul(step, back, out=wider[:, :active[t]])
            forward[:, now] *= beta  # what the state is after all symbols of its window
            beta = wider if t else beta
        first = forward[:, :active[0]]
        moves[0] += first[:, head].sum(axis=1)
        moves[1] += first[:, ~head].sum(axis=1)
        moves[2:] += pairs * step
        for k in range(states):
            emitted[k] += np.bincount(seen, weights=forward[k], minlength=len(emit))
    return emitted.T, moves


def baum_welch(rows: DataFrame, chain: Chain, masses: np.ndarray) -> Chain:
    """One round over all texts of ``rows``: counts are summed up across tasks by symbol.  Without texts the chain stays as it is."""
    shared = rows.sparkSession.sparkContext.broadcast(chain)
    states = chain.step.shape[0]
    names = [f"s{k}" for k in range(states)]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitted = np.zeros((len(shared.value.emit), states))
        moves = np.zeros((2 + states, states))
        for batch in batches:
            held = [np.frombuffer(b, "<u2") for b in batch["symbols"].to_pylist()]
            if held:
                e, m = expected_counts(held, shared.value)
                emitted += e
                moves += m
        some = np.flatnonzero(emitted.any(axis=1))
        keys = np.concatenate([some, -1 - np.arange(2 + states)])
        values = np.concatenate([emitted[some], moves])
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(values[:, k]) for k in range(states))], names=["symbol", *names])

    summed = rows.select("symbols").mapInArrow(releasing(expect), ", ".join(["symbol bigint", *(f"{n} double" for n in names)])).groupBy("symbol").agg(
        *[F.sum(n).alias(n) for n in names]).toPandas()
    shared.unpersist()
    keys, values = summed["symbol"].to_numpy(np.int64), summed[names].to_numpy(np.float64)
    emitted, moves = np.zeros_like(chain.emit), np.zeros((2 + states, states))
    emitted[keys[keys >= 0]] = values[keys >= 0]
    moves[-1 - keys[keys < 0]] = values[keys < 0]
    if not emitted.any():
        return chain
    share = masses / masses.sum()
    emit = emitted + SMOOTHING * share[:, None]
    start, middle, step = moves[0] + 0.1, moves[1] + 0.1, moves[2:] + 0.1
    return Chain(start / start.sum(), middle / middle.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def log10_likelihoods(symbols: list[np.ndarray], chain: Chain) -> np.ndarray:
    """log10 probability of each symbol sequence, by the forward recursion scaled at every step."""
    lengths = np.array([len(s) for s in symbols])
    flat = np.concatenate(symbols).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
    logs = np.zeros(len(order))
    alpha = np.tile(chain.start, (len(order), 1))
    for t, n in enumerate(active.tolist()):
        alpha = (alpha if t == 0 else alpha[:n] @ chain.step) * chain.emit[flat[starts[:n] + t]]
        total = alpha.sum(axis=1)
        logs[:n] += np.log(total)
        alpha /= total[:, None]
    out = np.empty(len(order))
    out[order] = logs / LN10
    return out


def forward_scores(rows: DataFrame, chain: Chain) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(chain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(b, "<u2") for b in batch["symbols"].to_pylist()]
            if held:
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c] for c in batch.schema.names if c != "symbols"), pa.array(log10_likelihoods(held, shared.value))],
                    names=[*(c for c in batch.schema.names if c != "symbols"), "chain"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "symbols"]
    return rows.mapInArrow(releasing(score), ", ".join([*kinds, "chain double"]))


def train(rows: DataFrame, masses: np.ndarray, states: int = STATES) -> Chain:
    """Baum-Welch, every round over all texts."""
    chain = first_chain(masses, states)
    for _ in range(ROUNDS):
        chain = baum_welch(rows, chain, masses)
    return chain


def scores(docs: DataFrame, held_out: Column, states: int = STATES) -> DataFrame:
    """Learn from the documents that are not held out and score all by their whole texts.

    Gives (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).  A null text is empty: its one
    token is the end.  Repeated rows count each time.  Without training texts all words are unseen.  Other columns
    are not looked at.
    """
    counts = saved(word_counts(docs.where(~held_out)), "word-counts")
    v = vocabulary(counts, docs.where(~held_out).count())
    rows = saved(encoded(docs, held_out, v).withColumn("uid", F.monotonically_increasing_id()), "symbols")
    chain = train(rows.where(~F.col("held_out")), v.masses, states)

    uncommon = counts.where(F.col("n") < KNOWN_RATE * v.tokens).select(F.xxhash64("word").alias("hash"), "n")
    rare = rows.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("one")).select(
        "uid", F.col("one.rare").alias("hash"), F.col("one.times").alias("times"))
    seen = F.coalesce("n", F.lit(0))
    added = rare.join(uncommon, "hash", "left").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(seen + 0.5)).alias("rare_logs"), F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    scored = forward_scores(rows.select("uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "within", "symbols"), chain)
    logs = F.coalesce("rare_logs", F.lit(0.0))
    return scored.join(added, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"),
        (F.col("chain") + F.col("within") + logs).alias("score"))
