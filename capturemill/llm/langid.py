"""Language identification by bit-sliced Bloom filters over character n-grams.

One array of slots serves all languages: a slot holds one bit per language, so the AND of an
n-gram's slots is the set of all languages that contain it.  A document counts, per language,
the n-grams found there; the counts are corrected for the false positives that the fill of the language's
bits predicts, and the largest decides.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturemill.llm.common import WordNumbers, byte_texts, number_words, releasing, saved, slices

ORDERS = (2, 3, 4)
SLOTS = 1 << 20
PROBES = 4
# A language contains an n-gram that makes up this share of its n-grams, and half the share that any other
# language gives it.  No language can contain more than 1 / LEAST_RATE n-grams, which bounds the fill.
LEAST_RATE = 1e-5
LEAST_OF_BEST = 0.5
SLICE_BYTES = 4 << 20
# Words a task remembers, and texts it gets at a time.
MOST_WORDS, TEXT_ROWS = 400_000, 1_000
UNKNOWN = "und"
LANE = 32


def letter_runs(token: bytes) -> list[str]:
    word = token.decode("utf-8", "replace").lower()
    return [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()


def grams(token: bytes) -> list[str]:
    """The n-grams of the letter runs of a token, with a blank on either side of a run."""
    out = []
    for run in letter_runs(token):
        padded = f" {run} "
        for n in ORDERS:
            out += [padded[i:i + n] for i in range(len(padded) - n + 1)]
    return out


def gram_counts(docs: DataFrame, languages: list[str]) -> DataFrame:
    """(gram, language, n) of each task's documents; ``language`` is a place in ``languages``."""
    place = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[WordNumbers, np.ndarray]] = {}
        for batch in batches:
            texts, langs = byte_texts(batch["text"]), batch["lang"].to_pylist()
            for name in sorted(set(langs)):
                own = [t for t, lang in zip(texts, langs, strict=True) if lang == name]
                for low, high in slices(map(len, own), SLICE_BYTES):
                    numbers, total = held.get(place[name], (WordNumbers(), np.zeros(0, np.int64)))
                    words, _ = number_words(own[low:high], numbers)
                    now = np.bincount(words, minlength=len(numbers))
                    now[:len(total)] += total
                    held[place[name]] = numbers, now
            if sum(len(numbers) for numbers, _ in held.values()) > MOST_WORDS:
                yield from _counted(held)
                held = {}
        yield from _counted(held)

    return docs.select("text", "lang").mapInArrow(releasing(count), "gram string, language int, n bigint")


def _counted(held: dict[int, tuple[WordNumbers, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of counted words; each distinct word is cut up once."""
    for language, (numbers, total) in held.items():
        counts: dict[str, int] = defaultdict(int)
        for word, n in zip(numbers, total.tolist(), strict=True):
            for gram in grams(word):
                counts[gram] += n
        yield pa.RecordBatch.from_arrays([
            pa.array(counts.keys(), pa.string()), pa.array(np.full(len(counts), language, np.int32)), pa.array(counts.values(), pa.int64()),
        ], names=["gram", "language", "n"])


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # (slots, words of 64 languages)
    false_rate: np.ndarray  # per language


def train(docs: DataFrame, slots: int = SLOTS) -> Filters:
    """Filters from the documents' (text, lang); rows without a language are left out.

    What reaches the driver is bounded by the number of slots and of languages.
    """
    known = docs.where("lang is not null")
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    width = max(1, -(-len(languages) // 64))
    table = np.zeros((slots, width), np.uint64)
    if languages:
        counts = saved(gram_counts(known, languages).groupBy("gram", "language").agg(F.sum("n").alias("n")), "grams", TEXT_ROWS)
        totals = {r["language"]: r["n"] for r in counts.groupBy("language").agg(F.sum("n").alias("n")).collect()}
        total = F.element_at(F.create_map(*[F.lit(x) for pair in totals.items() for x in pair]), F.col("language")) if totals else F.lit(1)
        rated = counts.withColumn("rate", F.col("n") / total)
        rated = rated.withColumn("best", F.max("rate").over(Window.partitionBy("gram"))).where(
            (F.col("rate") >= LEAST_RATE) & (F.col("rate") >= LEAST_OF_BEST * F.col("best")))
        h = F.xxhash64("gram")
        low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
        probes = F.array(*[F.pmod(low + high * i, F.lit(slots)) for i in range(PROBES)])
        bit = F.expr("shiftleft(cast(1 as bigint), language % 64)")
        filled = rated.select(F.explode(probes).alias("slot"), (F.col("language") / 64).cast("int").alias("word"), bit.alias("bit")).groupBy(
            "slot", "word").agg(F.bit_or("bit").alias("bits")).toPandas()
        table[filled["slot"].to_numpy(np.int64), filled["word"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([(table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(languages))])
    return Filters(languages, table, fill ** PROBES)


class GramLanguages(dict):
    """The languages that contain an n-gram, as one lane of ``LANE`` bits each; lane 0 counts the n-gram itself."""

    def __init__(self, filters: Filters):
        super().__init__()
        self.filters = filters

    def __missing__(self, gram: str) -> int:
        h = xxhash.xxh64_intdigest(gram.encode("utf-8", "replace"), 42)
        low, high = h & 0xFFFFFFFF, h >> 32 | 1
        table = self.filters.slots
        size, lanes = len(table), 1
        at = [(low + high * i) % size for i in range(PROBES)]
        for word in range(table.shape[1]):
            bits = int(np.bitwise_and.reduce(table[at, word]))
            while bits:
                lowest = bits & -bits
                lanes |= 1 << LANE * (word * 64 + lowest.bit_length())
                bits ^= lowest
        self[gram] = lanes
        return lanes


class WordLanguages(dict):
    """Words a task has met, numbered, with the counts of their n-grams; cleared at ``MOST_WORDS``."""

    def __init__(self, filters: Filters):
        super().__init__()
        self.grams, self.lanes = GramLanguages(filters), len(filters.languages) + 1
        self.fresh: list[bytes] = []
        self.counts = np.zeros((0, self.lanes), np.uint32)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number

    def found(self, texts: list[bytes]) -> np.ndarray:
        """Per text the number of n-grams, then of those found in each language."""
        if len(self) > MOST_WORDS:
            self.clear()
            self.grams.clear()
            self.counts = self.counts[:0]
        words, sizes = number_words(texts, self)
        if self.fresh:
            look, size = self.grams.__getitem__, self.lanes * LANE // 8
            packed = b"".join(sum(map(look, grams(word))).to_bytes(size, "little") for word in self.fresh)
            self.counts = np.concatenate([self.counts, np.frombuffer(packed, f"<u{LANE // 8}").reshape(-1, self.lanes)])
            self.fresh = []
        out = np.zeros((len(texts), self.lanes))
        filled = np.flatnonzero(sizes)
        if len(filled):
            starts = (np.cumsum(sizes) - sizes)[filled]
            out[filled] = np.add.reduceat(self.counts[words], starts, axis=0, dtype=np.int64)
        return out


def decide(counts: np.ndarray, filters: Filters) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the corrected count of the best language over that of all."""
    if not filters.languages:
        return [UNKNOWN] * len(counts), np.zeros(len(counts))
    total, found = counts[:, :1], counts[:, 1:]
    right = np.maximum(found - total * filters.false_rate, 0) / np.maximum(1 - filters.false_rate, 1e-9)
    best, everything = right.argmax(axis=1), right.sum(axis=1)
    score = np.where(everything > 0, right.max(axis=1) / np.maximum(everything, 1e-300), 0.0)
    lettered = total[:, 0] > 0
    names = [filters.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
    return names, np.where(lettered, score, 0.0)


def identify(docs: DataFrame, filters: Filters, *carry: str) -> DataFrame:
    """(carried columns, lang_pred, score) for every document by its whole text.

    A text without a letter, or null, is ``und`` with score 0.  Texts of which no n-gram is known get the first
    language with score 0.  Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    # carried columns travel under names of their own, the text once
    names = {c: "__text" if c == "text" else f"c{i}" for i, c in enumerate(carry)}
    chosen = docs.select(F.col("text").alias("__text"), *[F.col(f"`{c}`").alias(n) for c, n in names.items() if c != "text"])
    types = {f.name: f.dataType.simpleString() for f in chosen.schema.fields}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordLanguages(shared.value)
        for batch in batches:
            texts = byte_texts(batch["__text"])
            for low, high in slices(map(len, texts), SLICE_BYTES):
                found, scores = decide(cache.found(texts[low:high]), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [*(batch[n].slice(low, high - low) for n in names.values()), pa.array(found, pa.string()), pa.array(scores)],
                    names=[*names.values(), "lang_pred", "score"])

    out = chosen.mapInArrow(releasing(score), ", ".join([*(f"{n} {types[n]}" for n in names.values()), "lang_pred string", "score double"]))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "lang_pred", "score")


def held_out_identification(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learn from the rows that are not held out, predict all: (doc_id, held_out, lang_pred, score)."""
    filters = train(docs.where(~held_out).select("text", "lang"))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), filters, "doc_id", "held_out")
