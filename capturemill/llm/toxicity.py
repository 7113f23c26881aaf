"""Toxicity scores of restored text: a noisy channel undoes leetspeak, spacing and repetition.

Every token is a lattice: a sign may stand for letters it looks like, a separator between
letters for nothing, a run of two or more equal letters for one or two of them.  A Viterbi search under a character
trigram model, learnt from the words of all documents, picks the path.  Tokens whose lattice has a single path need no search.
A token of signs only may also stay as it is; it, and a word with doubled letters, is read as it is written besides.
Runs of single characters are tried as one spaced-out word besides.

The scorer adds up evidence weights of words and word beginnings of the restored text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturemill.llm.common import distinct_words, gather_runs, releasing, saved, slices
from capturemill.llm.minhash import near_duplicates
from capturemill.session import small_side

# The letters that a sign may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "#": "h",
}
# Signs that are more often punctuation than a letter.
MARKS = "!(|+#"
SEPARATORS = ".-_*~·,'/\\:;"
EDGES = ".,;:?\"'`´()[]{}<>«»“”„‚‘’…*_~-–—/\\#&=%^"

# Channel costs, natural logs: a sign read as a letter, a separator dropped, a run of three or more shortened, a single
# letter written twice, and each sign of a token that stays as it is.
SIGN, DROPPED, SHORTENED, DOUBLED, LEFT = -1.0, -0.5, -0.7, -4.0, -5.0
# Decoded tokens a task remembers.
MOST_DECODED = 200_000
NONE: list[int] = []
TWICE, THRICE = re.compile(r"(.)\1", re.DOTALL), re.compile(r"(.)\1\1+", re.DOTALL)
SYMBOLS = 64
PREFIXES = (4, 5, 6)
# Weighted features that are broadcast; a larger table is joined.
MOST_BROADCAST = 200_000
SLICE_BYTES = 4 << 20
# A document's weight in whole numbers, so that sums do not depend on their order.
WHOLE = 1 << 32


def symbol(char: str) -> int:
    """a-z are 1 to 26, other letters share the rest by code point; 0 is a word's edge."""
    code = ord(char)
    return code - 96 if 97 <= code <= 122 else 27 + code % (SYMBOLS - 27)


def core(token: bytes) -> str:
    """A token in lower case without punctuation at its ends; signs that may be letters stay."""
    return token.decode("utf-8", "replace").lower().strip(EDGES)


def text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in a row, some at a time."""
    for low, high in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE_BYTES):
        yield texts.slice(low, high - low)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(trigram, n) over the letter-only words of all documents, each word with two edges before and one after."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS ** 3, np.int64)
        for batch in batches:
            for texts in text_slices(batch["text"]):
                vocabulary, words, _ = distinct_words(texts)
                weights = np.bincount(words, minlength=len(vocabulary))
                cores = map(core, vocabulary.to_pylist())
                plain = [(c, n) for c, n in zip(cores, weights.tolist(), strict=True) if c.isalpha()]
                if not plain:
                    continue
                # two edges open a word, and the next word's first edge closes it
                points = np.frombuffer(("\0\0" + "\0\0".join(c for c, _ in plain) + "\0\0").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
                codes = np.where(points == 0, 0, np.where((points >= 97) & (points <= 122), points - 96, 27 + points % (SYMBOLS - 27)))
                lengths = np.array([len(c) for c, _ in plain])
                each = np.repeat(np.array([n for _, n in plain]), lengths + 1)
                first = np.repeat(np.cumsum(lengths + 2) - (lengths + 2), lengths + 1)
                at = first + np.arange(len(each)) - np.repeat(np.cumsum(lengths + 1) - (lengths + 1), lengths + 1)
                index = (codes[at] * SYMBOLS + codes[at + 1]) * SYMBOLS + codes[at + 2]
                np.add.at(total, index, each)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["trigram", "n"])

    return docs.select("text").mapInArrow(releasing(count), "trigram bigint, n bigint").groupBy("trigram").agg(F.sum("n").alias("n"))


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probability of a symbol after two others; the table has SYMBOLS ** 3 entries whatever the input."""
    counts = np.full((SYMBOLS, SYMBOLS, SYMBOLS), 0.0)
    seen = trigram_counts(docs).toPandas()
    counts.reshape(-1)[seen["trigram"].to_numpy(np.int64)] = seen["n"].to_numpy()
    single = counts.sum(axis=(0, 1)) + 0.5
    single /= single.sum()
    pairs = counts.sum(axis=0)
    pairs = (pairs + 10 * single) / (pairs.sum(axis=1, keepdims=True) + 10)
    return np.log((counts + 10 * pairs) / (counts.sum(axis=2, keepdims=True) + 10))


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """Steps of the lattice: each a list of (letters, channel cost).  Among signs only, none is mere punctuation."""
    steps: list[list[tuple[str, float]]] = []
    dropped = DROPPED if any(c.isalpha() for c in word) else LEFT
    i = 0
    while i < len(word):
        char, j = word[i], i
        while j < len(word) and word[j] == char:
            j += 1
        run = j - i
        if char in LOOKS_LIKE:
            options = [(letter, SIGN) for letter in LOOKS_LIKE[char]] + ([("", dropped)] if char in MARKS else [])
        elif char.isalpha():
            options = [(char, 0.0)]
        elif char in SEPARATORS:
            options = [("", DROPPED)]
        else:
            options = [("", DROPPED * 4)]
        if options[0][0] == "":
            steps.append(options)
        elif run >= 3:
            steps.append([(letter * n, cost + SHORTENED) for letter, cost in options for n in (1, 2) if letter or n == 1])
        elif run == 2:
            steps.append([(a + b, x + y) for a, x in options for b, y in options] + [(a, x + DOUBLED) for a, x in options if a])
        else:
            steps.append(options)
        i = j
    return steps


def restored(word: str, model: np.ndarray) -> str:
    """The best path through the lattice of a word; a word of signs only also has the path that leaves it as it is."""
    lettered = any(c.isalpha() for c in word)
    if not TWICE.search(word) if word.isalpha() else not lettered and not any(c in LOOKS_LIKE for c in word):
        return word
    # one row of doubles, whose items are plain floats
    table = memoryview(model.reshape(-1))
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for step in lattice(word):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in best.items():
            for letters, cost in step:
                x, y, total = a, b, score + cost
                for letter in letters:
                    z = symbol(letter)
                    total += table[(x * SYMBOLS + y) * SYMBOLS + z]
                    x, y = y, z
                if (x, y) not in after or total > after[x, y][0]:
                    after[x, y] = (total, (path, letters) if letters else path)
        best = after
    total, path = max(((s + table[(a * SYMBOLS + b) * SYMBOLS], p) for (a, b), (s, p) in best.items()), key=lambda t: t[0])
    if not lettered and (path is None or total <= LEFT * len(THRICE.sub(r"\1\1", word))):
        return word
    out = []
    while path is not None:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(f"{word[:n]}…" for n in PREFIXES if len(word) > n)]


class Decoder:
    """Readings of tokens; what needs a search is searched once as long as it is remembered."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.known: dict[str, list[str]] = {}

    def features(self, word: str) -> list[str]:
        """Features of the restored word, and of the written one where signs or doubled letters may be meant as they are."""
        if word.isalpha() and not TWICE.search(word):
            return features(word)
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= MOST_DECODED:
                self.known.clear()
            meant = restored(word, self.model)
            as_written = not THRICE.search(word) if word.isalpha() else not any(c.isalpha() for c in word)
            self.known[word] = found = list(dict.fromkeys([*features(meant), *(features(word) if as_written else [])]))
        return found


class Reader:
    """Distinct features of whole texts."""

    def __init__(self, decoder: Decoder):
        self.decoder = decoder
        self.numbers: dict[str, int] = {}

    def of_word(self, word: str) -> list[int]:
        """All features of a word."""
        return [self.numbers.setdefault(f, len(self.numbers)) for f in self.decoder.features(word)]

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Text and feature numbers, each pair once, in ascending order."""
        vocabulary, flat, sizes = distinct_words(texts)
        cores = [core(w) for w in vocabulary.to_pylist()]
        lists = [self.of_word(c) if c else [] for c in cores]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter((i for part in lists for i in part), np.int64, int(lengths.sum()))
        single = np.fromiter((len(c) == 1 for c in cores), bool, len(cores))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        spaced = [(text, i) for text, word in self._spaced(flat, owner, single, cores) for i in self.of_word(word)]
        more = np.array(spaced, np.int64).reshape(-1, 2)
        telling = lengths[flat] > 0
        flat, owner = flat[telling], owner[telling]
        rows = np.concatenate([np.repeat(owner, lengths[flat]), more[:, 0]])
        found = np.concatenate([ids[gather_runs((np.cumsum(lengths) - lengths)[flat], lengths[flat])], more[:, 1]])
        width = int(found.max(initial=0)) + 1
        pairs = np.sort(rows * width + found)
        return np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], width)

    def _spaced(self, words: np.ndarray, owner: np.ndarray, single: np.ndarray, cores: list[str]) -> Iterator[tuple[int, str]]:
        """(text number, word) of every run of three or more single characters of a text, read as one word."""
        at = np.flatnonzero(single[words])
        first = np.flatnonzero((np.diff(at, prepend=-2) > 1) | (np.diff(owner[at], prepend=-1) > 0))
        for start, end in zip(first.tolist(), np.append(first, len(at))[1:].tolist(), strict=True):
            if end - start >= 3:
                yield int(owner[at[start]]), "".join(cores[w] for w in words[at[start:end]].tolist())


class EvidenceReader(Reader):
    """Chosen features of whole texts: of a word and its beginnings, which are one piece of evidence, the strongest."""

    def __init__(self, decoder: Decoder, chosen: dict[str, int], weights: np.ndarray):
        super().__init__(decoder)
        self.chosen, self.sizes = chosen, np.abs(weights).tolist()
        # a word that is read as it is written is looked up without making its features
        self.known: dict[str, list[int]] = {}
        self.begun = [(n, {f[:-1]: i for f, i in chosen.items() if len(f) == n + 1 and f.endswith("…")}) for n in PREFIXES]

    def of_word(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= MOST_DECODED:
                self.known.clear()
            self.known[word] = found = self._strongest(word)
        return found

    def _strongest(self, word: str) -> list[int]:
        if word.isalpha() and not TWICE.search(word):
            known = [i] if (i := self.chosen.get(word)) is not None else []
            known += [i for n, begun in self.begun if len(word) > n and (i := begun.get(word[:n])) is not None]
        else:
            known = [self.chosen[f] for f in self.decoder.features(word) if f in self.chosen]
        return [max(known, key=self.sizes.__getitem__)] if known else NONE


class WordReader(Reader):
    """Distinct words of whole texts, each as the tuple of its features."""

    def of_word(self, word: str) -> list[int]:
        return [self.numbers.setdefault(tuple(self.decoder.features(word)), len(self.numbers))]


def near_copies(labelled: DataFrame) -> DataFrame:
    """(doc_id, toxic, component_id) of labelled documents: near copies, confirmed on their 5-word shingles, share a component."""
    components = near_duplicates(labelled.select("doc_id", "text"), width=5, percent=80).select("doc_id", "component_id").dropDuplicates(["doc_id"])
    return saved(labelled.select("doc_id", "toxic").join(components, "doc_id"), "near-copies")


def groups(copies: DataFrame) -> DataFrame:
    """(component_id, toxic, doc_id, copies): near copies with one label, the smallest id of them and their number."""
    return copies.groupBy("component_id", "toxic").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def unlike(labelled: DataFrame) -> DataFrame:
    """(doc_id, toxic, copies) of one document for each group of near copies and label."""
    return groups(near_copies(labelled)).select("doc_id", "toxic", "copies")


def weights(labelled: DataFrame) -> DataFrame:
    """(doc_id, toxic, weight): a group of near copies weighs as much as one document, so that words of one text do not pass for evidence."""
    copies = near_copies(labelled)
    return copies.join(groups(copies).drop("doc_id"), ["component_id", "toxic"]).select(
        "doc_id", "toxic", F.round(F.lit(WHOLE) / F.col("copies")).cast("long").alias("weight"))


def feature_counts(labelled: DataFrame, model: np.ndarray) -> DataFrame:
    """(feature, toxic, clean): weight of the documents of (text, toxic, weight) that hold the feature."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            marks, weight, low = batch["toxic"].to_numpy(zero_copy_only=False), batch["weight"].to_numpy(), 0
            for texts in text_slices(batch["text"]):
                reader = Reader(decoder)
                rows, found = reader.read(texts)
                rows, low = rows + low, low + len(texts)
                both = np.bincount(found, weights=weight[rows], minlength=len(reader.numbers)).astype(np.int64)
                toxic = np.bincount(found, weights=(weight * marks)[rows], minlength=len(reader.numbers)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.numbers.keys(), pa.string()), pa.array(toxic), pa.array(both - toxic)], names=["feature", "toxic", "clean"])

    return labelled.select("text", "toxic", "weight").mapInArrow(releasing(count), "feature string, toxic bigint, clean bigint").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass
class Scorer:
    model: np.ndarray
    chosen: dict[str, int]
    weights: np.ndarray
    bias: float
    table: DataFrame | None = None  # (feature, weight), where they are too many to broadcast


def train(labelled: DataFrame, documents: DataFrame) -> Scorer:
    """A scorer from (doc_id, text, toxic) rows, near copies weighing as one per label, and a character model from all documents.

    A feature is evidence if its log odds differ from the whole by more than chance would show among all features (twice
    the logarithm of their number, by the likelihood ratio); its weight is the log odds, drawn in by two
    standard errors.
    """
    model = character_model(documents)
    marked = saved(labelled.where("toxic is not null").select(
        F.monotonically_increasing_id().alias("doc_id"), "text", (F.col("toxic") == 1).cast("int").alias("toxic")), "labelled")
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bias = float(np.log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 0.5)))
    if len(sizes) < 2:
        return Scorer(model, {}, np.zeros(0), bias)
    weighed = small_side(weights(marked))
    total = {r["toxic"]: r["n"] / WHOLE for r in weighed.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()}
    bad, good = total[1], total[0]
    counts = saved(feature_counts(marked.join(weighed, ["doc_id", "toxic"]), model), "features")
    tested = counts.count()
    a, b = F.col("toxic") / WHOLE, F.col("clean") / WHOLE

    def part(x: Column, whole: float, both: Column) -> Column:
        expected = both * (whole / (bad + good))
        return F.when(x > 0, x * F.log(x / expected)).otherwise(F.lit(0.0))

    # likelihood ratio of the two-by-two table of feature and label
    ratio = 2 * (part(a, bad, a + b) + part(b, good, a + b) + part(bad - a, bad, bad + good - a - b) + part(good - b, good, bad + good - a - b))
    odds = F.log((a + 0.5) / (bad + 1.0)) - F.log((b + 0.5) / (good + 1.0))
    drawn_in = F.greatest(F.abs(odds) - 2 * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)), F.lit(0.0)) * F.signum(odds)
    kept = counts.where(ratio > 2 * np.log(max(tested, 2))).select("feature", "toxic", "clean", drawn_in.alias("weight")).where("weight <> 0")
    kept = saved(_own_evidence(saved(kept, "evidence")), "weights")
    if kept.count() > MOST_BROADCAST:
        return Scorer(model, {}, np.zeros(0), bias, kept)
    few = kept.toPandas().sort_values("feature", ignore_index=True)
    return Scorer(model, {f: i for i, f in enumerate(few["feature"])}, few["weight"].to_numpy(np.float64), bias)


def _own_evidence(kept: DataFrame) -> DataFrame:
    """(feature, weight) of whole words, and of beginnings that say more than the one word that mostly stands behind them."""
    held = kept.withColumn("support", F.greatest("toxic", "clean"))
    f = F.col("feature")
    beginnings = F.array_compact(F.array(*[F.when(F.length(f) > n, F.concat(F.substring(f, 1, n), F.lit("…"))) for n in PREFIXES]))
    most = held.where(~f.endswith("…")).select(F.explode(beginnings).alias("feature"), "support").groupBy("feature").agg(F.max("support").alias("most"))
    return held.join(most, "feature", "left").where(2 * F.col("support") >= 3 * F.coalesce("most", F.lit(0))).select("feature", "weight")


def score(docs: DataFrame, scorer: Scorer, *carry: str) -> DataFrame:
    """(carried columns, score): probability that the whole text is toxic.

    Null and empty texts score as texts without evidence.  Other columns are not looked at.
    """
    if scorer.table is not None:
        return _joined_score(docs, scorer, *carry)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    chosen = docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text").alias("__text"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        reader = EvidenceReader(Decoder(scorer.model), scorer.chosen, scorer.weights)
        for batch in batches:
            low = 0
            for texts in text_slices(batch["__text"]):
                rows, found = reader.read(texts)
                total = scorer.bias + np.bincount(rows, weights=scorer.weights[found], minlength=len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].slice(low, len(texts)) for c in carry), pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -500, 500))))],
                    names=[*carry, "score"])
                low += len(texts)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    return chosen.mapInArrow(releasing(rate), ", ".join([*kinds, "score double"]))


def _joined_score(docs: DataFrame, scorer: Scorer, *carry: str) -> DataFrame:
    """The same by joins: each distinct word gets its strongest feature, and each text those of its words."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer.model)
    names = [f"c{i}" for i in range(len(carry))]
    chosen = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            low = 0
            for texts in text_slices(batch["text"]):
                reader = WordReader(decoder)
                rows, found = reader.read(texts)
                words = [list(w) for w in reader.numbers]
                parts = np.split(found, np.cumsum(np.bincount(rows, minlength=len(texts)))[:-1])
                yield pa.RecordBatch.from_arrays(
                    [*(batch[n].slice(low, len(texts)) for n in names), pa.array([[words[i] for i in part.tolist()] for part in parts], pa.list_(pa.list_(pa.string())))],
                    names=[*names, "words"])
                low += len(texts)

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    rows = saved(chosen.mapInArrow(releasing(split), ", ".join([*kinds, "words array<array<string>>"])).withColumn(
        "uid", F.monotonically_increasing_id()), "words")
    words = rows.select("uid", F.explode("words").alias("word"))
    strongest = F.max(F.struct(F.abs("weight").alias("size"), (-F.col("pos")).alias("back"), "feature", "weight")).alias("best")
    best = words.select("word").distinct().select("word", F.posexplode("word").alias("pos", "feature")).join(
        scorer.table, "feature").groupBy("word").agg(strongest).select("word", "best.feature", "best.weight")
    added = words.join(saved(best, "words"), "word").select("uid", "feature", "weight").distinct().groupBy("uid").agg(F.sum("weight").alias("total"))
    total = F.greatest(F.least(F.lit(scorer.bias) + F.coalesce("total", F.lit(0.0)), F.lit(500.0)), F.lit(-500.0))
    return rows.join(added, "uid", "left").select(
        *[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], (1 / (1 + F.exp(-total))).alias("score"))


def held_out_scores(docs: DataFrame, labels: DataFrame, fold: Column) -> DataFrame:
    """Learn labels outside the fold, score all: (doc_id, held_out, score, predicted).

    The fold is a column of doc_id.  Labels whose document is missing, or whose mark is null, teach nothing;
    a document with two marks is a text under both.
    """
    marks = small_side(labels.select("doc_id", "toxic").where(~fold & F.col("toxic").isNotNull()))
    scorer = train(docs.select("doc_id", "text").join(marks, "doc_id"), docs)
    rated = score(docs.select("doc_id", "text", fold.alias("held_out")), scorer, "doc_id", "held_out")
    return rated.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
