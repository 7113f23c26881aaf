"""Near-duplicate documents by b-bit MinHash, band candidates and exact confirmation.

A document's signature keeps the low ``BITS`` bits of every minimum, packed into 64-bit words.
Bands of full minima name the buckets of a document.  Similarity is estimated from the packed words
by XOR and bit counts, corrected for chance agreement; what may reach the threshold is confirmed on
the full shingle sets.

Equal sets are one class from the start.  A bucket's members are first compared with its smallest
member only, each by its best estimate.  Once these links have been joined into components, only members
of different components meet.  A block of members meets its whole bucket, and every component of the block names its best
estimate, which is confirmed.  What has candidates in other components after that is gathered in clusters, whose blocks meet with their full sets:
every component names one confirmed link to another, components are joined, and this goes on until no cluster
names a link (Boruvka's rounds).  A step names no more pairs than it has members, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturemill.llm.common import WordNumbers, byte_texts, number_words, releasing, saved, slices
from capturemill.operators.graph import connected_components
from capturemill.session import SMALL_TABLE_ROWS

BITS = 4
ROWS, BANDS = 4, 28  # two sets of similarity 0.8 share no band once in 2.5 million times
HASHES = ROWS * BANDS
WORDS = HASHES * BITS // 64
NIBBLES = 0x1111111111111111
SLICE_BYTES = 4 << 20
# Rows a Python step gets at a time: texts, and pairs of sets.
TEXT_ROWS, PAIR_ROWS = 1_000, 500
# A candidate stays unless its estimate lies five standard deviations under the threshold.
DEVIATIONS = 5.0
# Members in a block that meets its whole group in one task: by signatures, and with full sets.
BLOCK, SET_BLOCK = 1_024, 256

_DRAW = np.random.default_rng(20_240_301)
FACTORS = _DRAW.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
PLACES = _DRAW.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = PLACES[-2:]

SIGNATURES = "doc_id bigint, n_shingles bigint, digest binary, signature array<bigint>, bands array<bigint>"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX[0]
    h = (h ^ (h >> np.uint64(29))) * MIX[1]
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text, A-Z lower-cased.

    A text of fewer words is one shingle, a text without words none.
    """
    numbers = WordNumbers()
    words, sizes = number_words((t.lower() for t in texts), numbers)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in numbers.words()), np.uint64, len(numbers))[words]
    out, at = [], 0
    for size in sizes.tolist():
        h = hashes[at:at + size]
        at += size
        span = min(size, width)
        total = np.full(max(size - width + 1, min(size, 1)), span, np.uint64)
        for i in range(span):
            total = total + h[i:i + len(total)] * PLACES[i]
        out.append(np.unique(_mixed(total)))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum of every hash function over each non-empty set."""
    flat = np.concatenate(sets)
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint32)
    for i, factor in enumerate(FACTORS):
        out[:, i] = np.minimum.reduceat(low * factor + high, starts)
    return out


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Set size, digest of the set, packed low bits and band keys of every document; nulls without words."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch["text"])
            for low, high in slices(map(len, texts), SLICE_BYTES):
                sets = shingle_sets(texts[low:high], width)
                filled = np.array([len(s) > 0 for s in sets])
                digests: list[bytes | None] = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]
                packed: list = [None] * len(sets)
                bands: list = [None] * len(sets)
                if filled.any():
                    least = minima([s for s in sets if len(s)])
                    nibbles = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(least), WORDS, 64 // BITS)
                    words = np.bitwise_or.reduce(nibbles << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)
                    rows = least.astype(np.uint64).reshape(len(least), BANDS, ROWS)
                    keys = _mixed((rows * PLACES[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * PLACES[ROWS])
                    for i, w, k in zip(np.flatnonzero(filled).tolist(), words.view(np.int64).tolist(), keys.view(np.int64).tolist(), strict=True):
                        packed[i], bands[i] = w, k
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(low, high - low), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()),
                    pa.array(packed, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64())),
                ], names=["doc_id", "n_shingles", "digest", "signature", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(sign), SIGNATURES)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures, corrected for minima whose low bits agree by chance."""
    def differing(i: int) -> Column:
        x = F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1))
        for shift in (1, 2):  # fold the bits of every nibble into its lowest
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(NIBBLES)))

    chance = 1.0 / (1 << BITS)
    agree = 1.0 - reduce(lambda p, q: p + q, [differing(i) for i in range(WORDS)]) / float(HASHES)
    return (agree - chance) / (1.0 - chance)


def least_estimate(threshold: float) -> float:
    chance = 1.0 / (1 << BITS)
    p = threshold + (1 - threshold) * chance
    return threshold - DEVIATIONS * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def _some_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of some ids; the ids are broadcast only if they are counted and few."""
    count = ids.count()
    return docs.join(F.broadcast(ids) if count <= SMALL_TABLE_ROWS else ids, "doc_id", "left_semi")


def shingle_table(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, hashes) of some documents, saved."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch["text"])
            for low, high in slices(map(len, texts), SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(low, high - low),
                    pa.array([s.tobytes() for s in shingle_sets(texts[low:high], width)], pa.binary()),
                ], names=["doc_id", "hashes"])

    wanted = _some_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids)
    return saved(wanted.mapInArrow(releasing(sets), "doc_id bigint, hashes binary").dropDuplicates(["doc_id"]), "sets", TEXT_ROWS)


def confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of documents with 100 * intersection >= percent * union on their full sets."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("doc_id").alias("v"), F.col("hashes").alias("b")), "v").join(
        sets.select(F.col("doc_id").alias("u"), F.col("hashes").alias("a")), "u")
    return joined.select("u", "v", "a", "b").mapInArrow(releasing(compare), "u bigint, v bigint")


def _signs(table: pa.Table) -> np.ndarray:
    return pc.list_flatten(table["signature"].combine_chunks()).to_numpy().view(np.uint64).reshape(-1, WORDS)


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Corrected similarity of all signatures of two blocks."""
    chance = 1.0 / (1 << BITS)
    differing = np.zeros((len(a), len(b)), np.uint8)
    for w in range(WORDS):
        x = a[:, w][:, None] ^ b[:, w][None, :]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        differing += np.bitwise_count(x & np.uint64(NIBBLES))
    return (1.0 - differing / HASHES - chance) / (1.0 - chance)


class Strip:
    """A block of members that meets all members of its group, its own included, a few at a time."""

    def __init__(self, own: pa.Table, least: float):
        self.ids, self.parts = own["doc_id"].to_numpy(), own["component"].to_numpy()
        self.signs, self.least = _signs(own), least

    def near(self, others: pa.Table) -> np.ndarray:
        """Estimates of candidates, those in other components that reach the least estimate; the rest is -1."""
        near = _estimates(self.signs, _signs(others))
        near[(near < self.least) | (self.parts[:, None] == others["component"].to_numpy()[None, :])] = -1.0
        return near


class BestPairs(Strip):
    """The best candidate pair of every component of the block."""

    def __init__(self, own: pa.Table, least: float):
        super().__init__(own, least)
        self.best = np.full(len(self.ids), -1.0)
        self.other = np.zeros(len(self.ids), np.int64)

    def meet(self, others: pa.Table) -> None:
        near, ids = self.near(others), others["doc_id"].to_numpy()
        at = near.argmax(axis=1)
        value = near[np.arange(len(near)), at]
        better = value > self.best
        self.best[better], self.other[better] = value[better], ids[at[better]]

    def pairs(self) -> Iterator[tuple[int, int]]:
        order = np.lexsort((-self.best, self.parts))
        order = order[np.flatnonzero(np.diff(self.parts[order], prepend=self.parts[order[0]] - 1))]
        for row in order[self.best[order] >= 0].tolist():
            x, y = int(self.ids[row]), int(self.other[row])
            yield min(x, y), max(x, y)


class CandidateTies(Strip):
    """Every member of the block that has a candidate, tied to the first member of the group."""

    def __init__(self, own: pa.Table, least: float):
        super().__init__(own, least)
        self.first, self.some = own["first"].to_numpy(), np.zeros(len(self.ids), bool)

    def meet(self, others: pa.Table) -> None:
        self.some |= (self.near(others) >= 0).any(axis=1)

    def pairs(self) -> Iterator[tuple[int, int]]:
        yield from zip(self.first[self.some].tolist(), self.ids[self.some].tolist(), strict=True)


class ConfirmedLinks(Strip):
    """A confirmed link to another component for every component of the block that has one."""

    def __init__(self, own: pa.Table, least: float, percent: int):
        super().__init__(own, least)
        self.sets = [np.frombuffer(h, np.uint64) for h in own["hashes"].to_pylist()]
        self.percent, self.linked = percent, {}

    def meet(self, others: pa.Table) -> None:
        near, ids, theirs = self.near(others), others["doc_id"].to_numpy(), others["hashes"]
        for i in np.flatnonzero((near >= 0).any(axis=1)).tolist():
            part, x = int(self.parts[i]), self.sets[i]
            if part in self.linked:
                continue
            for j in np.argsort(-near[i], kind="stable")[:int((near[i] >= 0).sum())].tolist():
                y = np.frombuffer(theirs[j].as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < self.percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= self.percent * (len(x) + len(y) - both):
                    self.linked[part] = (int(min(self.ids[i], ids[j])), int(max(self.ids[i], ids[j])))
                    break

    def pairs(self) -> Iterator[tuple[int, int]]:
        yield from self.linked.values()


def over_strips(members: DataFrame, group: str, size: int, kind: Callable[..., Strip], *args) -> DataFrame:
    """Distinct (u, v) that the strips of members (group, members, doc_id, component, signature, ...) name.

    A group is cut into blocks of about ``size`` members, and a block meets the members of its group in one task, which
    holds the block and one batch.  A strip names a pair per own member at most, so there are no more pairs than members.
    """
    blocks = F.ceil(F.col("members") / size)
    strips = members.withColumn("own", F.pmod(F.xxhash64("doc_id"), blocks)).withColumn(
        "strip", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumn("other", F.col("own") != F.col("strip"))
    # members of the block come first and are met as well
    spread = strips.drop("own", "members").withColumn("deal", F.xxhash64(group, "strip")).repartition("deal").sortWithinPartitions(
        "deal", group, "strip", "other", "doc_id")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, strip, found = None, [], None, set()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            marks = np.stack([table[group].to_numpy(), table["strip"].to_numpy(), table["other"].to_numpy().astype(np.int64)], axis=1)
            edges = (np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist()
            for low, high in zip([0, *edges], [*edges, len(table)], strict=True):
                if key != (key := tuple(marks[low, :2].tolist())):
                    found.update(whole(held, strip))
                    held, strip = [], None
                part = table.slice(low, high - low)
                if not marks[low, 2]:
                    held.append(part)
                elif held:
                    strip = strip or started(held)
                    met(strip, part)
            if len(found) >= 100_000:
                yield named(found)
                found = set()
        found.update(whole(held, strip))
        yield named(found)

    def started(held: list[pa.Table]) -> Strip:
        own = pa.concat_tables(held).combine_chunks()
        strip = kind(own, *args)
        met(strip, own)
        return strip

    def met(strip: Strip, others: pa.Table) -> None:
        for at in range(0, len(others), BLOCK):
            strip.meet(others.slice(at, BLOCK).combine_chunks())

    def whole(held: list[pa.Table], strip: Strip | None) -> Iterator[tuple[int, int]]:
        return (strip or started(held)).pairs() if held else iter(())

    def named(found: set[tuple[int, int]]) -> pa.RecordBatch:
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return spread.mapInArrow(releasing(cross), "u bigint, v bigint").distinct()


def _mixed_members(shared: DataFrame, parts: DataFrame, marks: DataFrame) -> DataFrame:
    """Members of the buckets that hold different components; of buckets with the same members one is enough."""
    placed = saved(shared.join(parts, "doc_id", "left").select(
        "bucket", "doc_id", F.coalesce("component", "doc_id").alias("component")), "placed")
    mixed = placed.groupBy("bucket").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("first"),
        F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(2), "doc_id")).alias("h2"),
    ).where("a < b").groupBy("members", "first", "h1", "h2").agg(F.min("bucket").alias("bucket")).drop("h1", "h2")
    return placed.join(mixed, "bucket").join(marks, "doc_id")


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links.select(F.lit(0).cast("long").alias("g"), "u", "v"), "g").select(
        F.col("node").alias("doc_id"), "component")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Every document with the component it belongs to: (doc_id, n_shingles, component_id, kept).

    Documents are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of ``width``-word
    shingles; a component bears its smallest doc_id and keeps that document.  Documents without words
    (null and empty texts too) are linked with nothing.  An id stands for one document, so repeated rows are kept or
    dropped together; a row without an id joins the component of its equals, or is kept if it has none.
    Other columns are not looked at.
    """
    signed = saved(signatures(docs, width), "signatures", TEXT_ROWS)
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    heads = saved(signed.where("digest is not null and doc_id is not null").join(
        classes, "digest").where("doc_id = rep").dropDuplicates(["doc_id"]).select("doc_id", "signature", "bands"), "heads")
    buckets = heads.select("doc_id", F.explode("bands").alias("bucket"))
    firsts = buckets.groupBy("bucket").agg(F.min("doc_id").alias("u"), F.max("doc_id").alias("most")).where("u < most")
    shared = saved(buckets.join(firsts.select("bucket", "u"), "bucket"), "buckets")

    least = least_estimate(percent / 100)
    marks = heads.select("doc_id", "signature")
    u_marks = marks.select(F.col("doc_id").alias("u"), F.col("signature").alias("u_signature"))
    v_marks = marks.select(F.col("doc_id").alias("v"), F.col("signature").alias("v_signature"))
    leaders = shared.select("u", F.col("doc_id").alias("v")).where("u < v").distinct().join(v_marks, "v").join(u_marks, "u")
    leaders = leaders.withColumn("near", estimate(F.col("u_signature"), F.col("v_signature"))).where(F.col("near") >= least)
    tested = saved(leaders.groupBy("v").agg(F.max(F.struct("near", (-F.col("u")).alias("back"))).alias("best")).select(
        (-F.col("best.back")).alias("u"), "v"), "best")
    sets = shingle_table(docs, shared.select("doc_id").distinct(), width)
    links = saved(confirmed(sets, tested, percent), "links", PAIR_ROWS)
    parts = _components(links)

    best = over_strips(_mixed_members(shared, parts, marks), "bucket", BLOCK, BestPairs, least)
    best = saved(best.join(tested, ["u", "v"], "left_anti"), "best")
    if best.limit(1).count():
        links = saved(links.unionByName(confirmed(sets, best, percent)), "links", PAIR_ROWS)
        parts = _components(links)
    # candidates that are still apart, gathered in clusters so that each is compared with its sets once; a best pair
    # that has been tested says nothing of the other pairs of its components
    ties = saved(over_strips(_mixed_members(shared, parts, marks), "bucket", BLOCK, CandidateTies, least), "ties")
    clusters = saved(_components(ties).select("doc_id", F.col("component").alias("cluster")), "clusters")
    while ties.limit(1).count():
        sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
        apart = clusters.join(sizes, "cluster").join(parts, "doc_id", "left").select(
            "cluster", "members", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        apart = apart.join(marks, "doc_id").join(sets, "doc_id")
        ties = saved(over_strips(apart, "cluster", SET_BLOCK, ConfirmedLinks, least, percent), "links", PAIR_ROWS)
        # every component with a link has named one, so a cluster without new links is done; the others go on
        links = links.unionByName(ties)
        parts = _components(links)
        named = ties.select(F.col("u").alias("doc_id")).distinct().join(clusters, "doc_id").select("cluster").distinct()
        clusters = clusters.join(named, "cluster", "left_semi")

    named = classes.join(parts, F.col("rep") == F.col("doc_id"), "left").select(
        "digest", F.coalesce("component", "rep").alias("component_id"))
    return signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
    ).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
