"""SimHash near duplicates by Golay-code fuzzy hashing.

The perfect Golay code cuts the 23-bit words into balls of radius 3 around 4,096 codewords.  A word is decoded to the indices of
all codewords at most 4 bits away: its nearest one, and five more if that is 3 bits away, no others.  Two words at
most 2 bits apart have an index in common, and two words 1 bit apart the nearest index of one of them.

A fingerprint of 64 bits has three segments, filled up with zeros to 23 bits.  At most 4 differing bits fall on them in one
of two ways: a segment is free of errors and another one has at most 2; or two segments have one error each and the
third one or two.  So keys are, for the first, a whole segment and an index of another one; for the second, an index of a segment with
one error, a half of the other such segment (one of its two halves is free of errors) and a third of the third (one of three
is).  Fingerprints that share a key are compared bit by bit; no link is missed.

Equal fingerprints are one from the start.  Members of a key meet in one task, in units of ``UNIT`` members if there are more;
a task sends on the links that join what it has not joined yet, so rows stay in proportion to members.  Members of
different units meet in a second pass, once the first one's links have been joined and only where more than one component is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturemill.llm.common import byte_texts, gather_runs, releasing, saved, slices
from capturemill.operators.graph import connected_components
from capturemill.session import counted_side, small_side

WIDTH, SEED, BITS, RADIUS = 4, 42, 64, 4
SLICE_BYTES = 4 << 20
# Members of a key that one task compares with each other.
UNIT = 16_384
# Pairs compared at a time, and links that a task holds before it joins them.
BLOCK_PAIRS, HELD_LINKS = 1 << 22, 1 << 18
PRINTS_AT_ONCE, PRINTS_PER_TASK = 2_000, 20_000
# Rows of one fingerprint above which its rows are spread over several tasks.
CROWD = 1_000

# Fixed value: generator polynomial of the Golay code, 1 + x^2 + x^4 + x^5 + x^6 + x^10 + x^11.
GENERATOR = 0b110001110101
LENGTH, CHECKS = 23, 11
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, bits) of each segment of a fingerprint


# --- the code ------------------------------------------------------------------------------------

def _remainder(word: int) -> int:
    """Remainder of a word by the generator polynomial."""
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << bit - CHECKS
    return word


_UNIT_SYNDROMES = [_remainder(1 << bit) for bit in range(LENGTH)]


def _byte_table(low: int) -> np.ndarray:
    """Syndromes of the words whose bits from ``low`` on are a byte."""
    out = np.zeros(256, np.int64)
    for bit in range(min(8, LENGTH - low)):
        out[(np.arange(256) >> bit & 1) == 1] ^= _UNIT_SYNDROMES[low + bit]
    return out


_SYNDROMES = [_byte_table(low) for low in (0, 8, 16)]


def _patterns() -> np.ndarray:
    """Error patterns of at most 4 bits by syndrome, the one of at most 3 bits first; -1 where there are no more."""
    out, used = np.full((1 << CHECKS, 6), -1, np.int64), np.zeros(1 << CHECKS, np.int64)
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= _UNIT_SYNDROMES[b]
            out[syndrome, used[syndrome]] = sum(1 << b for b in bits)
            used[syndrome] += 1
    return out


PATTERNS = _patterns()


def indices(words: np.ndarray) -> np.ndarray:
    """Indices of all codewords at most 4 bits from each 23-bit word, the nearest first; -1 where there are no more."""
    syndrome = _SYNDROMES[0][words & 255] ^ _SYNDROMES[1][words >> 8 & 255] ^ _SYNDROMES[2][words >> 16]
    errors = PATTERNS[syndrome]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECKS)


# --- fingerprints --------------------------------------------------------------------------------

def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Majority bits of the XXH64 of all word shingles, A-Z lower-cased; zero without words.

    A text of fewer words is one shingle.
    """
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], SEED) for a, b in zip(starts[:len(words) - span + 1].tolist(), ends[span - 1:].tolist(), strict=True)]
    return _majority(np.array(hashes, np.uint64))


def _majority(hashes: np.ndarray) -> int:
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, print) of every row; the print is the fingerprint as a signed long."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch["text"])
            for low, high in slices(map(len, texts), SLICE_BYTES):
                prints = np.array([fingerprint(t, width) for t in texts[low:high]], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(low, high - low), pa.array(prints)], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(sign), "doc_id bigint, print bigint")


# --- keys ----------------------------------------------------------------------------------------

def _segment(prints: np.ndarray, number: int) -> np.ndarray:
    low, bits = SEGMENTS[number]
    return (prints >> np.uint64(low)).astype(np.int64) & (1 << bits) - 1


def _part(words: np.ndarray, bits: int, part: int, parts: int) -> np.ndarray:
    low, high = bits * part // parts, bits * (part + 1) // parts
    return words >> low & (1 << high - low) - 1


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, chief) of all keys of some fingerprints.

    Of two members of a key one at least must be chief; in keys of the second kind that is the member whose nearest
    codeword the key names.
    """
    words = [_segment(prints, i) for i in range(len(SEGMENTS))]
    decoded = [indices(w) for w in words]
    key_parts, row_parts, chief_parts = [], [], []

    def add(scheme: int, whole: np.ndarray, index: np.ndarray, all_chief: bool) -> None:
        rows, choice = np.nonzero(index >= 0)
        key_parts.append((scheme << 40) + (whole[rows] << 12) + index[rows, choice])
        row_parts.append(rows)
        chief_parts.append((choice == 0) | all_chief)

    scheme = 0
    for whole, fuzzy in permutations(range(3), 2):
        add(scheme, words[whole], decoded[fuzzy], True)
        scheme += 1
    for third in range(3):
        one, other = (i for i in range(3) if i != third)
        for half in range(2):
            for piece in range(3):
                exact = (_part(words[other], SEGMENTS[other][1], half, 2) << 8) + _part(words[third], SEGMENTS[third][1], piece, 3)
                add(scheme, exact, decoded[one], False)
                scheme += 1
    return np.concatenate(key_parts), np.concatenate(row_parts), np.concatenate(chief_parts)


def key_table(classes: DataFrame) -> DataFrame:
    """(key, print, chief) of all keys of distinct fingerprints."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch["print"].to_numpy()
            for at in range(0, len(prints), PRINTS_AT_ONCE):
                some = prints[at:at + PRINTS_AT_ONCE]
                key, row, chief = keys(some.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some[row]), pa.array(chief)], names=["key", "print", "chief"])

    return classes.select("print").mapInArrow(releasing(decode), "key bigint, print bigint, chief boolean")


# --- comparison ----------------------------------------------------------------------------------

class Joined:
    """Links of a task: those that join two trees of its forest are kept."""

    def __init__(self) -> None:
        self.u, self.v, self.held, self.most = [], [], 0, HELD_LINKS

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.u.append(u)
        self.v.append(v)
        self.held += len(u)
        if self.held > self.most:
            u, v = self.forest()
            self.u, self.v, self.held, self.most = [u], [v], len(u), HELD_LINKS + 2 * len(u)

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Every linked node but the smallest of its tree, with that smallest node."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        names, ends = np.unique(np.concatenate([*self.u, *self.v]), return_inverse=True)
        a, b = ends[:len(ends) // 2], ends[len(ends) // 2:]
        root = np.arange(len(names))
        while (apart := root[a] != root[b]).any():
            x, y = root[a[apart]], root[b[apart]]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        moved = np.flatnonzero(root != np.arange(len(names)))
        return names[root[moved]], names[moved]


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS


def compare_groups(prints: np.ndarray, chief: np.ndarray, bounds: np.ndarray, sides: np.ndarray | None, parts: np.ndarray | None, joined: Joined) -> None:
    """Link the near members of each group of rows.

    With ``sides`` only members of different sides meet; with ``parts`` only members of different components.
    """
    sizes = np.diff(bounds)
    for low, size in zip(bounds[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        group = slice(low, low + size)
        some, lead = prints[group], chief[group]
        rows = max(1, BLOCK_PAIRS // size)
        for at in range(0, size, rows):
            a = slice(at, at + rows)
            meet = _near(some[a, None], some[None, :]) & (lead[a, None] | lead[None, :])
            if sides is not None:
                meet &= sides[group][a, None] < sides[group][None, :]
            if parts is not None:
                meet &= parts[group][a, None] != parts[group][None, :]
            u, v = np.nonzero(meet)
            after = u + at < v
            joined.add(some[u[after] + at] if sides is None else some[u + at], some[v[after]] if sides is None else some[v])


def compare_pairs(prints: np.ndarray, chief: np.ndarray, bounds: np.ndarray, joined: Joined) -> np.ndarray:
    """Link the members of all small groups at once; gives the groups that are left."""
    sizes = np.diff(bounds)
    small = np.flatnonzero((sizes > 1) & (sizes <= 64))
    starts, counts = bounds[small], sizes[small]
    for step in range(1, int(counts.max(initial=1))):
        starts, counts = starts[counts > step], counts[counts > step]
        at = gather_runs(starts, counts - step)
        near = _near(prints[at], prints[at + step]) & (chief[at] | chief[at + step])
        joined.add(prints[at[near]], prints[at[near] + step])
    return np.flatnonzero(sizes > 64)


def unit_links(members: DataFrame, unit: list[str], sides: bool) -> DataFrame:
    """Links (u, v) inside the units of members (unit, print, chief), or between the two sides of units with components.

    A unit is read as a whole; its rows are a few bytes each and ``UNIT`` for each side at most.
    """
    carried = ["side", "component"] if sides else []
    spread = members.select(*unit, "print", "chief", *carried).repartition(*unit).sortWithinPartitions(*unit)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, held = Joined(), []

        def compare(table: pa.Table, bounds: np.ndarray) -> None:
            prints, chief = table["print"].to_numpy(), table["chief"].to_numpy()
            if sides:
                compare_groups(prints, chief, bounds, table["side"].to_numpy(), table["component"].to_numpy(), joined)
                return
            large = compare_pairs(prints, chief, bounds, joined)
            for g in large.tolist():
                compare_groups(prints, chief, bounds[g:g + 2], None, None, joined)

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            change = np.zeros(max(len(table) - 1, 0), bool)
            for c in unit:
                values = table[c].to_numpy()
                change |= values[1:] != values[:-1]
            edges = np.flatnonzero(change) + 1
            if len(edges):  # the last unit may go on in the next batch
                compare(table, np.concatenate([[0], edges]))
                held = table.slice(edges[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            compare(table, np.array([0, len(table)]))
        u, v = joined.forest()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return spread.mapInArrow(releasing(meet), "u bigint, v bigint")


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links.select(F.lit(0).cast("long").alias("g"), "u", "v"), "g").select(F.col("node").alias("print"), "component")


def components(classes: DataFrame, unit: int = UNIT) -> DataFrame:
    """(print, component) of all distinct fingerprints that are linked with another one."""
    # a print of a few bytes makes about 128 rows, so the table is dealt to tasks by its rows, not by its bytes
    tasks = max(classes.sparkSession.sparkContext.defaultParallelism, classes.count() // PRINTS_PER_TASK + 1)
    members = key_table(classes.select("print").repartition(tasks, "print"))
    crowded, count = counted_side(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > unit).select(
        "key", F.ceil(F.col("size") / unit).alias("units")))
    if not count:
        return _components(saved(unit_links(members, ["key"], False), "links"))
    cut = members.join(crowded, "key", "left").withColumn("units", F.coalesce("units", F.lit(1).cast("long")))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("print"), F.col("units")))
    links = saved(unit_links(cut, ["key", "own"], False), "links")
    parts = saved(_components(links), "parts")
    # two units of a crowded key meet where different components are left
    left = saved(cut.where("units > 1").join(parts, "print", "left").withColumn("component", F.coalesce("component", "print")), "crowded")
    mixed = left.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    left = left.join(mixed, "key", "left_semi")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1))
    tiles = left.withColumn("other", other).where("own <> other").select(
        "key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), F.col("own").alias("side"), "print", "chief", "component")
    more = saved(unit_links(tiles, ["key", "one", "two"], True), "links")
    return _components(links.unionByName(more))


def spread_join(rows: DataFrame, table: DataFrame, key: str, salt: str, sizes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Left join of rows with a table of one row per key, where the rows of a key above ``crowd`` go to several tasks.

    ``sizes`` has the number of rows of each key; ``salt`` tells rows of a key apart.
    """
    crowded = small_side(sizes.where(F.col("size") > crowd).select(key, F.ceil(F.col("size") / crowd).alias("__lots")))
    lots = F.coalesce("__lots", F.lit(1).cast("long"))
    left = rows.join(crowded, key, "left").withColumn("__lot", F.pmod(F.xxhash64(salt), lots))
    right = table.join(crowded, key, "left").withColumn("__lot", F.explode(F.sequence(F.lit(0).cast("long"), lots - 1)))
    return left.drop("__lots").join(right.drop("__lots"), [key, "__lot"], "left").drop("__lot")


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every row of (doc_id, text) with its fingerprint and component: (doc_id, print, component_id).

    Rows are linked if their fingerprints differ in at most 4 bits; a component bears its smallest doc_id.  Texts
    without words (null and empty ones too) have the fingerprint of zeros and are linked like any other.  Repeated rows and rows
    without an id all stay; a component of rows without ids has a null id.  Other columns are not looked at.
    """
    signed = saved(fingerprints(docs, width).withColumn("row", F.monotonically_increasing_id()), "prints")
    classes = saved(signed.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")), "classes")
    parts = classes.join(components(classes), "print", "left").withColumn("component", F.coalesce("component", "print"))
    parts = saved(parts, "parts")
    named = parts.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    by_print = spread_join(parts.select("print", "component"), named.drop("size"), "component", "print", named.select("component", "size")).select(
        "print", "component_id")
    return spread_join(signed, by_print, "print", "row", classes.select("print", "size")).select("doc_id", "print", "component_id")


def hexadecimal(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))
