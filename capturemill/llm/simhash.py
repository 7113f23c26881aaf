"""SimHash fingerprints with DataFrame functions only, and all fingerprints within a Hamming radius.

Terms are word trigrams, weighted by their length.  Each of two 64-bit hashes votes on signed bits.  Votes are
counted in 16-bit lanes: one long holds every sixteenth bit of a hash, so sixteen sums count 64 bits.  No chunk
of ``2**CHUNK_BITS`` terms can fill more than 15 bits of a lane, so the highest lane leaves the sign of the long alone
(a sum beyond it is an error in ANSI mode); chunks are unpacked to 32-bit lanes and added up.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturemill.llm.common import saved
from capturemill.operators.numbering import running_folds
from capturemill.session import small_side

HASHES = 2
BITS = 64 * HASHES
LANES = 16
LANE_16, LANE_32 = 0x0001000100010001, 0x0000FFFF0000FFFF
MOST_WEIGHT = 7
CHUNK_BITS = 12  # 2**CHUNK_BITS times MOST_WEIGHT is less than 2**15
# Documents with ids that agree above this many bits are neighbours in one bucket, 1,024 at most.
ID_BITS = 10
FIRST_ID = -(1 << 63)
BLANKS = " \t\n\u000b\f\r"


def with_terms(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, place, hash and weight of the term) for every word trigram of a text.

    One or two words are one term; without words there is one row with a null place.
    """
    trimmed = F.btrim(F.lower(text), F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    listed = df.select(*keys, words.alias("words"))
    count = F.size("words")
    listed = listed.select(*keys, F.concat("words", F.array(F.lit(""), F.lit(""))).alias("words"), F.when(
        count > 2, count - 2).otherwise(F.least(count, F.lit(1))).alias("terms"))
    shifted = [F.slice("words", F.lit(i), F.col("terms")).alias(name) for i, name in enumerate("abc", 1)]
    split = listed.select(*keys, F.posexplode_outer(F.arrays_zip(*shifted)).alias("place", "term"))
    a, b, c = (F.col(f"term.{x}") for x in "abc")
    size = F.octet_length(a) + F.octet_length(b) + F.octet_length(c)
    return split.select(
        *keys, "place", F.xxhash64(a, b, c).alias("hash0"), F.xxhash64(c, F.lit(1), b, a).alias("hash1"),
        F.when(F.col("place").isNotNull(), F.least(F.lit(MOST_WEIGHT), 1 + F.shiftright(size, 3))).otherwise(0).cast("long").alias("weight"))


def votes_to_fingerprint(voted: DataFrame, *keys: str) -> DataFrame:
    """(keys, high, low): the two longs of the fingerprint; a bit is set if more weight votes for it than against."""
    lanes = [(h, i) for h in range(HASHES) for i in range(LANES)]
    counted = voted.groupBy(*keys, F.shiftright(F.coalesce("place", F.lit(0)), CHUNK_BITS).alias("chunk")).agg(
        F.sum("weight").alias("total"),
        *[F.sum(F.shiftrightunsigned(F.col(f"hash{h}"), i).bitwiseAND(F.lit(LANE_16)) * F.col("weight")).alias(f"v{h}_{i}") for h, i in lanes])
    wide = counted.groupBy(*keys).agg(
        F.sum("total").alias("total"),
        *[F.sum(F.shiftrightunsigned(F.col(f"v{h}_{i}"), 16 * odd).bitwiseAND(F.lit(LANE_32))).alias(f"v{h}_{i}_{odd}")
          for h, i in lanes for odd in (0, 1)])

    def word(h: int) -> Column:
        parts = []
        for bit in range(64):
            lane, i = divmod(bit, LANES)
            votes = F.shiftrightunsigned(F.col(f"v{h}_{i}_{lane % 2}"), 32 * (lane // 2)).bitwiseAND(F.lit(0xFFFFFFFF))
            parts.append(F.shiftleft((2 * votes > F.col("total")).cast("long"), bit))
        return reduce(lambda x, y: x.bitwiseOR(y), parts)

    return wide.select(*keys, word(0).alias("high"), word(1).alias("low"))


def hexadecimal(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def likeness(high: Column, low: Column, other_high: Column, other_low: Column) -> Column:
    """Share of the bits that two fingerprints have in common."""
    return 1.0 - (F.bit_count(high.bitwiseXOR(other_high)) + F.bit_count(low.bitwiseXOR(other_low))) / float(BITS)


def with_next(docs: DataFrame) -> DataFrame:
    """Documents with the text of the next by id, the first after the last, in buckets of neighbouring ids.

    A bucket also gets the first document of the bucket after it, as a guest.  So no window spans more than
    one bucket, and texts are shuffled once.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID))
    rows = docs.select("doc_id", order.alias("order"), F.coalesce("text", F.lit("")).alias("text"))
    bucket = F.shiftright("order", ID_BITS)
    firsts = rows.groupBy(bucket.alias("bucket")).agg(F.min("order").alias("first"))
    firsts = running_folds(firsts.withColumn("all", F.lit(0)), ["all"], "bucket", {"before": ("max", F.col("bucket"))}, exclusive=True)
    last = rows.agg(F.max(bucket)).first()[0]
    hosts = small_side(firsts.select(F.col("first").alias("order"), F.coalesce("before", F.lit(last)).alias("host")))
    seated = rows.join(hosts, "order", "left").withColumn("seat", F.explode(F.filter(F.array(
        F.struct(bucket.alias("bucket"), F.lit(0).alias("guest")), F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest")),
    ), lambda s: s["bucket"].isNotNull())))
    seated = seated.select("doc_id", "order", "text", "seat.bucket", "seat.guest")
    line = Window.partitionBy("bucket").orderBy("guest", "order", F.xxhash64("text"))
    return seated.withColumns({"line": F.row_number().over(line), "next_text": F.lead("text").over(line)})


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are.

    A null text is empty, and a text without words has the fingerprint of zeros.  Documents are taken in ascending
    doc_id, null first; rows that share an id follow each other.  Other columns are not looked at.
    """
    rows = with_next(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select(
        "bucket", "line", "guest", "doc_id", n.alias("n_chars"), "text",
        F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)).alias("edited"))
    keys = ["bucket", "line", "guest", "doc_id", "n_chars", "edited_sha256"]
    both = rows.select(*keys[:-1], F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("one"))
    both = both.select(*keys, "one.kind", F.col("one.text").alias("text"))
    prints = votes_to_fingerprint(with_terms(both, "text", *keys, "kind"), *keys, "kind")
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    joined = prints.groupBy(*keys).agg(
        pick(0, "high").alias("high"), pick(0, "low").alias("low"), pick(1, "high").alias("edited_high"), pick(1, "low").alias("edited_low"))
    line = Window.partitionBy("bucket").orderBy("line")
    joined = joined.withColumns({"next_high": F.lead("high").over(line), "next_low": F.lead("low").over(line)})
    high, low = F.col("high"), F.col("low")
    return joined.where("guest = 0").select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", hexadecimal(high, low).alias("fingerprint"),
        hexadecimal(F.col("edited_high"), F.col("edited_low")).alias("edited_fingerprint"),
        likeness(high, low, F.col("edited_high"), F.col("edited_low")).alias("near_edited"),
        likeness(high, low, F.col("next_high"), F.col("next_low")).alias("near_next"), "high", "low")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, high, low) of every document; rows that repeat an id and a text are one."""
    once = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    keyed = once.withColumn("text_key", F.sha2(F.col("text").cast("binary"), 256))
    return votes_to_fingerprint(with_terms(keyed, "text", "doc_id", "text_key"), "doc_id", "text_key").drop("text_key")


def block_masks(radius: int, blocks: int) -> list[tuple[int, int]]:
    """Masks (high, low) of all ways to pick ``blocks - radius`` of the blocks of a fingerprint."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        whole = sum(((1 << edges[i + 1] - edges[i]) - 1) << edges[i] for i in chosen)
        masks.append(tuple(part - (1 << 64) if part >> 63 else part for part in (whole >> 64, whole & (1 << 64) - 1)))
    return masks


def within_radius(prints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """All pairs of different fingerprints at most ``radius`` bits apart: (high, low, other_high, other_low, distance).

    Two such fingerprints agree on ``blocks - radius`` of the blocks at least.  There is a table for each choice of
    so many blocks, keyed by those blocks; a row of a table meets the rows of its key.  Each pair is given in
    both directions; equal fingerprints are one to begin with.
    """
    blocks = blocks or radius + 2
    once = prints.select("high", "low").distinct()
    tables = F.array(*[F.struct(F.lit(n).alias("table"), F.col("high").bitwiseAND(F.lit(a)).alias("a"), F.col("low").bitwiseAND(F.lit(b)).alias("b"))
                       for n, (a, b) in enumerate(block_masks(radius, blocks))])
    rows = saved(once.select("high", "low", F.explode(tables).alias("key")).select("high", "low", "key.*"), "block-tables")
    crowded = rows.groupBy("table", "a", "b").count().where("count > 1").drop("count")
    rows = rows.join(crowded, ["table", "a", "b"])
    other = rows.select("table", "a", "b", F.col("high").alias("other_high"), F.col("low").alias("other_low"))
    distance = F.bit_count(F.col("high").bitwiseXOR(F.col("other_high"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("other_low")))
    same = (F.col("high") == F.col("other_high")) & (F.col("low") == F.col("other_low"))
    return rows.join(other, ["table", "a", "b"]).where(~same & (distance <= radius)).select(
        "high", "low", "other_high", "other_low", distance.alias("distance")).distinct()


def near_counts(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Rows with the number of other rows whose fingerprint is at most ``radius`` bits away."""
    prints = saved(prints, "fingerprints")
    sizes = prints.groupBy("high", "low").agg(F.count(F.lit(1)).alias("size"))
    around = within_radius(sizes, radius).join(
        sizes.select(F.col("high").alias("other_high"), F.col("low").alias("other_low"), F.col("size").alias("other_size")), ["other_high", "other_low"]
    ).groupBy("high", "low").agg(F.sum("other_size").alias("others"))
    counts = sizes.join(around, ["high", "low"], "left").select("high", "low", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("near_docs"))
    return prints.join(counts, ["high", "low"])
