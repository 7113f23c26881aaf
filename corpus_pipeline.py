"""From raw documents to packed sequences: language, near duplicates, repeated passages, mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept.  All but the last give the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturemill.llm import langid, minhash, mixing, packing, repeats
from capturemill.llm.common import saved, table
from capturemill.llm.queries import TOKENIZER

# Shares of the best language under which a text fits none of them: this, or 1.2 even shares if that is less.
LEAST_SHARE = 0.3


def _names(docs: DataFrame) -> dict[str, str]:
    """Columns under names that no operator adds; doc_id and text keep theirs."""
    return {c: c if c in ("doc_id", "text") else f"column{i}" for i, c in enumerate(docs.columns)}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learnt languages, with the language found.

    The filters learn from all rows that name a language.  Texts without a letter go, and so do those whose n-grams
    point to no language in particular.
    """
    filters = langid.train(docs.select("text", "lang"))
    names = _names(docs)
    found = langid.identify(docs.withColumnsRenamed(names), filters, *names.values())
    least = min(LEAST_SHARE, 1.2 / max(len(filters.languages), 1))
    # whole texts go through Python: written here, a task holds few of them at a time
    found = saved(found, "language", langid.TEXT_ROWS)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[F.col("lang_pred" if c == "lang" else n).alias(c) for c, n in names.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by 5-word shingles at similarity 0.8; repeated rows stay once."""
    found = minhash.near_duplicates(docs, width=5, percent=80)
    kept = found.where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi").dropDuplicates(["doc_id", "text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 100 bytes that start earlier; documents that are left without a word go."""
    names = _names(docs)
    others = [n for c, n in names.items() if c not in ("text", "n_chars")]
    found = repeats.without_repeats(docs.withColumnsRenamed(names), *others, with_text=True)
    new = {"text": F.col("kept").alias("text"), "n_chars": F.char_length("kept").cast(docs.schema["n_chars"].dataType).alias("n_chars")}
    return found.where((F.col("n_removed") == 0) | (F.btrim("kept", F.lit(" \t\n\u000b\f\r")) != "")).select(
        *[new[c] if c in new else F.col(n).alias(c) for c, n in names.items()])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard by shard, each shard shuffled."""
    drawn = mixing.drawn(mixing.mix(docs, shard_blocks=4, carry=True))
    return drawn.repartition("shard").sortWithinPartitions("shard", "turn_key").select("document.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all drawn documents with their sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language_id", language), ("minhash_dedup", near_duplicates), ("suffix_dedup", repeated_passages),
    ("mixing", mix), ("packing", pack),
]

# Learning, hashing and tokenizing have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
