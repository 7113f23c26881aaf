"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source holds blocks of about ``block_docs`` documents, dealt out by hash.  A source
whose target is r times its size and a rest gives all its blocks r times and, once more, the
first documents of its blocks until the rest is reached.  The block counts of all sources
are split between the two halves of the output shards by one multivariate-hypergeometric
draw, and so on down to single shards, so each shard holds an exact share of each source's
quota.  Every node's draw depends only on the seed and on the node, so each task walks the tree
by itself and reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturemill.llm.common import WORD, releasing, saved
from capturemill.operators.numbering import running_folds
from capturemill.session import small_side

# A prime above any block count: multiplying by it permutes the blocks of a source.
STEP = 2_147_483_647


def source_targets(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """One row per source: number, size, documents and target words.

    Sources in code-point order, null last, take ``weights`` in turn and share all words in
    proportion; a source stops at ``max_repeat`` times its size and the excess is shared again
    by weight.  With sources in ascending order of limit per weight those at their limit come first,
    so the level of the others is the largest of the running levels.  The two windows see one
    row per source.
    """
    per = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("source_no", F.row_number().over(by_name).cast("long"))
    choice = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumns({
        "weight": F.element_at(choice, (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int")),
        "limit": F.col("source_size").cast("double") * max_repeat,
    })
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    return per.select(
        "source", "source_no", "source_size", "documents",
        F.least("limit", F.col("weight") * F.max("level").over(everything)).alias("target"),
    )


def size_of(text_column: str) -> Column:
    return F.regexp_count(F.col(text_column), F.lit(WORD)).cast("long").alias("size")


def split_quotas(quotas: np.ndarray, low: int, high: int, seed: int) -> np.ndarray:
    """Blocks per source for the left half of the shards ``low`` to ``high`` - 1."""
    middle = (low + high) // 2
    total = int(quotas.sum())
    share = total * (middle - low) // (high - low)
    draw = np.random.default_rng([seed, low, high])
    if total == 0:
        return np.zeros_like(quotas)
    # the method is limited to fewer than 10**9 blocks in a node
    return draw.multivariate_hypergeometric(quotas, share, method="marginals")


def shards_of(sources: np.ndarray, places: np.ndarray, quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """The shard of each block, given its source number and its place in the source's permuted blocks."""
    out = np.zeros(len(sources), np.int64)
    work = [(0, shards, quotas.astype(np.int64), np.arange(len(sources)), places.astype(np.int64))]
    while work:
        low, high, quota, rows, place = work.pop()
        if not len(rows):
            continue
        if high - low == 1:
            out[rows] = low
            continue
        left = split_quotas(quota, low, high, seed)
        first = left[sources[rows]]
        goes = place < first
        middle = (low + high) // 2
        work.append((low, middle, left, rows[goes], place[goes]))
        work.append((middle, high, quota - left, rows[~goes], place[~goes] - first[~goes]))
    return out


def mix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, block_docs: int = 256, shard_blocks: int = 64, seed: int = 7,
    carry: bool = False,
) -> DataFrame:
    """Which documents the mix takes, how often and into which shards.

    Gives (doc_id, source, size, source_size, target, shards) with one entry of ``shards`` per
    time the document is taken.  A null text has size 0; null is a source of its own, the last;
    repeated rows are documents of their own; other columns are not looked at; an empty table
    gives an empty mix.  The last pass of a source is cut inside one block, nearest to its target.
    ``carry`` adds the whole row of the document as the struct ``document``; ``docs`` is read twice then, so it has to be
    a table that gives the same rows each time.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), text.alias("__text"),
        F.xxhash64(F.lit(seed), F.col(id_column), text).alias("deal"),
        *([F.struct("*").alias("document")] if carry else []),
    )
    sized = saved(rows.select("doc_id", "source", size_of("__text"), "deal"), "mix-sizes")
    sources = small_side(source_targets(sized, weights, max_repeat).withColumns({
        "blocks": F.ceil(F.col("documents") / block_docs),
        "passes": F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("int"),
    }).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))

    def with_blocks(some: DataFrame) -> DataFrame:
        named = some.join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        return named.withColumn("block", F.pmod("deal", F.col("blocks")))

    dealt = with_blocks(sized)
    blocks = dealt.groupBy("source_no", "block").agg(
        F.sum("size").alias("block_size"), F.first("blocks").alias("blocks"),
        F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    blocks = running_folds(blocks, ["source_no"], "block", {"words_before": ("sum", F.col("block_size"))}, exclusive=True)
    # the last pass reaches a block if any words of the rest are left for it
    blocks = saved(blocks.select(
        "source_no", "block", "blocks", "passes", (F.col("rest") - F.coalesce("words_before", F.lit(0))).alias("left"), "block_size",
        (F.coalesce("words_before", F.lit(0)) < F.col("rest")).alias("opened"),
    ), "mix-blocks")
    quotas = small_side(blocks.groupBy("source_no").agg(
        F.first("blocks").alias("blocks"), F.first("passes").alias("passes"),
        F.sum(F.col("opened").cast("long")).alias("opened_blocks")))
    # whole rows are read again rather than written once more; their words are counted where they are asked for
    columns = ["doc_id", "source", size_of("__text"), "deal", "document"] if carry else sized.columns
    chosen = (with_blocks(rows) if carry else dealt).select(*columns, "source_no", "source_size", "target", "passes", "block").join(
        small_side(_placed_blocks(blocks, quotas, shard_blocks, seed)), ["source_no", "block"])
    split = F.col("opened") & (F.col("left") < F.col("block_size"))
    chosen = chosen.withColumn("once_more", F.col("opened").cast("int"))
    # one block of each source is cut: about block_docs rows
    cut = chosen.where(split).groupBy("source_no").applyInPandas(_nearest_fill, chosen.schema)
    return chosen.where(~split).unionByName(cut).select(
        "doc_id", "source", "size", "source_size", "target",
        F.slice("placed", F.lit(1), F.col("passes") + F.col("once_more")).alias("shards"),
        *(["document"] if carry else []),
    )


def _nearest_fill(docs: pd.DataFrame) -> pd.DataFrame:
    """Documents of a cut block that fill what is left, in the order of their deal; the last one brings it nearest."""
    docs = docs.sort_values(["deal", "doc_id", "size"], ignore_index=True)
    left, sizes = float(docs["left"].iloc[0]), docs["size"].to_numpy()
    takes = np.zeros(len(docs), np.int32)
    for i, size in enumerate(sizes.tolist()):
        if size <= left:
            takes[i], left = 1, left - size
    over = np.flatnonzero(takes == 0)
    if len(over):
        least = over[np.argmin(sizes[over])]
        takes[least] = sizes[least] - left < left
    return docs.assign(once_more=takes)


def _placed_blocks(blocks: DataFrame, quotas: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """Each block with its shard in every pass of its source."""
    # one row per source, counted before: the same table that the join above may broadcast
    rows = quotas.orderBy("source_no").collect()
    totals = np.array([r["blocks"] * r["passes"] + (r["opened_blocks"] or 0) for r in rows], np.int64)
    opened = np.array([r["opened_blocks"] or 0 for r in rows], np.int64)
    numbers = np.array([r["source_no"] for r in rows], np.int64)
    shards = max(1, -(-int(totals.sum()) // shard_blocks))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source_no, block, count, passes = (batch[c].to_numpy(zero_copy_only=False) for c in ("source_no", "block", "blocks", "passes"))
            source = np.searchsorted(numbers, source_no)
            is_open = batch["opened"].to_numpy(zero_copy_only=False).astype(bool)
            takes = passes.astype(np.int64) + is_open
            row = np.repeat(np.arange(len(block)), takes)
            turn = np.arange(len(row)) - np.repeat(np.cumsum(takes) - takes, takes)
            # the last pass draws on its opened blocks only
            pool = np.where(turn < passes[row], count[row], np.maximum(opened[source[row]], 1))
            places = turn * count[row] + (block[row] * (STEP % pool) + turn) % pool
            shard = shards_of(source[row], places, totals, shards, seed)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(takes)]).astype(np.int32), pa.array(shard, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch["source_no"], batch["block"], batch["left"], batch["block_size"], batch["opened"], lists],
                names=["source_no", "block", "left", "block_size", "opened", "placed"])

    return blocks.mapInArrow(releasing(place), "source_no bigint, block bigint, left double, block_size bigint, opened boolean, placed array<bigint>")


def drawn(mixed: DataFrame) -> DataFrame:
    """One row per time a document is taken, shuffled inside its shard: sort by (shard, turn_key)."""
    return mixed.select("*", F.posexplode("shards").alias("turn", "shard")).withColumn(
        "turn_key", F.xxhash64("shard", "doc_id", "turn"))


def taken_words(mixed: DataFrame) -> DataFrame:
    """Digest columns: words taken of each document."""
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"),
        F.size("shards").alias("times"), "shards")
