"""Connected components of edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturemill.session import checkpointed

# Links of one node, as its high or its low end, up to which they stay together in any case: a quarter of a megabyte.
LEAST_HUB = 10_000
# Links that are counted to find hubs; of more links, a sample of about so many tells which nodes are worth dealing.
COUNTED_LINKS = 1_000_000
# Edges a task contracts at a time; bounds its memory.
CONTRACT_EDGES = 500_000


def connected_components(edges: DataFrame, group: str = "capture_id") -> DataFrame:
    """Label every node of (group, u, v) with the smallest node id of its component.

    Every task first replaces the edges it happens to hold by stars, a pre-aggregation
    that shortens paths before anything is shuffled.  If more links are left than a task contracts at a time, they are dealt
    by ranges of their high ends and contracted once more, which settles most of a graph whose neighbours have near numbers,
    as meshes have; nodes that have but one link then wait aside for the label of its low end.
    A task contracts what is left if it holds all of it at a time (``CONTRACT_EDGES``).  Otherwise alternating large-star and
    small-star rounds (Kiveris et al., 2014) follow.  Each star is one pre-aggregated
    minimum per node and one join back.  A node with more links than a task's share is a hub: its links are
    dealt to sub-centres, each of which gets the minimum, so no task reads a hub as a whole.  A reliable checkpoint
    ends every round, and the rounds go on until the edges no longer change, however many that takes.
    """
    plain = edges.select(F.col(group).cast("long").alias(group), F.col("u").cast("long"), F.col("v").cast("long"))
    links = checkpointed(_contracted(plain.where("u <> v")).distinct())
    seen = [_fingerprint(links)]
    leaves = None
    if seen[-1][0] > CONTRACT_EDGES:
        near = links.repartitionByRange(group, "high", "low").withColumnsRenamed({"high": "u", "low": "v"})
        links, leaves = _without_leaves(checkpointed(_contracted(near).distinct()), group)
        seen = [_fingerprint(links)]
    if seen[-1][0] <= CONTRACT_EDGES:
        links = checkpointed(_contracted(links.withColumnsRenamed({"high": "u", "low": "v"}).coalesce(1)))
    else:
        links = _in_rounds(links, group, seen)
    nodes = plain.select(group, F.explode(F.array("u", "v")).alias("node"))
    roots = links.select(group, F.col("high").alias("node"), F.col("low").alias("component"))
    if leaves is not None:
        above = links.select(group, "high", F.col("low").alias("least")).withColumnRenamed("high", "low")
        roots = roots.unionByName(leaves.join(above, [group, "low"], "left").select(
            group, F.col("high").alias("node"), F.coalesce("least", "low").alias("component")))
    return nodes.distinct().join(roots, [group, "node"], "left").select(
        group, "node", F.coalesce("component", "node").alias("component")
    )


def _without_leaves(links: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Links without those whose high end has no other link, and these: such a node has the label of its low end."""
    ends = links.select(group, "high", "low", F.explode(F.array("high", "low")).alias("node"))
    # a node's links that are counted are those it is the high end of, named by their low end, if it has but one in all
    counted = ends.groupBy(group, "node").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("node") == F.col("high"), F.col("low"))).alias("low"))
    leaves = checkpointed(counted.where("n = 1 AND low IS NOT NULL").select(group, F.col("node").alias("high"), "low"))
    return checkpointed(links.join(leaves.select(group, "high"), [group, "high"], "left_anti")), leaves


def _in_rounds(links: DataFrame, group: str, seen: list[tuple]) -> DataFrame:
    """Links from every node to the smallest one of its component; ``seen`` begins with the state of ``links``."""
    while True:
        links = checkpointed(_round(links, group, seen[-1][0]))
        state = _fingerprint(links)
        if state == seen[-1]:
            return links
        if state in seen:  # every round moves links to smaller nodes, so none comes back
            raise RuntimeError("connected components went in a circle")
        seen.append(state)


def _round(links: DataFrame, group: str, count: int) -> DataFrame:
    """One large star and one small star over ``count`` links."""
    tasks = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(LEAST_HUB, count // tasks)
    lots = _lots(links, group, share, min(1.0, COUNTED_LINKS / max(count, 1))) if count > share else {}
    return _small_star(_large_star(links, group, lots.get("low")), group, lots.get("high"))


def _lots(links: DataFrame, group: str, share: int, fraction: float = 1.0) -> dict[str, DataFrame]:
    """Sub-centres (group, node, lots) of the nodes with more links than a share, for both ends of the links.

    A large star keeps the high ends, so the counts hold for the small star after it.  No more than one node per task and end can
    have more than a share, which bounds these tables.  A ``fraction`` of the links is looked at: what it
    finds decides how links are dealt, never what they say.
    """
    if fraction < 1.0:
        links = links.sample(fraction, seed=1)
    ends = F.explode(F.array(*[F.struct(F.lit(end).alias("end"), F.col(end).alias("node")) for end in ("high", "low")]))
    hubs = links.select(group, ends.alias("e")).groupBy(group, "e.end", "e.node").agg(F.count(F.lit(1)).alias("links")).where(
        F.col("links") > share * fraction).select("end", group, "node", F.ceil(F.col("links") / (share * fraction)).alias("lots")).collect()
    spark, schema = links.sparkSession, f"{group} bigint, node bigint, lots bigint"
    return {end: F.broadcast(spark.createDataFrame([tuple(r)[1:] for r in hubs if r["end"] == end], schema)) for end in {r["end"] for r in hubs}}


def _with_least(rows: DataFrame, least: DataFrame, group: str, lots: DataFrame | None) -> DataFrame:
    """Rows (group, node, other) with the minimum ``m`` of their node; those of a hub are dealt by their other end."""
    key = [group, "node"]
    if lots is None:
        return rows.join(least, key)
    many = F.coalesce("lots", F.lit(1).cast("long"))
    dealt = rows.join(lots, key, "left").withColumn("lot", F.pmod(F.xxhash64("other"), many)).drop("lots")
    centres = least.join(lots, key, "left").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop("lots")
    return dealt.join(centres, [*key, "lot"]).drop("lot")


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (group, high, low) of stars that join the same nodes, task by task."""
    group = edges.columns[0]

    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= CONTRACT_EDGES:
                yield _stars(pd.concat(held), group)
                held, rows = [], 0
        if rows:
            yield _stars(pd.concat(held), group)

    return edges.mapInPandas(contract, f"{group} bigint, high bigint, low bigint")


def _stars(edges: pd.DataFrame, group: str) -> pd.DataFrame:
    """Every node of some edges with the smallest node it is joined to."""
    n = len(edges)
    groups, in_group = np.unique(edges[group].to_numpy(), return_inverse=True)
    names, in_names = np.unique(np.concatenate([edges["u"], edges["v"]]), return_inverse=True)
    keys, ends = np.unique(np.tile(in_group, 2) * len(names) + in_names, return_inverse=True)
    u, v = ends[:n], ends[n:]
    root = np.arange(len(keys))
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(keys)))
    return pd.DataFrame({
        group: groups[keys[moved] // len(names)],
        "high": names[keys[moved] % len(names)],
        "low": names[keys[root[moved]] % len(names)],
    })


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*links.columns)).alias("h")
    ).first()
    return row["n"], row["h"]


def _large_star(links: DataFrame, group: str, lots: DataFrame | None = None) -> DataFrame:
    """Join every larger neighbour of a node to the node's smallest neighbour."""
    ends = [F.struct(F.col(a).alias("node"), F.col(b).alias("other")) for a, b in (("high", "low"), ("low", "high"))]
    around = links.select(group, F.explode(F.array(*ends)).alias("e")).select(group, "e.node", "e.other")
    least = around.groupBy(group, "node").agg(F.min("other").alias("m")).select(
        group, "node", F.least("m", "node").alias("m")
    )
    larger = links.select(group, F.col("low").alias("node"), F.col("high").alias("other"))
    # repeats are left to the small star, which drops them
    return _with_least(larger, least, group, lots).select(group, F.col("other").alias("high"), F.col("m").alias("low"))


def _small_star(links: DataFrame, group: str, lots: DataFrame | None = None) -> DataFrame:
    """Join every smaller neighbour of a node, and the node, to its smallest neighbour."""
    rows = links.select(group, F.col("high").alias("node"), F.col("low").alias("other"))
    least = rows.groupBy(group, "node").agg(F.min("other").alias("m"))
    moved = _with_least(rows, least, group, lots).where(F.col("other") > F.col("m")).select(
        group, F.col("other").alias("high"), F.col("m").alias("low")
    )
    return moved.unionByName(least.select(group, F.col("node").alias("high"), F.col("m").alias("low"))).distinct()


def registration_groups(strong: DataFrame) -> DataFrame:
    """Groups of images held together by strong pairs: (capture_id, image_id, component).

    ``strong`` has decoded image ids.
    """
    edges = strong.select("capture_id", F.col("image_id1").alias("u"), F.col("image_id2").alias("v"))
    return connected_components(edges).withColumnRenamed("node", "image_id")
