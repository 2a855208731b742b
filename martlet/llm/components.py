"""Connected components of links, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.session import stable, tidied


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all links (u, v) of a task: labels fall to the smallest of both ends until none moves."""
    ends = [np.concatenate(part) for part in zip(*((b["u"].to_numpy(), b["v"].to_numpy()) for b in batches))]
    if not ends:
        return
    nodes, place = np.unique(np.concatenate(ends), return_inverse=True)
    u, v = place[: len(ends[0])], place[len(ends[0]) :]
    label = np.arange(len(nodes))
    while True:
        least, before = np.minimum(label[u], label[v]), label.copy()
        for end in (u, v):
            np.minimum.at(label, before[end], least)  # the label's own node too, so that whole groups move
            np.minimum.at(label, end, least)
        label = label[label]
        if (label == before).all():
            break
    for i in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(nodes[label[i : i + 100_000]])], ["node", "label"])


def components(links: DataFrame, a: str = "a", b: str = "b", at_once: int = 0) -> DataFrame:
    """(node, label) for every node of ``links``; the label is the smallest node of its component.

    Every node hooks to its smallest neighbour, chains of hooks are shortened by doubling, and links are then drawn between
    the ends, until no link is left. Minima combine inside tasks first, so a node may have any number of links. Once there
    are ``at_once`` links or fewer between nodes that are longs, one task settles them, which spares the driver many jobs.
    """
    spark = links.sparkSession
    edges = stable(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u < v").distinct())
    mapping = None
    while left := edges.count():
        if left <= at_once:
            hooks = stable(edges.coalesce(1).mapInArrow(_settled, "node long, label long"))
        else:
            both = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).union(edges.select(F.col("v"), F.col("u")))
            hooks = stable(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("label")))
            while True:  # hooks lead to smaller nodes, so chains end; each round halves their length
                ends = hooks.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
                jumped = hooks.join(ends, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label"), (F.col("_l") < F.col("label")).alias("_moved"))
                jumped = stable(jumped)
                hooks = jumped.select("node", "label")
                if not jumped.agg(F.max("_moved")).first()[0]:
                    break
        if mapping is None:
            mapping = hooks
        else:
            step = hooks.withColumnsRenamed({"node": "_n", "label": "_l"})
            mapping = stable(
                mapping.join(step, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label"))
            )
        if left <= at_once:
            break
        ours, theirs = hooks.select(F.col("node").alias("u"), F.col("label").alias("lu")), hooks.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        moved = edges.join(ours, "u").join(theirs, "v")
        edges = stable(moved.select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).filter("u < v").distinct())
        tidied(spark)
    if mapping is None:
        node = links.schema[a].dataType.simpleString()
        return spark.createDataFrame([], f"node {node}, label {node}")
    return mapping
