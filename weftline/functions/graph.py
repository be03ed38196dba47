"""Connected components by least labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.scratch import materialize


#: Rows of components that a single task gives out at once.
_OUT = 50_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b), ascending, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        u, v = label[x], label[y]
        apart = u != v
        if not apart.any():
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(u, v)[apart], np.minimum(u, v)[apart])
        while (label[label] != label).any():
            label = label[label]


def _in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [pdf.to_numpy(np.int64) for pdf in batches]
    if held:
        nodes, least = least_labels(*np.concatenate(held).T)
        for i in range(0, len(nodes), _OUT):
            yield pd.DataFrame({"k": nodes[i : i + _OUT], "c": least[i : i + _OUT]})


def components(links: DataFrame, together: int = 0) -> DataFrame:
    """links (a, b) -> (k, c): the least node c reachable from each node k that has a link.

    Every round takes the least label among neighbours and then the label of that label, and is written to the shared
    folder; rounds end when no label changes. Up to ``together`` links (nodes long, none null) are solved by one task in
    one step instead. An empty link table gives an empty result.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    if together and both.count() <= 2 * together:
        return materialize(both.where("a < b").coalesce(1).mapInPandas(_in_one_task, "k long, c long"), "labels")
    labels = materialize(both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("a"), F.min("b")).alias("c")), "labels")
    while True:
        near = both.join(labels.hint("merge"), F.col("b") == F.col("k")).groupBy(F.col("a").alias("n")).agg(F.min("c").alias("m"))
        stepped = materialize(labels.join(near.hint("merge"), F.col("k") == F.col("n"), "left").select("k", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c")), "stepped")
        above = stepped.select(F.col("k").alias("u"), F.col("c").alias("d"))
        jumped = stepped.join(above.hint("merge"), F.col("c") == F.col("u"), "left").select("k", "old", F.least("c", F.coalesce("d", "c")).alias("c"))
        moved = materialize(jumped, "labels")
        labels = moved.select("k", "c")
        if moved.where("old <> c").isEmpty():
            return labels


def line_components(lines: DataFrame) -> DataFrame:
    """lines (wkb) -> (wkb, c): c tells the connected parts apart. Two lines touch where an end of one is an end of the other."""
    from weftline.geo import functions as g

    ends = materialize(lines.where(F.col("wkb").isNotNull()).select("wkb", g.call("ends", F.col("wkb")).alias("ends")), "line-ends")
    # end points are the nodes of the graph, named by a hash of their coordinates
    keyed = ends.select("wkb", F.transform("ends", lambda e: F.xxhash64(e)).alias("nodes")).where(F.size("nodes") > 0)
    links = keyed.select(F.col("nodes")[0].alias("a"), F.explode("nodes").alias("b"))
    labels = components(links)
    named = keyed.join(labels.hint("merge"), F.col("nodes")[0] == F.col("k"), "left")
    return named.select("wkb", F.coalesce("c", F.col("nodes")[0]).alias("c"))
