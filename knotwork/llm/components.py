"""Connected components of a graph of long vertices, by least labels and pointer jumping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, their roots) of a few edges."""
    v, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(v))
    while True:
        old = label.copy()
        low = np.minimum(old[x], old[y])
        np.minimum.at(label, old[x], low)
        np.minimum.at(label, old[y], low)
        label = label[label]
        if np.array_equal(label, old):
            return v, v[label]


def components(edges: DataFrame, few: int = 0) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b): root is the least vertex it can reach.

    Each round every vertex takes the least label among its own and its neighbours', then its
    label's label. Rounds end when nothing changes; each is cut in the shared checkpoint folder.
    Labels and edges stay distributed; only the number of changes comes to the driver. At most
    ``few`` different edges, 16 bytes each, are joined on the driver instead, which saves the rounds' jobs.
    """
    if few:
        edges = cut(edges.select("a", "b").filter("a != b").distinct())
        if edges.count() <= few:
            import pyarrow as pa

            rows = edges.toArrow()
            v, root = least_labels(*(rows.column(c).to_numpy() for c in ("a", "b")))
            return cut(edges.sparkSession.createDataFrame(pa.table({"v": v, "root": root})))
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("l")).select("v", F.least("v", "l").alias("l"))
    labels = cut(labels)
    while True:
        told = both.join(labels.withColumnRenamed("v", "a"), "a").groupBy(F.col("b").alias("v")).agg(F.min("l").alias("near"))
        hooked = labels.join(told, "v").select("v", F.col("l").alias("old"), F.least("l", "near").alias("l"))
        of = labels.select(F.col("v").alias("l"), F.col("l").alias("above"))
        moved = cut(hooked.join(of, "l").select("v", "old", F.least("l", "above").alias("l")))
        labels = moved.select("v", "l")
        if moved.filter("l != old").isEmpty():
            return labels.withColumnRenamed("l", "root")


def joined(roots: DataFrame, edges: DataFrame, few: int = 0) -> DataFrame:
    """Components (v, root) after more ``edges`` (a, b), which count once for each two roots that they link."""
    of = lambda c: roots.select(F.col("v").alias(c), F.col("root").alias(f"r{c}"))
    above = components(edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), few)
    new = above.select("v", F.col("v").alias("root")).join(roots, "v", "left_anti")
    return cut(roots.select("v", "root").union(new).join(above.select(F.col("v").alias("root"), F.col("root").alias("above")), "root", "left").select("v", F.coalesce("above", "root").alias("root")))
