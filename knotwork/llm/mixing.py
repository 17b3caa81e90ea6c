"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the exponential key ``-ln(u) / quality`` with u in (0, 1) from a hash of its
id, so reruns agree; least keys first is the order of ``u ** (1 / quality)`` falling, without its
underflow. A source's target in words is its share of the total by weight, capped at a number of
epochs over its own size, the excess reshared by weight ("water filling"). A source first takes
as many complete epochs as fit into its target; what remains is filled by its documents in the
order of their keys up to the budget.

The order within a source is never sorted in one task. The logarithms of the keys are cut into
slices of equal width; whatever the qualities, no part of them is denser than 1/e of all rows to
a unit, so the width bounds the rows of a slice. Slices are summed, the sums are prefix-summed
over the few rows of one source, and only the documents within a slice are sorted. One row per
source is small.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Rows of a source's order to a unit of the keys' logarithm, over their number of slices.
SLICE = 1024


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], max_epochs: int = 3) -> DataFrame:
    """Targets by source: (source, source_size, n_docs, target) from (source, source_size, n_docs).

    Weights go round the sources in code point order, null last. With sources in the order of
    cap / weight, those before a point are capped, the rest share what is left by weight; a
    source is capped if its share at its own turn would exceed its cap. Sums are whole numbers.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rows = sizes.withColumn("w", F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    rows = rows.withColumn("cap", F.col("source_size") * max_epochs)
    turn = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    rows = rows.withColumns(
        {
            "total": F.sum("source_size").over(everything),
            "before_cap": F.coalesce(F.sum("cap").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "left_w": F.sum("w").over(turn.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    # capped: cap / w < (total - caps before) / (weights from here), in whole numbers
    rows = rows.withColumn("capped", F.col("cap").cast("decimal(38,0)") * F.col("left_w") <= F.col("w") * (F.col("total") - F.col("before_cap")).cast("decimal(38,0)"))
    free = F.when(~F.col("capped"), F.struct(F.col("before_cap"), F.col("left_w")))
    rows = rows.withColumn("level", F.min(free).over(everything))
    share = (F.col("total") - F.col("level.before_cap")).cast("double") * F.col("w") / F.col("level.left_w")
    return rows.select("source", "source_size", "n_docs", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def log_key(hashed: Column, quality: Column) -> Column:
    """Logarithm of the exponential key of a 64-bit hash; qualities of any size keep their precision."""
    u = (F.pmod(hashed, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return F.log(-F.log(u)) - F.log(quality)


def slice_of(key: Column, n_docs: Column) -> Column:
    """Slice of about SLICE / e rows at most, as keys of one quality have a density of 1/e at most and mixtures no more."""
    return F.floor(key * (n_docs / SLICE + 1)).cast("long")


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: list[int] | None = None, max_epochs: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: (id, size, source_size, target, epochs, taken).

    ``quality``: (id, quality double above 0) of some documents; others, and null, non-positive
    or non-finite values, count as 1. A null id is dealt by a hash of the text. ``epochs`` is how often the mix takes the document,
    ``taken`` = ``epochs * size``; ``target`` is its source's. The last document of the
    fractional selection is taken if that brings the source nearer to its target. A null text
    has size 0; a null source is a source of its own; repeated rows are documents of their own,
    in an order by id and size; an empty table gives no rows. Other columns are not read.
    """
    weights = weights or [5, 2, 1]
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(seed), F.col(text_col))).otherwise(F.xxhash64(F.lit(seed), F.col(id_col))).alias("hash"))
    if quality is None:
        rows = rows.withColumn("quality", F.lit(1.0))
    else:
        known = quality.toDF("id", "quality").groupBy("id").agg(F.max("quality").alias("quality"))
        rows = rows.join(known, "id", "left").withColumn("quality", F.when((F.col("quality") > 0) & (F.col("quality") < float("inf")), F.col("quality")).otherwise(1.0))
    rows = cut(rows.withColumn("key", log_key(F.col("hash"), F.col("quality"))).drop("hash", "quality"))
    targets = cut(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, max_epochs))
    rows = rows.join(F.broadcast(targets) if targets.count() <= 10_000 else targets, rows.source.eqNullSafe(targets.source)).drop(targets.source)
    rows = rows.withColumn("slice", slice_of(F.col("key"), F.col("n_docs")))
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    sums = sums.withColumn("before", F.coalesce(F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("slice_size")
    within = Window.partitionBy("source", "slice").orderBy("key", "id", "size")
    ranked = rows.withColumn("so_far", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    ranked = ranked.join(sums.withColumnsRenamed({"source": "s", "slice": "k"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k"))).withColumn("so_far", F.col("so_far") + F.col("before"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - full * F.col("source_size")
    epochs = (full + F.when((F.col("size") > 0) & (full < max_epochs) & (2 * F.col("so_far") + F.col("size") <= 2 * rest), 1).otherwise(0)).cast("long")
    return ranked.select(F.col("id").alias(id_col), "size", "source_size", "target", epochs.alias("epochs"), (epochs * F.col("size")).alias("taken"))
