"""Approximate nearest neighbours along shifted space-filling curves.

Vectors are projected to a few of their principal axes, turned at random, shifted, and put in the
order of a Hilbert curve; this is done for several turns. Spark range-partitions each order,
which gives every vector a rank on every curve. A query's candidates are the vectors whose ranks
differ from its own by at most a fixed window on any curve. Each curve is cut into blocks; a
block's task holds that block and the queries whose windows reach it, and passes on each query's
nearest only. These are merged and ranked by exact distance, at a cost to a query that doesn't
grow with the table.

On vectors without structure no curve keeps neighbours together: a constant recall would need a
constant share of the table. There ``complete`` adds an exact pass: the queries go in chunks of
bounded size past all vectors, and only what is nearer than the k-th that the curves found is
passed on. It costs a distance for each query and vector, and makes the result exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Rows of a block, and bytes of the queries that go past all vectors at once.
BLOCK, CHUNK = 4096, 32 << 20


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of whole-number points (n, d), each below 2**bits."""
    x = points.astype(np.int64).copy()
    d = x.shape[1]
    for level in range(bits - 1, 0, -1):  # undo the rotation of each level from the coarsest on
        bit, below = 1 << level, (1 << level) - 1
        for i in range(d):
            on = (x[:, i] & bit) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & below)
            x[:, 0] ^= np.where(on, below, swap)
            x[:, i] ^= swap
    for i in range(1, d):  # Gray code
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, d - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[:, i] >> level) & 1
    return key


def _curves(sample: np.ndarray, curves: int, dims: int, seed: int) -> list[tuple]:
    """(projection, lowest, width) of each curve; its shift is part of the lowest."""
    rng = np.random.default_rng(seed)
    axes = np.linalg.svd(sample - sample.mean(0), full_matrices=False)[2][: 2 * dims]
    out = []
    for _ in range(curves):
        turn = np.linalg.qr(rng.normal(size=(len(axes), len(axes))))[0][:, :dims]
        p = axes.T @ turn
        y = sample @ p
        low, high = np.quantile(y, [0.001, 0.999], axis=0)
        width = np.maximum(high - low, 1e-12) / 0.75
        out.append((p, low - width * 0.25 * rng.random(len(low)), width))
    return out


def _keys(shared, bits: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
            for c, (p, low, width) in enumerate(shared.value):
                z = np.clip((x @ p - low) / width * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, c, np.int32)), pa.array(hilbert(z, bits)), b.column("id")], names=["curve", "key", "id"])

    return run


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _closest(c: np.ndarray, ids: np.ndarray, own: np.ndarray, q: np.ndarray, barred: np.ndarray, k: int, reach: float):
    """Ids and exact distances of the ``k`` nearest rows at ``reach`` or less; a product only rules out the rest."""
    rough = own + q @ q - 2 * (c @ q)
    rough[barred] = np.inf
    slack = 1e-9 * (own.max() + q @ q)
    edge = min(np.partition(rough, k - 1)[k - 1] if len(c) > k else np.inf, reach * reach) + slack
    near = np.nonzero((rough <= edge) & np.isfinite(rough))[0]
    far = np.sqrt(np.add.accumulate((c[near] - q) ** 2, axis=1)[:, -1])
    best = np.lexsort((ids[near], far))[:k]
    return ids[near][best], far[best]


def _found(rows: list):
    import pyarrow as pa

    join = lambda i, kind: pa.array(np.concatenate([r[i] for r in rows]) if rows else np.empty(0), kind)
    return pa.table({"query_id": join(0, pa.int64()), "id": join(1, pa.int64()), "score": join(2, pa.float64())})


def _nearest(k: int, window: int):
    def run(left, right):
        rows = []
        if left.num_rows and right.num_rows:
            ids, ranks, c = left.column("id").to_numpy(), left.column("rank").to_numpy(), _matrix(left.column("v"))
            own, order = (c * c).sum(1), np.argsort(ranks)
            ids, ranks, c, own = ids[order], ranks[order], c[order], own[order]
            for qid, rank, q in zip(right.column("q_id").to_numpy(), right.column("q_rank").to_numpy(), _matrix(right.column("q_v")), strict=True):
                lo, hi = np.searchsorted(ranks, [rank - window, rank + window + 1])
                if lo < hi:
                    found, far = _closest(c[lo:hi], ids[lo:hi], own[lo:hi], q, ids[lo:hi] == qid, k, np.inf)
                    rows.append((np.full(len(found), qid), found, far))
        return _found(rows)

    return run


def _scan(shared, k: int):
    """For each batch of vectors what is as near to a query of the chunk as its reach."""

    def run(batches: Iterator) -> Iterator:
        qids, qs, reach = shared.value
        for b in batches:
            rows = []
            if b.num_rows:
                ids, c = b.column("id").to_numpy(), _matrix(b.column("v"))
                own = (c * c).sum(1)
                for i in range(0, len(qs), 256):
                    rough = (qs[i : i + 256] ** 2).sum(1)[:, None] + own - 2 * qs[i : i + 256] @ c.T
                    slack = 1e-9 * (own.max() + (qs[i : i + 256] ** 2).sum(1))
                    for j in np.nonzero((rough <= (reach[i : i + 256] ** 2 + slack)[:, None]).any(axis=1))[0]:
                        found, far = _closest(c, ids, own, qs[i + j], ids == qids[i + j], k, reach[i + j])
                        rows.append((np.full(len(found), qids[i + j]), found, far))
            yield from _found(rows).to_batches()

    return run


def _merge(found: DataFrame, k: int) -> DataFrame:
    best = found.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id")))
    return best.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def neighbours(vectors: DataFrame, is_query, k: int = 10, curves: int = 6, dims: int = 8, bits: int = 6, window: int = 256, complete: bool = False, sample: int = 10_000, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of each query: (query_id, rank, id, score).

    Queries are the rows that ``is_query`` (a condition on ``id``) names, candidates all rows but
    the query's own id; score is the Euclidean distance in double precision, ties go to the
    smaller id. Vectors that are null, empty, zero or hold a null, NaN or infinite component take
    no part, nor do those of another length than most (ties: the shortest), nor rows with a null
    id; of rows that repeat an id the one with the least vector counts. With fewer than ``k``
    candidates all are returned; an empty table gives no rows. Candidates lie ``window`` ranks to
    either side on any of the ``curves``; with ``complete`` an exact pass follows. Projections
    are fitted on at most ``sample`` rows, those with the least hashes; every row is ordered.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).filter("id is not null and v is not null and size(v) > 0")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.filter(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    shape = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    rows = cut(rows.filter(F.size("v") == shape["n"]))
    asked = rows.filter(is_query)
    # of equal vectors more than k + 1 can't be among anyone's nearest; Spark limits them before it deals them
    held = cut(rows.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("copy") <= k + 1).drop("copy"))
    fit = np.array([r[0] for r in held.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()])
    shared = spark.sparkContext.broadcast(_curves(fit, curves, min(dims, shape["n"]), seed))
    # queries among the copies that aren't held have ranks too
    order = held.union(asked).dropDuplicates(["id"]).mapInArrow(_keys(shared, bits), "curve int, key long, id long")
    dealt = cut(order.repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id").withColumn("at", F.monotonically_increasing_id()))
    parts = dealt.groupBy("curve", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("curve").orderBy("part")) - F.col("n")
    parts = parts.select("curve", "part", "first", before.alias("before"))
    ranks = dealt.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(parts), ["curve", "part"]).select("curve", "id", (F.col("at") - F.col("first") + F.col("before")).alias("rank"))
    block = lambda r: F.floor(r / BLOCK)
    asking = ranks.join(asked, "id").select("curve", "id", "rank", "v", F.explode(F.sequence(F.greatest(F.lit(0), block(F.col("rank") - window)), block(F.col("rank") + window))).alias("block"))
    asking = asking.toDF(*[f"q_{c}" for c in asking.columns])
    blocks = ranks.join(held, "id").withColumn("block", block(F.col("rank")))
    near = blocks.groupBy("curve", "block").cogroup(asking.groupBy("q_curve", "q_block")).applyInArrow(_nearest(k, window), "query_id long, id long, score double")
    if not complete:
        return _merge(near, k)
    near = cut(_merge(near, k).drop("rank"))
    reach = near.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("score")).alias("reach"))
    reach = cut(asked.join(reach, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce("reach", F.lit(float("inf"))).alias("reach")))
    chunks = max(1, math.ceil(reach.count() * 8 * (shape["n"] + 2) / CHUNK))
    for i in range(chunks):
        part = reach.filter(F.pmod(F.xxhash64("id"), F.lit(chunks)) == i).collect()
        if part:
            sent = spark.sparkContext.broadcast((np.array([r["id"] for r in part]), np.array([r["v"] for r in part], np.float64), np.array([r["reach"] for r in part])))
            near = near.union(cut(held.mapInArrow(_scan(sent, k), "query_id long, id long, score double")))
    return _merge(near, k)
