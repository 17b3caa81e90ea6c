"""SimHash near-dedup with pigeonhole blocks.

A fingerprint is cut into ``distance + KEEP`` blocks. Two fingerprints that differ in at most
``distance`` bits agree in at least KEEP blocks, so every choice of KEEP blocks is a join key and
each close pair shares one. Keys met once are dropped; the rest are dealt by key, sorted, and
verified by Hamming distance run by run. Of a run only a spanning forest of its verified links
leaves the task, which keeps every component and never all pairs.

A run longer than ``most`` isn't dealt. Its fingerprints are linked through midpoints instead:
two fingerprints at distance d or less have a word within ceil(d / 2) bits of both, and all
fingerprints around a word within floor(d / 2) bits are linked, so for an even d grouping by such
words gives exactly the same components, in rows proportional to the fingerprints. An odd d has
no such words; its runs of any length are dealt and compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, share_broadcast, small_batches, text_bytes
from .components import components

SHINGLE = 4
SEED = 42
#: Blocks that a join key holds.
KEEP = 3


def shingle_hashes(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of UTF-8 bytes, with repeats; fewer words than a shingle's are one."""
    from xxhash import xxh64_intdigest as xx

    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < shingle:
        return np.array([xx(joined, SEED)], np.uint64)
    n = len(words) - shingle + 1
    spans = map(slice, starts[:n].tolist(), ends[shingle - 1 :].tolist())
    return np.fromiter(map(xx, map(joined.__getitem__, spans), repeat(SEED)), np.uint64, n)


def fold(hashes: np.ndarray) -> int:
    """Each bit as most of the hashes have it."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        count += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of UTF-8 bytes: words of the text in ASCII lower case, shingles with repeats."""
    return fold(shingle_hashes(data, shingle))


def _fingerprints(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        view, at = text_bytes(b.column("text"))
        found = np.fromiter((fingerprint(bytes(view[s:e])) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.uint64, len(at) - 1)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])


def block_keys(fp: Column, distance: int) -> Column:
    """Array of (which choice of blocks, their bits) as one long each."""
    n = distance + KEEP
    edges = [round(64 * i / n) for i in range(n + 1)]
    blocks = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    keys = []
    for number, chosen in enumerate(combinations(range(n), KEEP)):
        bits, width = F.lit(number).cast("long"), 0
        for i in chosen:
            bits = F.shiftleft(bits, edges[i + 1] - edges[i]).bitwiseOR(blocks[i])
            width += edges[i + 1] - edges[i]
        keys.append(bits)
    return F.array(*keys)


def forest(key: np.ndarray, fp: np.ndarray, distance: int) -> np.ndarray:
    """Index of another fingerprint of the same run and component, or its own, for each entry."""
    root = np.arange(len(key))
    live = np.arange(len(key) - 1)
    for d in range(1, len(key)):
        live = live[live + d < len(key)]
        live = live[key[live] == key[live + d]]
        if not len(live):
            break
        near = live[np.bitwise_count(fp[live] ^ fp[live + d]) <= distance]
        near = near[root[near] != root[near + d]]
        for i in near.tolist():
            a, b = i, i + d
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        if len(near):
            while True:
                above = root[root]
                if (above == root).all():
                    break
                root = above
    return root


def _links(distance: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kept_key, kept_fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def emit(key, fp):
            root = forest(key, fp.view(np.uint64), distance)
            i = np.nonzero(root != np.arange(len(root)))[0]
            return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[root[i]])], names=["a", "b"])

        for b in batches:
            key = np.concatenate((kept_key, b.column("key").to_numpy(zero_copy_only=False)))
            fp = np.concatenate((kept_fp, b.column("fp").to_numpy(zero_copy_only=False)))
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            kept_key, kept_fp = key[last:], fp[last:]
            if last:
                yield emit(key[:last], fp[:last])
        if len(kept_key):
            yield emit(kept_key, kept_fp)

    return run


def links(fps: DataFrame, distance: int = 4, most: int = 8192) -> DataFrame:
    """Links (a, b) that span the components of fingerprints at ``distance`` or less; see above."""
    most = most if distance % 2 == 0 else 1 << 62
    keys = fps.select("fp", F.explode(block_keys(F.col("fp"), distance)).alias("key"))
    crowds = cut(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    n = crowds.count()
    dealt = keys.join(share_broadcast(crowds.filter(F.col("n") <= most), n, 1_000_000), "key").select("key", "fp")
    found = dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links(distance), "a long, b long").distinct()
    crowded = crowds.filter(F.col("n") > most).select("key")
    if crowded.isEmpty():
        return found
    hot = keys.join(crowded, "key", "left_semi").select("fp").distinct()
    return found.union(_through_midpoints(hot, distance))


def _through_midpoints(fps: DataFrame, distance: int) -> DataFrame:
    masks = [sum(1 << i for i in chosen) for k in range(distance // 2 + 1) for chosen in combinations(range(64), k)]
    masks = np.array(masks, np.uint64).view(np.int64)

    def around(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            for part in np.array_split(fp, max(1, len(fp) // 64)):
                yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ masks).ravel()), pa.array(np.repeat(part, len(masks)))], names=["word", "fp"])

    near = cut(fps.mapInArrow(around, "word long, fp long"))
    least = near.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return near.join(least, "word").filter("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", most: int = 8192) -> DataFrame:
    """One row per input row: (id, fp long, component_id).

    Texts link when their fingerprints differ in ``distance`` bits or fewer; ``component_id`` is
    the smallest id that links reach. A null, empty or blank text has fingerprint 0 and links
    like any other; repeated rows give repeated rows; null ids never name a component (it is
    null if all its ids are); an empty table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = cut(rows.mapInArrow(_fingerprints, f"id {docs.schema[id_col].dataType.simpleString()}, fp long"))
    fps = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(fps.select("fp"), distance, most)).withColumnRenamed("v", "fp")
    placed = cut(fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    # cut, so that the join deals both sides anew and can split a large group
    named = cut(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = cut(placed.join(named, "root").select("fp", "component_id"))
    return prints.join(by_fp, "fp").select("id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id names their component.

    Rows with a null id stay only if no row of their component has an id.
    """
    found = near_duplicates(docs, distance, id_col, text_col)
    kept = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).select("id").distinct().toDF(*fresh(docs, "id"))
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(kept.columns[0])), "left_semi")
