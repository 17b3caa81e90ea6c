"""Near copies: all texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

SimHash alone can't give these: at similarity 0.8 the fingerprints of two texts differ in about
ten bits of 64, and blocks narrow enough for that distance meet nearly all pairs. So fingerprints
only propose links, each of which is verified on the shingles, and a prefix join completes them:
of sets in one global order, two with similarity s or more share an element among the first
``n - ceil(s * n) + 1`` of each. No similar pair is left out, whatever its fingerprints.

1. Close fingerprints, and neighbours in size among the texts that hold one prefix element,
   propose links, in rows proportional to the elements; the similar ones make first groups.
2. Of each prefix element, each text is compared with the one of another group whose sketch is
   nearest, in rows proportional to the elements, which joins the parts of a large group; then all
   texts of groups that are still different.

Before whole sets are compared, sketches rule pairs out exactly: each element flips one of 1,024
bits, so sketches differ in no more bits than sets in elements, and similar sets differ in at most
a ninth of their sizes' sum. Of sets with more elements than bits a second sketch of as many bits,
which is folded to the narrower one's width, is compared once for each pair.

The order puts elements that many texts hold last, so that common lines aren't keys. Which these
are is estimated on some texts; that bears on the cost only, as any order gives the same pairs.
A text is known by 64 bits of its hash, and sets are made again for the few that are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, release, share_broadcast, small_batches, text_bytes
from .components import components, joined
from .simhash import fold, links, shingle_hashes

#: Words in a shingle; similarity as a fraction of two integers, so that comparing is exact.
WORDS, PART, WHOLE = 5, 4, 5
#: Elements that this many of about ``SOME`` texts hold come last; at most ``LAST`` of them.
COMMON, SOME, LAST = 4, 5_000, 200_000
#: Bytes of a sketch.
SKETCH = 128
#: At most so many links are joined on the driver.
FEW = 200_000


def elements(found: np.ndarray) -> np.ndarray:
    """Distinct shingles as 62-bit hashes; a text without words has one of its own."""
    return np.unique(found >> np.uint64(2)) if len(found) else np.zeros(1, np.uint64)


def prefix_size(n: int) -> int:
    return n - -(-PART * n // WHOLE) + 1


def sketch(items: np.ndarray, size: int = SKETCH) -> bytes:
    odd = np.bincount((items & np.uint64(8 * size - 1)).astype(np.int64), minlength=8 * size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_sketch(items: np.ndarray) -> bytes:
    """A sketch of about a bit to an element; none for sets that the common one suits."""
    return sketch(items, 1 << (len(items) - 1).bit_length() - 3) if len(items) > 8 * SKETCH else b""


def folded(bits: np.ndarray, n: int) -> np.ndarray:
    """A sketch as one of ``n`` words would be."""
    while len(bits) > n:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _texts(column) -> Iterator:
    view, at = text_bytes(column)
    return (shingle_hashes(bytes(view[s:e]), WORDS) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _sets(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        items = pa.array([elements(found).view(np.int64) for found in _texts(b.column("text"))], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("v"), items], names=["v", "items"])


def _prints(last: np.ndarray):
    """Fingerprint, size, sketch and first elements in the order (common or not, hash), as one long each."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = ([], [], [], [], [])
            for found in _texts(b.column("text")):
                items = elements(found)
                x = items.view(np.int64)
                if len(last):
                    at = np.minimum(np.searchsorted(last, x), len(last) - 1)
                    x = x | ((last[at] == x).astype(np.int64) << 62)
                for o, value in zip(out, (np.uint64(fold(found)).view(np.int64), len(x), sketch(items), wide_sketch(items), np.sort(x)[: prefix_size(len(x))]), strict=True):
                    o.append(value)
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["id", "v", "fp", "n", "sketch", "wide", "prefix"])

    return run


def may_be_similar(n, n2, bits, bits2) -> np.ndarray:
    """Whether sizes and sketches (rows of words) leave it open that sets are similar."""
    apart = np.bitwise_count(bits ^ bits2).sum(axis=-1, dtype=np.int64)
    return ((PART + WHOLE) * apart <= (WHOLE - PART) * (n + n2)) & (WHOLE * np.minimum(n, n2) >= PART * np.maximum(n, n2))


def _runs(batches: Iterator, columns: tuple, with_sketch: bool) -> Iterator:
    """Arrays of ``columns`` (and sketches) for whole runs of one key, each batch's complete ones together."""
    kept = None
    for b in batches:
        new = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", *columns)]
        if with_sketch:
            new.append(np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH // 8))
        kept = new if kept is None else [np.concatenate(x) for x in zip(kept, new, strict=True)]
        end = int(np.searchsorted(kept[0], kept[0][-1])) if len(kept[0]) else 0
        if end:
            yield [x[:end] for x in kept]
            kept = [x[end:] for x in kept]
    if kept is not None and len(kept[0]):
        yield kept


def _beside(batches: Iterator) -> Iterator:
    """Rows that follow each other at one key and may be similar by size."""
    import pyarrow as pa

    for key, v, n in _runs(batches, ("v", "n"), False):
        i = np.nonzero((key[1:] == key[:-1]) & (WHOLE * n[:-1] >= PART * n[1:]))[0]
        yield pa.RecordBatch.from_arrays([pa.array(v[i]), pa.array(v[i + 1])], names=["a", "b"])


def _pairs(nearest: bool):
    """All pairs at one key that are of different roots and may be similar; ``nearest``: of each row only that with the nearest sketch."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for key, v, root, n, bits in _runs(batches, ("v", "root", "n"), True):
            starts = np.concatenate((np.nonzero(np.diff(key, prepend=key[0] - 1))[0], [len(key)]))
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                a, b = [], []
                for i in range(lo + 1, hi):
                    # rows of a run go by size
                    least = lo + int(np.searchsorted(n[lo:i], -(-PART * n[i] // WHOLE)))
                    j = least + np.nonzero(root[least:i] != root[i])[0]
                    j = j[may_be_similar(n[i], n[j], bits[i], bits[j])]
                    if nearest and len(j):
                        j = j[[np.bitwise_count(bits[i] ^ bits[j]).sum(axis=-1, dtype=np.int64).argmin()]]
                    if len(j):
                        a.append(np.full(len(j), v[i]))
                        b.append(v[j])
                        if len(a) == 1024:
                            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                            a, b = [], []
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _still_open(batches: Iterator) -> Iterator:
    """Pairs that sketches leave open."""
    import pyarrow as pa

    for b in batches:
        keep = []
        for n, x, m, y in zip(*(b.column(c).to_pylist() for c in ("n", "x", "m", "y")), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            words = min(len(x), len(y))
            keep.append(bool(may_be_similar(n, m, folded(x, words), folded(y, words))))
        yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar; ``prints`` has one row for each text."""
    pairs = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    n = pairs.count()
    bits = F.when(F.length("wide") > 0, F.col("wide")).otherwise(F.col("sketch"))
    side = lambda c, size, name: prints.select(F.col("v").alias(c), F.col("n").alias(size), bits.alias(name))
    sketched = share_broadcast(pairs, n, 1_000_000).join(side("a", "n", "x"), "a")
    sketched = sketched.join(side("b", "m", "y"), "b")
    pairs = cut(sketched.mapInArrow(_still_open, "a long, b long"))
    n = pairs.count()
    sets = lambda c, name: texts.join(share_broadcast(pairs.select(F.col(c).alias("v")).distinct(), n, 1_000_000), "v", "left_semi").mapInArrow(_sets, "v long, items array<long>").select(F.col("v").alias(c), F.col("items").alias(name))
    both = sets("a", "x").dropDuplicates(["a"]).join(share_broadcast(pairs, n, 1_000_000), "a").join(sets("b", "y").dropDuplicates(["b"]), "b")
    shared, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return cut(both.filter((PART + WHOLE) * shared >= PART * total).select("a", "b").distinct())


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, component_id).

    Texts of similarity 0.8 or more on five-word shingles (words as in SimHash; a text of fewer
    words is one shingle) link; ``component_id`` is the smallest id that links reach. Null,
    empty and blank texts are alike; null ids never name a component; an empty table gives no
    rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("v"), text.alias("text"))
    some = rows.sample(min(1.0, SOME / max(1, rows.count())), 1).mapInArrow(_sets, "v long, items array<long>")
    common = some.select(F.explode("items").alias("x")).groupBy("x").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "x").limit(LAST)
    last = np.sort(np.array([r["x"] for r in common.collect()], np.int64))
    prints = cut(rows.mapInArrow(_prints(last), f"id {docs.schema[id_col].dataType.simpleString()}, v long, fp long, n int, sketch binary, wide binary, prefix array<long>"))
    # copies of a text are compared as one
    distinct = prints.agg(F.count("*"), F.count_distinct("v")).first()
    one = prints if distinct[0] == distinct[1] else cut(prints.dropDuplicates(["v"]))
    keyed = one.select("v", "n", F.explode("prefix").alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("count")).filter("count > 1").select("key"))
    met = cut(keyed.join(shared, "key"))
    release(docs.sparkSession)
    # proposals: close fingerprints, equal ones, and neighbours in size at one key
    least = cut(one.groupBy("fp").agg(F.min("v").alias("least")))
    close = links(least.select("fp")).join(least.select(F.col("fp").alias("a"), F.col("least").alias("va")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("vb")), "b")
    equal = one.join(least, "fp").select(F.col("v").alias("a"), F.col("least").alias("b"))
    beside = met.repartition("key").sortWithinPartitions("key", "n", "v").mapInArrow(_beside, "a long, b long")
    first = verified(close.select(F.col("va").alias("a"), F.col("vb").alias("b")).union(equal).union(beside), rows, one)
    release(docs.sparkSession)
    roots = components(first, FEW)
    for nearest in (True, False):
        # a key whose texts are all of one group has nothing left to find
        few = share_broadcast(roots, roots.count(), 500_000)
        placed = met.join(few, "v", "left").select("key", "v", "n", F.coalesce("root", "v").alias("root"))
        open_keys = cut(placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key"))
        # only here sketches go along, as pairs of different groups are looked at
        dealt = placed.join(open_keys, "key").join(one.select("v", "sketch"), "v")
        more = verified(dealt.repartition("key").sortWithinPartitions("key", "n", "v").mapInArrow(_pairs(nearest), "a long, b long"), rows, one)
        release(docs.sparkSession)
        roots = joined(roots, more, FEW)
    named = prints.select("id", "v").join(roots, "v", "left").select("id", F.coalesce("root", "v").alias("root"))
    named = cut(named)
    # cut, so that the join deals both sides anew and can split a large group
    groups = cut(named.groupBy("root").agg(F.min("id").alias("component_id")))
    return named.join(groups, "root").select("id", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id names their component.

    Rows with a null id stay only if no row of their component has an id.
    """
    found = near_copies(docs, id_col, text_col)
    kept = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).select("id").distinct().toDF(*fresh(docs, "id"))
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(kept.columns[0])), "left_semi")
