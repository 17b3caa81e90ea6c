"""Exact dedup by composable polynomial fingerprints.

A text's UTF-8 bytes are cut into chunks. Each chunk is hashed by a polynomial in two prime
fields, all chunks of a text in one matrix product, and chunk hashes combine from left to right
by length-shifted arithmetic: ``h(a + b) = h(a) * BASE ** len(b) + h(b)``. A text of any
length therefore needs memory for one block of chunks only, and chunks may be hashed anywhere.

Equal fingerprints are only candidates. Candidates are compared chunk by chunk: every chunk of
every candidate goes to the row of its (fingerprint, chunk number), where the least and the
greatest chunk are kept, map side first, so a group of any size needs two chunks of memory.
Groups with a differing chunk are regrouped by their whole text.

Rows are never numbered in one plan and met again by that number in another, as a scan or a
shuffle may deal them differently the second time. They are met by their content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, share_broadcast, small_batches, text_bytes

#: Two primes below 2**31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 662608081)
#: Bytes of a chunk: 4096 products below 2**39 sum to less than 2**53, exact in a double.
CHUNK = 4096
#: Chunks that are hashed in one matrix product.
BLOCK = 256
#: Characters of a piece in the comparison of candidates.
PIECE = 262144


def _powers() -> np.ndarray:
    out = np.empty((CHUNK, 2))
    for f in range(2):
        x = 1
        for i in range(CHUNK - 1, -1, -1):
            out[i, f] = x
            x = x * BASES[f] % PRIMES[f]
    return out


POWERS = _powers()


def combine(left: tuple[int, int], right: tuple[int, int], right_len: int) -> tuple[int, int]:
    """Fingerprint of a concatenation from its parts' fingerprints."""
    return tuple((h * pow(b, right_len, p) + g) % p for h, g, b, p in zip(left, right, BASES, PRIMES, strict=True))


def fingerprint(data: memoryview | bytes) -> tuple[int, int]:
    """Polynomial fingerprint of bytes, block by block. Of no bytes: (0, 0)."""
    data = np.frombuffer(data, dtype=np.uint8)
    h: tuple[int, int] = (0, 0)
    whole = len(data) // CHUNK * CHUNK
    for start in range(0, whole, CHUNK * BLOCK):
        part = data[start : min(whole, start + CHUNK * BLOCK)].reshape(-1, CHUNK)
        for row in (part.astype(np.float64) @ POWERS).astype(np.int64):
            h = combine(h, (int(row[0]) % PRIMES[0], int(row[1]) % PRIMES[1]), CHUNK)
    if tail := len(data) - whole:
        row = (data[whole:].astype(np.float64) @ POWERS[CHUNK - tail :]).astype(np.int64)
        h = combine(h, (int(row[0]) % PRIMES[0], int(row[1]) % PRIMES[1]), tail)
    return h


def _fingerprints(batches: Iterator) -> Iterator:
    """Fingerprint, length and digest of ``text``, beside all other columns."""
    import pyarrow as pa

    for b in batches:
        view, at = text_bytes(b.column("text"))
        high, low, sha = [], [], []
        for i in range(len(at) - 1):
            data = view[at[i] : at[i + 1]]
            x, y = fingerprint(data)
            high.append(x)
            low.append(y)
            sha.append(hashlib.sha256(data).hexdigest())
        others = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in others), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(np.diff(at)), pa.array(sha, pa.string())],
            names=[*others, "h1", "h2", "n_bytes", "text_sha256"],
        )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when their characters are the same, without any change; a null text counts
    as the empty text. Of equal texts the row with the largest id stays; of rows that repeat
    both text and id one stays; a null id is below any other. An empty table gives no rows.
    Other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    kind = f"id {docs.schema[id_col].dataType.simpleString()}, tag long, h1 long, h2 long, n_bytes long, text_sha256 string"
    # the number tells rows of one id and text apart; it is fixed by the cut and used with these rows only
    prints = cut(rows.mapInArrow(_fingerprints, kind).withColumn("rid", F.monotonically_increasing_id()))
    key = ["h1", "h2", "n_bytes"]
    groups = _groups(prints, key)
    shared = cut(prints.join(groups.select(*key), key, "left_semi").select("tag", *key).distinct())
    differing = cut(_differing(rows, shared, key))
    found = prints.join(groups, key, "left")
    if not differing.isEmpty():  # fingerprints that different texts share: the text itself tells them apart
        whole = rows.withColumn("copy", F.col("text")).mapInArrow(_fingerprints, kind.replace("tag long", "tag long, copy string"))
        alike = whole.join(F.broadcast(differing) if differing.count() <= 100_000 else differing, key, "left_semi")
        alike = cut(alike.withColumn("rid", F.monotonically_increasing_id()))
        by_text = alike.groupBy(*key, "copy").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "rid")).alias("last"))
        of_text = alike.join(by_text, [*key, "copy"]).select(*found.columns)
        found = found.join(differing, key, "left_anti").unionByName(of_text)
    return found.select(
        "id",
        F.when(F.col("last").isNull(), F.col("id")).otherwise(F.col("last.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("last").isNull() | (F.col("last.rid") == F.col("rid"))).alias("kept"),
        "text_sha256",
    )


def _groups(rows: DataFrame, key: list[str]) -> DataFrame:
    """Groups of more than one row, cut so that a join's two sides are dealt apart and can be split; with a broadcast hint if they are few."""
    groups = cut(rows.groupBy(*key).agg(F.count("*").alias("group_size"), F.max(F.struct("id", "rid")).alias("last")).filter("group_size > 1"))
    return share_broadcast(groups, groups.count())


def _differing(rows: DataFrame, shared: DataFrame, key: list[str]) -> DataFrame:
    """Fingerprints whose candidate texts differ in a chunk.

    ``shared`` has the hash (tag) of each candidate text. Another text with the same hash is
    compared too, which can only call for the comparison of whole texts.
    """
    text = rows.join(share_broadcast(shared, shared.count()), "tag").select(*key, "text")
    pieces = text.select(*key, F.posexplode(F.transform(F.sequence(F.lit(0), F.expr(f"length(text) div {PIECE}")), lambda i: F.substring("text", i * PIECE + 1, F.lit(PIECE)))).alias("at", "piece"))
    return pieces.groupBy(*key, "at").agg(F.min("piece").alias("least"), F.max("piece").alias("most")).filter("least != most").select(*key).distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see :func:`exact_groups`.

    Of rows that repeat both text and id the one whose columns read least as JSON stays.
    """
    kept = exact_groups(docs, id_col, text_col).groupBy("id", "text_sha256").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).filter("kept")
    kept = cut(kept.drop("kept"))
    sha, i, n = fresh(docs, "sha", "i", "n")
    marked = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    met = lambda some: marked.join(some.toDF(i, f"{sha}_", n), F.col(id_col).eqNullSafe(F.col(i)) & (F.col(sha) == F.col(f"{sha}_")), "left_semi")
    once = met(kept.filter("n = 1")).drop(sha)
    again = kept.filter("n > 1")
    if again.isEmpty():
        return once
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = met(again).groupBy(id_col, sha).agg(F.min_by(row, F.to_json(row)).alias(n)).select(f"{n}.*")
    return once.unionByName(least)
