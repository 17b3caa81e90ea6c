"""Substring dedup by windows of words: of equal windows all but the first go, wherever they start.

The units of ``substring_dedup`` can't find a passage that starts and ends inside one or two of
them, nor what a single document repeats. Here words are runs of characters other than ASCII white
space and ``. ! ? , ; :``, compared in ASCII lower case, and every window of ``words`` of them counts.

1. The least hash of the shingles of about half as many words that a window holds is its anchor.
   Equal windows have equal anchors. Windows in a row with one anchor make a run, of 13 windows on
   the average for windows of 51 words.
2. Runs are met by digests of 128 bits of all that their windows cover. Of each digest the document
   that ranks first keeps its windows, and all others lose theirs.
3. Runs that differ but have one anchor may hold equal windows, as at the ends of a passage. Of
   these, windows of the runs that step 2 left are met, by digests likewise.
4. What a document holds twice is found where the document is: a window that starts after an equal
   one has ended goes too. Windows that overlap an equal one stay, so a whole one is kept.

Hashes only choose what is compared; no equal window is left out and no other one goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, share_broadcast, small_batches, text_bytes
from .substring_dedup import SHARED, remove

MARKS = b".!?,;:"
#: Words as they are compared, one byte for one: marks and white space blank, ASCII lower case.
PLAIN = bytes.maketrans(MARKS + bytes(range(9, 14)) + bytes(range(65, 91)), b" " * (len(MARKS) + 5) + bytes(range(97, 123)))
#: An odd factor and its inverse modulo 2^64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse; callers round sizes up."""
    return tuple(np.cumprod(np.full(size, f, np.uint64)) for f in (FACTOR, INVERSE))


def rolling(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` numbers in a row, modulo 2^64."""
    up, down = powers(1 << len(x).bit_length())
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[: len(x)], out=sums[1:])
    return (sums[k:] - sums[:-k]) * down[: len(x) - k + 1]


def lowest(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each ``k`` numbers in a row."""
    size = 1
    while 2 * size <= k:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - k + size], x[k - size :])


class Windows:
    """The windows of a text of UTF-8 bytes, known by the place of their first word."""

    def __init__(self, data: bytes, words: int):
        self.data, self.words = data, words
        self.plain = data.translate(PLAIN)
        self.parts = self.plain.split()
        self.n = len(self.parts)

    @cached_property
    def hashes(self) -> np.ndarray:
        from xxhash import xxh64_intdigest

        return np.fromiter(map(xxh64_intdigest, self.parts), np.uint64, self.n)

    @cached_property
    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words with a blank between, and the start and end of each in that."""
        ends = np.cumsum(np.fromiter(map(len, self.parts), np.int64, self.n) + 1) - 1
        return b" ".join(self.parts), np.append(0, ends[:-1] + 1), ends

    def anchors(self) -> np.ndarray:
        """One number for each window."""
        if self.n < self.words:
            return np.empty(0, np.int64)
        k = (self.words + 1) // 2
        return lowest(rolling(self.hashes, k), self.words - k + 1).view(np.int64)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, last window, anchor) of each run of windows with one anchor."""
        anchors = self.anchors()
        lo = np.flatnonzero(np.diff(anchors) != 0) + 1
        lo = np.concatenate(([0], lo)) if len(anchors) else lo
        return lo, np.append(lo[1:], len(anchors))[: len(lo)] - 1, anchors[lo]

    def digests(self, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
        """Of the words that each of the windows from ``lo`` to ``hi`` cover."""
        if not len(lo):
            return []
        joined, starts, ends = self.joined
        spans = map(slice, starts[lo].tolist(), ends[hi + self.words - 1].tolist())
        return [hashlib.blake2b(x, digest_size=16).digest() for x in map(joined.__getitem__, spans)]

    def again(self) -> np.ndarray:
        """Windows that begin after an equal one has ended."""
        if self.n < 2 * self.words:
            return np.empty(0, np.int64)
        hashes = rolling(self.hashes, self.words)
        order = np.argsort(hashes, kind="stable")
        same = np.diff(hashes[order]) == 0
        at = np.sort(order[np.append(same, False) | np.insert(same, 0, False)])
        first: dict[bytes, int] = {}
        before = np.fromiter((first.setdefault(d, i) for d, i in zip(self.digests(at, at), at.tolist(), strict=True)), np.int64, len(at))
        return at[at - before >= self.words]

    def spans(self, at: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) in bytes of the text of what windows cover, with the marks right behind."""
        if not len(at):
            return []
        ink = np.frombuffer(self.plain, np.uint8) != 32
        edges = np.flatnonzero(np.diff(ink, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        gap = np.diff(at) > self.words
        out = []
        for lo, hi in zip(at[np.concatenate(([True], gap))].tolist(), at[np.concatenate((gap, [True]))].tolist(), strict=True):
            end = int(ends[hi + self.words - 1])
            while end < len(self.data) and self.data[end] in MARKS:
                end += 1
            out.append((int(starts[lo]), end))
        return out


def _texts(batch) -> Iterator[bytes]:
    view, ends = text_bytes(batch.column("text"))
    return (bytes(view[s:e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))


def _lists(parts: list[np.ndarray], kind):
    import pyarrow as pa

    return pa.array(parts, pa.list_(kind))


def _halves(found: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def _runs(words: int):
    """Each run as its first window times 2^32 plus its last, its anchor and the halves of its digest; and
    the runs of windows that the text itself holds before."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = ([], [], [], [], [])
            for data in _texts(b):
                w = Windows(data, words)
                lo, hi, anchors = w.runs()
                halves = _halves(w.digests(lo, hi))
                # equal windows without overlap are of two runs with one anchor, or of one long run
                own = w.again() if len(np.unique(anchors)) < len(lo) or (hi - lo >= words).any() else lo[:0]
                for o, x in zip(out, (lo << 32 | hi, anchors, halves[:, 0], halves[:, 1], stretches(own)), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), *(_lists(o, pa.int64()) for o in out)], names=["id", "key", "run", "a", "h", "l", "own"])

    return run


def stretches(at: np.ndarray) -> np.ndarray:
    """Windows in order as runs."""
    cuts = np.flatnonzero(np.diff(at) != 1)
    return at[np.append(0, cuts + 1)] << 32 | at[np.append(cuts, -1)] if len(at) else at


def spread(runs: np.ndarray, n: int) -> np.ndarray:
    """The windows, of ``n``, in any of the runs."""
    lo, hi = runs >> 32, runs & 0xFFFFFFFF
    return np.flatnonzero(np.cumsum(np.bincount(lo, minlength=n + 1) - np.bincount(hi + 1, minlength=n + 1)) > 0)


def _windows(words: int):
    """Windows of the runs asked for, as runs of one, and their digests, less those that go anyway."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = ([], [], [])
            for data, runs in zip(_texts(b), b.column("runs"), strict=True):
                w = Windows(data, words)
                at = np.setdiff1d(spread(runs.values.to_numpy(), w.n), w.again())
                halves = _halves(w.digests(at, at))
                for o, x in zip(out, (at << 32 | at, halves[:, 0], halves[:, 1]), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), *(_lists(o, pa.int64()) for o in out)], names=["id", "key", "run", "h", "l"])

    return run


def _find(words: int):
    def find(data: bytes, gone: list[int]) -> tuple[int, list[tuple[int, int]]]:
        w = Windows(data, words)
        return w.n, w.spans(spread(np.array(gone, np.int64), w.n)) if len(gone) else []

    return find


def _met(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Texts with the runs (id, key, runs array<long>) found for them, which are materialised first."""
    found = cut(found.withColumnsRenamed({"id": "i", "key": "k"}))
    size = found.agg(F.sum(F.size("runs") * 8 + 64)).first()[0] or 0
    return rows.join(share_broadcast(found, size, SHARED), F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), how).select("id", "key", "text", "runs")


WHO = ("id", "key")


def repeated_windows(rows: DataFrame, words: int) -> DataFrame:
    """(id, key, runs array<long>): runs of windows that a document which ranks before, or the document itself, holds
    before; ``rows`` are (id, key, text)."""
    kind, who = rows.schema["id"].dataType.simpleString(), F.struct(*WHO)
    packed = cut(rows.mapInArrow(_runs(words), f"id {kind}, key long, run array<long>, a array<long>, h array<long>, l array<long>, own array<long>").filter(F.size("run") > 0))
    shared = cut(packed.select(F.explode("a").alias("a")).groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"))
    held = packed.select(*WHO, F.explode(F.arrays_zip("run", "a", "h", "l")).alias("x")).select(*WHO, "x.run", "x.a", "x.h", "x.l")
    held = cut(held.join(shared, "a"))
    first = cut(held.groupBy("a", "h", "l").agg(F.min(who).alias("first")))
    ranked = cut(held.join(first.drop("a"), ["h", "l"]).select(*WHO, "run", "a", who.eqNullSafe(F.col("first")).alias("stays")))
    mixed = cut(first.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"))
    wanted = ranked.filter("stays").join(mixed, "a").groupBy(*WHO).agg(F.collect_list("run").alias("runs"))
    found = _met(rows, wanted, "inner").mapInArrow(_windows(words), f"id {kind}, key long, run array<long>, h array<long>, l array<long>")
    single = cut(found.select(*WHO, F.explode(F.arrays_zip("run", "h", "l")).alias("x")).select(*WHO, "x.run", "x.h", "x.l"))
    both = single.groupBy("h", "l").agg(F.min(who).alias("first"), F.max(who).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last")))
    later = single.join(cut(both.drop("last")), ["h", "l"]).filter(~who.eqNullSafe(F.col("first")))
    gone = ranked.filter("not stays").select(*WHO, "run").unionByName(later.select(*WHO, "run")).unionByName(packed.select(*WHO, F.explode("own").alias("run")))
    return gone.groupBy(*WHO).agg(F.collect_list("run").alias("runs"))


def drop_repeated_windows(docs: DataFrame, words: int = 51, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_words, removed, text).

    Removed is what windows of ``words`` words cover that a document which ranks before holds too, or
    that the document itself holds before without overlap. ``removed`` has (start, end) of each run in
    characters of the original text, in order; ``text`` is what is left. Marks right behind a run
    go with it.

    Documents rank by id, null first, and of one id by a hash of the text; rows that repeat both
    are one document. A null text counts as empty; a text of any length is searched whole; an
    empty table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    met = _met(rows, repeated_windows(rows, words), "left").withColumnRenamed("runs", "gone")
    return met.mapInArrow(remove(_find(words), "n_words"), f"id {docs.schema[id_col].dataType.simpleString()}, n_words int, removed array<struct<start:int,end:int>>, text string")
