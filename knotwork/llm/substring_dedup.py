"""Substring dedup by hashing lines, paragraphs or, by default, the clauses within lines.

A text is cut into units. A unit is normalised (ASCII lower case, runs of ASCII white space as
one space, none at its ends); units without a word are none. Digests are made of each two units
that follow each other, and of single units of ``min_words`` words or more, and are grouped over
all documents: of each, the document that ranks first keeps it, in all others it is repeated.
Units that repeated digests link make a run; runs of ``min_words`` words or more are removed, if
they can be part of a passage of ``passage`` words, and reported in offsets of the original text. So a stock phrase stays, and a passage
goes wherever in a line it starts, less the clause that it shares with other words.

A first aggregate counts the documents of half a digest each, in two columns of fixed width and
map side first; only digests that two documents share are compared whole. Digests are made again
for that, which takes less than to write them down. Digests meet by shuffles, both sides dealt
apart so that adaptive execution can split a passage that very many documents hold; documents
meet what they lose by a broadcast within a bound in bytes and by a shuffle beyond it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, share_broadcast, small_batches, text_bytes

#: Kind of unit -> what a unit is (group 1), and what is removed with it.
UNITS = {
    "clause": re.compile(rb"([^\n.!?,;:]+)[.!?,;:]*"),
    "line": re.compile(rb"([^\n]+)\n?"),
    "paragraph": re.compile(rb"((?:[^\n]|\n(?![\x20\x09\x0B-\x0D]*\n))+)(?:\n[\x20\x09-\x0D]*)?"),
}
#: Bytes of a broadcast table at most.
SHARED = 32 << 20


def units_of(data: bytes, unit: str) -> list[tuple[bytes, int, int, int]]:
    """(normalised unit, its number of words, start, end of what is removed with it) in order."""
    return [(b" ".join(w), len(w), m.start(), m.end()) for m in UNITS[unit].finditer(data) if (w := m[1].lower().split())]


def digests(data: bytes, unit: str, min_words: int) -> tuple[list[int], list[bytes]]:
    """Places and digests; place 2i is the link of units i - 1 and i, place 2i + 1 unit i alone."""
    at, found, before = [], [], None
    for i, words in enumerate(filter(None, map(bytes.split, (m[1] for m in UNITS[unit].finditer(data.lower()))))):
        plain = b" ".join(words)
        if before is not None:
            at.append(2 * i)
            found.append(hashlib.blake2b(before + b"\n" + plain, digest_size=16).digest())
        if len(words) >= min_words:
            at.append(2 * i + 1)
            found.append(hashlib.blake2b(plain, digest_size=16).digest())
        before = plain
    return at, found


def runs(data: bytes, unit: str, min_words: int, passage: int, repeated: set[int]) -> tuple[int, list[tuple[int, int]]]:
    """Number of units, and (start, end) in bytes of the runs that go.

    What is shared around a run ends within the units beside it, so a run that has fewer than
    ``passage`` words together with these is part of no passage of so many.
    """
    units, out, i = units_of(data, unit), [], 0
    while i < len(units):
        last = i
        while 2 * (last + 1) in repeated:
            last += 1
        size = sum(u[1] for u in units[i : last + 1])
        around = size + sum(u[1] for u in units[max(0, i - 1) : i] + units[last + 1 : last + 2])
        if (last > i or 2 * i + 1 in repeated) and size >= min_words and around >= passage:
            out.append((units[i][2], units[last][3]))
        i = last + 1
    return len(units), out


def _digests(unit: str, min_words: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            view, ends = text_bytes(b.column("text"))
            places, high, low = [], [], []
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                at, found = digests(bytes(view[s:e]), unit, min_words)
                halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                for out, x in zip((places, high, low), (np.array(at, np.int32), halves[:, 0], halves[:, 1]), strict=True):
                    out.append(x)
            columns = [pa.array(places, pa.list_(pa.int32())), pa.array(high, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), *columns], names=["id", "key", "at", "h", "l"])

    return run


def remove(find, n: str = "n_units"):
    """Takes from each text what ``find(text, gone)`` names: the number of units, (start, end) in bytes of what goes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            view, ends = text_bytes(b.column("text"))
            out = ([], [], [])
            for s, e, gone in zip(ends[:-1].tolist(), ends[1:].tolist(), b.column("gone").to_pylist(), strict=True):
                data = bytes(view[s:e])
                size, found = find(data, gone or ())
                spans, kept, at, chars = [], [], 0, 0
                for start, end in found:
                    kept.append(data[at:start].decode())
                    lost = len(data[start:end].decode())
                    chars += len(kept[-1])
                    spans.append({"start": chars, "end": chars + lost})
                    at, chars = end, chars + lost
                kept.append(data[at:].decode())
                for o, x in zip(out, (size, spans, "".join(kept)), strict=True):
                    o.append(x)
            columns = [b.column("id"), pa.array(out[0], pa.int32()), pa.array(out[1], span), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", n, "removed", "text"])

    return run


def repeated_units(docs: DataFrame, unit: str = "clause", min_words: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places (id, key, gone array<int>) of digests that a document which ranks before holds too."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    packed = rows.mapInArrow(_digests(unit, min_words), f"id {docs.schema[id_col].dataType.simpleString()}, key long, at array<int>, h array<long>, l array<long>")
    shared = cut(packed.select(F.explode(F.array_distinct("h")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    entries = packed.select("id", "key", F.explode(F.arrays_zip("at", "h", "l")).alias("x")).select("id", "key", "x.at", "x.h", "x.l")
    met = cut(entries.join(shared, "h"))
    first = cut(met.groupBy("h", "l").agg(F.min(F.struct("id", "key")).alias("first")))
    later = met.join(first, ["h", "l"]).filter(~F.struct("id", "key").eqNullSafe(F.col("first")))
    return later.groupBy("id", "key").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def drop_repeated_units(docs: DataFrame, unit: str = "clause", min_words: int = 40, id_col: str = "doc_id", text_col: str = "text", passage: int = 0) -> DataFrame:
    """One row per input row: (id, n_units, removed, text).

    ``removed`` has (start, end) of each removed run in characters of the original text, in
    order; ``text`` is what is left. Clauses end at ``. ! ? , ; :`` and line feeds, which count
    as no part of them; the marks (not the line feed) go with a removed clause, a line's feed and
    the blank lines behind a paragraph with these. What only one document repeats stays in it.

    A passage that starts and ends inside clauses shows as a run that is shorter by its first and
    last clause. To find passages of n words, give n as ``passage`` and fewer as ``min_words``: runs
    of ``min_words`` go, unless they have fewer than ``passage`` words with the unit before and the
    unit behind them, so that they can't belong to such a passage.

    Documents rank by id, null first, and of one id by a hash of the text; rows that repeat both
    are one document. A null text counts as empty and has no unit; a text of any length is
    searched whole; an empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    gone = cut(repeated_units(docs, unit, min_words, id_col, text_col).withColumnsRenamed({"id": "i", "key": "k"}))
    size = gone.agg(F.sum(F.size("gone") * 4 + 64)).first()[0] or 0
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    met = rows.join(share_broadcast(gone, size, SHARED), F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    find = lambda data, gone: runs(data, unit, min_words, passage, set(gone))
    return met.select("id", "text", "gone").mapInArrow(remove(find), f"id {docs.schema[id_col].dataType.simpleString()}, n_units int, removed array<struct<start:int,end:int>>, text string")
