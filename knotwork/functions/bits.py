"""Fixed-width fields in one whole number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a long that fields may use.
ROOM = 63


def bits_for(cardinality: int) -> int:
    """Width of a field for ids 1 to ``cardinality`` (0 stands for unknown); 1 at least."""
    return max(1, cardinality.bit_length())


def largest_of(bits: int) -> int:
    return (1 << bits) - 1


def shifts(columns: list[int], n: int, bits: int) -> dict[int, int]:
    """How far each column's field is from the right; the first column is leftmost."""
    return {c: (n - 1 - c) * bits for c in columns}


def fits(n: int, bits: int) -> bool:
    return n * bits <= ROOM


def pack(ids: list[Column], bits: int) -> Column:
    """All ids in one long, first leftmost. Refuses what doesn't fit, as shifts would wrap."""
    if not fits(len(ids), bits):
        raise ValueError(f"{len(ids)} fields of {bits} bits don't fit into {ROOM}")
    at = shifts(list(range(len(ids))), len(ids), bits)
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(c.cast("long"), at[i]) for i, c in enumerate(ids)])


def unpack(packed: Column, column: int, n: int, bits: int) -> Column:
    return F.shiftright(packed, (n - 1 - column) * bits).bitwiseAND(F.lit(largest_of(bits)))
