"""The attribute lattice: closures, candidates, pruning and minimality, without Spark.

An attribute set is a bit mask, bit i for column i. All of this concerns the schema only, not
rows, so it stays on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations
from math import comb

#: What becomes of a candidate.
COMPLEMENT, SUPERSET, SUPERKEY, BY_FD, CHECK = "SKIP_COMPLEMENT", "SKIP_SUPERSET", "AUTO_SK", "AUTO_FD", "VALIDATE"
HOLDS = (SUPERKEY, BY_FD)


def mask(attributes: Iterable[int]) -> int:
    return sum(1 << a for a in set(attributes))


def members(m: int) -> tuple[int, ...]:
    return tuple(i for i in range(m.bit_length()) if m >> i & 1)


def inside(a: int, b: int) -> bool:
    """Whether ``a`` is a subset of ``b``."""
    return a & ~b == 0


def first_of(m: int) -> int:
    """The lowest bit. Of disjoint sets of one size the smaller in order has the lower one."""
    return m & -m


def level_sets(n: int, level: int) -> list[int]:
    """Left sides of one level in order; levels go from 1 to n - 2."""
    return [mask(c) for c in combinations(range(n), level)]


def search_space(n: int) -> int:
    return sum(comb(n, k) for k in range(1, n - 1))


def proper_parts(m: int) -> Iterator[int]:
    """Non-empty proper subsets."""
    part = (m - 1) & m
    while part:
        yield part
        part = (part - 1) & m


class Closures:
    """What each left side determines, as far as it is known."""

    def __init__(self, n: int):
        self.all = (1 << n) - 1
        self.known: dict[int, int] = {}

    def of(self, lhs: int) -> int:
        return self.known.get(lhs, lhs)

    def superkey(self, lhs: int) -> bool:
        return self.of(lhs) == self.all

    def reset(self, sets: Iterable[int]) -> None:
        self.known.update((s, s) for s in sets)

    def inherit(self, sets: Iterable[int]) -> None:
        """A set determines what its parts with one attribute less do."""
        for s in sets:
            got = s
            for a in members(s):
                got |= self.known.get(s & ~(1 << a), 0)
            self.known[s] = got

    def expand(self, fds: Iterable[tuple[int, int]], sets: Iterable[int]) -> None:
        """Apply dependencies (left side, attribute) until nothing is added."""
        fds = list(fds)
        if not fds:
            return
        for s in sets:
            got, before = self.of(s), -1
            while got != before:
                before = got
                for lhs, a in fds:
                    if inside(lhs, got):
                        got |= 1 << a
            self.known[s] = got


def fd_candidates(sets: Iterable[int], closures: Closures) -> list[tuple[int, list[int]]]:
    """(left side, attributes worth testing): neither in it nor known to follow."""
    found = []
    for s in sets:
        rest = members(closures.all & ~(s | closures.of(s)))
        if rest:
            found.append((s, list(rest)))
    return found


@dataclass
class Pruning:
    """Which shortcuts may be taken."""

    fd: bool = True
    superset: bool = True
    discovered: bool = True
    complement: bool = True


def sides_found(mvds: Iterable[tuple[int, int]], everything: int) -> dict[int, list[int]]:
    """Left sides by each side (right or rest) of the dependencies found so far."""
    found: dict[int, list[int]] = {}
    for lhs, rhs in mvds:
        for side in {rhs, everything & ~(lhs | rhs)}:
            found.setdefault(side, []).append(lhs)
    return found


def candidates(sets: Iterable[int], closures: Closures, mvds: Iterable[tuple[int, int]], pruning: Pruning | None = None) -> Iterator[tuple[str, int, int, int]]:
    """(kind, left side, right side, rest) for each right side of at most half the other attributes.

    Mirror images go first, then what a smaller left side already gives, then what superkeys and
    closures give; the remainder needs the data. A superkey or closure never hides that a
    smaller left side gives the same.
    """
    pruning = pruning or Pruning()
    everything = closures.all
    seen = sides_found(mvds, everything) if pruning.superset and pruning.discovered else {}
    for lhs in sets:
        closure = closures.of(lhs)
        others = members(everything & ~lhs)
        for size in range(1, len(others) // 2 + 1):
            for chosen in combinations(others, size):
                rhs = mask(chosen)
                rest = everything & ~(lhs | rhs)
                if pruning.complement and 2 * size == len(others) and first_of(rhs) > first_of(rest):
                    kind = COMPLEMENT
                elif any(s != lhs and inside(s, lhs) for s in seen.get(rhs, ())):
                    kind = SUPERSET
                elif pruning.fd and closure == everything:
                    kind = SUPERKEY
                elif pruning.fd and (inside(rhs, closure) or inside(rest, closure)):
                    kind = BY_FD
                else:
                    kind = CHECK
                yield kind, lhs, rhs, rest


def canonical(lhs: int, rhs: int, everything: int) -> int:
    """The smaller of the right side and the rest; of one size, the earlier."""
    rest = everything & ~(lhs | rhs)
    return min((rhs, rest), key=lambda m: (m.bit_count(), first_of(m)))


@dataclass
class Minimal:
    mvds: list[tuple[int, int]] = field(default_factory=list)
    not_lhs_minimal: int = 0
    not_rhs_minimal: int = 0


def minimal(mvds: set[tuple[int, int]], everything: int, strict: bool = False) -> Minimal:
    """Non-trivial dependencies in canonical form that no smaller one replaces.

    By default a smaller left side counts only with the same canonical right side as recorded;
    ``strict`` also looks for the rest, as the two are one dependency.
    """
    by_rhs: dict[int, set[int]] = {}
    sides: dict[int, set[int]] = {}
    for lhs, rhs in mvds:
        by_rhs.setdefault(rhs, set()).add(lhs)
        sides.setdefault(lhs, set()).update((rhs, everything & ~(lhs | rhs)))
    out, done = Minimal(), set()
    for lhs, rhs in sorted(mvds):
        y = canonical(lhs, rhs, everything)
        if (lhs, y) in done or not y or inside(y, lhs) or not everything & ~(lhs | y):
            continue
        done.add((lhs, y))
        same = by_rhs.get(y, set())
        if any(part in same or strict and (y in sides.get(part, ()) or everything & ~(lhs | y) in sides.get(part, ())) for part in proper_parts(lhs)):
            out.not_lhs_minimal += 1
        elif any(part in sides[lhs] for part in proper_parts(y)):
            out.not_rhs_minimal += 1
        else:
            out.mvds.append((lhs, y))
    return out


def names_of(m: int, names: list[str]) -> tuple[str, ...]:
    return tuple(names[i] if i < len(names) else f"?{i}" for i in members(m))


def formatted(mvds: Iterable[tuple[int, int]], names: list[str]) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    return sorted((names_of(lhs, names), names_of(rhs, names)) for lhs, rhs in mvds)
