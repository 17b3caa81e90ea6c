"""Small relations with planted dependencies, and their truth by brute force from the definitions."""

import random
from itertools import chain, combinations, product


def joined(left, right):
    """Natural join of two lists of rows on their first value: the rest of each is independent."""
    return [(*a, *b[1:]) for a in left for b in right if a[0] == b[0]]


def drawn(seed, n, rows, values):
    r = random.Random(seed)
    return [tuple(f"v{r.randrange(values)}" for _ in range(n)) for _ in range(rows)]


def shop():
    """Sizes and colours of a product are independent; a shelf belongs to one product, a colour to a tint."""
    sizes = [("mug", "small"), ("mug", "large"), ("cap", "large"), ("cap", "one")]
    colours = [("mug", "red", "warm"), ("mug", "blue", "cold"), ("cap", "red", "warm")]
    return joined(sizes, colours)


def ladder():
    """p and s are independent of the rest, q doesn't determine r: a larger left side gives the mirror image."""
    rows = [("p1", q, r, s) for (q, r), s in product([("a", "x"), ("b", "y"), ("b", "z")], ["1", "2", "3"])]
    return [*rows, ("p2", "a", "y", "1")]


def station():
    """Five columns: given the line, stops and (train, driver, kind) are independent; a train has one kind."""
    stops = [("L1", "north"), ("L1", "south"), ("L2", "north"), ("L2", "east"), ("L2", "west")]
    trains = [("L1", "t1", "ann", "fast"), ("L1", "t2", "bo", "slow"), ("L2", "t3", "ann", "slow"), ("L2", "t3", "cy", "slow")]
    return joined(stops, trains)


def camp():
    """Six columns: three independent facts of a group, one of two columns."""
    meals = [("g1", "rice"), ("g1", "soup"), ("g2", "soup")]
    games = [("g1", "chess", "indoor"), ("g1", "ball", "field"), ("g2", "ball", "field"), ("g2", "ball", "yard")]
    tents = [("g1", "t1", "east"), ("g2", "t2", "east"), ("g2", "t3", "west")]
    return joined(joined(meals, games), tents)


CASES = {
    "shop": ("pzct", shop()),
    "repeated rows": ("pzct", [*shop(), shop()[2], shop()[2]]),
    "a value is missing": ("pzct", [tuple(None if x == "cold" else x for x in row) for row in shop()[:-1]]),
    "nulls": ("kuv", [("m", "q", None), ("m", "q", "8"), ("n", "w", "9")]),
    "ladder": ("pqrs", ladder()),
    "station": ("lstdk", station()),
    "camp": ("gmaftw", camp()),
    "one row": ("xyz", [("a", "b", "c")]),
    "one column": ("x", [("a",), ("b",)]),
    "two columns": ("xy", [("a", "b"), ("a", "c")]),
    "all rows the same": ("xyz", [("a", "b", "c")] * 4),
    "keys only": ("xyz", [(f"a{i}", f"b{i}", f"c{i}") for i in range(5)]),
    "constant": ("xyz", [("same", f"b{i % 3}", f"c{i}") for i in range(6)]),
    **{f"drawn {n} {seed}": ("abcdef"[:n], drawn(seed, n, rows, values)) for n, seed, rows, values in ((3, 1, 6, 2), (3, 2, 9, 3), (4, 3, 10, 2), (4, 4, 14, 3), (5, 5, 20, 2), (6, 6, 24, 2))},
}


def subsets(items, sizes):
    return (frozenset(c) for k in sizes for c in combinations(sorted(items), k))


def value(rows, columns, row, wanted):
    return tuple(row[columns.index(c)] for c in sorted(wanted))


def determines(columns, rows, x, a):
    return all(value(rows, columns, p, a) == value(rows, columns, q, a) for p in rows for q in rows if value(rows, columns, p, x) == value(rows, columns, q, x))


def independent(columns, rows, x, y):
    """Within each group of x all combinations of its values of y and of the rest occur."""
    z = set(columns) - x - y
    have = {tuple(value(rows, columns, r, s) for s in (x, y, z)) for r in rows}
    return all((g, b, d) in have for g, b, _ in have for h, _, d in have if g == h)


def brute_fds(columns, rows, threshold=0.8):
    """FDs level by level, without those that closures of smaller left sides give; a level is left
    out if of the left sides before it a share of ``threshold`` are superkeys."""
    found, before = set(), []

    def closure(x, known):
        got = set(x)
        while more := {a for y, a in known if y <= got} - got:
            got |= more
        return got

    for level in range(1, len(columns) - 1):
        sides = list(subsets(columns, [level]))
        if level > 1 and sum(closure(x, found) == set(columns) for x in before) / len(before) >= threshold:
            before = sides
            continue
        known = {(y, a) for y, a in found if len(y) < level}
        found |= {(x, a) for x in sides for a in set(columns) - closure(x, known) if determines(columns, rows, x, {a})}
        before = sides
    return {(tuple(sorted(x, key=columns.index)), a) for x, a in found}


def brute_mvds(columns, rows, strict=False):
    """Minimal dependencies. What a smaller left side gives for one of the two sides isn't recorded;
    of the recorded, those stay that neither a smaller left side nor a smaller right side replaces."""
    everything, at = frozenset(columns), columns.index
    place = lambda s: (len(s), sorted(map(at, s)))
    recorded = set()
    for level in range(1, len(columns) - 1):
        new = set()
        for x in subsets(columns, [level]):
            for y in subsets(everything - x, range(1, (len(columns) - level) // 2 + 1)):
                z = everything - x - y
                if len(y) == len(z) and place(y) > place(z) or any(s < x and y in (b, everything - s - b) for s, b in recorded):
                    continue
                if independent(columns, rows, x, y):
                    new.add((x, y))
        recorded |= new
    out = []
    for x, y in recorded:
        z = everything - x - y
        smaller = [(s, b) for s, b in recorded if s < x]
        sides = set(chain.from_iterable((b, everything - x - b) for s, b in recorded if s == x))
        by_left = any(b == y or strict and {y, z} & {b, everything - s - b} for s, b in smaller)
        if not by_left and not any(b < y for b in sides):
            out.append((tuple(sorted(x, key=at)), tuple(sorted(y, key=at))))
    return sorted(out)
