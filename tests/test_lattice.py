from hypothesis import given
from hypothesis import strategies as st

from knotwork.functions.bits import bits_for, fits, largest_of, shifts
from knotwork.plans import lattice as L

A, B, C, D = 1, 2, 4, 8


def test_bits():
    assert [bits_for(c) for c in (0, 1, 3, 4, 5, 255)] == [1, 1, 2, 3, 3, 8]
    assert shifts([0, 1, 2], 3, 2) == {0: 4, 1: 2, 2: 0} and largest_of(3) == 7
    assert fits(9, 7) and not fits(8, 8)


def test_sets():
    assert L.members(L.mask([0, 3])) == (0, 3) and L.search_space(5) == 25
    assert L.level_sets(3, 1) == [1, 2, 4] and sorted(L.proper_parts(7)) == [1, 2, 3, 4, 5, 6]


def test_closure_expands():
    c = L.Closures(3)
    c.expand([(A, 1), (B, 0), (C, 0), (C, 1)], [A, B, C])
    assert [c.of(x) for x in (A, B, C)] == [A | B, A | B, 7] and [c.superkey(x) for x in (A, B, C)] == [False, False, True]
    c.expand([], [A])
    assert c.of(A) == A | B


def test_closure_inherits():
    c = L.Closures(4)
    c.expand([(B, 0), (B, 2), (C, 0), (C, 1), (D, 0)], [A, B, C, D])
    c.inherit([A | B, B | C, B | D])
    assert (c.of(A | B), c.of(B | C), c.of(B | D)) == (7, 7, 15)


def test_fd_candidates():
    c = L.Closures(3)
    c.expand([(B, 0), (C, 0)], [A, B, C])
    assert L.fd_candidates([A, B, C], c) == [(A, [1, 2]), (B, [2]), (C, [1])]
    c.expand([(B, 2)], [B])
    assert [x for x, _ in L.fd_candidates([A, B, C], c)] == [A, C]


def kinds(sets, closures, mvds=(), **pruning):
    return [(k, y) for k, _, y, _ in L.candidates(sets, closures, mvds, L.Pruning(**pruning))]


def test_candidates():
    c = L.Closures(4)
    assert list(L.candidates([A | B], c, ())) == [(L.CHECK, A | B, C, D), (L.COMPLEMENT, A | B, D, C)]
    assert kinds([A | B], c, [(A, C)]) == [(L.SUPERSET, C), (L.COMPLEMENT, D)]
    assert kinds([A | B], c, [(A, C)], superset=False) == kinds([A | B], c, [(A, C)], discovered=False) == [(L.CHECK, C), (L.COMPLEMENT, D)]
    assert kinds([A | B], c, complement=False) == [(L.CHECK, C), (L.CHECK, D)]
    assert kinds([A | B], c, [(A, B | D)]) == [(L.SUPERSET, C), (L.COMPLEMENT, D)]  # C is the rest of A >> BD
    c.known = {A: 15, B: B | C}
    assert kinds([A, B], c) == [(L.SUPERKEY, B), (L.SUPERKEY, C), (L.SUPERKEY, D), (L.CHECK, A), (L.BY_FD, C), (L.CHECK, D)]
    assert {k for k, _ in kinds([A, B], c, fd=False)} == {L.CHECK}


def test_minimal():
    assert L.minimal({(A, B), (A, C | D)}, 15).mvds == [(A, B)]
    assert L.canonical(A | B, D, 15) == C and L.minimal({(A | B, D)}, 15).mvds == [(A | B, C)]
    assert L.minimal({(A, C), (A | B, C)}, 15).not_lhs_minimal == 1
    assert L.minimal({(A, B), (A, B | C)}, 31).not_rhs_minimal == 1
    assert L.minimal({(A, A), (A, 14)}, 15).mvds == []
    q = {(A, D), (A | B, C)}
    assert sorted(L.minimal(q, 15).mvds) == [(A, D), (A | B, C)] and L.minimal(q, 15, strict=True).mvds == [(A, D)]


def test_union_survives_superset_pruning():
    """With A >> D and B >> C, AB >> C and AB >> D are pruned, so AB >> CD isn't seen to be a union."""
    e = 32 | 16
    found = {(A, D), (B, C), (A | B, C | D)}
    assert (A | B, C | D) in L.minimal(found, 15 | e).mvds


@given(st.sets(st.tuples(st.integers(1, 30), st.integers(0, 4)), max_size=8), st.integers(1, 30))
def test_closure_is_least_fixpoint(fds, start):
    c = L.Closures(5)
    c.expand(fds, [start])
    got = c.of(start)
    assert L.inside(start, got) and all(got >> a & 1 for x, a in fds if L.inside(x, got))
    step = start
    for _ in range(6):
        for x, a in fds:
            step |= 1 << a if L.inside(x, step) else 0
    assert got == step
