"""DuckDB forms of discovery for any number of columns, level by level over bit masks.

They follow the definitions: every verdict is an aggregate over the table, and the lattice's rules
are joins of the verdicts. Attribute sets are masks, bit i for column i.
"""

from __future__ import annotations

from knotwork.plans import lattice as L


class Forms:
    """SQL over one relation, given as SQL text with its column names."""

    def __init__(self, sql: str, columns: list[str]):
        self.sql, self.columns, self.n = sql, columns, len(columns)
        self.everything = (1 << self.n) - 1
        self.levels = range(1, self.n - 1)

    def of(self, m: int) -> str:
        return ",".join(L.names_of(m, self.columns))

    def name_table(self) -> str:
        rows = ", ".join(f"({m}, '{self.of(m)}')" for m in range(1, self.everything + 1))
        return f"names(mask, name) AS (VALUES {rows})"

    def fd_verdicts(self) -> str:
        """f(level, x, a, holds) for every left side and every attribute outside it."""
        one = "SELECT {k} AS level, {x} AS x, {a} AS a, coalesce(max(n) = 1, false) AS holds FROM (SELECT count(DISTINCT row({an})) AS n FROM t GROUP BY {xn})"
        pairs = [(k, x, 1 << a) for k in self.levels for x in L.level_sets(self.n, k) for a in range(self.n) if not x >> a & 1]
        return "f AS (" + " UNION ALL ".join(one.format(k=k, x=x, a=a, an=self.of(a), xn=self.of(x)) for k, x, a in pairs) + ")"

    def fd_levels(self, threshold: float) -> list[str]:
        """i2.. (what smaller left sides give), c1.. (what is known after a level), run (whether it ran)."""
        parts = ["run1 AS (SELECT true AS ran)", "i1 AS (SELECT x, a, false AS known FROM f WHERE level = 1)"]
        for k in self.levels:
            if k > 1:
                parts.append(f"run{k} AS (SELECT avg(CASE WHEN every THEN 1.0 ELSE 0.0 END) < {threshold} AS ran FROM (SELECT x, bool_and(known) AS every FROM c{k - 1} GROUP BY x))")
                parts.append(f"i{k} AS (SELECT f.x, f.a, EXISTS (SELECT 1 FROM c{k - 1} p WHERE p.known AND p.a = f.a AND (p.x & f.x) = p.x) AS known FROM f WHERE level = {k})")
            parts.append(f"c{k} AS (SELECT i.x, i.a, i.known AS before, i.known OR (r.ran AND f.holds) AS known, r.ran FROM i{k} i JOIN f ON f.x = i.x AND f.a = i.a, run{k} r)")
        union = " UNION ALL ".join(f"SELECT {k} AS level, * FROM c{k}" for k in self.levels)
        return [*parts, f"c AS ({union})"]

    def mvd_verdicts(self) -> list[str]:
        """m(level, lhs, rhs, z, holds) for each candidate but mirror images, and rec: those recorded."""
        one = "SELECT {k} AS level, {x} AS lhs, {y} AS rhs, {z} AS z, coalesce(bool_and(n_yz = n_y * n_z), true) AS holds FROM (SELECT count(DISTINCT row({yn})) AS n_y, count(DISTINCT row({zn})) AS n_z, count(DISTINCT row({yn},{zn})) AS n_yz FROM t GROUP BY {xn})"
        every = L.candidates([x for k in self.levels for x in L.level_sets(self.n, k)], L.Closures(self.n), ())
        free = [(x, y, z) for kind, x, y, z in every if kind == L.CHECK]
        parts = ["m AS (" + " UNION ALL ".join(one.format(k=x.bit_count(), x=x, y=y, z=z, xn=self.of(x), yn=self.of(y), zn=self.of(z)) for x, y, z in free) + ")"]
        for k in self.levels:
            smaller = " UNION ALL ".join(f"SELECT * FROM r{j}" for j in range(1, k))
            known = f" AND NOT EXISTS (SELECT 1 FROM ({smaller}) s WHERE (s.lhs & m.lhs) = s.lhs AND m.rhs IN (s.rhs, s.z))" if k > 1 else ""
            parts.append(f"r{k} AS (SELECT lhs, rhs, z FROM m WHERE level = {k} AND holds{known})")
        return [*parts, "rec AS (" + " UNION ALL ".join(f"SELECT * FROM r{k}" for k in self.levels) + ")"]

    def least(self, strict: bool = False) -> str:
        """least(lhs, rhs, not_lhs, not_rhs): recorded dependencies and whether a smaller one replaces them."""
        other = " OR m.rhs = s.z OR m.z IN (s.rhs, s.z)" if strict else ""
        return f"""least AS (SELECT lhs, rhs,
            EXISTS (SELECT 1 FROM rec s WHERE s.lhs <> m.lhs AND (s.lhs & m.lhs) = s.lhs AND (m.rhs = s.rhs{other})) AS not_lhs,
            EXISTS (SELECT 1 FROM rec s WHERE s.lhs = m.lhs AND ((s.rhs <> m.rhs AND (s.rhs & m.rhs) = s.rhs) OR (s.z <> m.rhs AND (s.z & m.rhs) = s.z))) AS not_rhs
            FROM rec m)"""

    def kinds(self) -> list[str]:
        """kinds(kind, lhs, rhs, holds) of all candidates when every level's dependencies are known."""
        n, everything = self.n, self.everything
        return [
            f"cl AS (SELECT x, x | coalesce(sum(a) FILTER (known), 0)::BIGINT AS closure FROM c GROUP BY x)",
            f"""cand AS (SELECT x.range AS lhs, y.range AS rhs, {everything} - x.range - y.range AS z FROM range(1, {everything}) x, range(1, {everything}) y
                WHERE bit_count(x.range) <= {n - 2} AND x.range & y.range = 0 AND bit_count(y.range) <= ({n} - bit_count(x.range)) // 2)""",
            """kinds AS (SELECT d.lhs, d.rhs, CASE
                WHEN bit_count(d.rhs) = bit_count(d.z) AND (d.rhs & -d.rhs) > (d.z & -d.z) THEN 'SKIP_COMPLEMENT'
                WHEN EXISTS (SELECT 1 FROM rec s WHERE s.lhs <> d.lhs AND (s.lhs & d.lhs) = s.lhs AND d.rhs IN (s.rhs, s.z)) THEN 'SKIP_SUPERSET'
                WHEN closure = %d THEN 'AUTO_SK' WHEN (d.rhs & closure) = d.rhs OR (d.z & closure) = d.z THEN 'AUTO_FD' ELSE 'VALIDATE' END AS kind, m.holds
                FROM cand d JOIN cl ON cl.x = d.lhs LEFT JOIN m ON m.lhs = d.lhs AND m.rhs = d.rhs)"""
            % everything,
        ]

    def query(self, *parts: str, select: str) -> str:
        return f"WITH t AS ({self.sql}), " + ", ".join(parts) + f" {select}"


def fds(forms: Forms, threshold: float) -> str:
    """Dependencies that discovery finds when it leaves out levels beyond a share of superkeys."""
    return forms.query(
        forms.name_table(), forms.fd_verdicts(), *forms.fd_levels(threshold), select="SELECT p.name AS lhs, q.name AS rhs FROM c JOIN names p ON p.mask = c.x JOIN names q ON q.mask = c.a WHERE c.known AND NOT c.before"
    )


def minimal(forms: Forms, strict: bool = False) -> str:
    return forms.query(
        forms.name_table(), *forms.mvd_verdicts(), forms.least(strict), select="SELECT p.name AS lhs, q.name AS rhs FROM least JOIN names p ON p.mask = lhs JOIN names q ON q.mask = rhs WHERE NOT not_lhs AND NOT not_rhs"
    )


def kinds(forms: Forms) -> str:
    return forms.query(
        forms.name_table(),
        forms.fd_verdicts(),
        *forms.fd_levels(2.0),
        *forms.mvd_verdicts(),
        *forms.kinds(),
        select="SELECT kind, p.name AS lhs, q.name AS rhs, CASE WHEN kind LIKE 'SKIP%' THEN NULL ELSE holds END AS holds FROM kinds JOIN names p ON p.mask = lhs JOIN names q ON q.mask = rhs",
    )


#: Counter -> SQL value, over the parts of ``kinds`` and ``least``.
COUNTERS = {
    "rows": "SELECT count(*) FROM t",
    "distinct_rows": "SELECT count(*) FROM (SELECT DISTINCT * FROM t)",
    "left_sides": "SELECT count(DISTINCT x) FROM c",
    "levels": "SELECT max(level) FROM c",
    "fd_levels_run": "SELECT count(DISTINCT level) FROM c WHERE ran",
    "fd_levels_skipped": "SELECT count(DISTINCT level) FROM c WHERE NOT ran",
    "fd_candidates": "SELECT count(*) FROM c WHERE NOT before",
    "fds": "SELECT count(*) FROM c WHERE known AND NOT before",
    "superkeys": "SELECT count(*) FROM (SELECT x FROM c GROUP BY x HAVING bool_and(known))",
    "generated": "SELECT count(*) FROM kinds",
    "skipped_complement": "SELECT count(*) FROM kinds WHERE kind = 'SKIP_COMPLEMENT'",
    "skipped_superset": "SELECT count(*) FROM kinds WHERE kind = 'SKIP_SUPERSET'",
    "auto_superkey": "SELECT count(*) FROM kinds WHERE kind = 'AUTO_SK'",
    "auto_fd": "SELECT count(*) FROM kinds WHERE kind = 'AUTO_FD'",
    "sent_to_full": "SELECT count(*) FROM kinds WHERE kind = 'VALIDATE'",
    "valid_by_full": "SELECT count(*) FROM kinds WHERE kind = 'VALIDATE' AND holds",
    "rejected_by_full": "SELECT count(*) FROM kinds WHERE kind = 'VALIDATE' AND NOT holds",
    "sent_to_sample": "SELECT 0",
    "rejected_by_sample": "SELECT 0",
    "found_mvds": "SELECT count(*) FROM rec",
    "not_lhs_minimal": "SELECT count(*) FROM least WHERE not_lhs",
    "not_rhs_minimal": "SELECT count(*) FROM least WHERE not_rhs AND NOT not_lhs",
    "minimal_mvds": "SELECT count(*) FROM least WHERE NOT not_lhs AND NOT not_rhs",
}


def counters(forms: Forms) -> str:
    rows = [f"SELECT '{k}' AS counter, ({v})::BIGINT AS value" for k, v in COUNTERS.items()]
    return forms.query(forms.fd_verdicts(), *forms.fd_levels(2.0), *forms.mvd_verdicts(), *forms.kinds(), forms.least(), select=" UNION ALL ".join(rows))
