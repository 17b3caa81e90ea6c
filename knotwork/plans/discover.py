"""Discovery, level by level: dependencies of one table from the lattice and the data."""

from __future__ import annotations

import logging
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import sample as S
from knotwork.operators import verdicts as V
from knotwork.operators.encode import COUNT, Relation, relation
from knotwork.plans import lattice as L
from knotwork.plans.stats import Stats

log = logging.getLogger("knotwork")
#: Columns beyond which the lattice (2 ** n left sides) is not walked unasked.
WIDEST = 16


@dataclass
class Options:
    """``mode="strict"`` drops what is the complement of a dependency of a smaller left side;
    the default keeps it. ``max_expand`` bounds the distinct counts of one query."""

    representation: str = "raw"
    fd: bool = True
    superkey_threshold: float = 0.80
    sampling: S.Sampling = field(default_factory=S.Sampling)
    pruning: L.Pruning = field(default_factory=L.Pruning)
    mode: str = "reference"
    max_expand: int = V.WIDTH
    batch: int = 16
    widest: int = WIDEST


class Result:
    """Dependencies as sets of names, and as DataFrames."""

    def __init__(self, spark: SparkSession, names: list[str], fds: set, mvds: list, candidates: list, stats: Stats):
        self.spark, self.names, self.stats = spark, names, stats
        self._fds, self._mvds, self._candidates = fds, mvds, candidates

    def fd_set(self) -> set[tuple[tuple[str, ...], str]]:
        return {(L.names_of(lhs, self.names), self.names[a]) for lhs, a in self._fds}

    def mvd_list(self) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
        return L.formatted(self._mvds, self.names)

    @property
    def fds(self) -> DataFrame:
        return self.spark.createDataFrame([(list(x), a) for x, a in sorted(self.fd_set())], "lhs array<string>, rhs string")

    @property
    def mvds(self) -> DataFrame:
        return self.spark.createDataFrame([(list(x), list(y)) for x, y in self.mvd_list()], "lhs array<string>, rhs array<string>")

    @property
    def candidates(self) -> DataFrame:
        """Every candidate, why it was accepted or rejected, and whether it holds (null: not decided)."""
        rows = [(kind, *(list(L.names_of(m, self.names)) for m in (x, y, z)), how, holds) for kind, x, y, z, how, holds in self._candidates]
        return self.spark.createDataFrame(rows, "kind string, lhs array<string>, rhs array<string>, z array<string>, decided_by string, holds boolean")


def discover(df: DataFrame, options: Options | None = None, counts: str | None = None) -> Result:
    """Functional dependencies, and minimal non-trivial multivalued dependencies, of ``df``.

    Left sides have 1 to n - 2 attributes, so a table of two columns or fewer has none. Null is
    a value, rows are a set. An empty table has no functional dependency and every multivalued.
    ``counts`` names a column that says how many rows a row stands for: what a join would make can
    so be given with both sides grouped first.
    """
    options = options or Options()
    names = [c for c in df.columns if c != counts]
    n = len(names)
    if n > options.widest:
        raise ValueError(f"{n} columns make {2**n} attribute sets; choose fewer or raise Options.widest")
    stats = Stats(columns=n, search_space=L.search_space(n))
    with stats.phase("total"):
        if n <= 2:
            return Result(df.sparkSession, names, set(), [], [], stats)
        with stats.phase("encode"):
            rel = relation(df, options.representation, counts)
            sums = rel.df.agg(F.count("*").alias("d"), F.coalesce(F.sum(COUNT), F.lit(0)).alias("r")).first()
            stats.rows, stats.distinct_rows, stats.representation = sums["r"], sums["d"], rel.representation
            if rel.cardinality:
                stats.max_cardinality, stats.average_cardinality = max(rel.cardinality), sum(rel.cardinality) / n
            if rel.representation == "packed":
                stats.bits_per_column, stats.packed_bits = rel.bits, rel.bits * n
        try:
            return _levels(df.sparkSession, rel, options, stats)
        finally:
            rel.close()


def _levels(spark: SparkSession, rel: Relation, options: Options, stats: Stats) -> Result:
    n, everything = rel.n, (1 << rel.n) - 1
    closures, counts = L.Closures(n), {everything: stats.distinct_rows} if stats.distinct_rows else {}
    fds: set[tuple[int, int]] = set()
    found: set[tuple[int, int]] = set()
    told: list = []
    before: list[int] = []
    for level in range(1, n - 1):
        sets = L.level_sets(n, level)
        so_far = [s for k in range(1, level + 1) for s in L.level_sets(n, k)]
        stats.levels, stats.left_sides = level, stats.left_sides + len(sets)
        if level > 1:
            closures.inherit(sets)
        if not options.fd:
            closures.reset(sets)
        elif level == 1 or sum(map(closures.superkey, before)) / len(before) < options.superkey_threshold:
            wanted = L.fd_candidates(sets, closures)
            asked = len(counts)
            with stats.phase("fd"):
                new = V.level_fds(rel, wanted, counts, options.max_expand) - fds
            with stats.phase("closure"):
                closures.expand(new, so_far)
            fds |= new
            stats.fd_levels_run += 1
            stats.fd_queries += -(-(len(counts) - asked) // options.max_expand)
            stats.fd_candidates += sum(len(r) for _, r in wanted)
        else:
            stats.fd_levels_skipped += 1
            log.info("level %d: FD discovery skipped, most smaller left sides are superkeys", level)
        stats.superkeys += sum(map(closures.superkey, sets))
        with stats.phase("candidates"):
            level_candidates = list(L.candidates(sets, closures, found, options.pruning))
        kinds = Counter(c[0] for c in level_candidates)
        stats.generated += len(level_candidates)
        stats.skipped_complement += kinds[L.COMPLEMENT]
        stats.skipped_superset += kinds[L.SUPERSET]
        stats.auto_superkey += kinds[L.SUPERKEY]
        stats.auto_fd += kinds[L.BY_FD]
        auto = {(x, y) for kind, x, y, _ in level_candidates if kind in L.HOLDS}
        checks = [(x, y, z) for kind, x, y, z in level_candidates if kind == L.CHECK]
        verdicts = _validate(rel, checks, counts, options, stats)
        for kind, x, y, z in level_candidates:
            how, holds = verdicts.get((x, y), ("lattice", True if kind in L.HOLDS else None))
            told.append((kind, x, y, z, how, holds))
        valid = {xy for xy, (_, holds) in verdicts.items() if holds}
        log.info("level %d: %d FDs so far, %d MVDs by the lattice, %d by the data", level, len(fds), len(auto), len(valid))
        found |= auto | valid
        before = sets
    with stats.phase("cleanup"):
        least = L.minimal(found, everything, options.mode == "strict")
    stats.fds, stats.found_mvds, stats.minimal_mvds = len(fds), len(found), len(least.mvds)
    stats.not_lhs_minimal, stats.not_rhs_minimal = least.not_lhs_minimal, least.not_rhs_minimal
    if least.mvds:
        lefts, rights = ([m.bit_count() for m in side] for side in zip(*least.mvds, strict=True))
        stats.largest_left, stats.average_left, stats.average_right = max(lefts), sum(lefts) / len(lefts), sum(rights) / len(rights)
    return Result(spark, rel.names, fds, least.mvds, told, stats)


def _validate(rel: Relation, checks: list[tuple[int, int, int]], counts: dict[int, int], options: Options, stats: Stats) -> dict[tuple[int, int], tuple[str, bool]]:
    """(lhs, y) -> (sample or full, holds)."""
    by_lhs: dict[int, list[tuple[int, int]]] = {}
    for x, y, z in checks:
        by_lhs.setdefault(x, []).append((y, z))
    verdicts: dict[tuple[int, int], tuple[str, bool]] = {}
    if options.sampling.enabled and stats.distinct_rows >= options.sampling.from_rows and by_lhs:
        stats.sent_to_sample += len(checks)
        with stats.phase("sampling"):
            groups = {x: S.sampled_groups(rel, x, options.sampling, stats.rows).persist() for x in by_lhs}
            sizes = [g.agg(F.count("*").alias("n"), F.sum("size").alias("rows"), F.min("size").alias("least"), F.max("size").alias("most")) for g in groups.values()]
            for i in range(0, len(sizes), options.batch):
                for size in reduce(DataFrame.unionByName, sizes[i : i + options.batch]).collect():
                    stats.sampled_groups += size["n"]
                    stats.sampled_rows += size["rows"] or 0
                    stats.largest_group = max(stats.largest_group, size["most"] or 0)
                    stats.smallest_group = min(stats.smallest_group or size["least"] or 0, size["least"] or 0)
            counts.update(V.distinct_counts(rel, [x for x in by_lhs if x not in counts], options.max_expand))
            stats.sampled_left_sides += len(by_lhs)
            stats.all_groups += sum(counts.get(x, 0) for x in by_lhs)
            stats.sample_queries += len(sizes)
        with stats.phase("sample_pass"):
            queries = [q for x, pairs in by_lhs.items() for q in V.mvd_verdicts(rel, x, pairs, S.rows_of(rel, x, groups[x]), options.max_expand)]
            stats.sample_queries += len(queries)
            failed = {xy for xy, holds in V.collect_verdicts(queries, options.batch).items() if not holds}
        for g in groups.values():
            g.unpersist()
        stats.rejected_by_sample += len(failed)
        verdicts |= {xy: ("sample", False) for xy in failed}
    with stats.phase("full_pass"):
        left = {x: [(y, z) for y, z in pairs if (x, y) not in verdicts] for x, pairs in by_lhs.items()}
        queries = [q for x, pairs in left.items() if pairs for q in V.mvd_verdicts(rel, x, pairs, None, options.max_expand)]
        stats.full_queries += len(queries)
        full = V.collect_verdicts(queries, options.batch)
    stats.sent_to_full += len(full)
    stats.valid_by_full += sum(full.values())
    stats.rejected_by_full += len(full) - sum(full.values())
    return verdicts | {xy: ("full", holds) for xy, holds in full.items()}
