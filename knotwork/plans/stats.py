"""What a run did: counters, phase times, and Spark's own stage metrics."""

from __future__ import annotations

import json
import time
import urllib.request
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field


@dataclass
class Stats:
    rows: int = 0
    distinct_rows: int = 0
    columns: int = 0
    representation: str = ""
    search_space: int = 0
    levels: int = 0
    left_sides: int = 0
    superkeys: int = 0
    fd_levels_run: int = 0
    fd_levels_skipped: int = 0
    fd_candidates: int = 0
    fds: int = 0
    generated: int = 0
    skipped_complement: int = 0
    skipped_superset: int = 0
    auto_superkey: int = 0
    auto_fd: int = 0
    sent_to_sample: int = 0
    rejected_by_sample: int = 0
    sent_to_full: int = 0
    rejected_by_full: int = 0
    valid_by_full: int = 0
    sampled_groups: int = 0
    sampled_rows: int = 0
    sampled_left_sides: int = 0
    all_groups: int = 0
    smallest_group: int = 0
    largest_group: int = 0
    fd_queries: int = 0
    sample_queries: int = 0
    full_queries: int = 0
    found_mvds: int = 0
    not_lhs_minimal: int = 0
    not_rhs_minimal: int = 0
    minimal_mvds: int = 0
    largest_left: int = 0
    average_left: float = 0.0
    average_right: float = 0.0
    max_cardinality: int = 0
    average_cardinality: float = 0.0
    bits_per_column: int = 0
    packed_bits: int = 0
    cached_mb: float = 0.0
    seconds: dict[str, float] = field(default_factory=dict)
    spark: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def phase(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def sent_to_validation(self) -> int:
        return self.generated - self.skipped_complement - self.skipped_superset - self.auto_superkey - self.auto_fd

    def average_group(self) -> float:
        return self.sampled_rows / self.sampled_groups if self.sampled_groups else 0.0

    def average_of_all_groups(self) -> float:
        """Rows in a group over all groups of the left sides that were sampled."""
        return self.rows * self.sampled_left_sides / self.all_groups if self.all_groups else 0.0

    def shares(self) -> dict[str, float]:
        """What became of the candidates, each as a percentage of those generated."""
        kinds = ("skipped_complement", "skipped_superset", "auto_superkey", "auto_fd", "rejected_by_sample")
        return {f"{k}_pct": round(100 * getattr(self, k) / self.generated, 2) if self.generated else 0.0 for k in kinds}

    def efficiency(self) -> float:
        """Share of fully checked candidates that hold."""
        return self.valid_by_full / self.sent_to_full if self.sent_to_full else 0.0

    def overall_efficiency(self) -> float:
        """The same over all candidates that aren't mirror images."""
        n = self.generated - self.skipped_complement
        return self.valid_by_full / n if n else 0.0

    def row(self) -> dict:
        """Flat: one value per column, times also as a share of the total."""
        flat = asdict(self)
        seconds, spark = flat.pop("seconds"), flat.pop("spark")
        total = seconds.get("total", 0.0)
        flat |= {"sent_to_validation": self.sent_to_validation(), "average_group": self.average_group(), "average_of_all_groups": self.average_of_all_groups(), "efficiency": self.efficiency(), "overall_efficiency": self.overall_efficiency()}
        for name in PHASES:
            flat[f"{name}_s"] = round(seconds.get(name, 0.0), 4)
            flat[f"{name}_pct"] = round(100 * seconds.get(name, 0.0) / total, 2) if total else 0.0
        other = max(0.0, total - sum(seconds.get(p, 0.0) for p in PHASES if p != "total"))
        flat |= self.shares() | {"other_s": round(other, 4), "other_pct": round(100 * other / total, 2) if total else 0.0}
        return flat | {f"spark_{k}": spark.get(k, 0) for k in (*STAGE_SUMS, "stages")}


PHASES = ("read", "encode", "fd", "closure", "candidates", "sampling", "sample_pass", "full_pass", "cleanup", "total")
STAGE_SUMS = ("numTasks", "numCompleteTasks", "numFailedTasks", "executorDeserializeTime", "resultSerializationTime", "executorRunTime", "executorCpuTime", "jvmGcTime", "inputBytes", "inputRecords", "outputBytes", "shuffleReadBytes", "shuffleReadRecords", "shuffleWriteBytes", "shuffleWriteRecords", "shuffleFetchWaitTime", "memoryBytesSpilled", "diskBytesSpilled", "peakExecutionMemory")


def stage_metrics(spark, timeout: float = 5.0) -> dict[str, float]:
    """Sums over all stages from the session's REST endpoint; empty if it can't be read.

    CPU time is in nanoseconds there and given in seconds here, run and GC time in milliseconds.
    """
    url = spark.sparkContext.uiWebUrl
    if not url:
        return {}
    try:
        with urllib.request.urlopen(f"{url}/api/v1/applications/{spark.sparkContext.applicationId}/stages", timeout=timeout) as answer:
            stages = json.load(answer)
    except (OSError, ValueError):
        return {}
    sums = {k: float(sum(s.get(k) or 0 for s in stages)) for k in STAGE_SUMS}
    sums["executorCpuTime"] /= 1e9
    return sums | {"stages": float(len(stages))}
