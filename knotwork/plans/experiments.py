"""Experiments from YAML files: ``python -m knotwork config.yaml N`` runs the N-th, from 1."""

from __future__ import annotations

import argparse
import logging
import time
import uuid

from pyspark.sql import SparkSession

from knotwork.operators.sample import Sampling
from knotwork.plans.discover import Options, Result, discover
from knotwork.plans.lattice import Pruning
from knotwork.plans.stats import Stats, stage_metrics
from knotwork.sources import results, tables

log = logging.getLogger("knotwork")


def options_of(config: dict) -> Options:
    """Options of one experiment; what is missing keeps its default."""
    show, fd, sampling = (config.get(k) or {} for k in ("representation", "fd", "sampling"))
    auto, pruning = sampling.get("auto") or {}, config.get("pruning") or {}
    on = lambda name: bool((pruning.get(name) or {}).get("enabled", True))
    if show.get("packing") and not show.get("encoding"):
        log.warning("packing needs encoding; rows stay raw")
    usual = Sampling()
    return Options(
        representation="raw" if not show.get("encoding") else "packed" if show.get("packing") else "encoded",
        fd=bool(fd.get("enabled", True)),
        superkey_threshold=fd.get("superkey_threshold", 0.80),
        sampling=Sampling(sampling.get("enabled", True), sampling.get("mode", usual.mode), sampling.get("largest_k", usual.largest_k), auto.get("coverage", usual.coverage), auto.get("min_k", usual.min_k), auto.get("max_k", usual.max_k), sampling.get("from_rows", usual.from_rows)),
        pruning=Pruning(on("fd_pruning"), on("superset_pruning"), on("discovered_mvd_pruning"), on("complement_pruning")),
        mode=config.get("mode", "reference"),
    )


def settings_of(spark: SparkSession, config: dict) -> dict:
    """What a run was asked to do and with what, for its row; known before anything is read."""
    o, settings = options_of(config), config.get("spark") or {}
    cores, workers = tables.total_cores(spark), tables.executors(spark)
    mode, n, shuffle = tables.partitions_of(settings.get("partitions") or {}, cores)
    return {
        "run_id": uuid.uuid4().hex[:12],
        "started": time.strftime("%Y-%m-%d %H:%M:%S"),
        "variant": config.get("ablation_variant", ""),
        "dataset": (config.get("input") or {}).get("path", ""),
        "asked_representation": o.representation,
        "mode": o.mode,
        "fd_enabled": o.fd,
        "superkey_threshold": o.superkey_threshold,
        "sampling_enabled": o.sampling.enabled,
        "sampling_mode": o.sampling.mode,
        "largest_k": o.sampling.largest_k,
        "sampling_coverage": o.sampling.coverage,
        "sampling_min_k": o.sampling.min_k,
        "sampling_max_k": o.sampling.max_k,
        "prune_fd": o.pruning.fd,
        "prune_superset": o.pruning.superset,
        "prune_discovered": o.pruning.discovered,
        "prune_complement": o.pruning.complement,
        "executors": workers,
        "cores_per_executor": max(1, cores // workers),
        "partition_mode": mode,
        "partitions": n,
        "shuffle_partitions": shuffle,
        "max_partition_mb": settings.get("max_partition_mb") or 0,
    }


def load(path: str, number: int) -> dict:
    import yaml

    with open(path) as f:
        found = (yaml.safe_load(f) or {}).get("experiments") or []
    if not 1 <= number <= len(found):
        raise SystemExit(f"{path} has experiments 1 to {len(found)}, not {number}")
    return found[number - 1]


def run(spark: SparkSession, config: dict) -> Result:
    """Run one experiment and append its row, also when it fails."""
    given, output, logs = config["input"], config.get("output") or {}, config.get("logging") or {}
    name, stats, asked = config.get("name", ""), Stats(), settings_of(spark, config)
    try:
        settings = config.get("spark") or {}
        _, n, shuffle = tables.partitions_of(settings.get("partitions") or {}, tables.total_cores(spark))
        tables.apply_confs(spark, shuffle, settings.get("max_partition_mb"))
        with stats.phase("read"):
            df, rows = tables.held(tables.read_csv(spark, given["path"], given.get("delimiter", ","), given.get("header", True), given.get("infer_schema", False)), n)
        log.info("%s: %d rows, %d columns", name, rows, len(df.columns))
        result = discover(df, options_of(config))
        result.stats.seconds |= {"read": stats.seconds["read"], "total": result.stats.seconds["total"] + stats.seconds["read"]}
        stats = result.stats
        stats.cached_mb = tables.cached_mb(spark)
        df.unpersist()
        if logs.get("print_spark_metrics"):
            stats.spark = stage_metrics(spark)
        if logs.get("print_mvds"):
            for x, y in result.mvd_list():
                log.info("%s ->> %s", ", ".join(x), ", ".join(y))
        if logs.get("print_stats"):
            for k, v in stats.row().items():
                log.info("%s: %s", k, v)
        if output.get("save_csv"):
            results.append(output["output_path"], results.run_row(name, stats, result.mvd_list(), settings=asked))
        return result
    except Exception as e:
        if output.get("save_csv"):
            results.append(output["output_path"], results.run_row(name, stats, error=e, settings=asked))
        raise


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="knotwork")
    parser.add_argument("config")
    parser.add_argument("number", type=int)
    given = parser.parse_args(args)
    config = load(given.config, given.number)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    spark = tables.session(config.get("name", "knotwork"))
    try:
        run(spark, config)
    finally:
        spark.stop()
