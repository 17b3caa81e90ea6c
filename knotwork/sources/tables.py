"""Sessions, scans and what goes with them."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def session(name: str = "knotwork", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, infer_schema: bool = False, skip_bad_lines: bool = False) -> DataFrame:
    """CSV as text columns unless types are inferred; an empty field is null."""
    return spark.read.csv(path, sep=delimiter, header=header, inferSchema=infer_schema, mode="DROPMALFORMED" if skip_bad_lines else "PERMISSIVE")


def read(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """A table by its kind, or by the ending of its path: csv, parquet, orc or json."""
    kind = kind or path.rstrip("/").rpartition(".")[2]
    return read_csv(spark, path, **options) if kind == "csv" else spark.read.format(kind).load(path, **options)


def held(df: DataFrame, partitions: int | None = None) -> tuple[DataFrame, int]:
    """The table persisted, in so many partitions if asked for, and its row count."""
    df = (df.repartition(partitions) if partitions else df).persist(StorageLevel.MEMORY_AND_DISK)
    return df, df.count()


def total_cores(spark: SparkSession) -> int:
    sc = spark.sparkContext
    return int(sc.getConf().get("spark.cores.max", "0")) or sc.defaultParallelism


def executors(spark: SparkSession) -> int:
    """Executors that are registered now; a local session's driver counts as one."""
    return max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)


def partitions_of(settings: dict, cores: int) -> tuple[str, int, int]:
    """(mode, partitions, shuffle partitions): given, or multiples of the cores, 1 at least."""
    mode = settings.get("mode", "auto")
    if mode == "manual":
        return mode, int(settings["num_partitions"]), int(settings["shuffle_partitions"])
    auto = settings.get("auto", {})
    return mode, max(1, round(auto.get("num_multiplier", 2) * cores)), max(1, round(auto.get("shuffle_multiplier", 2) * cores))


def apply_confs(spark: SparkSession, shuffle_partitions: int | None = None, max_partition_mb: int | None = None) -> None:
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if max_partition_mb:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(max_partition_mb << 20))


def cached_mb(spark: SparkSession) -> float:
    """Memory and disk of everything the session holds persisted."""
    infos = spark.sparkContext._jsc.sc().getRDDStorageInfo()
    return sum(i.memSize() + i.diskSize() for i in infos) / (1 << 20)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", check: bool = True) -> int:
    """Write, and read again to compare the row count; the count. Overwrites."""
    df.write.csv(path, sep=delimiter, header=True, mode="overwrite")
    n = df.sparkSession.read.csv(path, sep=delimiter, header=True).count() if check else df.count()
    if check and n != df.count():
        raise ValueError(f"{path} reads back with {n} rows")
    return n
