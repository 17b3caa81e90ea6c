import csv

import pytest
import yaml
from relations import CASES, brute_mvds

from knotwork.plans import experiments as X
from knotwork.sources import results, tables


@pytest.fixture
def config(tmp_path):
    columns, rows = CASES["nulls"]
    data = tmp_path / "in.csv"
    with data.open("w", newline="") as f:
        csv.writer(f, delimiter=";").writerows([list(columns), *[["" if v is None else v for v in r] for r in rows]])
    one = {"name": "one", "input": {"path": str(data), "delimiter": ";"}, "representation": {"encoding": True, "packing": True}, "output": {"save_csv": True, "output_path": str(tmp_path / "out" / "r.csv")}, "logging": {"print_mvds": True, "print_stats": True, "print_spark_metrics": True}, "spark": {"partitions": {"mode": "manual", "num_partitions": 2, "shuffle_partitions": 4}}}
    path = tmp_path / "c.yaml"
    path.write_text(yaml.safe_dump({"experiments": [one, one | {"name": "bad", "input": {"path": str(tmp_path / "no.csv")}}]}))
    return str(path), tmp_path / "out" / "r.csv"


def test_experiment(spark, config):
    path, out = config
    assert X.run(spark, X.load(path, 1)).mvd_list() == brute_mvds(*CASES["nulls"])
    with pytest.raises(Exception, match="no.csv"):
        X.run(spark, X.load(path, 2))
    rows = list(csv.DictReader(out.open()))
    assert [r["status"] for r in rows] == ["ok", "error"] and len(rows[1]["error"]) <= 500 and rows[0]["minimal_mvds"] == str(len(brute_mvds(*CASES["nulls"])))
    ok = rows[0]
    assert len(ok) >= 99 and ok["asked_representation"] == "packed" and int(ok["packed_bits"]) == int(ok["bits_per_column"]) * int(ok["columns"]) and int(ok["partitions"]) == 2
    assert rows[0]["run_id"] != rows[1]["run_id"] and int(ok["fd_queries"]) > 0 and float(ok["average_left"]) <= int(ok["largest_left"])
    with pytest.raises(SystemExit):
        X.load(path, 3)


def test_other_header_is_kept_aside(tmp_path):
    path = str(tmp_path / "r.csv")
    for row in ({"a": 1}, {"a": 2}, {"b": 3}, {"a": 4}):
        results.append(path, row)
    old = sorted(p.name for p in tmp_path.iterdir())
    assert len(old) == 3 and sum(".legacy-" in p for p in old) == 2
    assert (tmp_path / "r.csv").read_text().split() == ["a", "4"]


def test_file_address(tmp_path, monkeypatch):
    results.append(f"file://{tmp_path}/a%20b.csv", {"a": 1})
    results.append(f"file://{tmp_path}/a%20b.csv", {"b": 1})
    monkeypatch.setenv("MVD_RESULTS_DIR", str(tmp_path / "in"))
    results.append("c.csv", {"a": 1})
    assert (tmp_path / "in" / "c.csv").exists() and (tmp_path / "a b.csv").read_text().split() == ["b", "1"]
    assert [p.suffix for p in tmp_path.glob("a b.legacy-*")] == [".csv"]


def test_tables(spark, tmp_path):
    assert tables.partitions_of({"mode": "auto", "auto": {"num_multiplier": 0.01}}, 4) == ("auto", 1, 8)
    assert tables.partitions_of({"mode": "manual", "num_partitions": 3, "shuffle_partitions": 5}, 4) == ("manual", 3, 5)
    df, n = tables.held(spark.range(10).toDF("a"), 2)
    assert n == 10 and tables.cached_mb(spark) > 0 and tables.total_cores(spark) == 4
    df.unpersist()
    assert tables.write_csv(spark.range(5).toDF("a"), str(tmp_path / "x.csv")) == 5
    assert tables.read(spark, str(tmp_path / "x.csv")).count() == 5
    spark.range(3).write.parquet(str(tmp_path / "x.parquet"))
    assert tables.read(spark, str(tmp_path / "x.parquet")).count() == 3
