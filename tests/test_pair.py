import duckdb

from knotwork.plans import queries as Q


def test_pair_reads_all_orders(spark, tmp_path):
    """An order whose key 7 and 11 divide, alone with which all dependencies hold; others break them."""
    rows = [(77, "F", "1", 1, "1995-01-01")] + [(k, "FO"[k % 2], str(k % 3), k * k % 11, f"1995-01-{1 + k * k % 13:02}") for k in range(1, 70) if k % 7 and k % 11]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_orderpriority string, o_custkey long, o_orderdate string")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = sorted(map(tuple, Q.QUERIES["minimal_mvds_pair"](spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert found and found == sorted(c.execute(Q.ORACLES["minimal_mvds_pair"]).fetchall())
