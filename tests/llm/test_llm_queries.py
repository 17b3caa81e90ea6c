import pytest

from knotwork.llm import queries as Q

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", Q.ORACLES)
def test_sql_form(same, name):
    same(Q.QUERIES[name], Q.ORACLES[name])


@pytest.mark.parametrize("name", [k for k in Q.QUERIES if k not in Q.ORACLES])
def test_one_row_each(spark, name):
    table = "pages" if name.startswith("op1_") else "documents"
    assert Q.QUERIES[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n = [docs.count()]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in C.STAGES:
        docs = stage(spark, docs, SMALL)
        rows = docs.collect()
        n.append(len(rows))
        docs = spark.createDataFrame(rows, docs.schema)
        if name == "exact_dedup":
            assert len(rows) == len({r["text"] for r in rows})
        if name != C.STAGES[-1][0]:
            assert docs.columns == C.COLUMNS and all(before[r["doc_id"]] == r["text"] for r in rows)
    assert n[1] <= n[0] and n[2] < n[1] and n[3] <= n[2] and n[5] == n[4]


def test_pipeline_without_rows(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
