import pytest
from relations import CASES, brute_fds, brute_mvds

from knotwork import Options, Pruning, Sampling, discover
from knotwork.operators import encode as E
from knotwork.operators import sample as S
from knotwork.operators.profile import choose_columns, column_profile, trim
from knotwork.plans.stats import Stats


def table(spark, columns, rows):
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} string" for c in columns))


@pytest.mark.parametrize("name", CASES)
def test_against_brute_force(spark, name):
    columns, rows = CASES[name]
    r = discover(table(spark, columns, rows))
    assert r.fd_set() == brute_fds(columns, rows)
    assert r.mvd_list() == brute_mvds(columns, rows)


def test_planted_dependencies():
    """What the relations were made to hold, so that the brute force itself is held against something."""
    assert {(("p",), ("z",)), (("c",), ("t",))} <= set(brute_mvds(*CASES["shop"]))
    assert (("l",), ("s",)) in brute_mvds(*CASES["station"]) and (("t",), "k") in brute_fds(*CASES["station"])
    assert {(("g",), ("m",)), (("g",), ("a", "f"))} <= set(brute_mvds(*CASES["camp"]))


@pytest.mark.parametrize(
    "options",
    [Options(representation="encoded"), Options(representation="packed"), Options(fd=False), Options(sampling=Sampling(enabled=False)), Options(sampling=Sampling(mode="manual", largest_k=1, from_rows=0)), Options(sampling=Sampling(from_rows=0)), Options(superkey_threshold=0.1), Options(pruning=Pruning(fd=False)), Options(pruning=Pruning(complement=False)), Options(max_expand=2, batch=2)],
    ids=range(10),
)
@pytest.mark.parametrize("name", ["shop", "drawn 4 4"])
def test_options_keep_the_answer(spark, name, options):
    assert discover(table(spark, *CASES[name]), options).mvd_list() == brute_mvds(*CASES[name])


@pytest.mark.parametrize("threshold", [0.0, 0.3, 2.0])
def test_levels_are_skipped(spark, threshold):
    for name in ("keys only", "drawn 4 4"):
        r = discover(table(spark, *CASES[name]), Options(superkey_threshold=threshold))
        assert r.fd_set() == brute_fds(*CASES[name], threshold) and r.mvd_list() == brute_mvds(*CASES[name])
        assert r.stats.fd_levels_run + r.stats.fd_levels_skipped == len(CASES[name][0]) - 2
    assert threshold or r.stats.fd_levels_skipped == 1


def test_strict_and_frames(spark):
    columns, rows = CASES["ladder"]
    usual = set(discover(table(spark, columns, rows)).mvd_list())
    r = discover(table(spark, columns, rows), Options(mode="strict", sampling=Sampling(from_rows=0)))
    assert r.mvd_list() == brute_mvds(columns, rows, strict=True) and set(r.mvd_list()) < usual
    assert r.mvds.count() == len(r.mvd_list()) and r.fds.columns == ["lhs", "rhs"]
    assert {"sample", "full", "lattice"} >= {x[0] for x in r.candidates.select("decided_by").distinct().collect()}
    s = r.stats
    assert s.generated == r.candidates.count() and s.sent_to_validation() == s.sent_to_sample and s.row()["minimal_mvds"] == len(r.mvd_list())


def test_sampling_statistics(spark):
    """Two values of one left side, of 6 and 3 rows; every left side is sampled whole."""
    rows = [("x", str(i), str(i % 2)) for i in range(6)] + [("y", str(i), "0") for i in range(3)]
    s = discover(table(spark, "abc", rows), Options(fd=False, sampling=Sampling(mode="manual", largest_k=100))).stats
    assert (s.sampled_left_sides, s.all_groups, s.sampled_groups, s.sampled_rows) == (3, 2 + 6 + 2, 10, 27)
    assert (s.smallest_group, s.largest_group, s.average_of_all_groups()) == (1, 6, 2.7)


def test_empty_table(spark):
    r = discover(table(spark, "abc", []))
    assert r.fd_set() == set() and r.mvd_list() == brute_mvds("abc", [])


def test_refusals(spark):
    with pytest.raises(ValueError, match="attribute sets"):
        discover(table(spark, [f"c{i}" for i in range(17)], []))
    with pytest.raises(ValueError, match="representation"):
        E.relation(table(spark, "abc", []), "other")


def test_dictionary_and_packing(spark):
    ids = E.dictionary(table(spark, *CASES["nulls"])).collect()
    got = {(r["column"], None if r["is_null"] else r["value"]): r["id"] for r in ids}
    assert got == {(0, "m"): 1, (0, "n"): 2, (1, "q"): 1, (1, "w"): 2, (2, "8"): 1, (2, "9"): 2, (2, None): 3}
    rel = E.relation(table(spark, "xy", [("a", "r"), ("b", "s"), ("b", "t")]), "packed")
    from knotwork.functions.bits import pack

    assert rel.bits == 2
    assert sorted(r[0] for r in rel.df.select(pack(rel.columns(3), 2)).collect()) == [0b0101, 0b1010, 0b1011]
    rel.close()
    wide = spark.createDataFrame([tuple(str(i * 50 + j) for j in range(13)) for i in range(40)], ", ".join(f"c{j} string" for j in range(13)))
    with pytest.warns(UserWarning, match="encoded"):
        assert E.relation(wide, "packed").representation == "encoded"
    known = E.dictionary(table(spark, "a", ["1", "2"]))
    assert sorted(r[0] for r in E.encode(table(spark, "a", ["1", "9"]), known).collect()) == [0, 1]


def test_samples(spark):
    rel = E.relation(table(spark, "ab", [("x", str(i)) for i in range(6)] + [("y", "1")] * 3 + [("z", "1")]))
    top = lambda how: [tuple(r) for r in S.sampled_groups(rel, 1, how).orderBy("c0").collect()]
    assert top(S.Sampling(mode="manual", largest_k=2)) == [("x", 6), ("y", 3)]
    assert top(S.Sampling(coverage=0.5, min_k=1)) == [("x", 6)]
    assert top(S.Sampling(coverage=0.7, min_k=1)) == [("x", 6), ("y", 3)]
    assert len(top(S.Sampling(coverage=9.0))) == 3 and len(top(S.Sampling(coverage=0.1, min_k=9, max_k=2))) == 2


def test_profile(spark):
    df = spark.createDataFrame([(i, "k", None if i % 2 else "v", i % 3) for i in range(20)], "i int, k string, v string, m int")
    p = {r["column"]: r for r in column_profile(df).collect()}
    assert (p["v"]["n_distinct"], p["v"]["n_null"], p["v"]["null_pct"], p["v"]["max_group"]) == (1, 10, 50.0, 10)
    assert p["i"]["unique_pct"] == 100.0 and p["m"]["skew"] == pytest.approx(7 / (20 / 3))
    assert choose_columns(df, 2)[0] == "i" and "k" not in choose_columns(df, 4)
    assert trim(df, 3).columns == ["c0", "c1", "c2", "c3"] and trim(df, 3, "sample").count() == 3
    assert column_profile(df.limit(0)).count() == 0


def test_stats_defaults():
    assert Stats().efficiency() == 0 and Stats().average_group() == 0


@pytest.mark.parametrize("representation", ["raw", "encoded", "packed"])
def test_counted_rows(spark, representation):
    """A table with counts is the table with its rows repeated, however its columns are placed."""
    columns, rows = CASES["shop"]
    repeated = [r for i, r in enumerate(rows) for _ in range(i % 3 + 1)]
    counted = table(spark, columns, repeated).groupBy(*columns).count().select("count", *columns)
    mine, plain = discover(counted, Options(representation=representation), "count"), discover(table(spark, columns, repeated), Options(representation=representation))
    assert mine.names == list(columns) and mine.mvd_list() == plain.mvd_list() and mine.fd_set() == plain.fd_set()
    for name in ("rows", "distinct_rows", "sampled_groups", "sampled_rows", "largest_group", "smallest_group", "all_groups"):
        assert getattr(mine.stats, name) == getattr(plain.stats, name), name


def test_joins_are_grouped_first(spark, tmp_path):
    """200,000 customers and 20,000 suppliers of two nations, with null keys and repeated rows: two thousand million rows if joined plainly."""
    from knotwork.plans import queries as Q

    small = str(tmp_path / "small")
    for folder, customers, suppliers in ((small, 60, 40), (str(tmp_path), 200_000, 20_000)):
        spark.range(customers).selectExpr("nullif(cast(id % 3 AS int), 2) AS c_nationkey", "concat('m', id % 4) AS c_mktsegment").write.parquet(f"{folder}/customer.parquet")
        spark.range(suppliers).selectExpr("nullif(cast(id % 3 AS int), 2) AS s_nationkey", "id % 20 AS s_suppkey").write.parquet(f"{folder}/supplier.parquet")
    plain = Q.load(spark, small, "flag").groupBy("n", "m", "s").count()
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, Q.load(spark, small, "flag", counted=True).collect()))
    stats = Q.discovered(spark, str(tmp_path), "flag", Options()).stats
    assert stats.distinct_rows == 2 * 4 * 20
    assert stats.rows == 66_667 * 6_667 + 66_667 * 6_667
