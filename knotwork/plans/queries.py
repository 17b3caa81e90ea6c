"""Registered queries over the test tables, each with its DuckDB form.

Projections are SQL texts that both engines read; ``{table}`` stands for a table.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import encode as E
from knotwork.operators import sample as S
from knotwork.operators import verdicts as V
from knotwork.operators.profile import choose_columns, column_profile
from knotwork.plans import lattice as L
from knotwork.plans import lattice_sql as Q
from knotwork.plans.discover import Options, Result, discover

#: name -> (columns, SQL)
RELATIONS = {
    "flag": ("n m s", "SELECT c_nationkey AS n, c_mktsegment AS m, s_suppkey AS s FROM {customer} JOIN {supplier} ON c_nationkey = s_nationkey"),
    "lineflags": ("f t k", "SELECT l_returnflag AS f, l_linestatus AS t, l_linenumber AS k FROM {lineitem}"),
    "nation": ("k n r", "SELECT n_nationkey AS k, n_name AS n, n_regionkey AS r FROM {nation}"),
    "geo": ("r n m", "SELECT n_regionkey AS r, n_nationkey AS n, c_mktsegment AS m FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"),
    "geo4": ("a b c d", "SELECT r_name AS a, n_name AS b, n_regionkey AS c, c_mktsegment AS d FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"),
    "supplier": ("k n c b", "SELECT s_suppkey AS k, s_name AS n, s_nationkey AS c, s_acctbal AS b FROM {supplier}"),
    "fd2": ("ok ln h rf", "SELECT l_orderkey % 50 AS ok, l_linenumber AS ln, (l_orderkey % 50 * 3 + l_linenumber * 5) % 4 AS h, l_returnflag AS rf FROM {lineitem}"),
    "nulls": ("a b c", "SELECT c_nationkey AS a, nullif(c_mktsegment, 'BUILDING') AS b, nullif(c_nationkey % 5, 0) AS c FROM {customer}"),
    "pair": (
        "st pr cb oy",
        """SELECT a.st, a.pr, a.cb, b.oy
        FROM (SELECT DISTINCT o_orderstatus AS st, o_orderpriority AS pr, o_custkey % 97 AS cb FROM {orders}) a
        JOIN (SELECT DISTINCT o_orderstatus AS st, o_orderpriority AS pr, CAST(o_orderdate AS DATE) AS oy FROM {orders}) b
        ON a.st = b.st AND a.pr = b.pr""",
    ),
    "ordercat": ("s p y b", "SELECT o_orderstatus AS s, o_orderpriority AS p, year(o_orderdate) AS y, o_custkey % 10 AS b FROM {orders}"),
    "bazaar": (
        "r n m f k",
        """SELECT n_regionkey AS r, a.n, a.m, b.f, b.k
        FROM (SELECT DISTINCT c_nationkey AS n, c_mktsegment AS m FROM {customer}) a
        JOIN (SELECT DISTINCT s_nationkey AS n, s_suppkey % 3 AS f, CAST(floor(s_acctbal / 2500) AS INTEGER) AS k FROM {supplier}) b ON a.n = b.n
        JOIN {nation} ON a.n = n_nationkey""",
    ),
    "bazaar6": (
        "r n m q f k",
        """SELECT n_regionkey AS r, a.n, a.m, c.q, b.f, b.k
        FROM (SELECT DISTINCT c_nationkey AS n, c_mktsegment AS m FROM {customer}) a
        JOIN (SELECT DISTINCT s_nationkey AS n, s_suppkey % 3 AS f, CAST(floor(s_acctbal / 2500) AS INTEGER) AS k FROM {supplier}) b ON a.n = b.n
        JOIN (SELECT DISTINCT c_nationkey AS n, c_custkey % 3 AS q FROM {customer}) c ON a.n = c.n
        JOIN {nation} ON a.n = n_nationkey""",
    ),
    "keyed": ("k n c d e", "SELECT s_suppkey AS k, s_name AS n, s_nationkey % 5 AS c, s_suppkey % 3 AS d, (s_nationkey % 5 + 2 * (s_suppkey % 3)) % 4 AS e FROM {supplier}"),
    "part": ("b t s", "SELECT p_brand AS b, p_type AS t, p_size AS s FROM {part}"),
    "docs": ("l s c", "SELECT lang AS l, source AS s, n_chars % 5 AS c FROM {documents}"),
    "conv": ("c t r", "SELECT conv_id AS c, turn AS t, role AS r FROM {conversations}"),
    "empty": ("a b c", "SELECT c_nationkey AS a, c_mktsegment AS b, c_custkey AS c FROM {customer} WHERE c_custkey < 0"),
}

#: Relations whose join makes rows with the square of the tables: Spark makes each distinct row once, with its number of rows.
COUNTED = {
    "flag": """SELECT a.n, a.m, b.s, a.many * b.many AS n_rows
        FROM (SELECT c_nationkey AS n, c_mktsegment AS m, count(*) AS many FROM {customer} GROUP BY c_nationkey, c_mktsegment) a
        JOIN (SELECT s_nationkey AS n, s_suppkey AS s, count(*) AS many FROM {supplier} GROUP BY s_nationkey, s_suppkey) b ON a.n = b.n""",
}


def load(spark: SparkSession, sf_dir: str, name: str, counted: bool = False) -> DataFrame:
    text = COUNTED[name] if counted else RELATIONS[name][1]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"{(\w+)}", text))})


def discovered(spark: SparkSession, sf_dir: str, name: str, options: Options) -> Result:
    counted = name in COUNTED
    return discover(load(spark, sf_dir, name, counted), options, E.COUNT if counted else None)


def duck(name: str) -> str:
    return re.sub(r"{(\w+)}", r"\1", RELATIONS[name][1])


def columns(name: str) -> list[str]:
    return RELATIONS[name][0].split()


def forms(name: str) -> Q.Forms:
    return Q.Forms(duck(name), columns(name))


def names(m: int, name: str) -> str:
    return ",".join(L.names_of(m, columns(name)))


# --- representation and projection ---


def profile_query(spark, sf_dir):
    return column_profile(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("c_mktsegment")))


PROFILE = """
    WITH t AS (SELECT c_custkey, c_nationkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer),
    g AS ({}),
    f AS (SELECT "column", count(v) AS n_distinct, cast(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS n_null, sum(n) AS n, count(*) AS groups, max(n) AS max_group FROM g GROUP BY "column")
    SELECT "column", n_distinct, n_null, 100.0::DOUBLE * n_null / n AS null_pct, 100.0::DOUBLE * n_distinct / n AS unique_pct, 100.0::DOUBLE * max_group / n AS top_pct,
           n::DOUBLE / groups AS mean_group, max_group, max_group / (n::DOUBLE / groups) AS skew FROM f
""".format(" UNION ALL ".join(f"""SELECT '{c}' AS "column", cast({c} AS VARCHAR) AS v, count(*) AS n FROM t GROUP BY {c}""" for c in ("c_custkey", "c_nationkey", "c_mktsegment")))


def dictionary_query(spark, sf_dir):
    return E.dictionary(load(spark, sf_dir, "nulls")).select(F.col("column").alias("col_idx"), "value", "id")


DICTIONARY = f"WITH t AS ({duck('nulls')}) " + " UNION ALL ".join(
    f"SELECT DISTINCT {i} AS col_idx, coalesce(cast({c} AS VARCHAR), 'None') AS value, cast(dense_rank() OVER (ORDER BY coalesce(cast({c} AS VARCHAR), 'None'), {c} IS NULL) AS INTEGER) AS id FROM t" for i, c in enumerate("abc")
)


def relation_query(kind: str):
    def run(spark, sf_dir):
        rel = E.relation(load(spark, sf_dir, "nulls"), kind)
        if kind == "packed":
            from knotwork.functions.bits import pack

            return rel.df.select(pack(rel.columns(7), rel.bits).alias("packed"), F.col(E.COUNT))
        return rel.df if kind == "encoded" else rel.df.select(*[F.col(f"c{i}").cast("string").alias(f"c{i}") for i in range(3)], E.COUNT)

    return run


ENCODED = f"""
    WITH t AS ({duck("nulls")}), e AS (
        SELECT {", ".join(f"cast(dense_rank() OVER (ORDER BY coalesce(cast({c} AS VARCHAR), 'None'), {c} IS NULL) AS INTEGER) AS c{i}" for i, c in enumerate("abc"))} FROM t)
    SELECT c0, c1, c2, count(*) AS n_rows FROM e GROUP BY ALL
"""
PACKED = f"""
    WITH e AS ({ENCODED}), b AS (SELECT greatest(1, length(bin(greatest(max(c0), max(c1), max(c2))))) AS w FROM e)
    SELECT (c0::BIGINT << (2 * w)) | (c1::BIGINT << w) | c2::BIGINT AS packed, n_rows FROM e, b
"""


def project_query(spark, sf_dir):
    rel = E.relation(load(spark, sf_dir, "geo4"))
    return rel.df.select(*rel.columns(0b1010)).distinct().toDF("b", "d")


# --- sampling ---


def sizes_query(spark, sf_dir):
    return S.group_sizes(E.relation(load(spark, sf_dir, "fd2")), 0b0101).toDF("ok", "h", "size")


def multi_sizes_query(spark, sf_dir):
    return S.multi_group_sizes(E.relation(load(spark, sf_dir, "lineflags")), [0b001, 0b010, 0b101]).select(F.col("c0").alias("f"), F.col("c1").alias("t"), F.col("c2").cast("string").alias("k"), F.col("g").cast("long").alias("g"), "size")


def top_query(spark, sf_dir):
    return S.sampled_groups(E.relation(load(spark, sf_dir, "geo4")), 0b1010, S.Sampling(mode="manual", largest_k=7)).toDF("b", "d", "size")


def auto_query(spark, sf_dir):
    return S.sampled_groups(E.relation(load(spark, sf_dir, "geo4")), 0b1010, S.Sampling()).toDF("b", "d", "size")


AUTO = f"""
    WITH t AS ({duck("geo4")}), g AS (SELECT b, d, count(*) AS size FROM t GROUP BY b, d),
    r AS (SELECT *, row_number() OVER w AS k, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far, sum(size) OVER () AS total, count(*) OVER () AS n FROM g WINDOW w AS (ORDER BY size DESC, b, d)),
    c AS (SELECT least(max(n), 20, greatest(3, least(max(n), 1 + count(*) FILTER (so_far < 0.3 * total)))) AS k FROM r)
    SELECT b, d, size FROM r WHERE k <= (SELECT k FROM c)
"""


# --- dependencies ---


def fd_checks(name: str, level: int):
    """Every pair of a level: (lhs, rhs, holds)."""
    n = len(columns(name))
    pairs = [(x, a) for x in L.level_sets(n, level) for a in range(n) if not x >> a & 1]

    def run(spark, sf_dir):
        rel = E.relation(load(spark, sf_dir, name))
        counts = V.distinct_counts(rel, [m for x, a in pairs for m in (x, x | 1 << a)])
        return spark.createDataFrame([(names(x, name), names(1 << a, name), V.fd_holds(counts, x, a)) for x, a in pairs], "lhs string, rhs string, holds boolean")

    return run, truth_fds(name, pairs)


def truth_fds(name: str, pairs) -> str:
    return f"WITH t AS ({duck(name)}) " + " UNION ALL ".join(
        f"SELECT '{names(x, name)}' AS lhs, '{names(1 << a, name)}' AS rhs, coalesce(max(n) = 1, false) AS holds FROM (SELECT count(DISTINCT row({names(1 << a, name)})) AS n FROM t GROUP BY {names(x, name)})" for x, a in pairs
    )


def fd_discovery(name: str):
    n = len(columns(name))
    pairs = [(x, a) for k in range(1, n - 1) for x in L.level_sets(n, k) for a in range(n) if not x >> a & 1]
    smaller = " OR ".join(f"(f.lhs = '{names(x, name)}' AND g.lhs = '{names(p, name)}')" for x in {x for x, _ in pairs} for p in L.proper_parts(x)) or "false"

    def run(spark, sf_dir):
        fds = discover(load(spark, sf_dir, name), Options(superkey_threshold=2.0)).fd_set()
        return spark.createDataFrame([(",".join(x), a) for x, a in fds], "lhs string, rhs string")

    return run, f"WITH f AS ({truth_fds(name, pairs)}) SELECT lhs, rhs FROM f WHERE holds AND NOT EXISTS (SELECT 1 FROM f g WHERE g.holds AND g.rhs = f.rhs AND ({smaller}))"


def all_candidates(name: str) -> list[tuple[int, int, int]]:
    n = len(columns(name))
    free = L.candidates([x for k in range(1, n - 1) for x in L.level_sets(n, k)], L.Closures(n), ())
    return [(x, y, z) for kind, x, y, z in free if kind == L.CHECK]


def truth_mvds(name: str, rows: str = "t") -> str:
    one = "SELECT '{x}' AS lhs, '{y}' AS rhs, coalesce(bool_and(n_yz = n_y * n_z), true) AS holds FROM (SELECT count(DISTINCT row({y})) AS n_y, count(DISTINCT row({z})) AS n_z, count(DISTINCT row({y},{z})) AS n_yz FROM {rows} GROUP BY {x})"
    return " UNION ALL ".join(one.format(x=names(x, name), y=names(y, name), z=names(z, name), rows=rows) for x, y, z in all_candidates(name))


def mvd_checks(name: str, sampled: bool = False):
    """Every candidate's verdict; ``sampled``: on the two largest groups of its left side only."""

    def run(spark, sf_dir):
        rel = E.relation(load(spark, sf_dir, name))
        by_lhs: dict[int, list] = {}
        for x, y, z in all_candidates(name):
            by_lhs.setdefault(x, []).append((y, z))
        two = S.Sampling(mode="manual", largest_k=2)
        found = V.collect_verdicts([q for x, p in by_lhs.items() for q in V.mvd_verdicts(rel, x, p, S.rows_of(rel, x, S.sampled_groups(rel, x, two)) if sampled else None)])
        return spark.createDataFrame([(names(x, name), names(y, name), holds) for (x, y), holds in found.items()], "lhs string, rhs string, holds boolean")

    if not sampled:
        return run, f"WITH t AS ({duck(name)}) {truth_mvds(name)}"
    parts, ctes = [], [f"t AS ({duck(name)})"]
    for i, x in enumerate(sorted({x for x, _, _ in all_candidates(name)})):
        keys = names(x, name)
        ctes.append(f"s{i} AS (SELECT t.* FROM t JOIN (SELECT {keys}, count(*) AS size FROM t GROUP BY {keys} ORDER BY size DESC, {keys} LIMIT 2) g USING ({keys}))")
        parts.append((keys, f"s{i}"))
    of = dict(parts)
    body = re.sub(r"FROM t GROUP BY ([\w,]+)\)", lambda m: f"FROM {of[m[1]]} GROUP BY {m[1]})", truth_mvds(name))
    return run, f"WITH {', '.join(ctes)} {body}"


def minimal_mvds(name: str, mode: str = "reference", **options):
    """All minimal dependencies. The SQL form below holds for three and four columns, where right
    sides have one attribute; more columns take the form of ``lattice_sql``."""

    def run(spark, sf_dir):
        found = discovered(spark, sf_dir, name, Options(mode=mode, **options)).mvd_list()
        return spark.createDataFrame([(",".join(x), ",".join(y)) for x, y in found], "lhs string, rhs string")

    if len(columns(name)) > 4:
        return run, Q.minimal(forms(name), mode == "strict")
    low = [(x, y, z) for x, y, z in all_candidates(name)]
    drop = []
    for x, y, z in low:
        for p in L.proper_parts(x):
            drop.append((names(x, name), names(y, name), names(p, name), names(y, name)))
            if mode == "strict":
                drop.append((names(x, name), names(y, name), names(p, name), names(z, name)))
    values = ", ".join(str(d) for d in drop) or "('', '', '', '')"
    return run, f"""
        WITH t AS ({duck(name)}), m AS ({truth_mvds(name)}), d(lhs, rhs, by_lhs, by_rhs) AS (VALUES {values})
        SELECT lhs, rhs FROM m WHERE holds AND NOT EXISTS (
            SELECT 1 FROM d JOIN m k ON k.lhs = d.by_lhs AND k.rhs = d.by_rhs AND k.holds WHERE d.lhs = m.lhs AND d.rhs = m.rhs)"""


def fd_levels(name: str, threshold: float):
    """Dependencies found when levels are left out once ``threshold`` of the left sides are superkeys."""

    def run(spark, sf_dir):
        fds = discover(load(spark, sf_dir, name), Options(superkey_threshold=threshold)).fd_set()
        return spark.createDataFrame([(",".join(x), a) for x, a in fds], "lhs string, rhs string")

    return run, Q.fds(forms(name), threshold)


def kinds_known(name: str):
    """What becomes of every candidate, with the dependencies known that discovery finds."""

    def run(spark, sf_dir):
        found = discover(load(spark, sf_dir, name), Options(superkey_threshold=2.0)).candidates
        return found.select("kind", F.concat_ws(",", "lhs").alias("lhs"), F.concat_ws(",", "rhs").alias("rhs"), "holds")

    return run, Q.kinds(forms(name))


def counters(name: str):
    """Counters of a run that checks all candidates in full."""

    def run(spark, sf_dir):
        s = discover(load(spark, sf_dir, name), Options(superkey_threshold=2.0, sampling=S.Sampling(enabled=False))).stats.row()
        return spark.createDataFrame([(k, int(s[k])) for k in Q.COUNTERS], "counter string, value long")

    return run, Q.counters(forms(name))


def kinds_query(spark, sf_dir):
    """Candidates of five attributes when nothing is known yet."""
    rows = [(kind, x, y, z) for kind, x, y, z in L.candidates([x for k in range(1, 4) for x in L.level_sets(5, k)], L.Closures(5), ())]
    return spark.createDataFrame(rows, "kind string, lhs long, rhs long, z long")


KINDS = """
    WITH x AS (SELECT range AS lhs FROM range(1, 31) WHERE bit_count(range) BETWEEN 1 AND 3),
    c AS (SELECT lhs, y.range AS rhs, 31 - lhs - y.range AS z FROM x, range(1, 31) y WHERE lhs & y.range = 0 AND bit_count(y.range) <= (5 - bit_count(lhs)) // 2)
    SELECT CASE WHEN bit_count(rhs) = bit_count(z) AND (rhs & -rhs) > (z & -z) THEN 'SKIP_COMPLEMENT' ELSE 'VALIDATE' END AS kind, lhs, rhs, z FROM c
"""


def closure_query(spark, sf_dir):
    """Closures of all attribute sets of geo4 under its dependencies of one attribute."""
    rel = E.relation(load(spark, sf_dir, "geo4"))
    wanted = [(1 << i, [a for a in range(4) if a != i]) for i in range(4)]
    closures, sets = L.Closures(4), list(range(1, 15))
    closures.expand(V.level_fds(rel, wanted, {}), sets)
    return spark.createDataFrame([(s, closures.of(s)) for s in sets], "attributes long, closure long")


CLOSURE = f"""
    WITH RECURSIVE f AS (SELECT 1 << position(lhs IN 'abcd') - 1 AS x, 1 << position(rhs IN 'abcd') - 1 AS a FROM ({truth_fds("geo4", [(1 << i, a) for i in range(4) for a in range(4) if a != i])}) WHERE holds),
    c AS (SELECT range AS s, range AS got FROM range(1, 15) UNION SELECT s, got | a FROM c JOIN f ON (got & x) = x)
    SELECT s AS attributes, cast(bit_or(got) AS BIGINT) AS closure FROM c GROUP BY s
"""


def violations(name: str):
    """Found dependencies whose left side is no superkey: what keeps a table from fourth normal form."""

    def run(spark, sf_dir):
        df = load(spark, sf_dir, name)
        found = discover(df).mvd_list()
        rel = E.relation(df)
        sides = {L.mask(df.columns.index(c) for c in x) for x, _ in found}
        counts = V.distinct_counts(rel, [*sides, 7])
        rows = [(",".join(x), ",".join(y)) for x, y in found if counts[L.mask(df.columns.index(c) for c in x)] < counts[7]]
        return spark.createDataFrame(rows, "lhs string, rhs string")

    keys = " UNION ALL ".join(f"SELECT '{c}' AS k WHERE (SELECT count(DISTINCT {c}) FROM t) = (SELECT count(*) FROM (SELECT DISTINCT * FROM t))" for c in columns(name))
    return run, f"WITH t AS ({duck(name)}), m AS ({truth_mvds(name)}) SELECT lhs, rhs FROM m WHERE holds AND lhs NOT IN ({keys})"


def chosen_query(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return spark.createDataFrame([(i, c) for i, c in enumerate(choose_columns(df, 3), 1)], "place int, chosen string")


CHOSEN = """
    WITH g AS ({}),
    f AS (SELECT c, count(v) AS n_distinct, coalesce(sum(n) FILTER (v IS NULL), 0) AS n_null, sum(n) AS n, count(*) AS groups, max(n) AS most FROM g GROUP BY c),
    p AS (SELECT c, n_distinct, 100.0::DOUBLE * n_distinct / n AS u, most / (n::DOUBLE / groups) AS skew FROM f WHERE n_distinct + (n_null > 0)::INT > 1),
    r AS (SELECT *, CASE WHEN u >= 95 THEN row_number() OVER (ORDER BY u DESC, c) END AS k FROM p),
    s AS (SELECT *, ntile(3) OVER (ORDER BY n_distinct, c) AS stratum FROM r WHERE k IS NULL),
    o AS (SELECT 0 AS turn, 0 AS stratum, c FROM r WHERE k = 1 UNION ALL SELECT row_number() OVER (PARTITION BY stratum ORDER BY skew DESC, c), stratum, c FROM s)
    SELECT cast(row_number() OVER (ORDER BY turn, stratum) AS INTEGER) AS place, c AS chosen FROM o QUALIFY place <= 3
""".format(" UNION ALL ".join(f"SELECT '{c}' AS c, cast({c} AS VARCHAR) AS v, count(*) AS n FROM supplier GROUP BY {c}" for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")))


def stats_query(spark, sf_dir):
    """Counters of a run over geo4, as rows."""
    s = discover(load(spark, sf_dir, "geo4"), Options(superkey_threshold=2.0)).stats
    return spark.createDataFrame([("columns", s.columns), ("rows", s.rows), ("distinct_rows", s.distinct_rows), ("search_space", s.search_space)], "counter string, value long")


STATS = f"""
    WITH t AS ({duck("geo4")}) SELECT 'columns' AS counter, 4::BIGINT AS value UNION ALL SELECT 'search_space', 10::BIGINT
    UNION ALL SELECT 'rows', count(*) FROM t UNION ALL SELECT 'distinct_rows', count(*) FROM (SELECT DISTINCT * FROM t)
"""


def _registered() -> dict[str, tuple[Callable, str | None]]:
    t = lambda name: f"WITH t AS ({duck(name)}) "
    found: dict[str, tuple[Callable, str | None]] = {
        "column_profile": (profile_query, PROFILE),
        "choose_columns": (chosen_query, CHOSEN),
        "encode_dictionary": (dictionary_query, DICTIONARY),
        "encoded_rows": (relation_query("encoded"), ENCODED),
        "packed_rows": (relation_query("packed"), PACKED),
        "raw_rows": (relation_query("raw"), t("nulls") + "SELECT cast(a AS VARCHAR) AS c0, b AS c1, cast(c AS VARCHAR) AS c2, count(*) AS n_rows FROM t GROUP BY ALL"),
        "project_distinct": (project_query, t("geo4") + "SELECT DISTINCT b, d FROM t"),
        "group_sizes": (sizes_query, t("fd2") + "SELECT ok, h, count(*) AS size FROM t GROUP BY ok, h"),
        "group_sizes_multi_lhs": (multi_sizes_query, t("lineflags") + "SELECT f, t, cast(k AS VARCHAR) AS k, grouping(f, t, k) AS g, count(*) AS size FROM t GROUP BY GROUPING SETS ((f), (t), (f, k))"),
        "sample_topk": (top_query, t("geo4") + "SELECT b, d, count(*) AS size FROM t GROUP BY b, d ORDER BY size DESC, b, d LIMIT 7"),
        "sample_auto_coverage": (auto_query, AUTO),
        "candidate_kinds": (kinds_query, KINDS),
        "closure_fixpoint": (closure_query, CLOSURE),
        "run_statistics": (stats_query, STATS),
        "fd_check_level1": fd_checks("geo4", 1),
        "fd_check_level2": fd_checks("fd2", 2),
        "mvd_check_all": mvd_checks("fd2"),
        "mvd_sample_reject": mvd_checks("fd2", sampled=True),
        "fourth_nf_violations": violations("geo"),
        "candidate_kinds_bazaar": kinds_known("bazaar"),
        "candidate_kinds_keyed": kinds_known("keyed"),
        "run_counters_bazaar": counters("bazaar"),
        "run_counters_keyed": counters("keyed"),
        "fd_levels_keyed": fd_levels("keyed", 2.0),
        "fd_levels_skipped": fd_levels("keyed", 0.3),
    }
    for name in ("geo4", "fd2", "supplier", "nulls", "empty", "ordercat"):
        found[f"fd_discovery_{name}"] = fd_discovery(name)
    for name in ("flag", "lineflags", "nation", "geo", "fd2", "nulls", "empty", "part", "docs", "conv", "ordercat"):
        found[f"minimal_mvds_{name}"] = minimal_mvds(name)
    for name in ("bazaar", "bazaar6", "keyed"):
        found[f"minimal_mvds_{name}"] = minimal_mvds(name)
    found["minimal_mvds_bazaar_strict"] = minimal_mvds("bazaar", "strict")
    found["minimal_mvds_pair"] = minimal_mvds("pair")
    found["minimal_mvds_strict"] = minimal_mvds("fd2", "strict")
    found["minimal_mvds_encoded"] = minimal_mvds("geo", representation="encoded")
    found["minimal_mvds_packed"] = minimal_mvds("fd2", representation="packed")
    found["minimal_mvds_sampled"] = minimal_mvds("fd2", sampling=S.Sampling(from_rows=0))
    found["minimal_mvds_without_fd"] = minimal_mvds("fd2", fd=False)
    return found


REGISTERED = _registered()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, (f, _) in REGISTERED.items()}
ORACLES: dict[str, str] = {k: sql for k, (_, sql) in REGISTERED.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> Result:
    """Market segments of a nation are independent of its suppliers' classes by construction; the
    relation joins distinct values, so it doesn't grow with the square of the tables."""
    return discover(load(spark, sf_dir, "bazaar"))
