import itertools
import random

from knotwork.llm import url_filter


def test_rules_of_four_tokens(spark):
    """Bad are only URLs with two host labels and two path segments together."""
    r = random.Random(4)
    rows = []
    for _ in range(2500):
        have = [r.random() < 0.6 for _ in range(4)]
        a, b, c, d = (x if h else "no" + x for h, x in zip(have, "abcd", strict=True))
        rows.append((f"http://{a}.{b}/{c}/{d}", all(have)))
    mined = url_filter.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"))
    tokens = sorted(sorted(x["tokens"]) for x in mined.collect())
    baskets = [({"scheme:http", *("host:" + x for x in u[7:].split("/")[0].split(".")), *("path:" + x for x in u[7:].split("/")[1:])}, bad) for u, bad in rows]
    wanted = []
    for size in range(1, 6):
        for combo in itertools.combinations(sorted(set().union(*(t for t, _ in baskets))), size):
            has = [bad for t, bad in baskets if t.issuperset(combo)]
            if sum(has) >= 20 and sum(has) >= 0.005 * len(rows) and sum(has) >= 0.8 * len(has) and not any(w <= set(combo) for w in wanted):
                wanted.append(set(combo))
    assert tokens == sorted(map(sorted, wanted)) == [["host:a", "host:b", "path:c", "path:d"]]
