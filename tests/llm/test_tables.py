import itertools
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from knotwork.llm import chat, mixing, neighbours, url_filter
from knotwork.llm.queries import MIX_WEIGHTS, URL_RULES

# --- urls ---


def brute_judgement(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fit = [(len(r), r, v) for v, r in URL_RULES if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    best = max(fit, default=(0, None, None))
    return host, path, best[1], best[2]


URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/1?x#y", "http://www.example.com/en/a", "http://a.net/es/", "http://net/fr/x", "http://bnet/fr/x", "http://x.com", "http://x.com/", "HTTP://É.Com/é?://", "a://b://c.com/", "http://x.org#/en/", "http://m.example.com/EN/", "http://y.com/\nz/ü", "http://" + "a." * 3000 + "net/es/"]


def test_judgement(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS * 2)], "page_id long, url string, rid string, rule string")
    mined = url_filter.mine_rules(spark.createDataFrame([], "url string, bad boolean"))
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, mined, URL_RULES).collect()}
    for i, u in enumerate(URLS * 2):
        host, path, rule, verdict = brute_judgement(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or "allow")
    assert url_filter.judge_urls(pages.limit(0), mined, []).count() == 0


def test_mined_rules(spark):
    r = random.Random(1)
    rows = []
    for _ in range(600):
        host, part = r.choice(["casino", "news", "shop"]), r.choice(["win", "read", "buy"])
        bad = host == "casino" and part == "win" or r.random() < 0.02
        rows.append((f"http://{host}.example.org/{part}/{r.randrange(10**6)}", bad))
    mined = url_filter.mine_rules(spark.createDataFrame([*rows, ("http://x.y/", None)], "url string, bad boolean"))
    tokens = [{*x["tokens"]} for x in mined.collect()]
    baskets = [({f"scheme:http", f"host:{u.split('/')[2].split('.')[0]}", "host:example", "host:org", f"path:{u.split('/')[3]}", "path:0"}, b) for u, b in rows]
    n, wanted = len(rows), []
    for size in (1, 2, 3):
        for combo in itertools.combinations(sorted(set().union(*(t for t, _ in baskets))), size):
            has = [b for t, b in baskets if t.issuperset(combo)]
            if sum(has) >= max(20, 0.005 * n) and sum(has) >= 0.8 * len(has) and not any(w <= set(combo) for w in wanted):
                wanted.append(set(combo))
    assert sorted(map(sorted, tokens)) == sorted(map(sorted, wanted)) and tokens
    pages = spark.createDataFrame([(1, "http://casino.example.org/win/1"), (2, "http://casino.example.org/read/1"), (3, None)], "page_id long, url string")
    assert {x["page_id"]: x["verdict"] for x in url_filter.judge_urls(pages, mined, []).collect()} == {1: "block", 2: "allow", 3: "allow"}


# --- mixing ---


def brute_targets(sizes, weights, epochs=3):
    """Reshare what exceeds the caps until nothing does, in fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), Fraction(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= epochs * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = Fraction(epochs * sizes[s])
        left -= sum(out[s] for s in full)
        free -= full
    return out


def mix_rows(seed=1, n=4000):
    r = random.Random(seed)
    names = ["hot", "hot", "hot", "b", "c", "É", None, "tiny", "z"]
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40])), r.choice(names)) for i in range(n)]
    return [*rows, (n, None, "hot"), (n + 1, "a\u00a0b \x0b c", "tiny"), (n + 2, "x " * 30_000, "b"), (5, rows[5][1], rows[5][2]), (n + 3, "", "void")]


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 100)
    rows = mix_rows()
    d = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, source string, target int, key string")
    quality = spark.createDataFrame([(i, 2.0 if i % 2 else 0.5) for i in range(0, 4000, 3)] + [(1, None), (2, -1.0)], "doc_id long, q double")
    got = mixing.mix(d, quality, MIX_WEIGHTS).collect()
    again = mixing.mix(d.repartition(7), quality, MIX_WEIGHTS).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    sizes = Counter()
    count = lambda t: len((t or "").encode().split())
    for _, t, s in rows:
        sizes[s] += count(t)
    want = brute_targets(sizes, MIX_WEIGHTS)
    source = {i: s for i, _, s in rows}
    taken, longest = Counter(), Counter()
    for g in got:
        s = source[g["doc_id"]]
        assert g["source_size"] == sizes[s] and g["target"] == pytest.approx(float(want[s])) and g["taken"] == g["epochs"] * g["size"] <= 3 * g["size"]
        assert g["epochs"] >= math.floor(g["target"] / sizes[s] if sizes[s] else 0)
        taken[s] += g["taken"]
        longest[s] = max(longest[s], g["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6
    assert sum(want.values()) == sum(sizes.values())


def test_selection_follows_the_keys(spark):
    """Against one sort of the whole source."""
    d = spark.createDataFrame([(i, "w " * (i % 9 + 1), s) for i in range(3000) for s in ("a" if i % 3 else "b",)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(d, None, [1, 9]).collect()}
    keys = {r[0]: r[1] for r in d.select("doc_id", ((F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52))).collect()}
    for part in (0, 1):
        ids = sorted((i for i in got if bool(i % 3) == bool(part)), key=lambda i: -keys[i])
        size, target = got[ids[0]]["source_size"], got[ids[0]]["target"]
        so_far, full = 0, math.floor(target / size)
        for i in ids:
            assert got[i]["epochs"] == full + (2 * so_far + got[i]["size"] <= 2 * (target - full * size))
            so_far += got[i]["size"]


def test_quality_counts(spark):
    d = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(4000)], "doc_id long, text string, source string")
    q = spark.createDataFrame([(i, 4.0 if i % 4 < 2 else 0.25) for i in range(4000)], "doc_id long, q double")
    got = mixing.mix(d, q, [1, 3]).filter("source_size > 0").collect()
    taken = Counter((r["doc_id"] % 4 < 2) for r in got if r["doc_id"] % 2 == 0 and r["epochs"])
    assert taken[True] > 3 * taken[False]
    assert mixing.mix(d.limit(0)).count() == 0


def test_slices_are_balanced_for_any_quality(spark, monkeypatch):
    """Slices must not grow with the qualities; extreme ones keep their order."""
    monkeypatch.setattr(mixing, "SLICE", 200)
    n = 40_000
    for q in ("0.01D", "0.5D", "10D", "1e-300D", "pow(10D, id % 7 - 3)", "0.01D + 10 * rand(1)"):
        rows = spark.range(n).selectExpr("id", f"{q} AS q").select(mixing.log_key(F.xxhash64("id"), F.col("q")).alias("key"))
        sizes = [r["count"] for r in rows.groupBy(mixing.slice_of(F.col("key"), F.lit(n)).alias("slice")).count().collect()]
        assert sum(sizes) == n and max(sizes) <= 200
    d = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    tiny = spark.createDataFrame([(i, 1e-300 if i % 4 < 2 else 1e-290) for i in range(400)], "doc_id long, q double")
    taken = {r["doc_id"] for r in mixing.mix(d, tiny, [1, 3]).collect() if r["epochs"] and r["doc_id"] % 2 == 0}
    assert len(taken) == 100 and all(i % 4 >= 2 for i in taken)


# --- neighbours ---


@given(st.integers(1, 4), st.integers(1, 3))
def test_hilbert_curve_is_connected(d, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    key = neighbours.hilbert(points, bits)
    assert sorted(key.tolist()) == list(range(1 << bits * d))
    steps = np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(1)
    assert (steps == 1).all()


def brute_nearest(rows, k=10):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8]
    out = {}
    for q, x in ok:
        if q % 100 == 0:
            far = sorted((float(np.sqrt(np.add.accumulate((y - x) ** 2)[-1])), i) for i, y in ok if i != q)[:k]
            out[q] = [(i, d) for d, i in far]
    return out


def vectors(n, seed=1):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(n)]
    same = rows[7][1]
    rows += [(n + i, same) for i in range(40)]
    return rows + [(n + 100, None), (n + 101, [0.0] * 8), (n + 102, [float("nan")] * 8), (n + 103, [None] + [1.0] * 7), (n + 104, [1.0]), (None, same), (n + 105, [float("inf")] * 8), (n + 106, [])]


def nearest(spark, rows, **options):
    d = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, key int")
    out = {}
    for r in neighbours.neighbours(d, F.expr("id % 100 = 0"), **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_window_over_all_is_exact(spark):
    rows = vectors(460)
    assert nearest(spark, rows, curves=2, window=512) == brute_nearest(rows)
    assert nearest(spark, rows[:6], curves=2) == brute_nearest(rows[:6]) and nearest(spark, rows[:1]) == nearest(spark, []) == {}


def test_complete_is_exact(spark, monkeypatch):
    """Windows of 1 % of vectors without structure, queries in several chunks."""
    monkeypatch.setattr(neighbours, "BLOCK", 300)
    monkeypatch.setattr(neighbours, "CHUNK", 800)
    rows = vectors(4000)
    assert nearest(spark, rows, window=20, curves=2, complete=True) == brute_nearest(rows)
    few = [(i, v) for i, v in rows if i is not None and i % 700 == 0]
    assert nearest(spark, few, window=1, curves=1, complete=True) == brute_nearest(few)


def recall(got, want):
    assert got.keys() == want.keys()
    for q in want:
        true = dict(want[q])
        assert all(d == true[i] for i, d in got[q] if i in true)
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])


def test_recall_at_64_dimensions(spark, monkeypatch):
    """Vectors near a surface of four dimensions, windows of 5 % on either side, candidates of 6 curves."""
    monkeypatch.setattr(neighbours, "BLOCK", 300)
    r = np.random.default_rng(4)
    flat = r.normal(size=(4000, 4)) @ r.normal(size=(4, 64)) + 0.01 * r.normal(size=(4000, 64))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(flat)]
    want = {}
    x = np.array([v for _, v in rows], np.float64)
    for q in range(0, 4000, 100):
        far = np.sqrt(np.add.accumulate((x - x[q]) ** 2, axis=1)[:, -1])
        want[q] = [(int(i), float(far[i])) for i in np.lexsort((np.arange(4000), far)) if i != q][:10]
    assert recall(nearest(spark, rows, window=200), want) >= 0.9


# --- chat ---


@given(st.text(alphabet="\\#<:/ turn>\nhlcé", max_size=40))
def test_escape(text):
    for role in (False, True):
        e = chat.escape(text, role)
        assert chat.unescape(e) == text and "<" not in e and "#" not in e and (":" not in e or not role)


def chat_rows():
    r = random.Random(2)
    rows = [(1, 0, "user", "hi: </turn>"), (1, 2, "user", None), (1, 1, "assistant", "a\\"), (1, 3, "assistant", "### b"), (2, 0, "user", "only"), (None, 0, "assistant", "x"), (3, None, None, "y"), (3, 0, "as:si\n", ""), (4, 0, "assistant", "z" * 100_000), (4, 0, "assistant", "z" * 100_000), (None, None, "assistant", "\U0001f600 <"), (5, -3, "assistant", "")]
    return rows + [(6, r.randrange(-2000, 3000), r.choice(["user", "assistant"]), r.choice(["é#", "ab\\l", ": ", "\n"])) for _ in range(400)]


def brute_chat(rows):
    """Per conversation: the string and, per assistant turn, what stands before its text and the text."""
    esc = lambda t: t.replace("\\", "\\\\").replace("#", "\\h").replace("<", "\\l")
    by_id = {}
    for c, n, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        whole, examples, turns = by_id.setdefault(c, ["", [], []])
        whole += f"### {esc(role or '').replace(':', chr(92) + 'c')}: "
        if role == "assistant":
            examples.append((whole, esc(text or "")))
        by_id[c] = [whole + esc(text or "") + "</turn>\n", examples, [*turns, (role or "", text or "")]]
    return by_id


@pytest.mark.parametrize("segment", [1000, 3])
def test_chat(spark, monkeypatch, segment):
    """Segments of a few turns split conversations over tasks."""
    import hashlib

    monkeypatch.setattr(chat, "SEGMENT", segment)
    rows, want = chat_rows(), brute_chat(chat_rows())
    d = spark.createDataFrame([(*t, "c", 1) for t in rows], "conv_id long, turn long, role string, text string, piece string, start int")
    f = chat.format_chats(d)
    whole = {}
    for r in sorted(f.collect(), key=lambda r: r["start"]):
        assert r["start"] == len(whole.get(r["conv_id"], ""))
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["piece"]
    assert whole == {c: x[0] for c, x in want.items()}
    examples = sorted((r["conv_id"] or 0, r["context_end"], r["target"]) for r in chat.expand(f).collect())
    assert examples == sorted((c or 0, len(before), target) for c, x in want.items() for before, target in x[1])
    written = sorted((r["conv_id"] or 0, r["context"], r["target"]) for r in chat.with_context(chat.expand(f), f).filter("conv_id is null or conv_id != 6").collect())
    assert written == sorted((c or 0, *e) for c, x in want.items() if c != 6 for e in x[1])
    back = {r["conv_id"]: r for r in chat.read_back(f).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert back.keys() == want.keys()
    for c, (text, _, turns) in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert tuple(back[c])[1:] == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss), len(text))
    assert chat.format_chats(d.limit(0)).count() == chat.expand(f.limit(0)).count() == chat.read_back(f.limit(0)).count() == 0


def test_chat_refuses_what_no_template_wrote(spark):
    broken = spark.createDataFrame([(1, 0, "### user hi", 3, 0)], "conv_id long, start long, piece string, head int, loss int")
    with pytest.raises(Exception, match="not in the template"):
        chat.read_back(broken).collect()
