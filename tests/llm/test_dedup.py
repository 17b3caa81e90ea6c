import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from knotwork.llm import exact_dedup, simhash, substring_dedup
from knotwork.llm.components import components

SCHEMA = "doc_id long, text string, rid string, at int"


def docs(spark, rows):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def texts(seed=1, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = [" ".join(r.choices(words, k=r.randint(0, 80))) for _ in range(n)]
    for i in range(n // 3):
        t = out[i].split()
        if t:
            t[r.randrange(len(t))] = "changed"
        out.append(" ".join(t))
    return list(enumerate([*out, *out[:20], "", None, "a b", "A  b", "x" * 40_000]))


# --- exact ---


@given(st.binary(max_size=300), st.binary(max_size=300))
def test_fingerprints_compose(a, b):
    f = exact_dedup.fingerprint
    assert exact_dedup.combine(f(a), f(b), len(b)) == f(a + b)
    slow = tuple(sum(x * pow(base, len(a) - 1 - i, p) for i, x in enumerate(a)) % p for base, p in zip(exact_dedup.BASES, exact_dedup.PRIMES, strict=True))
    assert f(a) == slow


def test_long_fingerprint():
    data = np.random.default_rng(0).integers(0, 256, 2_500_001, dtype=np.uint8).tobytes()
    f = exact_dedup.fingerprint
    cut = 1_234_567
    assert f(data) == exact_dedup.combine(f(data[:cut]), f(data[cut:]), len(data) - cut)


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, max(g := groups[t or ""]), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_exact_groups(spark):
    rows = texts()
    found = exact_dedup.exact_groups(docs(spark, rows))
    assert sorted(map(tuple, found.collect())) == brute_exact(rows)
    kept = exact_dedup.exact_dedup(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "rid", "at"] and kept.count() == len({t or "" for _, t in rows})


def test_exact_cases(spark):
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0
    twice = exact_dedup.exact_groups(docs(spark, [(1, "a"), (1, "a"), (None, "a")])).collect()
    assert [r["keep_id"] for r in twice] == [1] * 3 and sum(r["kept"] for r in twice) == 1 and twice[0]["group_size"] == 3
    assert exact_dedup.exact_dedup(docs(spark, [(None, "b"), (None, "b")])).count() == 1


def poor_fingerprints(right):
    def run(batches):
        import pyarrow as pa

        for b in right(batches):
            for name in ("h1", "h2"):
                b = b.set_column(b.schema.get_field_index(name), name, pa.array([7] * b.num_rows, pa.int64()))
            yield b

    return run


def test_equal_fingerprints_are_compared(spark, monkeypatch):
    """Texts of one length share a fingerprint here, so that only the comparison tells them apart."""
    rows = [(1, "ab"), (2, "cd"), (3, "ab"), (4, "cd"), (5, "zz"), (6, "abc"), (7, "abc"), (8, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    key = ["h1", "h2", "n_bytes"]
    rows_of = d.selectExpr("xxhash64(coalesce(text, '')) tag", "coalesce(text, '') text")
    shared = rows_of.filter("text != ''").selectExpr("tag", "7 h1", "7 h2", "length(text) n_bytes").distinct()
    assert [tuple(r) for r in exact_dedup._differing(rows_of, shared, key).collect()] == [(7, 7, 2)]
    monkeypatch.setattr(exact_dedup, "_fingerprints", poor_fingerprints(exact_dedup._fingerprints))
    assert sorted(map(tuple, exact_dedup.exact_groups(d).collect())) == brute_exact(rows)


def test_exact_dedup_of_shuffled_rows(spark):
    """Input that a shuffle deals, with a wide column that only the result reads."""
    d = spark.range(20_000).selectExpr("id doc_id", "concat('text ', id % 15000) text", "repeat(cast(id as string), 50) wide", "1 __kw_sha")
    kept = exact_dedup.exact_dedup(d.repartition(d.doc_id)).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(5_000, 20_000))
    assert all(r["wide"] == str(r["doc_id"]) * 50 and r["text"] == f"text {r['doc_id'] % 15000}" for r in kept)
    again = spark.createDataFrame([(1, "a", 5), (1, "a", 3), (1, "b", 4), (None, "b", 1)], "doc_id long, text string, __kw_n int")
    assert sorted(map(tuple, exact_dedup.exact_dedup(again).collect())) == [(1, "a", 3), (1, "b", 4)]


# --- near ---


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, w = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words, w = [*words, w] if w else words, ""
        else:
            w += c
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance=4):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    at = list(range(len(rows)))
    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= distance and at[i] != at[j]:
                old, new = max(at[i], at[j]), min(at[i], at[j])
                at = [new if x == old else x for x in at]
    least = {}
    for (i, _), c in zip(prints, at, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted((i, f, least.get(c)) for (i, f), c in zip(prints, at, strict=True))


def near(found):
    return sorted((r["id"], r["fp"] % 2**64, r["component_id"]) for r in found.collect())


@given(st.text(alphabet="aB éÄ\t\n\x0b\x1c\u00a0_", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("most", [8192, 1])
def test_near_duplicates(spark, most):
    """``most`` = 1 sends every run through midpoints."""
    rows = texts(n=60) if most == 1 else texts()
    assert near(simhash.near_duplicates(docs(spark, rows), most=most)) == brute_components(rows)


@pytest.mark.parametrize("most", [8192, 1])
def test_odd_distance(spark, most):
    rows = texts(n=60)
    assert near(simhash.near_duplicates(docs(spark, rows), 5, most=most)) == brute_components(rows, 5)


def test_near_cases(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    found = simhash.near_duplicates(docs(spark, [(3, None), (2, " "), (2, " "), (None, "")])).collect()
    assert {r["component_id"] for r in found} == {2} and len(found) == 4
    assert simhash.drop_near_duplicates(docs(spark, [(3, None), (2, " "), (7, "other words than these")])).columns == ["doc_id", "text", "rid", "at"]
    assert simhash.drop_near_duplicates(docs(spark, [(3, None), (2, " "), (7, "other words than these")])).count() == 2
    clash = spark.createDataFrame([(3, "a", 1), (2, "a", 2)], "doc_id long, text string, __kw_id int")
    assert [tuple(r) for r in simhash.drop_near_duplicates(clash).collect()] == [(2, "a", 2)]


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=6), st.data())
def test_every_close_pair_meets_in_a_block(base, data):
    flips = data.draw(st.sets(st.integers(0, 63), max_size=4))
    a, b = base[0], base[0]
    for f in flips:
        b ^= 1 << f
    n = 4 + simhash.KEEP
    edges = [round(64 * i / n) for i in range(n + 1)]
    same = sum((a >> lo) % (1 << hi - lo) == (b >> lo) % (1 << hi - lo) for lo, hi in zip(edges, edges[1:], strict=False))
    assert same >= simhash.KEEP


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(50)]
    at = {v: v for e in edges for v in e}
    for _ in range(len(at)):
        before = dict(at)
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
        if at == before:
            break
    linked = {v for a, b in edges if a != b for v in (a, b)}
    got = {x["v"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: at[v] for v in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- passages ---


def brute_units(text, marks):
    """(words, start, end with the marks behind) of each clause or, without marks, line."""
    out, start = [], 0
    while start < len(text):
        end = start
        while end < len(text) and text[end] not in marks + "\n":
            end += 1
        stop = end
        while stop < len(text) and (text[stop] in marks if marks else text[stop] == "\n" and stop == end):
            stop += 1
        words = text[start:end].encode().lower().split()
        if words:
            out.append((words, start, stop))
        start = max(stop, start + 1)
    return out


def brute_passages(rows, marks, min_words, passage=0):
    """Every unit and every two units in a row are looked for in all documents that rank before."""
    units = {i: brute_units(t or "", marks) for i, t in rows}
    out = []
    for i, t in rows:
        t, own = t or "", [u[0] for u in units[i]]
        before = [[u[0] for u in units[j]] for j in units if j < i]
        runs, run = [], []
        for n, words in enumerate(own):
            if n and any(own[n - 1 : n + 1] == o[k : k + 2] for o in before for k in range(len(o))):
                run.append(n)
            else:
                run = [n]
                runs.append(run)
        gone = [r for r in runs if sum(len(own[n]) for n in r) >= min_words and (len(r) > 1 or any(own[r[0]] in o for o in before))]
        gone = [r for r in gone if sum(len(own[n]) for n in range(max(0, r[0] - 1), min(len(own), r[-1] + 2))) >= passage]
        spans = [(units[i][r[0]][1], units[i][r[-1]][2]) for r in gone]
        rest = "".join(c for n, c in enumerate(t) if not any(s <= n < e for s, e in spans))
        out.append((i, len(own), spans, rest))
    return sorted(out)


def passages(found):
    return sorted((r["id"], r["n_units"], [(s["start"], s["end"]) for s in r["removed"]], r["text"]) for r in found.collect())


@pytest.mark.parametrize(("unit", "marks"), [("clause", ".!?,;:"), ("line", "")])
def test_passages(spark, unit, marks):
    """Passages that start in the middle of a line, stock phrases, blank and very long texts."""
    r = random.Random(5)
    pool = [" ".join(r.choices("é a B cc d Ee f".split(), k=r.randint(1, 9))) for _ in range(60)]
    rows = [(i, "".join(r.choice(pool) + r.choice([". ", ", ", "\n", "?!\n\n", ";"]) for _ in range(r.randint(0, 14)))) for i in range(60)]
    passage = "one two three, four five six. Seven eight nine ten: eleven twelve"
    rows += [(60, None), (61, ""), (62, "before " + passage + "\nafter"), (63, "Other words; and " + passage.upper() + ". The end."), (64, ".,. \n \n;"), (65, "x, " + "long " * 20_000 + ". y"), (66, "z " * 3 + ", " + "long " * 20_000)]
    found = passages(substring_dedup.drop_repeated_units(docs(spark, rows), unit, min_words=8))
    assert found == brute_passages(rows, marks, 8)
    assert any(f[2] for f in found)
    if unit == "clause":
        assert found[63][2] and not found[62][2] and found[66][2]


def test_passages_cut_by_clauses(spark):
    """Passages of 51 to 60 words that start and end inside clauses, put into the middle of other texts."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abdeiklmnorstu") for _ in range(r.randint(2, 8)))
    text = lambda n: "".join(word() + (r.choice([". ", ", ", "? "]) if r.random() < 0.12 else " ") for _ in range(n))
    rows, planted = [], set()
    for i in range(0, 120, 3):
        passage = text(r.randint(51, 60)).strip()
        rows += [(i, text(60) + passage + " " + text(60)), (i + 1, text(200)), (i + 2, text(90) + passage + " " + text(30))]
        planted.add(i + 2)
    phrase = text(18).replace(".", "").replace(",", "").replace("?", "")
    rows += [(i, f"{word()}. {phrase}. {word()}. {text(80)}") for i in range(200, 210)]
    found = passages(substring_dedup.drop_repeated_units(docs(spark, rows), min_words=15, passage=51))
    assert found == brute_passages(rows, ".!?,;:", 15, 51)
    hit = {f[0] for f in found if f[2]}
    assert hit <= planted and len(hit) >= 0.9 * len(planted)


def test_passage_cases(spark):
    drop = substring_dedup.drop_repeated_units
    assert drop(docs(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(40))
    same = drop(docs(spark, [(1, long), (1, long), (2, long.upper() + ". x")])).collect()
    assert sorted(r["text"] for r in same) == [" x", long, long]
    stays = drop(docs(spark, [(1, "a b, " * 50), (2, long[:-4] + ". c"), (3, long[:-4] + ". d")])).collect()
    assert not any(r["removed"] for r in stays)
    paragraphs = drop(docs(spark, [(1, "a b c d e\nf\n\nx"), (2, "y\n \na b c d e f")]), "paragraph", 5)
    assert [r["text"] for r in paragraphs.orderBy("id").collect()] == ["a b c d e\nf\n\nx", "y\n \n"]
    nulls = drop(docs(spark, [(None, long), (1, long)])).collect()
    assert sorted((r["id"] is None, r["text"]) for r in nulls) == [(False, ""), (True, long)]
