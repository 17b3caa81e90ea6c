"""Windows of words against brute force, and what clauses leave in."""

import random
import re

import numpy as np
import pytest

from knotwork.llm import passages, substring_dedup


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute_windows(rows, words):
    """Every window is looked for in all documents that rank before, and in its own before it starts."""
    found = {i: [(m[0].encode().lower(), m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D.!?,;:]+", t or "")] for i, t in rows}
    held = {i: [tuple(w[0] for w in f[k : k + words]) for k in range(len(f) - words + 1)] for i, f in found.items()}
    out = []
    for i, t in rows:
        t = t or ""
        before = {w for j in held if j < i for w in held[j]}
        gone = {n for k, w in enumerate(held[i]) if w in before or w in held[i][: max(0, k - words + 1)] for n in range(k, k + words)}
        spans = []
        for n in sorted(gone):
            end = found[i][n][2]
            while end < len(t) and t[end] in ".!?,;:":
                end += 1
            spans = [*spans[:-1], (spans[-1][0], end)] if n - 1 in gone else [*spans, (found[i][n][1], end)]
        out.append((i, len(found[i]), spans, "".join(c for n, c in enumerate(t) if not any(s <= n < e for s, e in spans))))
    return sorted(out)


def removed(found):
    return sorted((r["id"], r["n_words"], [(s["start"], s["end"]) for s in r["removed"]], r["text"]) for r in found.collect())


@pytest.mark.parametrize("words", [1, 4, 7])
def test_windows(spark, words):
    """Few words, so that windows repeat in all ways; marks, white space and case count for nothing."""
    r = random.Random(words)
    pool = ["é", "É", "a", "A", "bb", "c"] + [f"w{i}" for i in range(12)]
    marks = [" ", " ", " ", ". ", ",", "\n\n", " ?! ", "\x0b", "\x1c "]
    rows = [(i, "".join(r.choice(pool) + r.choice(marks) for _ in range(r.randint(0, 40)))) for i in range(60)]
    copied = " ".join(rows[7][1].split()).upper()
    rows += [(60, None), (61, ""), (62, ".,. \n"), (63, "x " * 50), (64, "start " + copied + " end"), (65, copied), (66, "p q r s t u v, " * 3), (67, "y z " * 40 + "\n" + "y Z;" * 9)]
    found = removed(passages.drop_repeated_windows(docs(spark, rows), words))
    assert found == brute_windows(rows, words)
    assert any(f[2] for f in found)


def test_passages_that_clauses_leave_in(spark):
    """Passages without a mark inside other clauses, and what one document repeats."""
    r = random.Random(4)
    text = lambda n: " ".join("".join(r.choice("abdeiklmnorstu") for _ in range(r.randint(3, 8))) for _ in range(n))
    passage, own, short = text(60), text(51), text(50)
    rows = [(1, f"{text(9)} {passage} {text(9)}. {short}"), (2, f"{text(5)} {passage} {text(7)}"), (3, f"{own}, {text(4)} {own}; {text(3)}"), (4, f"{text(8)} {short} {text(8)}"), (5, "junk " * 200)]
    assert not any(x["removed"] for x in substring_dedup.drop_repeated_units(docs(spark, rows), min_words=15, passage=51).collect())
    found = removed(passages.drop_repeated_windows(docs(spark, rows)))
    assert found == brute_windows(rows, 51)
    assert [len(f[2]) for f in found] == [0, 1, 1, 0, 1]
    assert passage not in found[1][3] and found[2][3].count(own) == 1 and found[4][3].split() == ["junk"] * 51


def test_window_cases(spark):
    long = " ".join(f"w{i}" for i in range(60))
    assert passages.drop_repeated_windows(docs(spark, [])).count() == 0
    same = passages.drop_repeated_windows(docs(spark, [(1, long), (1, long), (2, long.upper() + ". x"), (None, "w " + long)])).collect()
    assert sorted((r["id"] or 0, r["text"]) for r in same) == [(0, "w " + long), (1, ""), (1, ""), (2, " x")]
    named = docs(spark, [(1, long), (2, long)]).selectExpr("cast(doc_id as string) name", "text body", "1 id", "2 key", "3 i", "4 k")
    assert [(r["id"], r["text"]) for r in passages.drop_repeated_windows(named, 51, "name", "body").orderBy("id").collect()] == [("1", long), ("2", "")]


def test_passages_by_shuffle(spark, monkeypatch):
    """Beyond the bound of a broadcast texts meet what they lose by a shuffle."""
    monkeypatch.setattr(passages, "SHARED", 0)
    rows = [(i, " ".join(f"w{j % 90}" for j in range(i, i + 70))) for i in range(40)]
    assert removed(passages.drop_repeated_windows(docs(spark, rows))) == brute_windows(rows, 51)


def test_least_of_each():
    x = np.random.default_rng(1).integers(0, 99, 40)
    for k in range(1, 41):
        assert passages.lowest(x, k).tolist() == [x[i : i + k].min() for i in range(41 - k)]
