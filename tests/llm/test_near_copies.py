import random

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """Ids that stay: the least of each group that similarity 0.8 or more links, all pairs compared."""
    sets, at = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and at[i] != at[j]:
                old, new = at[i], at[j]
                at = [new if x == old else x for x in at]
    least = {}
    for (i, _), c in zip(rows, at, strict=True):
        least[c] = min(i, least.get(c, i))
    return sorted(least.values())


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], COLUMNS)
    return sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())


def test_stage_finds_all_similar_texts(spark):
    """Copies with words changed up to and beyond the bound, a common line, chains, blank and short texts."""
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    common = " ".join(r.choices(vocabulary, k=15))
    rows = []
    for _ in range(40):
        words = r.choices(vocabulary, k=r.randint(8, 150))
        for _ in range(4):
            rows.append(" ".join(words) + (" " + common if r.random() < 0.5 else ""))
            words = list(words)
            for _ in range(max(1, round(len(words) * r.choice((0.01, 0.02, 0.03))))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
    rows += ["", None, " ", "a b", "A  b", "a b c", common, common + " x"]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    assert kept(spark, rows) == brute(rows)


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert kept(spark, rows) == brute(rows)


def test_long_and_repeated_texts(spark):
    """Sets with more elements than a sketch has bits, and copies of one text."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    base = r.choices(words, k=3000)
    rows = []
    for changed in (0, 20, 60, 64, 70, 200, 1500):
        at = r.sample(range(3000), changed)
        rows.append(" ".join("x" if i in at else w for i, w in enumerate(base)))
    rows += [" ".join(base[:1500] + r.choices(words, k=1500)), " ".join(base[:2450]), " ".join(base[:1000]), " ".join(base[:1200])]
    rows += [rows[3]] * 5 + ["a b", "a b"]
    rows = list(enumerate(rows))
    assert kept(spark, rows) == brute(rows)


def test_wide_sketches_fold():
    import numpy as np

    from knotwork.llm import near_copies as N

    r = np.random.default_rng(1)
    for n in (1025, 2048, 2049, 9000):
        items = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        wide = N.wide_sketch(items)
        assert len(wide) * 8 >= n and len(wide) * 4 < n * 2
        assert N.folded(np.frombuffer(wide, np.uint64), N.SKETCH // 8).tobytes() == N.sketch(items)
    assert N.wide_sketch(items[:1024]) == b""


def test_parts_of_a_large_group_meet_in_linear_rows():
    """400 texts at one key, of two groups and alike: one pair a text first, not 200 times 200."""
    import numpy as np
    import pyarrow as pa

    from knotwork.llm import near_copies as N

    r = np.random.default_rng(5)
    items = np.unique(r.integers(0, 1 << 62, 300).astype(np.uint64))
    sketches = [N.sketch(np.delete(items, i % len(items))) for i in range(400)]
    long = lambda x: pa.array(np.asarray(x, np.int64))
    batch = pa.RecordBatch.from_arrays([long([7] * 400), long(range(400)), long([i % 2 for i in range(400)]), long([299] * 400), pa.array(sketches, pa.binary())], names=["key", "v", "root", "n", "sketch"])
    pairs = lambda nearest: [p for b in N._pairs(nearest)(iter([batch])) for p in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)]
    every, few = pairs(False), pairs(True)
    assert len(every) == len(set(every)) == 200 * 200 and len(few) == 399 and set(few) < set(every)


def test_joined_is_components_of_all_edges(spark):
    from knotwork.llm.components import components, joined

    r = random.Random(2)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    rows = lambda d: {(x["v"], x["root"]) for x in d.collect()}
    assert rows(joined(components(frame(edges[:25])), frame(edges[25:]))) == rows(components(frame(edges)))
    assert rows(joined(components(frame([])), frame(edges))) == rows(components(frame(edges)))
    assert rows(joined(components(frame(edges)), frame([]))) == rows(components(frame(edges)))


def test_few_edges_are_joined_on_the_driver(spark):
    """The same components as by rounds of jobs, in a few jobs; above the bound by rounds."""
    import numpy as np

    from knotwork.llm.components import components, joined, least_labels

    r = random.Random(4)
    edges = [(r.randrange(-90, 90), r.randrange(-90, 90)) for _ in range(80)] + [(5, 5)]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    rows = lambda d: {(x["v"], x["root"]) for x in d.collect()}
    jobs, expected = {}, rows(components(frame(edges)))
    for few in (0, 10, 1000):
        spark.sparkContext.setJobGroup(f"few {few}", "")
        assert rows(joined(components(frame(edges[:40]), few), frame(edges[40:]), few)) == expected
        jobs[few] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"few {few}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 2 * jobs[1000] < jobs[0]
    assert rows(components(frame([]), 10)) == set()
    way = np.random.default_rng(1).permutation(5000)
    v, root = least_labels(way[1:], way[:-1])
    assert v.tolist() == list(range(5000)) and not root.any()


def test_release_lets_go_of_what_only_python_cycles_hold(spark):
    from knotwork.llm.common import release

    sc = spark.sparkContext
    held = [sc._gateway.new_array(sc._jvm.byte, 1 << 20)]
    held.append(held)
    weak = sc._jvm.java.lang.ref.WeakReference(held[0])
    del held
    release(spark)
    assert weak.get() is None
