import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm import language, pieces, toxicity
from knotwork.llm.wfst import Wfst

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def frame(spark, rows, extra="h int"):
    return spark.createDataFrame([(*r, 0) for r in rows], f"doc_id long, text string, lang string, {extra}")


# --- pieces ---


@pytest.fixture(scope="module")
def transducer():
    return pieces.Transducer(pieces.load(MODEL))


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


@settings(deadline=None, max_examples=400)
@given(st.text(alphabet="aeithsrn T▁  \n\t.,<>=(0é日ß😀\x00", max_size=40) | st.text(max_size=20))
def test_ids_are_the_librarys(transducer, library, text):
    ids = list(transducer.encode(text))
    assert ids == library.encode(text)
    assert transducer.decode(ids) == text.replace("▁", " ")


def test_real_texts(transducer, library, spark):
    rows = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert [list(transducer.encode(t)) for t in rows] == library.encode(rows)
    assert [transducer.decode(transducer.encode(t)) for t in rows] == rows


def test_small_tables_forget(library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 4)
    t = pieces.Transducer(pieces.load(MODEL))
    text = " ".join(f"word{i % 7} other{i}" for i in range(60))
    assert list(t.encode(text)) == library.encode(text)


def test_unigram_takes_the_shortest_path():
    words = {"▁": (3, -2.0), "▁a": (4, -1.5), "a": (5, -2.0), "ab": (6, -1.2), "b": (7, -1.0), "abb": (8, -2.5)}
    t = pieces.Transducer({"kind": "unigram", "prefix": True, "pieces": words, "bytes": {}, "unknown": 0})
    names = {i: p for p, (i, _) in words.items()}

    def all_paths(text):
        if not text:
            yield 0.0, []
        for p, (i, s) in words.items():
            if text.startswith(p):
                for cost, rest in all_paths(text[len(p) :]):
                    yield cost - s, [i, *rest]

    for text in ("ab", "abb", "aabb", "b a ab", "abab bb"):
        best = min(all_paths("▁" + text.replace(" ", "▁")))[0]
        ids = list(t.encode(text))
        assert sum(-words[names[i]][1] for i in ids) == pytest.approx(best) and t.decode(ids) == text
    assert list(t.encode("x")) == [3, 0]


def test_encode_frames(spark, library):
    model = pieces.load(MODEL)
    rows = [(1, "one  two", None), (1, "one  two", None), (None, "é", None), (3, None, None), (4, "", None), (5, "long word " * 30_000, None)]
    found = pieces.decode(pieces.encode(frame(spark, rows), model), model).collect()
    assert len(found) == 6
    for r in found:
        assert r["ids"] == library.encode(r["text"]) and r["text"] in {t or "" for _, t, _ in rows}
    assert pieces.encode(frame(spark, []), model).count() == 0


# --- transducers ---


def test_compose_and_shortest():
    a = Wfst(0).arc(0, "x", "p", 1.0, 0).arc(0, "x", "q", 0.25, 0).end(0)
    b = Wfst(0).arc(0, "p", "P", 0.0, 0).arc(0, "q", "Q", 2.0, 0).end(0)
    assert a.shortest("xx") == (0.5, ["q", "q"]) and a.shortest("y") is None
    assert a.compose(b).shortest("xx") == (2.0, ["P", "P"])


# --- toxicity ---

FILL = "the of and river stone green walk under seven paper window table small".split()


def toxic_rows(n=400, seed=2):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = r.choices(FILL, k=r.randint(5, 60))
        bad = r.random() < 0.2
        if bad:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(["zargon", "you zargon", "blefuous", "blefuity"]))
        rows.append((i, " ".join(words) + ".", None))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    held = {i for i, _ in labels if i % 3 == 1}
    model = toxicity.learn(frame(spark, rows), spark.createDataFrame([x for x in labels if x[0] not in held] + [(0, None), (None, 1)], "doc_id long, toxic int"))
    found = {r["id"]: r for r in toxicity.toxicity(frame(spark, rows), model).collect()}
    right = [found[i]["predicted"] == y for i, y in labels if i in held]
    assert sum(right) / len(right) > 0.97
    kept = toxicity.drop_toxic(frame(spark, rows), model)
    assert kept.columns == ["doc_id", "text", "lang", "h"] and kept.count() == sum(r["predicted"] == 0 for r in found.values())


def test_clauses_count_their_scope():
    model = {"words": {"fool": 4.0}, "stems": {"idiot": 4.0}, "offsets": toxicity.OFFSETS, "calibration": [1.0, 0.5, -2.0, -4.0]}
    s = toxicity.Scorer(model)
    best = lambda t: s.features(t)[0]
    assert best("you are a fool.") > best("a fool.") > best("he said a fool.") > best("he is not a fool.") > best("fine. nothing.") == 0
    assert best("IDIOTIC plan") == 4.0 and best("foolish") == 0 and s.features("a fool. fine. fool!")[1] == pytest.approx(1.0986, abs=1e-3)
    assert best("I will destroy you") < best("you, I will destroy") and 0 <= s.score(None) == s.score("") < 0.5


def test_toxicity_without_labels(spark):
    rows, _ = toxic_rows(20)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(frame(spark, rows), none)
    assert not model["words"] and json.loads(json.dumps(model)) == model
    found = toxicity.toxicity(frame(spark, [*rows, (99, None, None), (99, "", None), (None, "long " * 50_000, None)]), model)
    assert {r["predicted"] for r in found.collect()} == {0} and toxicity.toxicity(frame(spark, []), model).count() == 0


# --- language ---

SOUNDS = {"aa": ("the ing tion wh", "latin"), "ab": ("der ung keit sch", "latin"), "ba": ("que ción ado ll", "x"), "bb": ("eau ment eux é", "x")}


def language_rows(n=160, seed=4):
    r = random.Random(seed)
    return [(i, " ".join("".join(r.choices(SOUNDS[k][0].split(), k=r.randint(1, 3))) for _ in range(r.randint(8, 40))), k) for i, k in enumerate(r.choices(list(SOUNDS), k=n))]


def test_language(spark):
    rows = language_rows()
    held = {i for i, *_ in rows if i % 3 == 1}
    model = language.learn(frame(spark, [r for r in rows if r[0] not in held] + [(900, "und so", None), (901, "x", "")]))
    assert sorted(x for g in model["families"] for x in g) == sorted(SOUNDS) and len(model["families"]) == 2
    found = {r["id"]: r for r in language.identify(frame(spark, rows), model).collect()}
    right = [found[i]["lang_pred"] == k for i, _, k in rows if i in held]
    assert sum(right) / len(right) > 0.95 and all(0 <= r["score"] <= 1 for r in found.values())
    odd = language.identify(frame(spark, [(1, None, None), (2, "", None), (3, "12 !?", None), (4, "é" * 300_000, None), (4, "é", None)]), model).collect()
    assert [r["lang_pred"] for r in odd[:3]] == ["und"] * 3 and len(odd) == 5 and odd[3]["lang_pred"] in SOUNDS
    assert language.identify(frame(spark, []), model).count() == 0


def test_language_without_or_with_one_class(spark):
    none = language.learn(frame(spark, []))
    assert language.identify(frame(spark, [(1, "text", None)]), none).first()["lang_pred"] == "und"
    one = language.learn(frame(spark, [(1, "text", "en"), (2, "more", "en")]))
    assert language.identify(frame(spark, [(1, "text", None)]), one).first()[1:] == ("en", pytest.approx(1.0))
