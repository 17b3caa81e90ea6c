"""Models with a character map and squeezed blanks, against the library that made the format."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as pb

from knotwork.llm import pieces
from knotwork.llm.normaliser import Normaliser, spellings

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Letters with marks, ligatures, full-width and half-width forms, blanks of several kinds, what is dropped.
HARD = "ab é̀oÅﬁＡ①　 ​‍\t\n\r\x00\x1f¨각ｶﾞ▁™½日ß😀."


def spec(rule):
    return pb.ModelProto.FromString(SentencePieceNormalizer(rule_name=rule).serialized_model_proto()).normalizer_spec


def bpe(rule, squeeze, prefix):
    with open(MODEL, "rb") as f:
        model = pb.ModelProto.FromString(f.read())
    model.normalizer_spec.CopyFrom(spec(rule))
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.add_dummy_prefix = squeeze, prefix
    return model


def unigram(rule):
    """A few pieces, no byte pieces: scores are halves, so that sums are exact at any precision."""
    model = pb.ModelProto()
    model.normalizer_spec.CopyFrom(spec(rule))
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for piece, score, kind in [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -2.0, 1), ("▁a", -1.5, 1), ("a", -2.5, 1), ("ab", -1.0, 1), ("b", -3.5, 1), ("fi", -4.0, 1), ("é", -4.5, 1), ("A", -5.0, 1), ("ガ", -5.5, 1), ("o", -6.0, 1), ("▁ab", -3.0, 1)]:
        model.pieces.add(piece=piece, score=score, type=kind)
    return model


def compiled(model, folder):
    path = folder / "some.model"
    path.write_bytes(model.SerializeToString())
    return pieces.Transducer(pieces.load(str(path))), SentencePieceProcessor(model_proto=model.SerializeToString())


CASES = {f"bpe {rule} {squeeze} {prefix}": (rule, squeeze, prefix) for rule in ("nmt_nfkc", "nmt_nfkc_cf", "identity") for squeeze in (True, False) for prefix in (True, False)} | {"unigram": ("nmt_nfkc",)}


@pytest.fixture(scope="module", params=CASES)
def both(request, tmp_path_factory):
    model = unigram(*CASES[request.param]) if request.param == "unigram" else bpe(*CASES[request.param])
    return compiled(model, tmp_path_factory.mktemp("model"))


@settings(deadline=None, max_examples=250)
@given(st.text(alphabet=HARD, max_size=30) | st.text(max_size=15))
def test_ids_are_the_librarys(both, text):
    mine, library = both
    assert list(mine.encode(text)) == library.encode(text)


def test_real_texts(both, spark):
    mine, library = both
    rows = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    assert [list(mine.encode(t)) for t in rows] == library.encode(rows)
    assert [mine.decode(mine.encode(t)) for t in rows] == library.decode(library.encode(rows))


def test_every_spelling():
    """Each spelling of the map alone and next to others gives what the library writes."""
    rules = spellings(spec("nmt_nfkc").precompiled_charsmap)
    library = SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    mine = Normaliser(rules, False)
    assert len(rules) > 1000 and not spellings(b"")
    assert [mine(f"x{s}a") for s in rules] == [library.normalize(f"x{s}a") for s in rules]


def test_refusals(tmp_path):
    model = bpe("identity", False, True)
    model.pieces.add(piece="<own>", score=0.0, type=4)
    with pytest.raises(ValueError, match="user-defined"):
        compiled(model, tmp_path)
