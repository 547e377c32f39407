import hashlib
import time

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from docketloom.llm import pieces, queries
from tests.llm import samples

PATH = queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return pieces.Pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def with_map(tmp_path, squeeze: bool, bytes_too: bool = True) -> str:
    """The given vocabulary with a public character map that the library carries, instead of none."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    carried = pb.ModelProto()
    carried.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = carried.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    if not bytes_too:
        model.trainer_spec.byte_fallback = False
        for p in model.pieces:
            if p.type == 6:
                p.type = 3
    path = tmp_path / "mapped.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def same(own, library, text):
    ids, spans = own.encode([text])[0]
    want = library.encode(text, add_bos=True, add_eos=True)
    assert ids.tolist() == want
    assert own.decode(ids) == library.decode(want)
    data = text.encode()
    proto = library.encode(text, return_type="proto")
    assert [data[a:b].decode() for a, b in spans[1:-1].tolist()] == [p.surface for p in proto.pieces]
    assert spans[1:-1].tolist() == [[p.begin, p.end] for p in proto.pieces]


CASES = [t or "" for t in samples.TEXTS] + [" ", "   ", "a  b ", "\n\n x \n", "a▁b", "▁", "<s> x </s> <0x41> <unk>", "ﬁ½ ㌀㎥ é", "日本\U0001d518\x00\x01\x7f", " 　 z ", " " * 40 + "x" * 90, "ab" * 60 + " " + "é" * 50, "\t\t", "﻿x​­y", "\U0001f600\U0001f600 "]


@pytest.mark.parametrize("text", CASES)
def test_cases(both, text):
    same(*both, text)


TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁'sabcethinABC<>0x½²ﬁé́日"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_any_text(both, text):
    same(*both, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 300), max_size=12))
def test_any_ids(both, ids):
    own, library = both
    assert own.decode(np.array(ids, "<u4")) == library.decode(ids)


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("bytes_too", [False, True])
def test_character_map(tmp_path, squeeze, bytes_too):
    path = with_map(tmp_path, squeeze, bytes_too)
    own, library = pieces.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in CASES:
        same(own, library, text)

    @settings(max_examples=200, deadline=None)
    @given(TEXT)
    def any_text(text):
        same(own, library, text)

    any_text()


def test_table(spark, both):
    _, library = both
    for frame in (samples.table(spark, extra=True), samples.documents(spark)):
        for r in pieces.encode_decode(frame, PATH, full=True).join(frame.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").collect():
            ids = library.encode(r.text or "", add_bos=True, add_eos=True)
            assert list(r.ids) == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded == library.decode(ids) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
            data = (r.text or "").encode()
            assert b"".join(data[a:b] for a, b in r.spans) == data
    assert pieces.encode_decode(samples.table(spark), PATH).count() == len(samples.TEXTS) + 1
    assert pieces.encode_decode(samples.empty(spark), PATH).count() == 0


def test_long_texts(both):
    own, library = both
    for text in ("ab" * 500_000, " " * 500_000, "word \n" * 300_000):
        began = time.time()
        ids, _ = own.encode([text])[0]
        assert time.time() - began < 30
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.pieces[300].type = 4
    (tmp_path / "user.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Pieces(str(tmp_path / "user.model"))
