import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketloom.llm import bpe, queries
from tests.llm import samples

PATH = queries.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return bpe.ByteBPE(PATH), Tokenizer.from_file(PATH)


def test_library_agrees(spark, both):
    docs = samples.table(spark)
    own, library = both
    for frame in (docs, samples.documents(spark)):
        for r in bpe.encode_decode(frame, PATH, full=True).join(frame.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == decoded
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sabcAB<|>½²é ́日"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=60))
def test_any_text(both, text):
    own, library = both
    ids = np.frombuffer(own.encode([text])[0], "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_empty_table(spark):
    assert bpe.encode_decode(samples.empty(spark), PATH).count() == 0
