"""Sentence pieces against the library: ids, texts, odd characters, very long stretches."""

import random

import cases
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from textpairs.llm import catalogue
from textpairs.llm.sentence_pieces import MODEL, PieceModel, encode_pieces

PATH = public_tokenizers.path(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return PieceModel(open(PATH, "rb").read(), cached=300)


def ids_of(model, text):
    return np.frombuffer(model.encode(text), np.int32)


def same(model, library, text):
    ids = ids_of(model, text)
    want = library.encode(text, add_bos=True, add_eos=True)
    assert ids.tolist() == want, text[:80]
    assert model.decode(ids, np.array([0, len(ids)])) == [library.decode(want)]


@given(
    st.text(max_size=60)
    | st.text("ab ▁", max_size=80)
    | st.text("the in an er\n\t", max_size=120)
    | st.text("aé́ 日本\U0001f600<s>0x41\0", max_size=60)
)
@settings(max_examples=600, deadline=None)
def test_ids_are_the_library_s(model, library, text):
    same(model, library, text)


@pytest.mark.parametrize("text", ["", " ", "▁", "<s>", "</s> <0x41>", "\0", "﻿ a", "a" * 5000, " " * 3001, "ab" * 3000, "日本語" * 900, "x \n" * 999])
def test_particular_texts(model, library, text):
    same(model, library, text)


def test_runs_of_blanks(model, library):
    """Pieces of blanks have all the same score, so the leftmost merge decides."""
    for n in range(1, 80):
        for text in (" " * n, " " * n + "a", "b" + " " * n, "a" + " " * n + "the", "\n" + " " * n + "."):
            same(model, library, text)


def test_texts_of_any_ids(model, library):
    rng = random.Random(6)
    rows = [[rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(180, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(9))] for _ in range(3000)]
    ends = np.cumsum([0, *map(len, rows)])
    found = model.decode(np.array([i for r in rows for i in r], np.int32), ends)
    assert found == [library.decode(r) for r in rows]


def test_every_place_is_given_up_once(library):
    """A stretch that leads the longest matches astray takes steps in proportion to its length."""
    own = PieceModel(open(PATH, "rb").read())
    tries = []
    fits = own._fits
    own._fits = lambda last, token: tries.append(1) or fits(last, token)
    own.pairs = type("Never", (dict,), {"get": lambda self, key: None})()
    text = "".join(random.Random(7).choices("aeinrst", k=4000))
    tokens = own.segment("▁" + text)
    assert tokens == library.encode(text) and len(tries) < 20 * len(text)


def test_other_models_are_refused():
    proto = sentencepiece_model_pb2.ModelProto.FromString(open(PATH, "rb").read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError, match="without normalisation"):
        PieceModel(proto.SerializeToString())


def test_op12_query(spark, sf_dir, library):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want[r.doc_id] = (len(ids), cases.sha(np.array(ids, "<u4").tobytes()), cases.sha(library.decode(ids)))
    assert {r[0]: tuple(r)[1:] for r in catalogue.QUERIES["op12_sentence_pieces"](spark, sf_dir).collect()} == want


def test_rows(spark, library):
    rows = [*cases.texts().items(), (None, "no id"), (None, None), (4, "repeated id"), (4, "repeated id")]
    for clashing in (False, True):
        found = encode_pieces(cases.documents(spark, clashing=clashing, rows=rows)).collect()
        got = sorted((repr(r.doc_id), r.n_tokens, r.ids, r.decoded) for r in found)
        each = ((i, library.encode(t or "", add_bos=True, add_eos=True), t or "") for i, t in rows)
        assert got == sorted((repr(i), len(ids), ids, text) for i, ids, text in each)
    packed = encode_pieces(cases.documents(spark, rows=rows[:4]), packed=True).collect()
    assert all(np.frombuffer(r.ids, "<u4").tolist() == library.encode(dict(rows[:4])[r.doc_id] or "", add_bos=True, add_eos=True) for r in packed)
    assert encode_pieces(cases.documents(spark, rows=[])).count() == 0


def test_stretches_are_encoded_like_the_whole(model, library):
    """Texts are cut between letters and other characters; without the cuts the ids are the same."""
    import re

    whole = PieceModel(open(PATH, "rb").read())
    assert "(?!" in whole.stretches.pattern
    whole.stretches = re.compile("(?s).+")
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choices("the in  ▁²³½x.,)(\n|#é1日本-'’", k=rng.randrange(60)))
        assert whole.encode(text) == model.encode(text)
        same(model, library, text)
