"""SentencePiece encoding, spans and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import pieces

PATH = P.path("piece_bpe_32k.model")
SIGNS = [" ", "  ", "\n", "\t", "a", "the", "ing", "é", "日本", "▁", "\U0001f600", "<s>", "<0x41>", "</s>", "<unk>", "1", "...", "\x00", "\x85", "​", "  \n ", "x" * 30, "ﬁ", "Ⅳ", "́", "％", "ｶﾞ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def _texts(n=1500):
    rng = random.Random(1)
    return ["".join(rng.choices(SIGNS, k=rng.randint(0, 30))) for _ in range(n)] + ["", "a" * 5000, " " * 3000, "ab" * 4000, "word " * 20000, "\n" * 50]


def _same(model, library, texts):
    for text, (ids, spans) in zip(texts, model.encode(texts), strict=True):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want, text
        assert model.decode(ids) == library.decode(want), text
        assert spans[1:-1].tolist() == [[p.begin, p.end] for p in library.encode(text, return_type="proto").pieces], text
        assert spans[0].tolist() == [0, 0] and spans[-1].tolist() == [len(text.encode())] * 2


def test_as_the_library(library):
    _same(pieces.pieces(PATH), library, _texts())
    # few parts remembered: forgetting changes nothing
    _same(pieces.Pieces(PATH, most=40), library, _texts(100))


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    _same(pieces.pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH), [text])


def test_decode_any_ids(library):
    rng, model = random.Random(4), pieces.pieces(PATH)
    for _ in range(1500):
        ids = [rng.choice([rng.randint(0, 300), rng.randint(0, 31999)]) for _ in range(rng.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids), ids
    with pytest.raises(ValueError, match="none of"):
        model.decode([32000])


@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("rule", ["nmt_nfkc", "identity"])
def test_normalisation_with_offsets(rule, squeeze):
    """The compiled map of a standard rule: texts and the source of every character as in the library."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=squeeze, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    model = pieces.sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    own = pieces.Normalizer(model.normalizer_spec)
    assert (len(own.map) > 200_000) == (rule != "identity")
    for text in _texts(400):
        want, offsets = library.Normalize(text, with_offsets=True)
        starts = pieces._byte_starts(text)
        got, source = own(text)
        assert got == want, text
        # the library gives offsets of an empty text as it likes
        assert not text or source.tolist() == [int(starts[i]) for i in offsets], text


def test_operators(spark, library):
    texts = [*_texts(300), None]
    df = spark.createDataFrame([(i, t, "clash", "x", 1) for i, t in enumerate(texts)] + [(None, "no id", "c", "x", 2), (3, texts[3], "c", "x", 3)], "doc_id long, text string, ids string, pieces string, id int")
    encoded = pieces.encode(df, PATH)
    for r in encoded.collect():
        text = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        assert [p.id for p in r.pieces] == library.encode(text, add_bos=True, add_eos=True)
        # spans lie on end, from the text's first byte to its last
        assert [p.begin for p in r.pieces][1:] == [p.stop for p in r.pieces][:-1] and r.pieces[-1].stop == len(text.encode())
    back = pieces.decode(encoded.selectExpr("doc_id", "pieces.id AS ids"), PATH)
    assert {r.doc_id: r.text for r in back.where("doc_id is not null").collect()} == {i: library.decode(library.encode(t or "")) for i, t in enumerate(texts)}
    for r in pieces.round_trip(df, PATH).where("doc_id is not null").collect():
        ids = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.round_trip(df, PATH).count() == len(texts) + 2
    assert pieces.round_trip(df.limit(0), PATH).isEmpty() and pieces.encode(df.limit(0), PATH).isEmpty()
