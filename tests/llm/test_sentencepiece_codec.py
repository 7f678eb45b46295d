import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from lavka.llm import sentencepiece_codec as S

SF = "/root/testdata/sf0.001"
LETTERS = [*"ab c\n\t ,.!?'\"-_▁éß²½٣日本😀<>0x0A \x00​́ ﬁＡ①Å㍿ｶﾞ　", "  ", "the ", "ing", "</s>", "<s>", "<unk>", "   ",
           ".com", "e.g.", "▁▁", " "]


@pytest.fixture(scope="module")
def raw():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def model_with(raw, rule, **spec):
    """The model with another character map and other rules for blanks."""
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model, other = pb2.ModelProto(), pb2.ModelProto()
    model.ParseFromString(raw)
    if rule:
        other.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        model.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    for name, value in spec.items():
        setattr(model.normalizer_spec, name, value)
    return model.SerializeToString()


def texts(n):
    rng = random.Random(n)
    return ["", " ", "  ", "▁", "a" * 3000, "ab" * 200 + " " + "é" * 500] + [
        "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("rule, spec", [
    (None, {}), ("nfkc", {}), ("nmt_nfkc_cf", {"remove_extra_whitespaces": True}),
    ("nmt_nfkc", {"add_dummy_prefix": False}), (None, {"remove_extra_whitespaces": True}), (None, {"add_dummy_prefix": False}),
])
def test_same_as_the_library(raw, rule, spec):
    model = model_with(raw, rule, **spec) if rule or spec else raw
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=model), S.Codec(model)
    assert bool(codec.map.units) == bool(rule)
    for text in texts(1500):
        ids, begins, ends = codec.encode(text)
        assert ids.tolist() == library.encode(text), text
        proto = library.encode(text, return_type="proto")
        assert begins.tolist() == [p.begin for p in proto.pieces], text
        assert ends.tolist() == [p.end for p in proto.pieces], text
        assert codec.decode([*ids.tolist(), codec.end]) == library.decode([*ids.tolist(), codec.end]), text


def test_decodes_any_ids(raw):
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=raw), S.Codec(raw)
    rng = random.Random(3)
    for _ in range(1500):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_spans_tile_the_text(raw):
    codec = S.Codec(raw)
    for text in texts(300):
        ids, begins, ends = codec.encode(text)
        if text:
            assert begins[0] == 0 and ends[-1] == len(text.encode()) and (begins[1:] == ends[:-1]).all()
            assert len(ids) == len(begins)


def test_on_a_table(spark, raw, awkward, empty):
    rows = {r.doc_id: r for r in S.encode(awkward, raw).collect()}
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    for r in awkward.where("doc_id <> 10").collect():
        assert rows[r.doc_id].ids == library.encode(r.text or "")
    back = S.decode(S.encode(awkward, raw), raw).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in awkward.collect())
    assert S.encode(empty, raw).collect() == [] and S.round_trips(empty, raw).collect() == []


def test_query_against_the_library(spark, raw, tables):
    from lavka.llm.queries import op1_sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    found = {r.doc_id: r for r in op1_sentencepiece(spark, SF).collect()}
    docs = tables.execute("select doc_id, text from documents").fetchall()
    assert len(found) == len(docs)
    for doc_id, text in docs:
        ids = [*library.encode(text or ""), library.eos_id()]
        r = found[doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_other_models_are_refused(raw):
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb2.ModelProto()
    model.ParseFromString(raw)
    model.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        S.Codec(model.SerializeToString())
