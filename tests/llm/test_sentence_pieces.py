"""Ids and texts against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from stratakeep.llm.sentence_pieces import Encoder, Model, decode, encode, load, round_trip

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids_of(encoder, texts):
    return [np.frombuffer(b, "<u4").tolist() for b in encoder(pa.array(texts, pa.string()))]


ALPHABETS = ["abcdefgh", "thenaiosr ", "  ▁a", "ab", "aaab", "éèüß漢字mn", "0123456789,.", "\n\t x", "()[]{}->=_*/#", "\U0001f600\u0000­　"]


def test_random_texts(library):
    rng, encoder = random.Random(5), Encoder(load(PATH))
    texts = ["".join(rng.choices("".join(rng.sample(ALPHABETS, rng.randint(1, 3))), k=rng.randint(0, 300))) for _ in range(2000)]
    pieces = [library.id_to_piece(k) for k in range(259, library.get_piece_size())]
    texts += ["".join(rng.choices(pieces, k=rng.randint(1, 30))) for _ in range(2000)]
    got = ids_of(encoder, texts)
    assert got == library.encode(texts, add_bos=True, add_eos=True)
    assert [t.decode() for t in encoder.model.decode([np.array(r, np.uint32) for r in got])] == library.decode(got)


def test_merges_that_stir_their_neighbours(library):
    """Repeated patterns, where a merge makes a pair of a better rank than its own, and long words without a blank."""
    rng, encoder = random.Random(6), Encoder(load(PATH))
    restless = [library.id_to_piece(k) for k in np.flatnonzero(encoder.model.restless[: library.get_piece_size()]).tolist() if k > 258]
    texts = [p * n for p in rng.sample(restless, 300) for n in (2, 3, 9)] + ["".join(rng.choices(restless[:40], k=60)).replace("▁", "") for _ in range(200)]
    texts += ["ab" * 20_000, "a" * 30_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=50_000)), " " * 40_000 + "t"]
    assert ids_of(encoder, texts) == library.encode(texts, add_bos=True, add_eos=True)


def test_runs_of_blanks(library):
    encoder = Encoder(load(PATH))
    texts = [before + " " * n + after for n in [*range(100), 1000, 1001] for before in ("", "a", "\n") for after in ("", "t", "tx y", "é")]
    assert encoder.model.step == 16
    assert ids_of(encoder, texts) == library.encode(texts, add_bos=True, add_eos=True)


def test_any_ids_decode_as_in_the_library(library):
    rng, model = random.Random(7), load(PATH)
    rows = [[rng.randrange(3, 259) if rng.random() < 0.6 else rng.randrange(32_000) for _ in range(rng.randint(0, 40))] for _ in range(1000)]
    assert [t.decode() for t in model.decode([np.array(r, np.uint32) for r in rows])] == [library.decode(r) if r else "" for r in rows]
    with pytest.raises(ValueError):
        model.decode([np.array([32_000], np.uint32)])


def test_words_are_forgotten(library, monkeypatch):
    import stratakeep.llm.sentence_pieces as sp

    monkeypatch.setattr(sp, "_MOST_WORDS", 10)
    monkeypatch.setattr(sp, "_MERGE_BYTES", 20)
    encoder, texts = Encoder(load(PATH)), [f"word{k} and other{k} words" for k in range(50)]
    for text in texts:
        assert ids_of(encoder, [text, None, ""]) == [library.encode(t, add_bos=True, add_eos=True) for t in (text, "", "")]


def test_round_trip_of_documents(spark, odd, library):
    got = sorted((tuple(r) for r in round_trip(odd, PATH).collect()), key=str)
    want = []
    for r in odd.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert round_trip(odd.where("false"), PATH).count() == 0


def test_decode_keeps_other_columns(spark, odd):
    rows = encode(odd, PATH).selectExpr("*", "1 AS text", "2 AS `a.b`")
    assert decode(rows, PATH).columns == ["doc_id", "a.b", "text"]
    assert decode(spark.createDataFrame([(None,)], "ids binary"), PATH).first().text == ""


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        Model(str(tmp_path / "none.model"))
