import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratakeep.llm.token_files import ShardReader, ShardWriter, bits_for, pack, unpack
from stratakeep.llm.tokenise import Encoder, digest, tokenise_to_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 32), st.integers(0, 100), st.integers(0, 1 << 30))
def test_pack_round_trip(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
    packed = pack(ids, bits)
    assert len(packed) == -(-n * bits // 8) and (unpack(packed, n, bits) == ids).all()


def test_bits():
    assert [bits_for(n) for n in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_random_access():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << 13, n).astype(np.uint32) for n in (0, 5, 3000, 1, 700_000, 0)]
    sink = io.BytesIO()
    writer = ShardWriter(sink, 13, block=64)
    for k, d in enumerate(docs):
        writer.add(k or None, d)
    writer.close()
    reader, flat = ShardReader(sink), np.concatenate(docs)
    assert all((reader.document(k) == d).all() for k, d in enumerate(docs))
    for a, b in ((0, 1), (63, 65), (64, 128), (12_345, 600_001), (len(flat) - 1, len(flat)), (5, 5)):
        assert (reader.ids(a, b) == flat[a:b]).all()
    with pytest.raises(ValueError):
        writer.add(1, np.array([1 << 13], np.uint32))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("aBé'sÀÿİ,.!?&1 \n\x1c  ́<|>endoftx", max_size=25), max_size=5))
def test_pieces_are_the_whole(texts):
    e = Encoder(PATH, "<u2")
    texts = [*texts, "x<|endoftext|>y I'll don't", "The the THE the, the. &&& a&&b 42"]
    got = e(texts, 1)
    assert got == [np.array([*e.tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u2").tobytes() for t in texts]


def test_files(spark, odd):
    rows = odd.select("doc_id", "text").collect()
    got = digest(tokenise_to_files(odd, PATH, 49_408)).collect()
    e = Encoder(PATH, "<u4")
    ids = lambda t: e([t], 1)[0]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(r.doc_id), len(ids(r.text)) // 4, zlib.crc32(ids(r.text))) for r in rows)
    got.sort(key=lambda r: r.start)
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert tokenise_to_files(odd.limit(0), PATH, 49_408).count() == 0


def test_folders_are_what_spark_takes_them_for(spark):
    """A path without a scheme is on Spark's default file system, for Arrow too."""
    from stratakeep.llm.token_files import uri_of

    conf = spark._jsc.hadoopConfiguration()
    assert uri_of(spark, "/tmp/x") == "file:///tmp/x" == uri_of(spark, "file:/tmp/x") == uri_of(spark, "file:///tmp/x")
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "viewfs://c/")
        conf.set("fs.viewfs.mounttable.c.link./d", "file:///tmp")
        assert uri_of(spark, "/d/x") == "viewfs://c/d/x"
    finally:
        conf.set("fs.defaultFS", before)


def test_ranges_of_many_bounds(spark):
    from stratakeep.llm.token_files import _range_of

    for n in (0, 1, 64, 65, 1000):
        bounds = sorted({k * k % 7919 for k in range(n)})
        got = spark.range(-5, 8000, 13).select("id", _range_of(F.col("id"), bounds).alias("r")).collect()
        assert all(r.r == sum(b < r.id for b in bounds) for r in got)
