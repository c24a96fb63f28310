"""Token ids of whole documents by a public tokenizer, and their way through packed files (operator 6)."""

from __future__ import annotations

import gc
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakeep.llm.store import new_path
from stratakeep.llm.token_files import read_tokens, write_tokens
from stratakeep.llm.words import chunks

#: str.split() also splits at these; texts with any of them are split at ASCII white space alone.
_OTHER_BLANKS = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_PIECE = re.compile(r"[^ \t\n\r\x0b\x0c]+")
#: Letters whose lower case is one letter and which no normal form changes, then marks: two pre-tokens at most.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_MOST_KNOWN = 150_000
_open: dict = {}


def id_bytes(vocabulary: int) -> str:
    """numpy type of ids on their way to the files."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class Memory(dict):
    """What `make` gives for a key, remembered: at most about 2 * most entries, those asked for lately."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def age(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


#: Words by which the model alone is held against the whole tokenizer.
_PROBES = ("a", "the", "zebra", "été", "straße", "ñandú", "onharent", "...", "!!", "&&&", "#$%", "qqqq", "über|")


def _alphabet() -> dict[int, str]:
    """The characters by which byte-level tokenizers write bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_ALPHABET = _alphabet()


def _tokenizer(path: str):
    """The tokenizer, loaded once in a Python worker, and its model's own splitting of a word, if that does the same."""
    if path not in _open:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        split = tokenizer.model.tokenize

        def same(word: str) -> bool:
            parts = [p for p in _PLAIN.fullmatch(word).groups() if p] if _PLAIN.fullmatch(word) else [word]
            alone = [t.id for p in parts for t in split(p.encode().decode("latin-1").translate(_ALPHABET))]
            return alone == tokenizer.encode(word, add_special_tokens=False).ids

        _open.clear()
        _open[path] = tokenizer, split if all(map(same, _PROBES)) else None
    return _open[path]


class Encoder:
    """Ids of texts, piece by piece.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    pieces between ASCII white space. Pieces recur, and the words inside them more so; the ids of
    both are remembered, up to a bound. A new word of plain letters, or run of marks, is one
    pre-token, so the tokenizer's model alone splits it.
    """

    def __init__(self, path: str, dtype: str):
        (self.tokenizer, self.split), self.dtype = _tokenizer(path), dtype
        self.code = {"<u2": "H", "<u4": "I"}[dtype]
        self.pieces, self.words = Memory(self._piece, _MOST_KNOWN), Memory(self._word, 2 * _MOST_KNOWN)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        ids = [t.id for t in self.split(word if word.isascii() else word.encode().decode("latin-1").translate(_ALPHABET))]
        return array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        m = self.split and _PLAIN.fullmatch(piece)
        if not m:
            return self._whole(piece)
        word, marks = m.groups()
        return self.words[word.lower()] + self.words[marks] if marks else self.words[word.lower()]

    def __call__(self, texts: list[str | None], end_id: int) -> list[bytes]:
        """ids of each text in dtype, with end_id after them."""
        self.pieces.age()
        self.words.age()
        split = (_PIECE.findall(t) if _OTHER_BLANKS.search(t) else t.split() for t in (x or "" for x in texts))
        end, known = np.array([end_id], self.dtype).tobytes(), self.pieces.__getitem__
        return [b"".join(map(known, pieces)) + end for pieces in split]


def _encode(path: str, dtype: str, end_id: int):
    def run(batches):
        encoder = Encoder(path, dtype)  # what it remembers goes with the task, as workers are kept
        gc.disable()  # many small objects and no cycles
        try:
            for batch in chunks(batches, "text"):
                ids = encoder(batch.column(1).to_pylist(), end_id)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), *batch.columns[2:]], ["doc_id", "ids", *batch.schema.names[2:]])
        finally:
            gc.enable()

    return run


def encode(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int = 1, order: str = "doc_id") -> DataFrame:
    """(doc_id, ids as binary) of each document, and its column `order` (long) if that is another; null and empty texts have the end id alone.

    ids are unsigned little-endian, of two bytes for vocabularies of up to 65536 and else of four.
    """
    more = [] if order == "doc_id" else [order]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return texts.mapInArrow(_encode(tokenizer, id_bytes(vocabulary), end_id), ", ".join(["doc_id long, ids binary", *(f"`{c}` long" for c in more)]))


def digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_tokens gives."""
    return tokens.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def tokenise_to_files(docs: DataFrame, tokenizer: str, vocabulary: int, path: str | None = None, end_id: int = 1, order: str = "doc_id") -> DataFrame:
    """Encode docs, write them to packed files under `path` (by default a new shared folder), ascending in the column `order`, and read those back.

    The texts are encoded once, on their way to the shuffle that orders them.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(encode(docs, tokenizer, vocabulary, end_id, order), docs.select(F.col(order).cast("long").alias(order)), path, vocabulary, id_bytes(vocabulary), order)
    return read_tokens(spark, path)
