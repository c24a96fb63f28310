"""Statistics of whole texts, one pass, vectorised over Arrow batches; shared by the quality operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakeep.llm.words import Words, chunks, mix

_U = np.uint64


def _bytes(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_SYMBOL = _bytes("#*$%&|<>")
_MARK = _bytes("!?.,;:")
_UPPER, _DIGIT = _bytes("".join(map(chr, range(65, 91)))), _bytes("0123456789")
_LETTER = _UPPER | _bytes("".join(map(chr, range(97, 123))))
_BLANK = " \t\n\r\x0b\x0c"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the learned operators see; all follow from the text alone.
FEATURES = (
    "n_words", "word_length", "symbols_per_word", "exclamations_per_word", "marks_per_word", "upper_share",
    "digit_share", "dup_line_share", "repeat_word_share", "distinct_share", "adjacent_share", "words_per_line",
)


def repeated_words(words: Words, hashes: np.ndarray, n: int = 3) -> np.ndarray:
    """Of each row, how many words lie in n-word windows that its text has twice or more."""
    grams, whole = words.grams(hashes, n)
    at = np.flatnonzero(whole)
    keys = mix(grams[at] ^ (words.rows()[at].astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    start = at[counts[inverse] > 1]
    step = np.zeros(len(hashes) + n, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + n, -1)
    return words.words_per_row(np.cumsum(step)[: len(hashes)] > 0)


def _distinct(words: Words, hashes: np.ndarray, window: int = 64) -> np.ndarray:
    """Sum over each row's windows of `window` words of their distinct words; doesn't fall with length."""
    rows = words.rows()
    windows = ((np.arange(len(rows)) - words.first[rows]) // window).astype(np.uint64)
    _, first = np.unique(mix(hashes ^ mix(rows.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + windows)), return_index=True)
    return np.bincount(rows[first], minlength=len(words.first) - 1)


def _lines(text: str | None) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    lines = [x for x in (text or "").split("\n") if x.strip(_BLANK)]
    return len(lines), len(lines) - len(set(lines))


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """BASE and FEATURES of each text; all 0 for nulls and texts without words."""
    words = Words(texts)
    data, hashes = words.data, words.hashes(fold=False)
    n = np.diff(words.first).astype(np.int64)
    lead = (data & 0xC0) != 0x80
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=chars[1:])
    lengths = np.r_[0, np.cumsum(chars[words.ends] - chars[words.starts])]
    word_chars = lengths[words.first[1:]] - lengths[words.first[:-1]]
    symbols, marks, upper, digits, letters = (words.per_row(t[data]) for t in (_SYMBOL, _MARK, _UPPER, _DIGIT, _LETTER))
    loud = words.per_row(data == ord("!"))
    lines = np.array([_lines(t) for t in texts.to_pylist()], np.int64).reshape(-1, 2)
    repeats = repeated_words(words, hashes)
    next_same = np.zeros(len(hashes), bool)
    rows = words.rows()
    next_same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    some, any_chars = np.maximum(n, 1), np.maximum(word_chars, 1)
    return {
        "n_words": n, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": lines[:, 1], "n_repeat_words": repeats,
        "word_length": word_chars / some, "symbols_per_word": symbols / some, "exclamations_per_word": loud / some, "marks_per_word": marks / some,
        "upper_share": upper / np.maximum(letters, 1), "digit_share": digits / any_chars, "dup_line_share": lines[:, 1] / np.maximum(lines[:, 0], 1),
        "repeat_word_share": repeats / some, "distinct_share": _distinct(words, hashes) / some, "adjacent_share": words.words_per_row(next_same) / some,
        "words_per_line": n / np.maximum(lines[:, 0], 1),
    }


_COLUMNS = (*BASE, *FEATURES[1:])


def _run(batches):
    for batch in chunks(batches, "text"):
        got = measure(batch.column(0))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(got[c]) for c in _COLUMNS)], [*batch.schema.names[1:], *_COLUMNS])


def statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """(doc_id, carry, BASE as long, the other FEATURES as double), one row for each row of docs."""
    schema = T.StructType([*(docs.schema[c] for c in ("doc_id", *carry)), *(T.StructField(c, T.LongType() if c in BASE else T.DoubleType()) for c in _COLUMNS)])
    return docs.select(F.col("text").cast("string").alias("text"), "doc_id", *carry).mapInArrow(_run, schema)


def training_rows(sample: DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """FEATURES and labels of a bounded sample (doc_id, text, label), in an order that doesn't vary."""
    got = statistics(sample, "label").select("doc_id", "label", *FEATURES).toPandas()
    got = got.sort_values(["doc_id", *FEATURES], kind="stable")
    return {c: got[c].to_numpy(np.float64) for c in FEATURES}, got["label"].to_numpy(np.int64)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, modulus: int | None = None, fold: int | None = None, keep: bool = False) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled documents, chosen by a hash of doc_id.

    With modulus and fold, rows whose crc32(doc_id as text) mod modulus equals fold are left out
    (keep: only they stay). The ids, `most` at the utmost, are broadcast; the texts stay where they are.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    if modulus:
        held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == fold
        known = known.where(held if keep else ~held)
    total = known.count()
    if total > most:
        share = 0.98 * most / total
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    known = known.limit(most)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")


def held_out(modulus: int, fold: int):
    """Whether crc32(doc_id as text) mod modulus is fold; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == fold, F.lit(False))
