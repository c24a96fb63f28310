"""Fill-in-the-middle by a piece table (operator 13).

A batch of documents is two immutable buffers, its texts' bytes and the sentinels' bytes, and flat
arrays of descriptors (buffer, start, length). Cutting a document splits its descriptor, an
arrangement puts descriptors and sentinels in another order, the inverse arrangement puts them
back, and hashes take the described bytes one descriptor after the other: no text is copied
before an output is asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakeep.llm.words import chunks

SENTINELS = ("<P>", "<S>", "<M>")
_TEXT, _SENTINEL = 0, 1
PREFIX, SUFFIX, MIDDLE = range(3)
#: Order in which a form shows the three segments, each after its sentinel.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Order of the segments in the text.
_READING = (PREFIX, MIDDLE, SUFFIX)


@dataclass
class PieceTable:
    """Descriptors of many documents. buffers: what they refer to; first: of each document its first descriptor, with the total at the end."""

    buffers: tuple[memoryview, ...]
    buffer: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, data: memoryview, bounds: np.ndarray, more: bytes = b"") -> PieceTable:
        """One descriptor a document: document i is data[bounds[i]:bounds[i + 1]]."""
        n = len(bounds) - 1
        return cls((data, memoryview(more)), np.full(n, _TEXT), bounds[:-1].astype(np.int64), np.diff(bounds).astype(np.int64), np.arange(n + 1))

    def rows(self, chosen: np.ndarray) -> PieceTable:
        """The chosen documents alone."""
        counts = np.diff(self.first)[chosen]
        first = np.r_[0, np.cumsum(counts)]
        at = np.arange(first[-1]) + np.repeat(self.first[:-1][chosen] - first[:-1], counts)
        return PieceTable(self.buffers, self.buffer[at], self.start[at], self.length[at], first)

    def cut(self, at: np.ndarray) -> PieceTable:
        """Each document's one descriptor split before the bytes at[i, 0] <= at[i, 1] <= ... of its buffer."""
        edges = np.column_stack([self.start, at, self.start + self.length])
        n, pieces = at.shape[0], at.shape[1] + 1
        return PieceTable(self.buffers, np.repeat(self.buffer, pieces), edges[:, :-1].ravel(), np.diff(edges, axis=1).ravel(), np.arange(n + 1) * pieces)

    def permute(self, order: tuple[int, ...]) -> PieceTable:
        """Every document's descriptors in another order; each has as many as order."""
        k = len(order)
        at = (self.first[:-1, None] + np.array(order)[None, :]).ravel()
        return PieceTable(self.buffers, self.buffer[at], self.start[at], self.length[at], np.arange(len(self.first)) * k)

    def marked(self, starts: list[int], lengths: list[int]) -> PieceTable:
        """Before the j-th descriptor of each document, one of the second buffer: starts[j], lengths[j]."""
        n, k = len(self.first) - 1, len(starts)
        fill = lambda ours, theirs: np.stack([np.broadcast_to(np.array(theirs), (n, k)), ours.reshape(n, k)], axis=2).ravel()
        return PieceTable(self.buffers, fill(self.buffer, [_SENTINEL] * k), fill(self.start, starts), fill(self.length, lengths), np.arange(n + 1) * 2 * k)

    def views(self) -> Iterator[list[memoryview]]:
        """Of each document the described bytes, uncopied."""
        buffer, start, end = self.buffer.tolist(), self.start.tolist(), (self.start + self.length).tolist()
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            yield [self.buffers[buffer[k]][start[k] : end[k]] for k in range(a, b)]

    def texts(self) -> list[bytes]:
        return [b"".join(views) for views in self.views()]

    def sha256(self) -> list[str]:
        out = []
        for views in self.views():
            digest = hashlib.sha256()
            for view in views:
                digest.update(view)
            out.append(digest.hexdigest())
        return out


def _bytes(texts: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a text array and each row's bounds in them; a null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    return memoryview(body if body is not None else b""), bounds


def _lines(data: memoryview, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines of each row, positions after every newline, of each row its first of these)."""
    low, high = int(bounds[0]), int(bounds[-1])
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw[low:high] == 10) + 1 + low
    first = np.searchsorted(ends, bounds, side="right")
    open_end = np.diff(bounds) > 0
    open_end[open_end] = raw[bounds[1:][open_end] - 1] != 10
    return np.diff(first) + open_end, ends, first


def _characters(data: memoryview, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points in each span of bytes."""
    low, high = (int(starts.min()), int(ends.max())) if len(starts) else (0, 0)
    sums = np.r_[0, np.cumsum((np.frombuffer(data, np.uint8)[low:high] & 0xC0) != 0x80)]
    return sums[ends - low] - sums[starts - low]


def _cut_places(n: np.ndarray, ends: np.ndarray, first: np.ndarray, bounds: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The byte after that many lines of each row."""
    inside = (units > 0) & (units < n)
    at = np.where(units == 0, bounds[:-1], bounds[1:])
    at[inside] = ends[(first[:-1] + units - 1)[inside]]
    return at


def _transform(sentinels: tuple[str, str, str], rate: int, spm: int):
    marks = [s.encode() for s in sentinels]
    mark_at = np.r_[0, np.cumsum([len(m) for m in marks])].tolist()

    def run(batches):
        for batch in chunks(batches, "text"):
            doc_id, texts, *drawn = batch.columns[:6]
            h1, h2, h3, h4 = (np.asarray(h, dtype=np.int64) for h in drawn)
            data, bounds = _bytes(texts)
            n, ends, first = _lines(data, bounds)
            plain = (np.diff(bounds) == 0) | (h3 % 100 >= rate)
            for s in sentinels:
                plain |= np.asarray(pc.match_substring(texts, s).fill_null(False))
            form = np.where(plain, "plain", np.where(h4 % 100 < spm, "spm", "psm"))
            a, b = h1 % (n + 1), h2 % (n + 1)
            at = np.column_stack([_cut_places(n, ends, first, bounds, u) for u in (np.minimum(a, b), np.maximum(a, b))])
            table = PieceTable.of(data, bounds, b"".join(marks))
            outputs, hashes = [None] * len(n), [None] * len(n)
            for name in ("plain", *ORDERS):
                rows = np.flatnonzero(form == name)
                if not len(rows):
                    continue
                shown = table.rows(rows)
                if name != "plain":
                    order = ORDERS[name]
                    places = tuple(_READING.index(s) for s in order)
                    shown = shown.cut(at[rows]).permute(places).marked([mark_at[s] for s in order], [len(marks[s]) for s in order])
                for row, text, hash_ in zip(rows.tolist(), shown.texts(), shown.sha256()):
                    outputs[row], hashes[row] = text, hash_
            chars = [pa.array(_characters(data, x, y), pa.int64(), mask=plain) for x, y in ((bounds[:-1], at[:, 0]), (at[:, 0], at[:, 1]))]
            yield pa.RecordBatch.from_arrays(
                [doc_id, pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *chars, pa.array(outputs, pa.binary()).cast(pa.string()), pa.array(hashes, pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"],
            )

    return run


def _restore(sentinels: tuple[str, str, str], with_text: bool):
    marks = [s.encode() for s in sentinels]

    def run(batches):
        for batch in chunks(batches, "output"):
            data, bounds = _bytes(batch.column(0))
            form = np.array(batch.column(1).fill_null("plain").to_pylist(), dtype=object)
            low = int(bounds[0])
            table, raw = PieceTable.of(data, bounds), bytes(data[low : int(bounds[-1])])
            texts, hashes = [None] * len(form), [None] * len(form)
            for name in (None, *ORDERS):
                rows = np.flatnonzero(form == name if name else ~np.isin(form, list(ORDERS)))
                if not len(rows):
                    continue
                whole = table.rows(rows)
                if name:
                    order, edges = ORDERS[name], []
                    for at in (whole.start - low).tolist():
                        edges.append([])
                        for s in order:
                            at = raw.index(marks[s], at)
                            edges[-1] += [at, at := at + len(marks[s])]
                    # a sentinel, its segment and so on; then the segments alone, in the text's order
                    whole = whole.cut(np.array(edges) + low).permute(tuple(2 + 2 * order.index(s) for s in _READING))
                for row, text, hash_ in zip(rows.tolist(), whole.texts() if with_text else [None] * len(rows), whole.sha256()):
                    texts[row], hashes[row] = text, hash_
            text = [pa.array(texts, pa.binary()).cast(pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *text, pa.array(hashes, pa.string())], [*batch.schema.names[2:], *(["text"] if with_text else []), "text_sha256"])

    return run


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2 ** 32 of each document: the first groups of eight hex digits of sha256 of `seed:doc_id`."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256) of each row of (doc_id, text).

    A text is cut after whole lines, of which it has n. form: psm shows prefix, suffix, middle, and
    spm suffix, prefix, middle, each after its sentinel; plain shows the text as it is. `rate` in a
    hundred texts are cut, `spm` in a hundred of these by spm. Empty and null texts, and those that
    hold a sentinel, are plain; their prefix_chars and middle_chars are null. A null doc_id counts
    as an empty string in the draw. Repeated rows give repeated rows, an empty table an empty one,
    and other columns are left alone. One narrow pass: no row waits for another.
    """
    if len(set(sentinels)) != 3 or any(not s or "<" in s[1:] or s[0] != "<" for s in sentinels):
        raise ValueError("sentinels are three different strings with one '<', at their start: only so no text and sentinel can form another together")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *draws(F.col("doc_id").cast("long"), seed))
    columns = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
    return texts.mapInArrow(_transform(tuple(sentinels), rate, spm), columns)


def restore(outputs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, with_text: bool = True) -> DataFrame:
    """The inverse of fill_in_middle, from each row's output and form alone.

    Gives the other columns, then text (unless it isn't wanted) and text_sha256, which replace
    columns of these names. A null output is an empty text; a form that isn't psm or spm, null too,
    leaves the text as it is. An output without its form's sentinels is an error. Empty tables and
    repeated rows stay as they are.
    """
    more = [c for c in outputs.columns if c not in ("output", "form", "text", "text_sha256")]
    # mapInArrow can't take names with dots
    rows = outputs.select(F.col("output").cast("string").alias("output"), F.col("form").cast("string").alias("form"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(more)], F.col("form").alias("shown_as"))
    texts = ["text", "text_sha256"] if with_text else ["text_sha256"]
    schema = rows.drop("output", "form").select("*", *[F.lit("").alias(c) for c in texts]).schema
    return rows.mapInArrow(_restore(tuple(sentinels), with_text), schema).toDF(*more, "form", *texts)
