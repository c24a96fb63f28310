"""Fuzzy line dedup (operator 3): MinHash of character shingles, exact checks, one line per component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakeep.llm.links import band_keys, linked, multipliers
from stratakeep.llm.store import materialise, observed
from stratakeep.llm.wanted import asked_for, bitmap, bits_for
from stratakeep.llm.words import PLAIN, Words, chunks

SHINGLE, PERMUTATIONS, BAND_ROWS, LEAST_BYTES = 8, 35, 5, 1
_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Lines:
    """The lines of a text array, trimmed of ASCII white space: starts and ends in data, row, number in its row."""

    def __init__(self, texts: pa.Array):
        self.words = words = Words(texts, PLAIN)
        data = words.data
        breaks = np.flatnonzero(data == 10)
        full = np.flatnonzero(np.diff(words.row_at) > 0)
        starts = np.sort(np.r_[words.row_at[full], breaks + 1])
        # a break that ends a row opens an empty line there, in front of the next row's first
        rows = np.repeat(np.arange(len(words.row_at) - 1), np.diff(np.searchsorted(breaks, words.row_at)) + (np.diff(words.row_at) > 0))
        first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
        at = np.arange(len(rows))
        self.row, self.number = rows, at - np.maximum.accumulate(np.where(first, at, 0)) if len(rows) else at
        ends = np.r_[starts[1:], len(data)] if len(starts) else starts
        # from its first word's start to its last word's end; lines without words are empty
        low, high = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
        some = high > low
        self.starts, self.ends = starts.copy(), starts.copy()
        self.starts[some] = words.starts[low[some]]
        self.ends[some] = words.ends[high[some] - 1]

    def ids(self) -> np.ndarray:
        """A 64-bit hash of each line, case of A-Z ignored."""
        return self.words.spans(self.starts, self.ends).view(np.int64)

    def of_bytes(self, least: int) -> np.ndarray:
        return self.ends - self.starts >= least

    def body(self, k: int) -> bytes:
        return _FOLD[self.words.data[self.starts[k] : self.ends[k]]].tobytes()


def _signatures(lines: Lines, chosen: np.ndarray, shingle: int, by: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Min-max signatures of the chosen lines (one row each), about `block` shingles at a time."""
    runs = (lines.words.windows(shingle) >> _U(32)).astype(np.uint32)
    counts = lines.ends[chosen] - lines.starts[chosen] - shingle + 1
    pieces = -(-counts // block)  # a line of more shingles is cut up
    owner, first = np.repeat(np.arange(len(chosen)), pieces), np.cumsum(pieces) - pieces
    skipped = (np.arange(len(owner)) - first[owner]) * block
    starts, sizes = lines.starts[chosen][owner] + skipped, np.minimum(counts[owner] - skipped, block)
    low, high = np.empty((2, len(by), len(owner)), np.uint32)
    ends, room, k = np.cumsum(sizes), np.empty(2 * block, np.uint32), 0
    while k < len(owner):
        to = max(k + 1, int(np.searchsorted(ends, ends[k] - sizes[k] + block, side="right")))
        at = ends[k:to] - sizes[k:to] - (ends[k] - sizes[k])
        x = runs[np.arange(ends[to - 1] - ends[k] + sizes[k]) + np.repeat(starts[k:to] - at, sizes[k:to])]
        v = room[: len(x)]  # one piece of memory for all products
        for p, a in enumerate(by.ravel()):
            np.multiply(x, a, out=v)
            np.minimum.reduceat(v, at, out=low[p, k:to])
            np.maximum.reduceat(v, at, out=high[p, k:to])
        k = to
    return np.concatenate([np.minimum.reduceat(low, first, axis=1), np.maximum.reduceat(high, first, axis=1)]).T


def _signed(shingle: int, permutations: int, rows: int, least: int):
    by = multipliers(permutations, np.uint32)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in chunks(batches, "text"):
            lines = Lines(batch.column(1))
            at = np.flatnonzero(lines.of_bytes(least))
            ids = lines.ids()[at]
            _, first = np.unique(ids, return_index=True)
            first = np.sort(first[lines.of_bytes(shingle)[at[first]]])
            keys = band_keys(_signatures(lines, at[first], shingle, by), rows) if len(first) else np.zeros((0, 1), np.int64)
            has = np.zeros(len(at) + 1, np.int32)
            has[first + 1] = keys.shape[1]
            missing = np.ones(len(at), bool)
            missing[first] = False
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(has, dtype=np.int32)), pa.array(keys.ravel()), mask=pa.array(missing))
            of_row = np.bincount(lines.row[at], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lines.row[at])), pa.array(lines.number[at]), pa.array(of_row[lines.row[at]]), pa.array(ids), bands], ["doc_id", "line_no", "of", "id", "bands"])

    return run


def _bodies(least: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in chunks(batches, "text"):
            lines = Lines(batch.column(1))
            ids = lines.ids()
            at = np.flatnonzero(lines.of_bytes(least) & asked_for(wanted, ids))
            _, first = np.unique(ids[at], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at[first]]), pa.array([lines.body(k) for k in at[first]], pa.binary())], ["id", "body"])

    return run


def shingle_sets(bodies: pa.Array) -> list[np.ndarray]:
    """The sorted distinct byte-shingle hashes of each line."""
    words = Words(bodies.cast(pa.large_binary()).view(pa.large_string()))
    runs, at = words.windows(SHINGLE), words.row_at.tolist()
    return [np.unique(runs[a : max(a, b - SHINGLE + 1)]) for a, b in zip(at[:-1], at[1:])]


def line_components(docs: DataFrame, threshold: int = 80, permutations: int = PERMUTATIONS, rows: int = BAND_ROWS, least_bytes: int = LEAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Every compared line (doc_id, line_no, of, id), and (id, first_doc, first_line) of each one that has copies.

    Lines are trimmed of ASCII white space and compared without the case of A-Z; those of fewer
    than least_bytes are never copies (1: every line that isn't blank is compared). Those shorter than a shingle are one shingle, so only equal ones are
    alike, and they need no bands. Lines alike to the letter are one node; nodes are linked when
    the Jaccard index of their sets of 8-byte shingles is 0.8 or more. first_doc and first_line
    are the first place of the component, by doc_id and line_no; of is how many lines of the
    text are compared.

    35 permutations give 70 values, in 14 bands of 5: a pair at J = 0.8 shares no band with
    probability (1 - 0.8 ** 5) ** 14 = 0.4 %, one at 0.85 with 0.03 %, one at 0.9 with 1e-5. A
    node's id is a 64-bit hash; among n distinct lines n * n / 2 ** 65 pairs share one by chance.
    """
    least = max(1, least_bytes)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = texts.mapInArrow(_signed(SHINGLE, permutations, rows, least), "doc_id long, line_no long, of long, id long, bands array<long>")
    lines, about = observed(signed, "lines", keys=F.sum(F.when(F.col("bands").isNotNull(), F.size("bands"))))
    places = lines.select("doc_id", "line_no", "of", "id")

    def bodies_of(ids: DataFrame, n: int) -> DataFrame:
        wanted = bitmap(ids, F.col("id"), bits_for(n))
        found = texts.mapInArrow(_bodies(max(least, SHINGLE), wanted), "id long, body binary").dropDuplicates(["id"])
        return found.join(ids, "id", "left_semi")

    groups = linked(lines.where("bands is not null").select("id", "bands"), about["keys"] or 0, bodies_of, threshold, shingle_sets)
    nodes = places.groupBy("id").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("times"))
    copied = nodes.join(groups, "id", "left").where("times > 1 or component is not null")
    copied = materialise(copied.select("id", F.coalesce("component", "id").alias("component"), "first"), "copied")
    head = copied.groupBy("component").agg(F.min("first").alias("head"))
    return places, copied.join(head, "component").select("id", F.col("head.doc_id").alias("first_doc"), F.col("head.line_no").alias("first_line"))


def removed_lines(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_compared, removed: the numbers of the lines to drop, ascending) of documents with compared lines.

    Blank lines, null and empty texts and rows with a null doc_id have none. Of equal or alike
    lines the first place stays, by doc_id and then by line. Repeated rows of a doc_id are one
    document; where their texts differ, a line number counts if it does in either of them, and
    n_compared is that of the text with most. An empty table gives no rows.
    """
    places, copied = line_components(docs, **options)
    later = (F.col("doc_id") != F.col("first_doc")) | (F.col("line_no") != F.col("first_line"))
    dropped = places.join(copied, "id").where(later).groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    counted = places.groupBy("doc_id").agg(F.max("of").alias("n_compared"))
    return counted.join(dropped, "doc_id", "left").select("doc_id", "n_compared", F.coalesce("removed", F.array().cast("array<long>")).alias("removed"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs without the lines that aren't the first of their component; n_chars (if there) counted anew.

    Documents without a line to drop, null and empty texts and rows with a null doc_id come back
    as they were. A document may end up with an empty text.
    """
    removed = removed_lines(docs, **options).where(F.size("removed") > 0).select(F.col("doc_id").alias("removed_doc"), "removed")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = packed.join(removed, F.col("row.doc_id").cast("long") == F.col("removed_doc"), "left")
    kept = F.expr("array_join(transform(filter(transform(split(row.text, '\\n'), (x, i) -> struct(x AS x, cast(i AS long) AS i)), s -> NOT array_contains(removed, s.i)), s -> s.x), '\\n')")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(kept)
    out = joined.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
