"""Benchmark decontamination by a generalised suffix automaton of the test items (operator 1)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakeep.llm.store import materialise
from stratakeep.llm.words import ALNUM, Words, chunks

#: Words of test items in one automaton; larger benchmarks take one more job for each such shard.
SHARD_WORDS = 200_000


class SuffixAutomaton:
    """All substrings of several word sequences, as one automaton.

    follow: transitions by word number; link, length: suffix links and longest strings of states.
    """

    def __init__(self):
        self.follow, self.link, self.length = [{}], [-1], [0]

    def _state(self, length: int, follow: dict, link: int) -> int:
        self.follow.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the strings that come through p; returns it."""
        clone = self._state(self.length[p] + 1, dict(self.follow[q]), self.link[q])
        while p >= 0 and self.follow[p].get(w) == q:
            self.follow[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.follow[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.follow[p]:
            self.follow[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.follow[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def add(self, sequence: list[int]) -> None:
        last = 0
        for w in sequence:
            last = self._extend(last, w)


class Index:
    """The automaton of one shard of items, and the windows that end in each state."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        words = Words(pa.array([text for _, text in items], pa.large_string()), ALNUM)
        self.vocabulary, numbers = np.unique(words.hashes(), return_inverse=True)
        sequences = [numbers[a:b].tolist() for a, b in zip(words.first[:-1], words.first[1:])]
        self.window, self.automaton = window, SuffixAutomaton()
        for s in sequences:
            self.automaton.add(s)
        auto = self.automaton
        self.least = min((min(len(s), window) for s in sequences if s), default=0)
        self.items: list[set[str]] = [set() for _ in auto.link]  # of window-long strings
        self.short: list[dict[int, set[str]]] = [{} for _ in auto.link]
        for (name, _), s in zip(items, sequences):
            at = 0
            for k, w in enumerate(s):
                at = auto.follow[at][w]
                if k + 1 >= window:
                    self.items[self._at(at, window)].add(name)
            if 0 < len(s) < window:
                self.short[self._at(at, len(s))].setdefault(len(s), set()).add(name)
        self.any_short = [False] * len(auto.link)
        for v in sorted(range(1, len(auto.link)), key=auto.length.__getitem__):
            self.any_short[v] = bool(self.short[v]) or self.any_short[auto.link[v]]

    def _at(self, v: int, length: int) -> int:
        """The state of the suffix of this length of v's strings."""
        while self.automaton.length[self.automaton.link[v]] >= length:
            v = self.automaton.link[v]
        return v

    def stream(self, numbers: list[int], hit, base: int, found: set[str]) -> None:
        """Follow the longest match over a run of words; mark hit words from `base` on, add items found."""
        follow, link, length = self.automaton.follow, self.automaton.link, self.automaton.length
        v = match = 0
        for k, w in enumerate(numbers):
            to = follow[v].get(w)
            while to is None and v:
                v = link[v]
                match = length[v]
                to = follow[v].get(w)
            v, match = (0, 0) if to is None else (to, match + 1)
            if match >= self.window:
                found |= self.items[self._at(v, self.window)]
                hit[base + k + 1 - self.window : base + k + 1] = True
            if match and self.any_short[v]:
                u = v
                while u > 0:
                    for n, names in self.short[u].items():
                        if n <= match:
                            found |= names
                            hit[base + k + 1 - n : base + k + 1] = True
                    u = link[u]

    def rows(self, words: Words):
        """Of each row: the boolean array of its hit words and the items found, or None for neither."""
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        total = np.r_[0, np.cumsum(known)]
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if total[b] - total[a] < self.least:
                yield None
                continue
            inside = np.r_[False, known[a:b], False]
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            hit, found = np.zeros(b - a, bool), set()
            for s, e in edges.reshape(-1, 2):
                if e - s >= self.least:
                    self.stream(at[a + s : a + e].tolist(), hit, int(s), found)
            yield (hit, found) if found else None


_built: dict = {}


def _index(shard, window: int) -> Index:
    """One index for each shard in a Python worker, whatever number of tasks it runs."""
    name, items = shard.value
    if (name, window) not in _built:
        _built.clear()
        _built[name, window] = Index(items, window)
    return _built[name, window]


def _shards(benchmark: DataFrame) -> Iterator[Broadcast]:
    """The items as broadcasts of at most about SHARD_WORDS words (an item over that is one alone), each made when it is asked for."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    # a word takes two bytes at least with its end, so this counts no fewer words than there are
    size = items.agg(F.coalesce(F.sum((F.octet_length("text") + 1) / 2), F.lit(0.0)).alias("words")).first().words
    n = int(size // SHARD_WORDS) + 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        yield benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r.item, r.text) for r in part.collect()]))


def _scan(shard: Broadcast, window: int, every: bool):
    """Batches (row or doc_id, text, ...) with spans and items behind them; every: also of rows without a match."""

    def run(batches):
        index = _index(shard, window)
        for batch in chunks(batches, "text"):
            got = list(index.rows(Words(batch.column(1), ALNUM))) if index.least else [None] * batch.num_rows
            at = list(range(len(got))) if every else [k for k, g in enumerate(got) if g is not None]
            if not at:
                continue
            spans = [np.flatnonzero(np.diff(np.r_[0, got[k][0].view(np.int8), 0])).reshape(-1, 2).tolist() if got[k] else [] for k in at]
            items = [sorted(got[k][1]) if got[k] else [] for k in at]
            kept = batch if every else batch.select([batch.schema.names[0]]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(spans, _SPANS), pa.array(items, _ITEMS)], [*kept.schema.names, "spans", "items"])

    return run


_SPANS, _ITEMS = pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())
_FOUND = "spans array<array<bigint>>, items array<string>"


def _union(parts: list[list[list[int]]]) -> list[list[int]]:
    """Spans of several lists as one list of spans that don't touch."""
    out: list[list[int]] = []
    for a, b in sorted(x for part in parts for x in part):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _merged(batches):
    """Rows (spans and items of each shard, the rest) with those of all shards together, behind the rest."""
    for batch in batches:
        spans = [_union(x or []) for x in batch.column(0).to_pylist()]
        items = [sorted({i for part in x or [] for i in part}) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(spans, _SPANS), pa.array(items, _ITEMS)], [*batch.schema.names[2:], "spans", "items"])


def _with_matches(docs: DataFrame, benchmark: DataFrame, window: int, then: Callable, schema: str | T.StructType) -> DataFrame:
    """docs (doc_id, text, ...) through `then`, which takes batches of them with spans and items behind.

    One shard of items is one narrow pass. More of them are jobs one after the other, each of which
    writes the rows it found something in, so that a worker holds one shard's index whatever the
    number of shards; these rows, few of them, are then joined to the documents.
    """
    shards = _shards(benchmark)
    first = next(shards)
    second = next(shards, None)
    if second is None:
        return docs.mapInArrow(_chained([_scan(first, window, True), then]), schema)
    base, hits = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "documents"), []
    for shard in chain((first, second), shards):
        hits.append(materialise(base.select("_row", "text").mapInArrow(_scan(shard, window, False), f"_row long, {_FOUND}"), "matches"))
        shard.destroy()
    found = reduce(DataFrame.unionByName, hits).groupBy("_row").agg(F.collect_list("spans").alias("_spans"), F.collect_list("items").alias("_items"))
    joined = base.join(found, "_row", "left").select("_spans", "_items", *docs.columns)
    return joined.mapInArrow(_chained([_merged, then]), schema)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs (doc_id, text) with spans (word numbers [from, to) of the hit words) and items (their ids, sorted).

    A window is `window` consecutive words of an item, or all of an item of fewer; words are runs
    of letters, digits and non-ASCII characters with A-Z in lower case. Null texts, and items of
    no words, have no windows. Repeated rows are matched each, empty tables give empty ones.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([*texts.schema, T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))])
    return _with_matches(texts, benchmark, window, iter, schema)


def _chained(steps: list):
    """Several passes over batches as one, so that a task needs one Python worker."""

    def run(batches):
        for step in steps:
            batches = step(batches)
        yield from batches

    return run


def _digest(batches):
    for batch in chunks(batches, "text"):
        words = Words(batch.column(1), ALNUM)
        spans, items = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        hit = [sum(e - s for s, e in x) for x in spans]
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(words.first), pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array([n > 0 for n in hit])], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; nulls and empty texts have none of these."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return _with_matches(texts, benchmark, window, _digest, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _cleaned(max_coverage: float):
    def run(batches):
        for batch in chunks(batches, "text"):
            words = Words(batch.column(1), ALNUM)
            texts, verdicts = [], []
            for k, spans in enumerate(batch.column(batch.num_columns - 2).to_pylist()):
                a, b = int(words.first[k]), int(words.first[k + 1])
                if not spans:
                    texts.append(batch.column(1)[k].as_py())
                    verdicts.append(False)
                    continue
                pieces, at, end = [], int(words.row_at[k]), int(words.row_at[k + 1])
                for s, e in spans:
                    pieces.append(words.data[at : words.starts[a + s]].tobytes())
                    at = int(words.ends[a + e - 1])
                pieces.append(words.data[at:end].tobytes())
                texts.append(b"\n".join(p for p in (x.strip() for x in pieces) if p).decode())
                verdicts.append(sum(e - s for s, e in spans) > max_coverage * (b - a))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(verdicts), *batch.columns[2:-2]], ["text", "drop", *batch.schema.names[2:-2]])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """docs with the spans of matched words cut out of text, and n_chars (if there) counted anew.

    A match of `window` words or more is over the length limit and is cut; a document of which
    more than max_coverage of the words matched is over the coverage limit and is removed whole.
    Documents without a match come back as they were, in all columns; null texts have none.
    Repeated rows are cleaned each, empty tables give empty ones.
    """
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    schema = T.StructType().add("text", "string").add("drop", "boolean").add("row", packed.schema["row"].dataType)
    kept = _with_matches(packed, benchmark, window, _cleaned(max_coverage), schema).where(~F.col("drop"))
    columns = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    out = kept.select(*columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
