"""Phrase collocations by HAT-trie counting (operator 11).

Every task counts word sequences in a burst trie: first words lead to hash containers, and a
container that grows too large bursts into a node by ranges of second words. When the trie holds too much,
whole subtrees, the largest first, are spilled as sorted runs of (phrase, count). The runs of all
tasks are a table, whose rows are merged by ranges of phrases, that is by intervals of the sorted
trie: a range may begin inside a prefix, so that a prefix which very many phrases share is spread.

The texts are read twice. A phrase that occurs `least` times has only parts that do, so a first pass
adds up hashes of words and of what two and three of them make, and the second counts phrases that
have no such part whose hash is too rare. What is frequent goes to the tasks as a bitmap of bounded size; what
it lets through by chance is counted exactly and then dropped, so nothing depends on it but time.

A phrase leaves every counting task that meets it. So the second pass takes the table's partitions
together, into as few tasks as keep all cores busy or more where these would have too much text: the
runs then follow the phrases there are, not phrases times partitions.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from stratakeep.llm.store import discard, materialise, observed
from stratakeep.llm.wanted import asked_for, bitmap, bits_for
from stratakeep.llm.words import _FOLD, Words, chunks, mix

#: Bytes that end a piece: .,;:!? and line ends; blanks and tabs end words alone.
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_IS_WORD = ~_ENDS
_IS_WORD[[0x20, 0x09]] = False

_BITS = 20  # of a word's number within a task; 0 is no word
_MASK = (1 << _BITS) - 1
_RANGE = 2 * _BITS + 8  # 256 second words share a container: most have few sequences, and a dict for each takes more than they do
#: Entries of one container, of a task's trie, and bytes of text taken at once.
BURST, MOST_ENTRIES, _BATCH = 4096, 1_000_000, 1 << 20
#: Entries of one sorted run, about.
_RUN_ENTRIES = 100_000
#: Bytes of words that a task numbers before it starts anew, and hashes that it adds up at once.
_WORD_BYTES, _HASHES = 1 << 24, 1 << 20
#: Bytes of text of one counting task, where one for each core would have more.
_TASK_BYTES = 1 << 28
_U = np.uint64


class Node(dict):
    """A burst container: range of second words -> container of what begins with one of them."""


class HatTrie:
    """Counts of sequences (first, rest): first is any number, rest packs up to three words of _BITS bits, the second highest."""

    def __init__(self, burst: int = BURST):
        self.burst, self.root, self.sizes, self.size = burst, {}, {}, 0

    def add(self, first: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> None:
        """Add counts; the sequences are distinct and sorted."""
        edges = np.flatnonzero(np.r_[True, first[1:] != first[:-1], True]) if len(first) else []
        rests, numbers = rest.tolist(), counts.tolist()
        for f, a, b in zip(first[edges[:-1]].tolist() if len(first) else [], edges[:-1], edges[1:]):
            tree = self.root.get(f)
            if tree is None:
                tree = self.root[f] = {}
            grown = 0
            if type(tree) is Node:
                for k in range(a, b):
                    container = tree.setdefault(rests[k] >> _RANGE, {})
                    had = container.get(rests[k])
                    container[rests[k]] = numbers[k] + (had or 0)
                    grown += had is None
            else:
                had = len(tree)
                for k in range(a, b):
                    tree[rests[k]] = tree.get(rests[k], 0) + numbers[k]
                grown = len(tree) - had
                if len(tree) > self.burst:
                    node = self.root[f] = Node()
                    for key, n in tree.items():
                        node.setdefault(key >> _RANGE, {})[key] = n
            self.sizes[f] = self.sizes.get(f, 0) + grown
            self.size += grown

    def spill(self, keep: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take out whole subtrees, the largest first, until at most `keep` entries are left: (first, rest, count) of theirs."""
        firsts, rests, counts = [], [], []
        for f in sorted(self.sizes, key=self.sizes.__getitem__, reverse=True):
            if self.size <= keep:
                break
            tree, n = self.root.pop(f), self.sizes.pop(f)
            self.size -= n
            firsts.append(np.full(n, f, np.int64))
            for container in tree.values() if type(tree) is Node else (tree,):
                rests.append(np.fromiter(container.keys(), np.int64, len(container)))
                counts.append(np.fromiter(container.values(), np.int64, len(container)))
        none = [np.zeros(0, np.int64)]
        return tuple(np.concatenate(x or none) for x in (firsts, rests, counts))


def distinct(first: np.ndarray, rest: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (first, rest) and the sums of their counts (of ones)."""
    order = np.lexsort((rest, first))
    first, rest = first[order], rest[order]
    at = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])]) if len(first) else np.zeros(0, np.int64)
    ends = np.r_[at[1:], len(first)] if len(at) else at
    sums = ends - at if counts is None else np.add.reduceat(counts[order], at) if len(at) else at
    return first[at], rest[at], sums


class _Text:
    """Words of a batch: their numbers within the task, and which stand next to each other in one piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        w = self.words = Words(texts, _IS_WORD)
        self.rows = w.rows()
        langs = langs.fill_null("und").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang_of_word = np.asarray(langs.indices)[self.rows] if len(self.rows) else np.zeros(0, np.int64)
        ended = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(_ENDS[w.data], out=ended[1:])
        self.next = np.zeros(len(w.starts), bool)  # the next word follows in the same piece
        if len(w.starts) > 1:
            self.next[:-1] = (ended[w.starts[1:]] == ended[w.ends[:-1]]) & (self.rows[1:] == self.rows[:-1])

    def spelt(self, wanted: np.ndarray) -> pa.DictionaryArray:
        """The wanted words as bytes, A-Z in lower case."""
        w = self.words
        offsets = np.r_[0, np.cumsum(w.ends - w.starts)].astype(np.int64)
        data = _FOLD[w.data[_IS_WORD[w.data]]]
        words = pa.Array.from_buffers(pa.large_binary(), len(w.starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return words.filter(pa.array(wanted)).dictionary_encode()

    def marks(self, n: int) -> np.ndarray:
        """A hash below 2 ** 48 of the n words from each word on, and of their language."""
        lang = np.array([zlib.crc32(x.encode()) for x in self.langs] or [0], np.uint64)[self.lang_of_word]
        one = h = self.words.hashes() ^ mix(lang + _U(1))
        for k in range(1, n):
            h = mix(h * _U(0x9E3779B97F4A7C15) + np.roll(one, -k))
        return (h >> _U(16)).view(np.int64)

    def joined(self, n: int) -> np.ndarray:
        """Whether the n words from each word on are in one piece."""
        out = np.ones(len(self.next), bool)
        for k in range(n - 1):
            out &= _ahead(self.next, k)
        return out


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    """What is k places further on."""
    return np.r_[x[k:], np.zeros(min(k, len(x)), bool)]


def _reach(text: _Text, frequent: Broadcast) -> np.ndarray:
    """How many words, 4 at most, the longest phrase to count from each word on has: no part of up to three words that is known to be rare is in it."""
    word, pair, three = (text.joined(n) & asked_for(frequent, text.marks(n)) for n in (1, 2, 3))
    two = word & pair & _ahead(word, 1)
    third = two & _ahead(two, 1) & three
    return word.astype(np.int64) + two + third + (third & _ahead(third, 1))


def _rough(batches):
    """(id, n): hashes of one to three words, added up over as many as are held at once."""
    held, size = [], 0
    for batch in chunks(batches, "text", _BATCH):
        text = _Text(batch.column(0), batch.column(1))
        for n in (1, 2, 3):
            held.append(text.marks(n)[text.joined(n)])
            size += len(held[-1])
        if size > _HASHES:
            yield _added(held)
            held, size = [], 0
    if size:
        yield _added(held)


def _added(held: list[np.ndarray]) -> pa.RecordBatch:
    ids, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["id", "n"])


_RUN = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])


def _spill(trie: HatTrie, keep: int, known: dict[bytes, int], langs: dict[str, int]):
    """Sorted runs of the largest subtrees, until `keep` entries are left."""
    spelt, langs_ = pa.array(list(known), pa.large_binary()).cast(pa.large_string()), pa.array(list(langs), pa.large_string())
    while trie.size > keep:
        yield from _run(trie.spill(max(keep, trie.size - _RUN_ENTRIES)), spelt, langs_)


def _run(spilled: tuple[np.ndarray, np.ndarray, np.ndarray], spelt: pa.Array, langs: pa.Array):
    """Spilled subtrees' phrases of one to four words, in their order: a sorted run, in pieces."""
    first, rest, n = spilled
    # a sequence of four words is also one of its first three, and so on
    levels = [distinct(first, np.zeros_like(rest), n)]
    for k in (2, 1, 0):
        longer = (rest >> k * _BITS & _MASK) > 0
        levels.append(distinct(first[longer], rest[longer] >> k * _BITS << k * _BITS, n[longer]))
    first, rest, n = (np.concatenate(x) for x in zip(*levels))
    ids = [first & _MASK, rest >> 2 * _BITS, rest >> _BITS & _MASK, rest & _MASK]
    phrase = pc.binary_join_element_wise(*[spelt.take(pa.array(i - 1, mask=i == 0)) for i in ids], pa.scalar(" ", pa.large_string()), null_handling="skip")
    lang = langs.take(pa.array(first >> _BITS))
    table = pa.table({"lang": lang, "phrase": phrase, "words": sum((i > 0).astype(np.int32) for i in ids), "n": n})
    table = table.take(pc.sort_indices(table, sort_keys=[("lang", "ascending"), ("phrase", "ascending")]))
    for batch in table.to_batches(max_chunksize=20_000):
        yield batch.cast(_RUN)


def _count(frequent: Broadcast, most: int):
    def run(batches):
        trie, known, langs, size, total = HatTrie(), {}, {}, 0, {}
        for batch in chunks(batches, "text", _BATCH):
            text = _Text(batch.column(0), batch.column(1))
            for lang, n in zip(text.langs, np.bincount(text.lang_of_word, minlength=len(text.langs)).tolist()):
                total[lang] = total.get(lang, 0) + n
            reach = _reach(text, frequent)
            spelt = text.spelt(reach > 0)
            new = spelt.dictionary.to_pylist()
            if len(known) + len(new) > _MASK - 1 or size > _WORD_BYTES:
                yield from _spill(trie, 0, known, langs)
                known, langs, size = {}, {}, 0
            before = len(known)
            number = np.array([known.setdefault(w, len(known) + 1) for w in new] or [0], np.int64)
            size += sum(map(len, new)) if len(known) > before else 0
            lang = np.array([langs.setdefault(x, len(langs)) for x in text.langs] or [0], np.int64)
            at = np.flatnonzero(reach)
            ids = np.zeros(len(reach) + 4, np.int64)
            ids[at] = number[np.asarray(spelt.indices)] if len(at) else 0
            first = lang[text.lang_of_word[at]] << _BITS | ids[at]
            lone = reach[at] == 1
            trie.add(*distinct(first[lone], np.zeros(lone.sum(), np.int64)))
            at, first = at[~lone], first[~lone]
            rest = sum(np.where(reach[at] > k, ids[at + k], 0) << (3 - k) * _BITS for k in (1, 2, 3))
            trie.add(*distinct(first, rest))
            if trie.size > most:
                yield from _spill(trie, most // 2, known, langs)
        yield from _spill(trie, 0, known, langs)
        if total:
            yield pa.RecordBatch.from_pylist([{"lang": k, "phrase": "", "words": 0, "n": n} for k, n in total.items()], _RUN)

    return run


def phrase_counts(docs: DataFrame, least: int = 30, most_entries: int = MOST_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, a) of phrases of 1 to 4 words that occur at least `least` times, (lang, n) of all words).

    Both are of a stored table. most_entries bounds what a task's trie holds before it spills.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = Observation()
    read = texts.observe(size, F.sum(F.octet_length("text")).alias("bytes"))
    rough = read.mapInArrow(_rough, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    ids, seen = observed(rough.select("id"), "frequent-hashes")
    frequent = bitmap(ids, F.col("id"), bits_for(4 * seen["n"]))  # most sequences are rare: one in a hundred gets through
    discard(ids)
    much = size.get["bytes"] if seen["n"] else 0  # where nothing is frequent, tries stay empty; an empty table gives no sum
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-much // _TASK_BYTES))
    runs = materialise(texts.coalesce(tasks).mapInArrow(_count(frequent, most_entries), "lang string, phrase string, words int, n long"), "phrase-runs")
    merged = runs.repartitionByRange("lang", "phrase").groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.sum("n").alias("a"))
    found = materialise(merged.where((F.col("a") >= least) | (F.col("words") == 0)), "phrases")
    discard(runs)
    return found.where("words > 0"), found.where("words = 0").select("lang", F.col("a").alias("n"))


#: Exact for any counts: decimals as wide as needed.
_SCORE = "(cast(a as decimal(19,0)) * 2000000) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"


def collocations(docs: DataFrame, least: int = 30, best: int = 2000, covered: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `best` phrases of 2 to 4 words that occur at least `least` times.

    A phrase is cut where its score is least (of equal ones first); it is dropped if a longer one
    that holds it occurs at least `covered` hundredths as often. Ties in score and count are in the
    order of the phrases' bytes. A null text has no words, a null language is `und`; repeated rows
    count each time, an empty table has no phrases, and other columns are left alone.
    """
    found, totals = phrase_counts(docs, least)
    cut = found.where("words > 1").withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cut = cut.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - words)"))
    part = lambda text, count: found.select("lang", F.col("phrase").alias(text), F.col("a").alias(count))
    cut = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    lowest = F.min(F.struct(F.expr(_SCORE).alias("score"), "k", "l", "r")).alias("least")
    scored = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), lowest).select("lang", "phrase", "a", "least.score", "least.l", "least.r")
    inner = F.expr("""flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), k ->
        array_join(slice(split(phrase, ' ', -1), k, n), ' '))))""")
    longer = found.where("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(f"longer is null or cast(longer as decimal(19,0)) * 100 < cast(a as decimal(19,0)) * {int(covered)}").drop("longer")
    # a language may have a third of all phrases: its best are found in shares of it first
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    few = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("rank") <= best)
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
