"""Collocations against a plain count, and the trie against a dictionary."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from stratakeep.llm import phrases
from stratakeep.llm.phrases import HatTrie, Node, collocations, distinct, phrase_counts


def plain(rows, least=30, best=2000, covered=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    candidates, out = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}, []
    longest = Counter()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longest[lang, w[i : i + k]] = max(longest[lang, w[i : i + k]], a)
    for (lang, w), a in candidates.items():
        if 100 * longest[lang, w] >= covered * a:
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    got, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= best:
            got.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return got


def texts(rng, n):
    words = ["the", "of", "New", "york", "a b", "été", "x\x01", "z", *(f"w{k}" for k in range(200))]
    for _ in range(n):
        out = []
        while len(out) < rng.randint(1, 60):
            out += ["New", "york", "city", "hall"][: rng.randint(1, 4)] if rng.random() < 0.2 else [rng.choice(words) if rng.random() < 0.6 else "the"]
            if rng.random() < 0.2:
                out[-1] += rng.choice([".", ", ", "\n", "!", "\t", "\r\n", " \t "])
        yield " ".join(out)


@pytest.mark.parametrize("entries", [phrases.MOST_ENTRIES, 50])
def test_like_a_plain_count(spark, monkeypatch, entries):
    rng = random.Random(entries)
    rows = [(t, rng.choice(["en", "en", "de", None, ""])) for t in texts(rng, 800)] + [(None, "en"), ("", None), (" . \n", "xx"), (None, None)]
    rows += rows[:50]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    want = plain(rows)
    assert len(want) > 20
    found, totals = phrase_counts(docs, most_entries=entries)
    counted = found.groupBy("lang", "phrase").count()
    assert counted.where("count > 1").isEmpty()  # spilled runs of one phrase are one row again
    got = collocations(docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    few = collocations(docs, best=3, least=20, covered=60)
    assert sorted(map(tuple, few.collect())) == sorted(plain(rows, 20, 3, 60))


def test_odd_tables(spark, odd):
    rows = [(r.text, r.lang) for r in odd.select("text", "lang").collect()]
    assert sorted(map(tuple, collocations(odd).collect())) == sorted(plain(rows))
    assert collocations(odd.where("false")).count() == 0


class Everything:
    """A bitmap that lets all through."""

    value = np.full(32, 255, np.uint8)


def test_long_words_of_a_task(monkeypatch):
    """More bytes of words than a task numbers: it starts anew and the counts stay whole."""
    monkeypatch.setattr(phrases, "_WORD_BYTES", 100)
    import pyarrow as pa

    docs = ["one two three four five", "one two three four", "six seven eight", ""] * 3
    batches = [pa.RecordBatch.from_arrays([pa.array([t]), pa.array(["en"])], ["text", "lang"]) for t in docs * 20]
    got = Counter()
    for b in phrases._count(Everything, 1000)(iter(batches)):
        for r in b.to_pylist():
            got[r["phrase"]] += r["n"]
            assert r["words"] == len(r["phrase"].split())
    want = Counter({"": 720})
    for t in docs * 20:
        w = t.split()
        want.update(" ".join(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert got == want


def test_trie_bursts_and_spills():
    rng = np.random.default_rng(1)
    trie, want, spilled = HatTrie(burst=16), Counter(), Counter()
    for _ in range(30):
        first, rest = rng.integers(0, 6, 200), rng.integers(1, 5, 200) << 40 | rng.integers(0, 9, 200) << 20
        want.update(zip(first.tolist(), rest.tolist()))
        trie.add(*distinct(first, rest))
        if trie.size > 60:
            for f, r, n in zip(*(x.tolist() for x in trie.spill(30))):
                spilled[f, r] += n
            assert trie.size <= 30
    assert any(isinstance(t, Node) for t in trie.root.values()) and trie.size == sum(trie.sizes.values())
    for f, r, n in zip(*(x.tolist() for x in trie.spill())):
        spilled[f, r] += n
    assert spilled == want and trie.size == 0 and not trie.root
    trie.add(*distinct(np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert [len(x) for x in trie.spill()] == [0, 0, 0]


def test_runs_follow_phrases_not_partitions(spark, monkeypatch):
    """A phrase leaves each counting task that meets it: tables in many partitions are counted in few tasks."""
    from pyspark.sql import functions as F

    rows, stored = {}, phrases.materialise

    def materialise(df, name, compression=None):
        out = stored(df, name, compression)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(phrases, "materialise", materialise)
    docs = spark.range(0, 960, 1, 96).select(F.lit("one two three. four five").alias("text"), F.lit("en").alias("lang"))
    found, totals = phrase_counts(docs)
    want = [("en", p, len(p.split()), 960) for p in ("five", "four", "four five", "one", "one two", "one two three", "three", "two", "two three")]
    assert sorted(map(tuple, found.collect())) == want and [tuple(r) for r in totals.collect()] == [("en", 4800)]
    few = rows["phrase-runs"]
    assert few <= (len(want) + 1) * spark.sparkContext.defaultParallelism
    # more text than a task should have: more tasks, the same counts
    monkeypatch.setattr(phrases, "_TASK_BYTES", 24 * 960 // 40)
    found, _ = phrase_counts(docs)
    assert sorted(map(tuple, found.collect())) == want and rows["phrase-runs"] > few


def test_burst_node_has_few_containers():
    """Second words share containers, as a dict for each would take more than its entries do."""
    trie, seconds = HatTrie(burst=16), np.arange(1, 1001)
    trie.add(*distinct(np.ones(1000, np.int64), seconds << 40))
    assert isinstance(trie.root[1], Node) and len(trie.root[1]) <= 4
    trie.add(*distinct(np.ones(1000, np.int64), seconds << 40))
    first, rest, n = trie.spill()
    assert trie.size == 0 and sorted((rest >> 40).tolist()) == seconds.tolist() and set(n.tolist()) == {2} and len(first) == 1000
