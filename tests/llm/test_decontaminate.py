import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from llm.conftest import WORDS, rows_of
from stratakeep.llm import decontaminate as dc


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window):
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for name, item in items:
            v = words(item)
            n = min(len(v), window)
            for i in range(len(v) - n + 1 if n else 0):
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == v[i : i + n]:
                        hit.update(range(k, k + n))
                        found.add(str(name))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "shard"), [(0, 200_000), (1, 200_000), (2, 30)])
def test_is_brute_force(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(dc, "SHARD_WORDS", shard)
    rng = random.Random(seed)
    few = WORDS[:3]
    items = [(k, " ".join(rng.choices(few if k % 2 else WORDS, k=rng.choice((0, 1, 2, 4, 5, 9, 14))))) for k in range(14)] + [(90, None), (11, "X-ray: Été!")]
    docs = [(k, ". ".join(rng.choices(few if k % 3 else WORDS, k=rng.randrange(30)))) for k in range(25)] + [(50, None), (51, "x RAY été Ete"), (52, "été")]
    docs += [(60 + k, f"pre {t.upper()} post") for k, (_, t) in enumerate(items) if t]
    got = dc.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=5)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute(docs, items, 5)


def test_cleaning(spark):
    items = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Keep this; One, two three FOUR five! and this text too, all of it", "x"), (2, "one two three four five six", "y"), (3, " as it was ", None), (4, None, "z")], "doc_id long, text string, spans string")
    got = dc.decontaminate(docs.withColumn("n_chars", F.length("text")), items, window=5)
    assert rows_of(got, "doc_id", "text", "spans", "n_chars") == [(1, "Keep this;\n! and this text too, all of it", "x", 41), (3, " as it was ", None, 11), (4, None, "z", None)]


def test_shards_clean_like_one(spark, monkeypatch, odd):
    items = spark.createDataFrame([(k, " ".join(WORDS[k : k + 6])) for k in range(18)], "item_id long, text string")
    docs = odd.unionByName(odd.limit(1).withColumn("doc_id", F.lit(500).cast("long")).withColumn("text", F.lit("Before. " + " ".join(WORDS) + " after that " + "x " * 200)))
    whole = rows_of(dc.decontaminate(docs, items, window=5), "doc_id", "text", "n_chars")
    spans = rows_of(dc.matches(docs, items, window=5), "doc_id", "spans", "items")
    monkeypatch.setattr(dc, "SHARD_WORDS", 40)
    assert rows_of(dc.decontaminate(docs, items, window=5), "doc_id", "text", "n_chars") == whole
    assert rows_of(dc.matches(docs, items, window=5), "doc_id", "spans", "items") == spans and any(s for _, s, _ in spans)
    assert dc.contamination(docs.limit(0), items).count() == 0


def test_odd_input(spark, odd):
    items = spark.createDataFrame([(None, "one"), (2, ""), (None, None)], "item_id long, text string")
    got = dc.contamination(odd, items)
    assert got.count() == odd.count()
    assert got.where("contaminated").count() == 4  # "one" three times, "ONE two"
    assert dc.contamination(odd, items.limit(0)).where("n_items > 0").count() == 0
    assert dc.contamination(odd.limit(0), items).count() == 0
    clean = dc.decontaminate(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 3
