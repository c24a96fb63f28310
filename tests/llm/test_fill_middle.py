"""Fill-in-the-middle against a plain form of the rules, and its way back."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from stratakeep.llm.fill_middle import fill_in_middle, restore


def plain_form(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(x, 16) for x in re.findall("........", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest())[:4]]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, i), (i, j), (j, n)))
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", "\n", "\n\n\n", "one", "one\n", "a\nb\nc", "é\nü\U0001f600\n\nx", "a <P> b\nc", "x<S>\n", "<M>", "ends with <\n<P\n", "P>\nS>\n<", "\r\n\x00\n a\n", "line\n" * 3000,
    "long " * 200_000 + "\nend",
]


@pytest.mark.parametrize("options", [{}, {"rate": 50}, {"seed": 3, "spm": 0}, {"spm": 100}])
def test_by_the_rules_and_back(spark, options):
    rows = [(k * len(TEXTS) + j, t) for k in range(6) for j, t in enumerate(TEXTS)] + [(None, "a\nb"), (None, None), (-5, "a\nb"), (-5, "a\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    shown = fill_in_middle(docs, **options).persist()
    got = sorted(map(tuple, shown.collect()), key=str)
    want = []
    for doc_id, text in rows:
        n, form, p, m, out = plain_form(doc_id, text, **options)
        want.append((doc_id, n, form, p, m, out, hashlib.sha256(out.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = restore(shown).select("doc_id", "text", "text_sha256").collect()
    assert sorted(map(tuple, back), key=str) == sorted(((d, t or "", hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows), key=str)
    shown.unpersist()


def test_odd_tables(spark, odd):
    shown = fill_in_middle(odd)
    assert shown.count() == odd.count()
    assert fill_in_middle(odd.where("false")).count() == 0
    back = restore(shown.withColumn("text", F.lit("other")).withColumn("a.b", F.lit(1)))
    assert "a.b" in back.columns and back.columns.count("text") == 1 and sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in odd.select("text").collect())


def test_odd_outputs(spark):
    rows = [(1, None, "plain"), (2, "x", None), (3, "y", "other"), (4, None, None), (5, "<P>a<S>c<M>b", "psm")]
    got = restore(spark.createDataFrame(rows, "doc_id long, output string, form string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, ""), (2, "x"), (3, "y"), (4, ""), (5, "abc")]
    with pytest.raises(Exception, match="subsection|substring|not found"):
        restore(spark.createDataFrame([(1, "no sentinel", "psm")], "doc_id long, output string, form string")).collect()


def test_sentinels_that_could_run_together(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("P>", "<S>", "<M>"), ("<<P>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, sentinels=bad)
