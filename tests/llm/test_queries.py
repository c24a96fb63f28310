"""Queries at the smallest scale: SQL where there is some, whole results everywhere."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from stratakeep.llm.queries import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", ORACLE)
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    found = duck.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(found.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_one_row_a_document(spark, name):
    rows = QUERIES[name](spark, str(DATA)).collect()
    key, table = ("page_id", "pages") if name.startswith("op2_") else ("doc_id", "documents")
    assert sorted(r[key] for r in rows) == sorted(r[key] for r in spark.read.parquet(str(DATA / f"{table}.parquet")).select(key).collect())


def test_pipeline(spark, duck):
    """Each stage does its work on the one before."""
    import corpus_pipeline as cp
    from stratakeep.llm.decontaminate import contamination
    from stratakeep.llm.near_documents import near_documents
    from stratakeep.llm.store import materialise

    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    seen = {"documents": docs}
    for name, stage in cp.STAGES:
        docs = seen[name] = materialise(stage(spark, docs, str(DATA)), name)
    columns = seen["documents"].columns
    assert all(seen[n].columns == columns for n, _ in cp.STAGES[:-1])
    labels = spark.read.parquet(str(DATA / "labels.parquet"))
    gone = seen["documents"].join(seen["quality"], "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.where("quality = 1").count() <= 1 and gone.where("quality = 0").count() > 0
    assert near_documents(seen["near_dedup"]).where("not kept").count() == 0
    assert seen["near_dedup"].count() == near_documents(seen["quality"]).where("kept").count()
    benchmark = spark.read.parquet(str(DATA / "benchmark.parquet"))
    assert contamination(seen["decontaminate"], benchmark).where("contaminated").count() == 0
    ids = lambda n: {r.doc_id for r in seen[n].select("doc_id").collect()}
    assert ids("mix") == ids("decontaminate") == ids("token_files") and seen["mix"].count() == seen["token_files"].count()


def test_token_files_follow_the_mix(spark):
    """The packed files hold the documents in the order of the mix, copies in their own places."""
    import corpus_pipeline as cp
    from stratakeep.llm.store import materialise

    docs = spark.createDataFrame([(k, f"w{k} " * (1 + k % 7) * 90, "big" if k % 5 else "small") for k in range(600)], "doc_id long, text string, source string")
    want = [r.doc_id for r in cp.mixed(spark, docs, str(DATA)).select("doc_id").collect()]
    got = cp.token_files(spark, materialise(cp.mixed(spark, docs, str(DATA)), "mix"), str(DATA)).collect()
    assert want != sorted(want) and [r.doc_id for r in sorted(got, key=lambda r: r.start)] == want


@pytest.mark.parametrize("stage", ["quality", "near_dedup", "decontaminate", "mix"])
def test_stages_take_odd_documents(spark, odd, stage):
    """Nulls, repeats, empty and very long texts, extra columns; what comes out are documents that went in."""
    import corpus_pipeline as cp

    run = dict(cp.STAGES)[stage]
    got = run(spark, odd, str(DATA))
    assert got.columns == odd.columns
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    assert ids <= {r.doc_id for r in odd.select("doc_id").collect()}
    if stage != "decontaminate":  # all others leave texts as they are
        assert got.join(odd.select("doc_id", "text"), (got["doc_id"].eqNullSafe(odd["doc_id"])) & got["text"].eqNullSafe(odd["text"]), "left_anti").count() == 0
    assert run(spark, odd.limit(0), str(DATA)).count() == 0


def test_near_dedup_keeps_the_least_text(spark):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(1, "b b b b b b", "x"), (1, "a a a a a a", "y"), (1, None, "z"), (2, "c d e f g h", "x"), (None, "n", "x"), (None, "n", "x")], "doc_id long, text string, source string").repartition(4)
    got = sorted((tuple(r) for r in cp.near_dedup(spark, docs, str(DATA)).collect()), key=str)
    assert got == sorted([(1, "a a a a a a", "y"), (2, "c d e f g h", "x"), (None, "n", "x"), (None, "n", "x")], key=str)


def test_token_files_of_odd_documents(spark, odd):
    import corpus_pipeline as cp
    from stratakeep.llm.store import materialise

    got = cp.token_files(spark, materialise(odd.select("doc_id", "text"), "odd"), str(DATA))
    assert got.count() == odd.count() and got.where("n_tokens < 1").count() == 0
