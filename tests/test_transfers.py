"""Sealed chunks, checked reads, delimited listings, clean-up of coordination paths, scans by version."""

import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratakeep.functions import crypto
from stratakeep.functions.text import absolute_path
from stratakeep.operators import cleanup, transfers
from stratakeep.sources import metadata, scans

KEY = b"0123456789abcdef"


# ---- sealed chunks


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 16, 100])
def test_chunks_open_whole_and_in_part(spark, size):
    data = os.urandom(size)
    df = spark.createDataFrame([(bytearray(data),)], "data binary").select("data", crypto.seal_chunks(F.col("data"), F.lit(KEY), 8, F.lit("path")).alias("sealed")).persist()
    chunks = max(1, -(-size // 8))
    assert len(df.first().sealed) == len(crypto.MAGIC) + size + 28 * chunks
    ranges = [(0, None), (0, size), (3, 5), (7, 9), (size - 1 if size else 0, size), (size, size + 5), (5, 3), (8, 16)]
    got = df.select(*[crypto.open_range(F.col("sealed"), F.lit(KEY), a, b, 8, F.lit("path")).alias(f"r{k}") for k, (a, b) in enumerate(ranges)]).first()
    assert [bytes(x) for x in got] == [data[a:b] if b is None or a < b else b"" for a, b in ranges]


def test_changed_chunks_dont_open(spark):
    data = bytes(range(40))
    sealed = bytes(spark.range(1).select(crypto.seal_chunks(F.lit(data), F.lit(KEY), 8, F.lit("a")).alias("s")).first().s)
    m, step = len(crypto.MAGIC), 36
    pieces = [sealed[k : k + step] for k in range(m, len(sealed), step)]
    head = sealed[:m]
    bad = {
        "swapped": head + b"".join([pieces[1], pieces[0], *pieces[2:]]), "cut": head + b"".join(pieces[:-1]), "more": sealed + pieces[0], "broken": sealed[:-1],
        "flipped": sealed[:60] + bytes([sealed[60] ^ 1]) + sealed[61:], "short": head, "twice": head + b"".join([*pieces[:2], pieces[1], *pieces[3:]]),
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in bad.items()], "k string, s binary")
    opened = crypto.open_range(F.col("s"), F.lit(KEY), chunk=8, context=F.lit("a"))
    assert {r.k: r.o for r in df.select("k", opened.alias("o")).collect()} == dict.fromkeys(bad)
    good = spark.createDataFrame([(bytearray(sealed),)], "s binary")
    elsewhere, other_key = crypto.open_range(F.col("s"), F.lit(KEY), chunk=8, context=F.lit("b")), crypto.open_range(F.col("s"), F.lit(KEY[::-1]), chunk=8, context=F.lit("a"))
    assert list(good.select(elsewhere, other_key, crypto.is_sealed(F.lit(b"{}")), crypto.seal_chunks(F.lit(None).cast("binary"), F.lit(KEY))).first()) == [None, None, False, None]
    # a range needs its own chunks alone
    tampered = bytearray(sealed)
    tampered[-1] ^= 1
    part = spark.createDataFrame([(tampered,)], "s binary").select(crypto.open_range(F.col("s"), F.lit(KEY), 4, 20, 8, F.lit("a")).alias("p"), crypto.open_range(F.col("s"), F.lit(KEY), 4, 40, 8, F.lit("a")).alias("q")).first()
    assert bytes(part.p) == data[4:20] and part.q is None


def test_sealed_and_plain_documents(spark, tmp_path):
    text = '{"meta": {"name": "x", "state": "created"}}'
    sealed = bytes(spark.range(1).select(crypto.seal_chunks(F.lit(text.encode()), F.lit(KEY), 16, F.lit("x")).alias("s")).first().s)
    for name, content in (("x", sealed), ("plain", text.encode())):
        (tmp_path / name).mkdir()
        (tmp_path / name / "backup_struct.json").write_bytes(content)
    got = metadata.read_sealed_documents(spark, str(tmp_path), KEY, 16)
    assert {tuple(r) for r in got.collect()} == {("x", text), ("plain", text)} and metadata.parse(got).count() == 2
    (tmp_path / "moved").mkdir()
    (tmp_path / "moved/backup_struct.json").write_bytes(sealed)
    with pytest.raises(Exception, match="can't be opened"):
        metadata.read_sealed_documents(spark, str(tmp_path), KEY, 16).collect()
    assert metadata.read_sealed_documents(spark, str(tmp_path / "none"), KEY).count() == 0


# ---- checked reads

ATTEMPT = "object string, seq long, generation string, received long, total long"


def read_by_answers(rows):
    """One object's answers in turn."""
    rows = sorted(rows)
    generation, total, delivered, failed = None, None, 0, None
    for _, seq, told, received, size in rows:
        if seq == 0:
            generation, total = told, size
            continue
        if told is not None and told != generation:
            if delivered:
                failed = seq
                break
            generation, total = told, size
        delivered += max(received or 0, 0)
    state = "overwritten" if failed is not None else "complete" if total is not None and delivered >= total else "partial"
    return state, delivered, generation, total, failed


@pytest.mark.parametrize("seed", range(3))
def test_reads_are_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(40):
        rows.append((f"o{k}", 0, "g0", None, 30))
        for seq in range(1, rng.randint(1, 7)):
            g = rng.choices(["g0", "g1", None], [6, 1, 1])[0]
            rows.append((f"o{k}", seq, g, rng.choice([0, 10, 10, 20]), {"g1": 20}.get(g, 30)))
    df = spark.createDataFrame(rng.sample(rows, len(rows)) + [rows[0], (None, 1, "g", 1, 1), ("o1", None, "g", 1, 1)], ATTEMPT)
    reads = transfers.checked_reads(df)
    got = {r.object: (r.state, r.delivered, r.generation, r.total, r.failed_at) for r in reads.collect()}
    assert got == {f"o{k}": read_by_answers([r for r in rows if r[0] == f"o{k}"]) for k in range(40)}
    after = {r.object: (r.start, r.end, r.generation) for r in transfers.next_range(reads, 7).collect()}
    assert after == {k: (0, 7, None) if s == "overwritten" else (d, min(d + 7, t), g) for k, (s, d, g, t, _) in got.items() if s != "complete"}
    assert transfers.checked_reads(df.limit(0)).count() == 0


# ---- delimited listings


def listed(paths, prefix, delimiter, after, page):
    found = {}
    for p, size in paths.items():
        if p.startswith(prefix) and p != prefix:
            cut = p.find(delimiter, len(prefix)) if delimiter else -1
            entry = p if cut < 0 else p[: cut + len(delimiter)]
            if after is None or entry.encode() > after.encode():
                n, s, _ = found.get(entry, (0, 0, False))
                found[entry] = (n + 1, s + size, bool(delimiter) and entry.endswith(delimiter))
    return [(k // page, p, found[p][2], found[p][1], found[p][0]) for k, p in enumerate(sorted(found, key=str.encode))]


@pytest.mark.parametrize("case", [("", "/", None, 3), ("a/", "/", None, 2), ("a/", "", None, 5), ("a/", "/", "a/b/", 2), ("a/", "/", "a/b/zz", 2), ("none/", "/", None, 2), ("", "--", None, 4)])
def test_listing_is_the_loop(spark, case):
    rng = random.Random(3)
    names = ["a", "b", "bb", "é", "x--y", "z"]
    paths = {"/".join(rng.choice(names) for _ in range(rng.randint(1, 4))): rng.randrange(100) for _ in range(120)} | {"a/": 0, "a/b/": 0}
    df = spark.createDataFrame([*paths.items(), *list(paths.items())[:9], (None, 1)], "path string, size long")
    prefix, delimiter, after, page = case
    got = transfers.delimited(df, prefix, delimiter, after, page).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1].encode()) == listed(paths, prefix, delimiter, after, page)
    assert transfers.exists_below(df, "a") and not transfers.exists_below(df, "none")


# ---- clean-up


def test_absolute_paths(spark):
    paths = {"/a//b/./c/": "/a/b/c", "a/../../b": "/b", "/..": "/", "": "/", "/a/b/..": "/a"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.q for r in df.select("p", absolute_path(F.col("p")).alias("q")).collect()} == {p: os.path.abspath("/" + p.lstrip("/")) for p in paths} == paths


def test_cleanup_of_tables(spark):
    ddl = "CREATE TABLE d.{} (a Int32) ENGINE = ReplicatedMergeTree('{}', '{{replica}}') ORDER BY a"
    tables = spark.createDataFrame(
        [("d", "t", "u1", ddl.format("t", "/ch/{shard}//{database}/./{table}")), ("d", "u", "u2", ddl.format("u", "/ch/{uuid}/{unknown}")), ("d", "t", "u1", ddl.format("t", "/ch/{shard}//{database}/./{table}")),
         ("d", "plain", None, "CREATE TABLE d.plain (a Int32) ENGINE = MergeTree ORDER BY a"), ("d", "none", None, None), ("d", "gone", "u3", ddl.format("gone", "/nowhere"))],
        "database string, table string, uuid string, statement string",
    )
    macros = spark.createDataFrame([("shard", "s1"), ("replica", "r1"), ("database", "not this"), (None, "x"), ("other", None)], "macro string, substitution string")
    tree = spark.createDataFrame([(p,) for p in ("/root/ch/s1/d/t/replicas/r1", "/root/ch/s1/d/t/replicas/r1/is_active", "/root/ch/s1/d/t/replicas/r2", "/root/ch/s1/d/t/replicas/r2/log", "/root/ch/u2/{unknown}/replicas/r1", "/ch/s1/d/t/replicas/far", "/root/nowhere", None)], "path string")
    plan = cleanup.clean_tables(tables, macros, tree, "/root")
    got = sorted((r.table, r.name, r.path, r.step, r.action, r.node) for r in plan.collect())
    top = "/root/ch/s1/d/t/replicas"
    assert got == [
        ("t", "r1", "/ch/s1/d/t", 0, "delete_node", f"{top}/r1/is_active"), ("t", "r1", "/ch/s1/d/t", 1, "drop_replica", f"{top}/r1"), ("t", "r2", "/ch/s1/d/t", 1, "drop_replica", f"{top}/r2"),
        ("u", "r1", "/ch/u2/{unknown}", 1, "drop_replica", "/root/ch/u2/{unknown}/replicas/r1"),
    ]
    assert {(r.table, r.name) for r in cleanup.clean_tables(tables, macros, tree, "root/", replica="r2").collect()} == {("t", "r2")}
    assert {r.name for r in cleanup.clean_tables(tables, macros, tree).where("action = 'drop_replica'").collect()} == {"far"}
    errors = spark.createDataFrame([(f"{top}/r1", "Code 305: TABLE_WAS_NOT_DROPPED"), (f"{top}/r2", "it does not look like a table path"), ("/root/ch/u2/{unknown}/replicas/r1", "else")], "node string, message string")
    assert {r.node.rsplit("/", 1)[1] + r.table: r.next for r in cleanup.after_errors(plan, errors).collect()} == {"r1t": "delete_tree", "r2t": "ignore", "r1u": "raise"}
    assert cleanup.clean_tables(tables.limit(0), macros, tree).count() == 0 and cleanup.clean_tables(tables, macros.limit(0), tree, "/root").count() == 1


def test_cleanup_of_databases(spark):
    databases = spark.createDataFrame([("d", "u1", "Replicated('/db/{database}', '{shard}', '{replica}')"), ("e", None, "Atomic"), ("f", None, None)], "database string, uuid string, engine_full string")
    macros = spark.createDataFrame([("shard", "s1")], "macro string, substitution string")
    tree = spark.createDataFrame([(p,) for p in ("/db/d/replicas/s1|r1", "/db/d/replicas/s1|r1/active", "/db/d/replicas/s2|r1")], "path string")
    assert sorted((r.name, r.step, r.action) for r in cleanup.clean_databases(databases, macros, tree).collect()) == [("s1|r1", 0, "delete_node"), ("s1|r1", 1, "drop_database_replica"), ("s2|r1", 1, "drop_database_replica")]
    assert {r.name for r in cleanup.clean_databases(databases, macros, tree, replica="r1").collect()} == {"s1|r1"}


# ---- scans


@pytest.fixture
def server(spark):
    df = spark.createDataFrame
    at = datetime(2024, 1, 1)
    tables = [("d", "b", "Log", "Log()", "q", ["/x"], "m", "u", at.replace(day=3)), ("d", "a", "StorageProxy", "", "q", ["/never"], "m", "u", at), ("e", "a", "Log", "", "q", ["/y"], "m", "u", at.replace(day=2)), ("d", "p", "Proxy", "", "q", ["/z"], "m", "u", None)]
    return {
        "tables": df(tables, "database string, name string, engine string, engine_full string, create_table_query string, data_paths array<string>, metadata_path string, uuid string, metadata_modification_time timestamp_ntz"),
        "databases": df([("d", "Atomic", "/m", "u", "Atomic()"), ("r", "Replicated", "/m", "u", "Replicated('/p')"), ("system", "Atomic", "", "", ""), ("own", "Atomic", "", "", "")], "name string, engine string, metadata_path string, uuid string, engine_full string"),
        "disks": df([("a", "/v/", "Local", "None", "None", ""), ("b", "/v/long/", "ObjectStorage", "S3", "Local", "/c")], "name string, path string, type string, object_storage_type string, metadata_type string, cache_path string"),
        "replicas": df([("d", "t", 1), ("d", "s", 0), ("e", "t", 1)], "database string, table string, is_readonly int"),
        "functions": df([("f", "CREATE FUNCTION f", "SQLUserDefined"), ("sum", "", "System")], "name string, create_query string, origin string"),
        "named_collections": df([("n",)], "name string"), "macros": df([("shard", "1")], "macro string, substitution string"),
        "detached_tables": df([("d", "x", "u", "m"), ("my", "x", "u", "m")], "database string, table string, uuid string, metadata_path string"),
        "distributed_ddl_queue": df([("q2", "x", "Active", "0", "", "c"), ("q1", "x", "Active", "60", "bad", "c"), ("q3", "x", "Finished", "60", "", "c"), ("q4", "x", "Active", "60", "", "other"), ("q5", "x", "Active", None, "", "c")], "entry string, query string, status string, exception_code string, exception_text string, cluster string"),
        "workloads": df([("w",), ("all",)], "name string"), "resources": df([("r",)], "name string"),
        **{kind: df([(f"i-{kind}", "n", "local_directory"), ("no", "n", "users_xml")], "id string, name string, storage string") for kind in scans.ACCESS_CHARS},
    }


def test_scans(server):
    rows = lambda df, *c: [tuple(r[x] for x in c) for r in df.collect()]
    assert rows(scans.tables(server, "24.3.1"), "database", "name", "data_paths") == [("d", "p", []), ("d", "a", []), ("e", "a", ["/y"]), ("d", "b", ["/x"])]
    # an old server is asked for no table of a name that some StorageProxy has
    assert rows(scans.tables(server, "23.8"), "database", "name", "data_paths") == [("d", "p", ["/z"]), ("d", "a", []), ("d", "b", ["/x"])]
    assert rows(scans.tables(server, "24.3", "d", ["a", "b"]), "name") == [("a",), ("b",)] and len(rows(scans.tables(server, "24.3", "d", []), "name")) == 3
    assert "data_paths" not in scans.tables(server, "24.3", short=True).columns
    assert sorted(rows(scans.databases(server, "23.3", "own", ["x"]), "name", "engine_full")) == [("d", None), ("r", "Replicated('/p')")]
    assert {r.engine_full for r in scans.databases(server, "22.8").collect()} == {None}
    assert rows(scans.SCANS["disks"](server, "24.3"), "name", "object_storage_type", "cache_path") == [("b", "S3", "/c"), ("a", "None", "")]
    assert rows(scans.SCANS["disks"](server, "22.8"), "name", "object_storage_type", "cache_path") == [("b", None, "/c"), ("a", None, "")]
    assert rows(scans.disk(server, "22.3", "b"), "path", "cache_path") == [("/v/long/", None)] and scans.disk(server, "24.3", "z").count() == 0
    assert rows(scans.replicas(server, "24.3"), "database", "table") == [("d", "s"), ("d", "t"), ("e", "t")]
    assert rows(scans.replicas(server, "24.3", "d", ["t", "s"], True), "table") == [("t",)] and scans.replicas(server, "24.3", readonly=False).count() == 1
    assert rows(scans.SCANS["functions"](server, "24.3"), "name") == [("f",)]
    assert scans.SCANS["named_collections"](server, "22.12").count() == 1 and scans.SCANS["named_collections"](server, "22.11").count() == 0
    assert rows(scans.detached_tables(server, "24.8"), "database") == [("d",)] and scans.detached_tables(server, "24.7").count() == 0
    assert rows(scans.ddl_errors(server, "24.3", "c"), "entry") == [("q1",)]
    assert rows(scans.workload_entities(server, "24.11"), "name", "type") == [("all", "workload"), ("r", "resource"), ("w", "workload")]
    assert sorted(rows(scans.access_entities(server, "24.3"), "id", "char")) == sorted((f"i-{k}", c) for k, c in scans.ACCESS_CHARS.items())
    both = scans.of_servers([("new", "24.3", server), ("old", "22.3", server)], scans.SCANS["disks"])
    assert sorted(rows(both.where("name = 'b'"), "host", "cache_path")) == [("new", "/c"), ("old", None)]
    with pytest.raises(KeyError, match="has a table disks"):
        scans.SCANS["disks"]({"macros": server["macros"]}, "24.3")


def test_running_freezes(spark):
    p = spark.createDataFrame([("Alter", "b", "alter table x FREEZE", "1"), ("Alter", "b", "ALTER TABLE x DROP", "2"), ("Select", "b", "ALTER TABLE FREEZE", "3"), ("Alter", "c", "ALTER TABLE x FREEZE", "4")], "query_kind string, user string, query string, query_id string")
    assert [r.query_id for r in scans.running_freezes(p, "b").collect()] == ["1"]
