import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratakeep.operators import dedup, reconcile, retention, selection, totals, workloads
from stratakeep.operators.prefix import batches, running_total
from stratakeep.plans.actions import with_statements
from stratakeep.plans.catalog import Catalog

START = datetime(2024, 1, 1)


def test_running_total(spark):
    rng = random.Random(1)
    data = [(rng.randrange(50), k, rng.randrange(9)) for k in range(500)]
    got = running_total(spark.createDataFrame(data, "k long, t long, v long"), "k", ["t"], F.col("v"), "before").collect()
    total, want = 0, {}
    for k, t, v in sorted(data):
        want[t] = total
        total += v
    assert {r.t: r.before for r in got} == want
    assert running_total(spark.createDataFrame([], "k long, t long, v long"), "k", ["t"], F.col("v"), "before").count() == 0
    sizes = batches(spark.range(25).select(F.col("id").alias("k")), "k", [], 10).groupBy("batch").count().collect()
    assert {r.batch: r["count"] for r in sizes} == {0: 10, 1: 10, 2: 5}


@pytest.mark.parametrize("seed", range(4))
def test_retention_is_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(f"b{k}", START + timedelta(days=rng.randrange(20)), rng.choice(retention.STATES)) for k in range(30)]
    backups = spark.createDataFrame(rows, "name string, start_time timestamp_ntz, state string")
    for count, since in ((3, None), (2, START + timedelta(days=15)), (None, START + timedelta(days=10)), (0, None)):
        left, keep = count or 0, set()
        for name, at, state in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True):
            if left > 0:
                keep.add(name)
                left -= state == "created"
            elif since and at >= since:
                keep.add(name)
        got = retention.retention(backups, count, str(since) if since else None)
        assert {r.name for r in got.where("retained").collect()} == keep


def loop_candidates(backups, parts, hostname):
    """Newest to oldest, closing databases as created backups come by."""
    names, open_, seen, out = {b[0] for b in backups}, {}, set(), {}
    for backup, host, state, at in sorted(backups, key=lambda b: (b[3], b[0]), reverse=True):
        for db in sorted({p[1] for p in parts if p[0] == backup}):
            rep, non = open_.get(db, (False, False))
            for p in (p for p in parts if p[0] == backup and p[1] == db):
                replicated = "Replicated" in p[3]
                if (rep if replicated else non or host != hostname) or (db, p[2], p[4]) in seen or p[7] and p[7] not in names:
                    continue
                seen.add((db, p[2], p[4]))
                out[db, p[2], p[4]] = p[7] or backup
            if state == "created":
                open_[db] = (True, non or host == hostname)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_candidates_are_the_loop(spark, seed):
    rng = random.Random(seed)
    backups = [(f"b{k}", f"h{rng.randrange(2)}", rng.choice(("created", "failed", "creating")), START + timedelta(hours=k)) for k in range(6)]
    parts = []
    for b, *_ in backups:
        for db in ("d1", "d2"):
            for t, engine in (("r", "ReplicatedMergeTree"), ("m", "MergeTree")):
                for n in range(4):
                    if rng.random() < 0.6:
                        parts.append((b, db, t, engine, f"all_{n}_{n}_0", f"c{n}", 1, rng.choice((None, "b0", "b2", "gone")), None))
    named = spark.createDataFrame(backups, "backup string, hostname string, state string, start_time timestamp_ntz").withColumn("schema_only", F.lit(False))
    stored = spark.createDataFrame(parts, "backup string, database string, table string, engine string, part string, checksum string, bytes long, link string, link_part_name string")
    databases = stored.select("backup", "database").distinct().join(named.drop("schema_only"), "backup")
    got = dedup.candidates(stored, databases, dedup.considered(named, None), "h0").collect()
    assert {(r.database, r.table, r.part): r.supplier for r in got} == loop_candidates(backups, parts, "h0")
    assert dedup.considered(named, None, enabled=False).count() == 0
    assert dedup.considered(named, START + timedelta(hours=3)).count() == 3


def test_top_match_hides_others(spark):
    """The name is looked at only after one stored part has been chosen."""
    stored = spark.createDataFrame(
        [("d", "t", "all_1_1_0", "c", "a1", False, None, 1), ("d", "t", "all_9_9_0", "c", "b2", False, None, 1), ("d", "t", "all_5_5_0", "e", "a1", True, "all_5_5_0_1", 1)],
        "database string, table string, part string, checksum string, supplier string, verified boolean, link_part_name string, bytes long",
    )
    current = spark.createDataFrame([("d", "t", "all_1_1_0", "c"), ("d", "t", "all_5_5_0_7", "e"), ("d", "t", "all_6_6_0", "z")], "database string, table string, part string, checksum string")
    got = {r.part: (r.action, r.link, r.link_part_name) for r in dedup.link_plan(current, stored).collect()}
    assert got == {"all_1_1_0": ("upload", None, None), "all_5_5_0_7": ("link", "a1", "all_5_5_0_1"), "all_6_6_0": ("upload", None, None)}
    whole = spark.createDataFrame([], "supplier string, database string, table string, stored_part string")
    assert {r.part for r in dedup.link_plan(current, stored, whole).where("action = 'link'").collect()} == {"all_5_5_0_7"}


PARTS = "backup string, database string, table string, engine string, part string, checksum string, bytes long, link string, link_part_name string"


@pytest.fixture
def chain(spark):
    """b1 holds two parts, b2 links one under another name, b3 holds its own."""
    parts = spark.createDataFrame(
        [("b1", "d", "t", "MergeTree", "p_1_1_0", "c1", 10, None, None), ("b1", "d", "t", "MergeTree", "q_1_1_0", "c2", 20, None, None),
         ("b2", "d", "t", "MergeTree", "p_1_1_0_5", "c1", 10, "b1", "p_1_1_0"), ("b3", "d", "t", "MergeTree", "x_1_1_0", "c3", 5, None, None)], PARTS)
    backups = spark.createDataFrame([(f"b{k}", "h", "created", START + timedelta(days=k), START + timedelta(days=k), False) for k in (1, 2, 3)], "name string, hostname string, state string, start_time timestamp_ntz, end_time timestamp_ntz, schema_only boolean")
    return Catalog(backups, parts.select("backup", "database").distinct(), parts)


def test_catalog(spark, chain):
    assert [(r.name, r.size, r.real_size, r.data_count, r.link_count) for r in chain.list_backups().collect()] == [("b3", 5, 5, 1, 0), ("b2", 10, 0, 0, 1), ("b1", 30, 30, 2, 0)]
    assert chain.resolve("LAST") == "b3"
    with pytest.raises(ValueError):
        chain.resolve("none")
    with pytest.raises(ValueError):
        chain.show("b1", "other")
    assert chain.show("b1", "d", "t").count() == 2


def test_delete_keeps_what_is_referred_to(chain):
    plan = {(r.backup, r.action, r.part) for r in chain.plan_delete("b1").collect()}
    assert plan == {("b1", "delete_part", "q_1_1_0"), ("b1", "set_state", None)}
    assert {(r.backup, r.action) for r in chain.plan_delete("b2").collect()} == {("b2", "delete_backup")}
    assert chain.plan_purge().count() == 0
    assert {(r.backup, r.action) for r in chain.plan_purge(1).collect()} == {("b1", "delete_backup"), ("b2", "delete_backup")}


def test_plans(spark, chain):
    current = spark.createDataFrame([("d", "t", "x_1_1_0", "c3", 5), ("d", "t", "n_1_1_0", "c9", 100)], "database string, table string, part string, checksum string, bytes long")
    got = {r.part: (r.action, r.link, r.chunk, r.multipart) for r in chain.plan_backup(current, "h", chunk=10, most_chunks=5).collect()}
    assert got == {"x_1_1_0": ("link", "b3", None, None), "n_1_1_0": ("upload", None, 20, True)}
    table = "database string, table string, engine string, uuid string, statement string"
    wanted = spark.createDataFrame([("d", "t", "MergeTree", None, "CREATE TABLE d.t (a Int32)"), ("d", "v", "View", None, "CREATE VIEW d.v AS SELECT 1")], table)
    state = spark.createDataFrame([("d", "t", "p_1_1_0_5", "downloaded")], "database string, table string, part string, state string")
    rows = chain.plan_restore("b2", wanted, wanted.limit(0), state).collect()
    assert [(r.table, r.action) for r in rows] == [("t", "create"), ("v", "create")]
    assert [tuple(p) for p in rows[0].parts] == [("p_1_1_0_5", "attach", "b1", "p_1_1_0")] and rows[1].parts is None
    with pytest.raises(ValueError):
        chain.plan_restore("b2", wanted.withColumn("statement", F.lit(None).cast("string")), wanted.limit(0), state)
    assert [r.path for r in chain.cloud_metadata_paths("b2", "root", ["s3"]).collect()] == ["root/b2/disks/s3/d/t.tar"]


def test_selection(spark):
    t = spark.createDataFrame([("db1", "table2"), ("db2", "table2"), ("db1", "other")], "database string, table string")
    accept = selection.accepts(F.col("database"), F.col("table"), ["db1.table*"])
    assert [r.table for r in t.where(accept).collect()] == ["table2"]
    both = selection.combined(F.col("database"), F.col("table"), ["db1.*"], ["db1.oth*"])
    assert [(r.database, r.table) for r in t.where(both).collect()] == [("db1", "table2")]
    assert selection.only(t, []).count() == 0 and selection.only(t, None).count() == 3
    assert [r.table for r in selection.chosen_tables(t, ["db1.other"]).collect()] == ["other"]


def test_trees(spark):
    e = spark.createDataFrame([("all", None), ("user", "all"), ("dev", "user"), ("x", "y"), ("y", "x")], "name string, parent string")
    assert {r.name: r.depth for r in workloads.depths(e).collect()} == {"all": 0, "user": 1, "dev": 2, "x": -1, "y": -1}
    with pytest.raises(ValueError):
        workloads.depths(spark.createDataFrame([("a", "gone")], "name string, parent string"))
    chain = spark.createDataFrame([("n0", None)] + [(f"n{k}", f"n{k - 1}") for k in range(1, 40)], "name string, parent string")
    assert {r.name: r.depth for r in workloads.depths(chain).collect()} == {f"n{k}": k for k in range(40)}
    with pytest.raises(ValueError, match="over 5"):
        workloads.depths(chain, most=5)


def test_duplicates_and_prefixes(spark):
    t = spark.createDataFrame([(1, "d", "a", "u"), (2, "d", "a", "u"), (3, "d", "b", "u"), (4, "d", "c", None), (5, "d", "e", None)], "k long, database string, table string, uuid string")
    assert {r.k: r.verdict for r in reconcile.first_of_uuid(t, ["k"]).collect()} == {1: "keep", 2: "duplicate", 3: "conflict", 4: "keep", 5: "keep"}
    disks = spark.createDataFrame([("a", "/var/"), ("b", "/var/lib/")], "disk string, disk_path string")
    paths = spark.createDataFrame([("/var/lib/x",), ("/var/y",), ("/z",)], "p string")
    assert {r.p: r.disk for r in reconcile.longest_prefix(paths, disks, "p", ["p"]).collect()} == {"/var/lib/x": "b", "/var/y": "a", "/z": None}


def test_gate_and_statements(spark):
    b = spark.createDataFrame([("a", "h", START, None), ("b", "g", START, START + timedelta(hours=5))], "name string, hostname string, start_time timestamp_ntz, end_time timestamp_ntz")
    assert {r.hostname: r.allowed for r in totals.interval_gate(b, "2024-01-01 05:30:00", 3600, ["hostname"]).collect()} == {"h": True, "g": False}
    rows = spark.createDataFrame([("attach_part", "d", "t`x", "p", None, None), ("none", "d", "t", None, None, None)], "action string, database string, table string, part string, name string, path string")
    assert [r.statement for r in with_statements(rows).collect()] == ["ALTER TABLE `d`.`t\\`x` ATTACH PART 'p'", None]
