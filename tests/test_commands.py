"""Whole plans: a new backup, a restore, entities, and purging what has no metadata."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratakeep.plans import commands
from stratakeep.plans.catalog import Catalog
from stratakeep.plans.commands import Choice

START = datetime(2024, 1, 1)
PARTS = "backup string, database string, table string, engine string, part string, checksum string, bytes long, link string, link_part_name string"


@pytest.fixture
def catalog(spark):
    parts = [("b1", "d", "t", "MergeTree", "p_1_1_0", "c1", 10, None, None), ("b1", "d", "dist", "Distributed", "x", "c0", 1, None, None), ("b2", "d", "t", "MergeTree", "p_1_1_0_5", "c1", 10, "b1", "p_1_1_0"), ("b2", "d", "t", "MergeTree", "q_1_1_0", "c2", 5, None, None), ("b2", "e", "u", "MergeTree", "r_1_1_0", "c3", 5, None, None)]
    backups = [("b1", "h", "created", START, START + timedelta(hours=1), False), ("b2", "h", "failed", START + timedelta(days=1), START + timedelta(days=1, hours=1), False)]
    p = spark.createDataFrame(parts, PARTS)
    return Catalog(spark.createDataFrame(backups, "name string, hostname string, state string, start_time timestamp_ntz, end_time timestamp_ntz, schema_only boolean"), p.select("backup", "database").distinct(), p)


CURRENT = "database string, table string, part string, checksum string, bytes long, disk_name string"


@pytest.fixture
def current(spark):
    return spark.createDataFrame([("d", "t", "p_1_1_0", "c1", 10, "default"), ("d", "t", "n_1_1_0", "c9", 10, "default"), ("d", "t", "s_1_1_0", "c8", 10, "cold"), ("e", "u", "r_1_1_0", "c3", 5, "default"), ("f", "v", "z_1_1_0", "c7", 5, "default")], CURRENT)


def test_new_backup(spark, catalog, current):
    now = START + timedelta(days=2)
    disks = spark.createDataFrame([("default", "Local", None), ("cold", "ObjectStorage", "S3")], "disk string, type string, object_storage_type string")
    made = commands.new_backup(catalog, "b3", current, "h", now, disks=disks, exclude=["f"], labels={"a": "2"}, usual_labels={"a": "1", "b": "1"})
    got = {r.part: (r.action, r.link) for r in made.parts.collect()}
    assert got == {"p_1_1_0": ("link", "b1"), "n_1_1_0": ("upload", None), "s_1_1_0": ("keep", None), "r_1_1_0": ("link", "b2")}
    meta = made.meta.first()
    assert (meta.name, meta.state, meta.labels, meta.schema_only) == ("b3", "creating", {"a": "2", "b": "1"}, False) and made.sources == set(commands.SOURCES)
    plan = lambda **o: commands.new_backup(catalog, "b3", current, "h", now, **o)
    assert {r.part for r in plan(databases=["e"]).parts.collect()} == {"r_1_1_0"}
    assert {r.part for r in plan(tables=["f.v"]).parts.collect()} == {"z_1_1_0"} and plan(tables=[]).parts.count() == 0
    assert {r.action for r in plan(dedup=False).parts.collect()} == {"upload"}
    assert plan(schema_only=True).parts.count() == 0 and plan(schema_only=True).meta.first().schema_only
    assert plan(sources={"access"}).sources == {"access"} and plan(sources={"data"}).sources == {"data", "schema"}
    assert plan(min_interval=3 * 86400).skipped == "b2" and plan(min_interval=3 * 86400, force=True).skipped is None and plan(min_interval=60).skipped is None
    for bad in ({"databases": ["d"], "tables": ["d.t"]}, {"sources": {"nothing"}}):
        with pytest.raises(ValueError):
            plan(**bad)
    for name in ("b1", "a b", "", "é", "x\n"):
        with pytest.raises(ValueError):
            commands.new_backup(catalog, name, current, "h", now)


TABLE = "database string, table string, engine string, uuid string, statement string"


@pytest.fixture
def stored_tables(spark):
    return spark.createDataFrame(
        [("d", "t", "MergeTree", "u1", "CREATE TABLE d.t (a Int32) ENGINE = MergeTree ORDER BY a"), ("d", "dist", "Distributed", None, "CREATE TABLE d.dist (a Int32) ENGINE = Distributed('c', 'd', 't')"),
         ("d", "v", "View", None, "CREATE VIEW d.v AS SELECT a FROM d.dist JOIN e.u USING a"), ("e", "u", "MergeTree", "u2", "CREATE TABLE e.u (a Int32) ENGINE = MergeTree ORDER BY a"), ("e", "u", "MergeTree", "u2", "CREATE TABLE e.u (a Int32) ENGINE = MergeTree ORDER BY a")], TABLE)


def plan_of(spark, catalog, tables, live=(), live_databases=(), state=(), **options):
    df = spark.createDataFrame
    databases = df([("d", "Atomic"), ("e", "Atomic")], "database string, engine string")
    required = options.pop("required", None)
    return commands.restore(
        catalog, options.pop("name", "b2"), databases, tables, df(list(live_databases), "database string, engine string"), df(list(live), TABLE), df(list(state), "database string, table string, part string, state string"),
        Choice(**options), df(required, "database string, table string") if required is not None else None,
    ).collect()


def test_restore_in_order(spark, catalog, stored_tables):
    rows = plan_of(spark, catalog, stored_tables, live_databases=[("d", "Lazy")], state=[("d", "t", "q_1_1_0", "restored"), ("d", "t", "p_1_1_0_5", "downloaded")])
    assert [(r.phase, r.kind, r.database, r.table, r.action) for r in rows if r.phase < 2] == [
        (0, "database", "d", None, "recreate"), (0, "database", "e", None, "create"), (1, "table", "d", "t", "create"), (1, "table", "e", "u", "create"), (1, "table", "d", "dist", "create"), (1, "table", "d", "v", "create"),
    ]
    assert [(r.part, r.action, r.stored_in, r.stored_as) for r in rows if r.phase == 2] == [("p_1_1_0_5", "attach", "b1", "p_1_1_0"), ("r_1_1_0", "download", "b2", "r_1_1_0")]
    assert not [r for r in rows if r.phase == 3]
    same = plan_of(spark, catalog, stored_tables, live=[("d", "t", "MergeTree", "u1", "ATTACH TABLE d.t ( a Int32 ) ENGINE = MergeTree ORDER BY a"), ("d", "dist", "Log", None, "CREATE TABLE d.dist (b Int8) ENGINE = Log")])
    assert {r.table: r.action for r in same if r.phase == 1} == {"t": "skip", "dist": "recreate", "v": "create", "u": "create"}


def test_restore_of_a_choice(spark, catalog, stored_tables):
    tables_of = lambda rows, phase=1: {r.table for r in rows if r.phase == phase}
    rows = plan_of(spark, catalog, stored_tables, include=("d.t*", "e.*"), exclude=("e.u",))
    assert tables_of(rows) == {"t"} and {r.part for r in rows if r.phase == 2} == {"p_1_1_0_5", "q_1_1_0"}
    assert tables_of(plan_of(spark, catalog, stored_tables, databases=["e"])) == {"u"} and plan_of(spark, catalog, stored_tables, databases=[]) == []
    assert not [r for r in plan_of(spark, catalog, stored_tables, schema_only=True) if r.phase == 2]
    assert not [r for r in plan_of(spark, catalog, stored_tables, sources=frozenset({"schema"})) if r.phase == 2]
    with pytest.raises(ValueError, match="not in b2: x"):
        plan_of(spark, catalog, stored_tables, databases=["x", "d"])
    # the view needs a table of a database that is left out
    with pytest.raises(ValueError, match="can't be restored.*d.v"):
        plan_of(spark, catalog, stored_tables, exclude_databases=("e",))
    rows = plan_of(spark, catalog, stored_tables, exclude_databases=("e",), keep_going=True)
    assert [(r.table, r.action, r.reason) for r in rows if r.phase == 3] == [("v", "fail", "missing")]
    # unless it is live
    rows = plan_of(spark, catalog, stored_tables, exclude_databases=("e",), live=[("e", "u", "MergeTree", "u2", "CREATE TABLE e.u (a Int32)")])
    assert tables_of(rows) == {"t", "dist", "v"}


def test_restore_that_finds_faults(spark, catalog, stored_tables):
    odd = stored_tables.unionByName(spark.createDataFrame([("d", "zz", "Log", "u1", "CREATE TABLE d.zz (a Int32) ENGINE = Log"), ("e", "w", "Log", None, None), ("e", "x", "View", None, "CREATE VIEW e.x AS SELECT 1 FROM e.y"), ("e", "y", "View", None, "CREATE VIEW e.y AS SELECT 1 FROM e.x")], TABLE))
    for match, tables in (("uuid", odd.where("`table` in ('t', 'zz')")), ("no statement", odd.where("`table` = 'w'")), ("can't be restored", odd.where("`table` in ('x', 'y')"))):
        with pytest.raises(ValueError, match=match):
            plan_of(spark, catalog, tables)
    with pytest.raises(ValueError, match="required.*d.q"):
        plan_of(spark, catalog, stored_tables, required=[("d", "q"), ("d", "t")])
    rows = plan_of(spark, catalog, odd, keep_going=True, required=[("d", "q"), ("d", "t")])
    assert {(r.table, r.reason) for r in rows if r.phase == 3} == {("zz", "conflict"), ("w", "no statement"), ("x", "cycle"), ("y", "cycle"), ("q", "absent")}
    assert {r.table for r in rows if r.phase == 1} == {"t", "dist", "v", "u"}


def test_restore_of_entities(spark):
    entity, collection = "name string, type string, parent string, statement string", "name string, statement string"
    entities = spark.createDataFrame([("all", "workload", None, "A"), ("user", "workload", "all", "U"), ("dev", "workload", "user", "D"), ("io", "resource", None, "R"), ("same", "workload", "all", "S")], entity)
    live = spark.createDataFrame([("user", "workload", None, "other"), ("io", "resource", None, "old"), ("same", "workload", None, "S")], entity).drop("parent")
    named, there = spark.createDataFrame([("n1", "N"), ("n2", "M"), ("n3", "K")], collection), spark.createDataFrame([("n2", "old"), ("n3", "K")], collection)
    got = [(r.action, r.name, r.statement) for r in commands.restore_entities(entities, live, named, there).collect()]
    assert got == [
        ("drop_resource", "io", None), ("create_resource", "io", "R"), ("create_workload", "all", "A"), ("drop_workload", "user", None), ("create_workload", "user", "U"), ("create_workload", "dev", "D"),
        ("create_named_collection", "n1", "N"), ("drop_named_collection", "n2", None), ("create_named_collection", "n2", "M"),
    ]
    with pytest.raises(ValueError, match="io is a resource"):
        commands.restore_entities(entities, live.withColumn("type", F.lit("workload")), named, there)


def test_purge_takes_what_has_no_metadata(spark, catalog):
    names = spark.createDataFrame([("b1",), ("b2",), ("lost",), ("lost",), (None,)], "backup string")
    plan = {(r.backup, r.action) for r in catalog.plan_purge(5, names=names).collect()}
    assert plan == {("lost", "delete_backup")} and catalog.plan_purge(names=names).count() == 0
    assert {(r.backup, r.action) for r in catalog.plan_purge(0, names=names).collect()} == {("lost", "delete_backup"), ("b1", "delete_backup"), ("b2", "delete_backup")}


def test_freezes(spark):
    tables = spark.createDataFrame([("d", "t"), ("d", "t"), ("d", "u"), (None, "x")], "database string, table string")
    parts = spark.createDataFrame([("d", "t", "p1", 1), ("d", "t", "p1", 1), ("d", "t", "p2", 0), ("e", "t", "p1", 1)], "database string, table string, partition_id string, active int")
    from stratakeep.plans.actions import freezes

    assert sorted((r.action, r.table or "") for r in freezes(tables, parts, "n").collect()) == [("freeze_table", "t"), ("freeze_table", "u"), ("unfreeze", "")]
    assert sorted((r.action, r.part or "") for r in freezes(tables, parts, "n", by_partition=True).collect()) == [("freeze_partition", "p1"), ("unfreeze", "")]


def test_cloud_metadata_that_is_stored(spark, catalog):
    paths = lambda *there: spark.createDataFrame([(p,) for p in there], "path string")
    got = lambda existing: sorted(r.path for r in catalog.cloud_metadata_paths("b2", "root", ["s3", "cold"], existing=existing).collect())
    assert len(got(None)) == 4
    assert got(paths("root/b2/disks/s3/d/t.tar", "root/b2/disks/s3.tar", "root/b2/disks/cold/e/u.tar", "root/b2/disks/cold/x/y.tar")) == ["root/b2/disks/cold/e/u.tar", "root/b2/disks/s3.tar"]
    assert got(paths("x")) == []


def test_statements_of_archives(spark):
    from stratakeep.sources import archives
    from stratakeep.sources.statements import database_statements, statement_members, table_statements

    tables = spark.createDataFrame([("d b", "t/1", "CREATE TABLE é"), ("d b", "t/1", "CREATE TABLE é"), ("d b", "none", None), ("e", "u+", "U")], "database string, table string, statement string")
    databases = spark.createDataFrame([("d b", "CREATE DATABASE"), ("x", None)], "database string, statement string")
    members = statement_members(tables, databases)
    back = archives.members(archives.tarballs(members))
    legacy = spark.createDataFrame([("r/b/metadata/e/u%2B.sql", bytearray(b"stale")), ("r/b/metadata/f/v.sql", bytearray(b"V")), ("r/b/metadata/g.sql", bytearray(b"G")), ("r/b/metadata/d%20b.sql", bytearray(b"stale")), ("other", bytearray(b""))], "path string, content binary")
    assert {tuple(r) for r in table_statements(back, legacy).collect()} == {("d b", "t/1", "CREATE TABLE é"), ("e", "u+", "U"), ("f", "v", "V")}
    assert {tuple(r) for r in database_statements(back, legacy).collect()} == {("d b", "CREATE DATABASE"), ("g", "G")}
    assert {tuple(r) for r in table_statements(back).collect()} == {("d b", "t/1", "CREATE TABLE é"), ("e", "u+", "U")}


def test_checksums_of_parts(spark):
    import hashlib

    from stratakeep.sources.files import part_checksums

    files = spark.createDataFrame([("p", "checksums.txt", bytearray(b"abc")), ("p", "data.bin", bytearray(b"x")), ("q", "data.bin", bytearray(b"y"))], "part string, name string, content binary")
    assert [tuple(r) for r in part_checksums(files, ["part"]).collect()] == [("p", hashlib.md5(b"abc").hexdigest())]


def test_times_in_another_zone(spark):
    from stratakeep.functions.ddl import placeholder_table
    from stratakeep.functions.text import TIME_FORMATS, format_time, parse_time

    rows = spark.createDataFrame([("2024-01-01 03:00:00", "%Y-%m-%d %H:%M:%S"), ("2024-01-01 06:00:00 +0300", "%Y-%m-%d %H:%M:%S %z"), ("2024-01-01 03:00:00.000000", "%Y-%m-%d %H:%M:%S.%f"), ("2024-01-01T03:00:00+0000", "%Y-%m-%dT%H:%M:%S%z"), ("x", "%Y-%m-%d %H:%M:%S")], "t string, f string")
    assert len(TIME_FORMATS) == 5
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        got = [r.x for r in rows.select(format_time(parse_time(F.col("t"), F.col("f"))).alias("x")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == ["2024-01-01 03:00:00.000000 +0000"] * 4 + [None]
    assert "UUID 'u'" in spark.range(1).select(placeholder_table(F.lit("u"))).first()[0]
