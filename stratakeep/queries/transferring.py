"""Queries over transfers and servers: sealed chunks, checked reads, listings, clean-up, scans, and whole plans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from stratakeep import fixtures as fx
from stratakeep.fixtures import table
from stratakeep.functions.crypto import open_range, seal_chunks
from stratakeep.functions.names import quote_path
from stratakeep.operators import cleanup, transfers
from stratakeep.plans import commands
from stratakeep.plans.actions import freezes, with_statements
from stratakeep.plans.catalog import Catalog
from stratakeep.queries import Registry
from stratakeep.queries.catalogue import LINK_PLAN
from stratakeep.sources import scans
from stratakeep.sources.shared import stored
from stratakeep.sources.statements import statement_members, table_statements

registry = Registry()

_HEX = "hex(encode(coalesce(text, '')))"


@registry.add("sealed_chunks", f"""SELECT doc_id, CAST(8 + octet_length(encode(coalesce(text, ''))) + 28 * greatest(1, ceil(octet_length(encode(coalesce(text, ''))) / 1000)) AS BIGINT) AS sealed_bytes, md5({_HEX}) AS opened,
md5(substr({_HEX}, 2 * 700 + 1, 2 * 900)) AS part, FALSE AS elsewhere FROM documents""")
def sealed_chunks(spark, d):
    key, context = F.lit(b"an example's key"), F.col("doc_id").cast("string")
    docs = table(spark, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    sealed = docs.select("doc_id", seal_chunks(F.col("data"), key, 1000, context).alias("s"))
    opened = lambda *at, of=context: open_range(F.col("s"), key, *at, chunk=1000, context=of)
    return sealed.select("doc_id", F.octet_length("s").cast("long").alias("sealed_bytes"), F.md5(F.hex(opened())).alias("opened"), F.md5(F.hex(opened(700, 1600))).alias("part"), opened(of=F.lit("other")).isNotNull().alias("elsewhere"))


# A look at each object, then its answers: another generation now and then, some without bytes.
_ANSWERS = """answers AS (SELECT 'o' || user_id AS object, event_id + 1 AS seq, CASE WHEN event_id % 41 = 0 THEN 'g1' WHEN event_id % 5 = 0 THEN NULL ELSE 'g0' END AS told, (event_id % 3) * 10 AS received, CASE WHEN event_id % 41 = 0 THEN 70 ELSE 90 END AS total FROM events)"""


@registry.add("checked_reads", f"""WITH RECURSIVE {_ANSWERS},
n AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY seq) AS i FROM answers),
run(object, i, generation, total, delivered, failed_at) AS (
  SELECT DISTINCT object, CAST(0 AS BIGINT), 'g0', CAST(90 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM answers
  UNION ALL SELECT n.object, n.i, CASE WHEN told <> run.generation AND delivered = 0 THEN told ELSE run.generation END, CASE WHEN told <> run.generation AND delivered = 0 THEN n.total ELSE run.total END,
    CASE WHEN told <> run.generation AND delivered > 0 THEN delivered ELSE delivered + received END, CASE WHEN told <> run.generation AND delivered > 0 THEN n.seq END
  FROM run JOIN n ON n.object = run.object AND n.i = run.i + 1 WHERE failed_at IS NULL)
SELECT object, CASE WHEN failed_at IS NOT NULL THEN 'overwritten' WHEN delivered >= total THEN 'complete' ELSE 'partial' END AS state, delivered, generation, total, failed_at FROM run QUALIFY row_number() OVER (PARTITION BY object ORDER BY i DESC) = 1""")
def checked_reads(spark, d):
    n = F.col("event_id")
    object_ = F.concat(F.lit("o"), F.col("user_id").cast("string")).alias("object")
    e = table(spark, d, "events")
    told = F.when(n % 41 == 0, "g1").when(n % 5 == 0, F.lit(None)).otherwise("g0")
    answers = e.select(object_, (n + 1).alias("seq"), told.alias("generation"), (n % 3 * 10).alias("received"), F.when(n % 41 == 0, 70).otherwise(90).cast("long").alias("total"))
    looks = e.select(object_).distinct().select("object", F.lit(0).cast("long").alias("seq"), F.lit("g0").alias("generation"), F.lit(None).cast("long").alias("received"), F.lit(90).cast("long").alias("total"))
    return transfers.checked_reads(answers.unionByName(looks))


@registry.add("delimited_listing", """WITH p AS (SELECT DISTINCT replace(url, '://', '/') AS path FROM pages), sized AS (SELECT path, (SELECT max(page_id % 100) FROM pages WHERE replace(url, '://', '/') = path) AS size FROM p WHERE starts_with(path, 'https/') AND path <> 'https/'),
e AS (SELECT CASE WHEN contains(substr(path, 7), '/') THEN 'https/' || split_part(substr(path, 7), '/', 1) || '/' ELSE path END AS entry, size FROM sized),
g AS (SELECT entry AS path, entry LIKE '%/' AS is_prefix, CAST(sum(size) AS BIGINT) AS size, count(*) AS objects FROM e WHERE entry > 'https/m' GROUP BY entry)
SELECT CAST(floor((row_number() OVER (ORDER BY path) - 1) / 4) AS BIGINT) AS page, path, is_prefix, size, objects FROM g""")
def delimited_listing(spark, d):
    objects = table(spark, d, "pages").select(F.replace("url", F.lit("://"), F.lit("/")).alias("path"), (F.col("page_id") % 100).alias("size"))
    return transfers.delimited(objects, "https/", after="https/m", page=4)


@registry.add("coordination_cleanup", """WITH nodes AS (SELECT DISTINCT '/root/ch/s1/db/t' || o_custkey || '/replicas/r' || (o_orderkey % 3) AS node, o_custkey AS k, 'r' || (o_orderkey % 3) AS name FROM orders),
flags AS (SELECT DISTINCT '/root/ch/s1/db/t' || o_custkey || '/replicas/r' || (o_orderkey % 3) AS node FROM orders WHERE o_orderstatus = 'O'),
t AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 4 <> 3)
SELECT 'db' AS database, 't' || k AS "table", name, '/ch/s1/db/t' || k AS path, 1 AS step, 'drop_replica' AS action, node FROM nodes JOIN t USING (k)
UNION ALL SELECT 'db', 't' || k, name, '/ch/s1/db/t' || k, 0, 'delete_node', node || '/is_active' FROM nodes JOIN t USING (k) JOIN flags USING (node)""")
def coordination_cleanup(spark, d):
    k = F.col("c_custkey")
    name = F.concat(F.lit("t"), k.cast("string"))
    path = F.when(k % 4 == 0, "/ch/{shard}/{database}/{table}").when(k % 4 == 1, F.concat(F.lit("//ch/x/../{shard}/./{database}/"), name)).otherwise(F.concat(F.lit("/{top}/s1/db/t{uuid}")))
    engine = F.when(k % 4 == 3, "MergeTree").otherwise(F.concat(F.lit("ReplicatedMergeTree('"), path, F.lit("', '{replica}')")))
    tables = table(spark, d, "customer").select(F.lit("db").alias("database"), name.alias("table"), k.cast("string").alias("uuid"), F.concat(F.lit("CREATE TABLE db."), name, F.lit(" (a Int32) ENGINE = "), engine, F.lit(" ORDER BY a")).alias("statement"))
    macros = table(spark, d, "region").select(F.get(F.array(*map(F.lit, ("shard", "top", "table", "replica", "x"))), F.col("r_regionkey")).alias("macro"), F.get(F.array(*map(F.lit, ("s1", "ch", "no", "r1", "y"))), F.col("r_regionkey")).alias("substitution"))
    node = F.concat(F.lit("/root/ch/s1/db/t"), F.col("o_custkey").cast("string"), F.lit("/replicas/r"), (F.col("o_orderkey") % 3).cast("string"))
    both = F.array_compact(F.array(node, F.when(F.col("o_orderstatus") == "O", F.concat(node, F.lit("/is_active")))))
    return cleanup.clean_tables(tables, macros, table(spark, d, "orders").select(F.explode(both).alias("path")), "/root")


@registry.add("scan_tables", """WITH t AS (SELECT r_name AS database, n_name AS name, ['Log', 'Proxy', 'StorageProxy', 'MergeTree'][CAST(n_nationkey % 4 AS INT) + 1] AS engine, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'new' AS host, database, name, CASE WHEN engine IN ('Proxy', 'StorageProxy') THEN 0 ELSE 1 END AS n_paths, '/m' AS metadata_path FROM t
UNION ALL SELECT 'old', database, name, CASE WHEN engine = 'StorageProxy' THEN 0 ELSE 1 END, '/m' FROM t""")
def scan_tables(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    k = F.col("n_nationkey")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("r_name").alias("database"), F.col("n_name").alias("name"), F.get(F.array(*map(F.lit, ("Log", "Proxy", "StorageProxy", "MergeTree"))), k % 4).alias("engine"), F.lit("").alias("engine_full"), F.lit("").alias("create_table_query"),
        F.array(F.concat(F.lit("/data/"), k.cast("string"))).alias("data_paths"), F.lit("/m").alias("metadata_path"), F.lit(None).cast("string").alias("uuid"), F.make_timestamp_ntz(F.lit(2024), F.lit(1), k % 28 + 1, F.lit(0), F.lit(0), F.lit(0)).alias("metadata_modification_time"),
    )
    found = scans.of_servers([("new", "24.3", {"tables": rows}), ("old", "23.8", {"tables": rows})], scans.tables)
    return found.select("host", "database", "name", F.size("data_paths").alias("n_paths"), "metadata_path")


@registry.add("scan_replicas_disks", """SELECT 'replica' AS kind, 'd' || (s_nationkey % 3) AS name, 't' || s_suppkey AS detail, NULL AS type FROM supplier WHERE s_nationkey % 3 = 1 AND s_acctbal < 5000
UNION ALL SELECT 'disk', 'disk' || r_regionkey, repeat('/x', CAST(r_regionkey AS INT) + 1), v.t FROM region, (VALUES ('s3'), (NULL)) v(t)""")
def scan_replicas_disks(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("d"), (F.col("s_nationkey") % 3).cast("string")).alias("database"), F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("table"), (F.col("s_acctbal") < 5000).cast("int").alias("is_readonly"))
    disks = table(spark, d, "region").select(F.concat(F.lit("disk"), F.col("r_regionkey").cast("string")).alias("name"), F.repeat(F.lit("/x"), F.col("r_regionkey") + 1).alias("path"), F.lit("ObjectStorage").alias("type"), F.lit("s3").alias("object_storage_type"), F.lit("").alias("metadata_type"), F.lit("").alias("cache_path"))
    readonly = scans.replicas({"replicas": s}, "24.3", "d1", readonly=True).select(F.lit("replica").alias("kind"), F.col("database").alias("name"), F.col("table").alias("detail"), F.lit(None).cast("string").alias("type"))
    both = scans.of_servers([("a", "24.3", {"disks": disks}), ("b", "23.1", {"disks": disks})], scans.SCANS["disks"])
    return readonly.unionByName(both.select(F.lit("disk").alias("kind"), "name", F.col("path").alias("detail"), F.col("object_storage_type").alias("type")))


def _catalog(spark, d) -> Catalog:
    known = fx.parts_once(spark, d)
    backups = fx.catalog(spark, d, known).withColumnRenamed("backup", "name").withColumn("end_time", F.col("start_time") + F.expr("INTERVAL 1 HOUR"))
    parts = stored(fx.snap(spark, d, known), "snap")
    return Catalog(backups, parts.select("backup", "database").distinct(), parts)


@registry.add("plan_backup", LINK_PLAN.replace("SELECT database, \"table\", part, CASE WHEN supplier IS NULL THEN 'upload' ELSE 'link' END AS action, supplier AS link, link_part_name\nFROM current", """SELECT database, "table", part, CASE WHEN contains(part, '_1_1_') THEN 'keep' WHEN supplier IS NULL THEN 'upload' ELSE 'link' END AS action,
CASE WHEN NOT contains(part, '_1_1_') THEN supplier END AS link, CASE WHEN NOT contains(part, '_1_1_') THEN link_part_name END AS link_part_name, 'b2002' AS backup, 'creating' AS state, 'new' AS label FROM current"""))
def plan_backup(spark, d):
    name = F.when(F.col("b") == 1, F.concat("part", F.lit("_5"))).when((F.col("b") == 2) & (F.col("y") % 2 == 0), F.replace("part", F.lit("_3_3_"), F.lit("_3_4_"))).otherwise(F.col("part"))
    current = fx.parts(spark, d).select("database", "table", name.alias("part"), F.when(F.col("ym").like("%12"), F.md5("checksum")).otherwise(F.col("checksum")).alias("checksum"), "bytes", F.when(F.contains(name, F.lit("_1_1_")), "cold").otherwise("default").alias("disk_name"))
    disks = spark.createDataFrame([("default", "Local", None), ("cold", "ObjectStorage", "S3")], "disk string, type string, object_storage_type string")
    made = commands.new_backup(_catalog(spark, d), "b2002", stored(current, "current"), "host1", datetime(2003, 1, 1), disks=disks, since="1997-01-01", labels={"k": "new"}, usual_labels={"k": "old"}, min_interval=3600)
    one = made.meta.select(F.col("name").alias("backup"), "state", F.col("labels")["k"].alias("label"))
    return made.parts.select("database", "table", "part", "action", "link", "link_part_name").join(F.broadcast(one))


@registry.add("plan_purge", f"""WITH {fx.SNAP},
judged AS (SELECT backup, start_time >= TIMESTAMP '1998-06-01' OR coalesce(sum(CAST(state = 'created' AS INT)) OVER (ORDER BY start_time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 2 AS retained FROM catalog),
refs AS (SELECT DISTINCT link AS backup, database, "table", coalesce(link_part_name, part) AS part FROM snap WHERE link IN (SELECT backup FROM judged WHERE NOT retained) AND backup IN (SELECT backup FROM judged WHERE retained)),
gone AS (SELECT backup, backup IN (SELECT backup FROM refs) AS held FROM judged WHERE NOT retained)
SELECT backup, 'delete_backup' AS action, NULL AS database, NULL AS "table", NULL AS part, NULL AS next_state FROM gone WHERE NOT held
UNION ALL SELECT backup, 'set_state', NULL, NULL, NULL, 'partially_deleted' FROM gone WHERE held
UNION ALL SELECT s.backup, 'delete_part', s.database, s."table", s.part, NULL FROM snap s JOIN gone USING (backup) LEFT JOIN refs r ON r.backup = s.backup AND r.database = s.database AND r."table" = s."table" AND r.part = s.part WHERE held AND link IS NULL AND r.part IS NULL
UNION ALL SELECT 'lost' || r_regionkey, 'delete_backup', NULL, NULL, NULL, NULL FROM region""")
def plan_purge(spark, d):
    c = _catalog(spark, d)
    names = c.backups.select(F.col("name").alias("backup")).unionByName(table(spark, d, "region").select(F.concat(F.lit("lost"), F.col("r_regionkey").cast("string")).alias("backup")))
    return c.plan_purge(2, "1998-06-01", names)


# Two tables and views over them and each other; every fifth view is on the server already, every fifth after it in another form.
_ROUNDS = """o AS (SELECT 'lineitem' AS "table", -2 AS k, 'ReplicatedMergeTree' AS engine UNION ALL SELECT 'lineitem_local', -1, 'MergeTree' UNION ALL SELECT 'v' || n_nationkey, n_nationkey, 'View' FROM nation),
e AS (SELECT k, CASE WHEN k % 3 = 0 THEN -2 ELSE k - 1 END AS s FROM o WHERE k >= 0 UNION ALL SELECT k, -1 FROM o WHERE k >= 0 AND k % 3 = 2),
waited AS (SELECT k, s FROM e WHERE NOT (s >= 0 AND s % 5 = 0)),
far(k, d) AS (SELECT k, 0 FROM o UNION SELECT waited.k, d + 1 FROM far JOIN waited ON waited.s = far.k)"""


@registry.add("plan_restore", f"""WITH RECURSIVE {fx.SNAP}, {_ROUNDS}
SELECT 0 AS phase, NULL AS round, NULL AS rank, 'database' AS kind, 'sales' AS database, NULL AS "table", NULL AS part, 'create' AS action, NULL AS stored_in, NULL AS stored_as, NULL AS reason
UNION ALL SELECT 1, CAST((SELECT max(d) FROM far WHERE far.k = o.k) AS BIGINT), CASE WHEN k < 0 THEN 0 ELSE 3 END, 'table', 'sales', "table", NULL, CASE WHEN k >= 0 AND k % 5 = 0 THEN 'skip' WHEN k >= 0 AND k % 5 = 1 THEN 'recreate' ELSE 'create' END, NULL, NULL, NULL FROM o
UNION ALL SELECT 2, NULL, NULL, 'part', database, "table", part, CASE WHEN b = 2 THEN 'attach' ELSE 'download' END, coalesce(link, backup), coalesce(link_part_name, part), NULL FROM snap WHERE backup = 'b2001' AND b <> 1
UNION ALL SELECT 3, NULL, NULL, 'table', 'sales', 'wanted', NULL, 'fail', NULL, NULL, 'absent'""")
def plan_restore(spark, d):
    c, k = _catalog(spark, d), F.col("n_nationkey")
    view = lambda n: F.concat(F.lit("v"), n.cast("string"))
    source = F.when(k % 3 == 0, "lineitem").when(k % 3 == 1, view(k - 1)).otherwise(F.concat(view(k - 1), F.lit(" JOIN sales.lineitem_local USING a")))
    views = table(spark, d, "nation").select(F.lit("sales").alias("database"), view(k).alias("table"), F.lit("View").alias("engine"), F.concat(F.lit("u"), k.cast("string")).alias("uuid"), F.concat(F.lit("CREATE VIEW sales."), view(k), F.lit(" AS SELECT a FROM sales."), source).alias("statement"), k)
    held = c.parts.where("backup = 'b2001'")
    tables = held.select("database", "table", "engine").distinct().select("*", F.lit(None).cast("string").alias("uuid"), F.concat(F.lit("CREATE TABLE sales."), "table", F.lit(" (a Int32) ENGINE = MergeTree ORDER BY a")).alias("statement"))
    live = views.where("n_nationkey % 5 < 2").withColumn("statement", F.when(k % 5 == 1, F.concat("statement", F.lit(" LIMIT 1"))).otherwise(F.replace("statement", F.lit("CREATE"), F.lit("ATTACH"))))
    state = held.where("b in (1, 2)").select("database", "table", "part", F.when(F.col("b") == 1, "restored").otherwise("downloaded").alias("state"))
    databases = held.select("database").distinct().withColumn("engine", F.lit("Atomic"))
    required = spark.createDataFrame([("sales", "wanted"), ("sales", "lineitem")], "database string, table string")
    return commands.restore(c, "LAST", databases, tables.unionByName(views.drop("n_nationkey")), databases.limit(0), live.drop("n_nationkey"), state, commands.Choice(keep_going=True), required)


@registry.add("restore_entities", """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS name, CASE WHEN n_nationkey < 5 THEN 'r' || n_regionkey ELSE 'n' || (n_nationkey // 5) END AS parent, 'workload' AS kind, n_nationkey AS k FROM nation
UNION ALL SELECT 'r' || r_regionkey, NULL, 'workload', 2 FROM region UNION ALL SELECT 's' || s_suppkey, NULL, 'resource', s_suppkey FROM supplier),
t AS (SELECT name, 0 AS depth FROM e WHERE parent IS NULL AND kind = 'workload' UNION ALL SELECT e.name, t.depth + 1 FROM e JOIN t ON e.parent = t.name),
rows_ AS (SELECT CASE kind WHEN 'resource' THEN 0 ELSE 1 END AS phase, coalesce(depth, 0) AS depth, kind, name, CASE k % 3 WHEN 0 THEN 'skip' WHEN 1 THEN 'recreate' ELSE 'create' END AS action, 'CREATE ' || name AS statement FROM e LEFT JOIN t USING (name)
  UNION ALL SELECT 2, 0, 'named_collection', 'c' || c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'skip' ELSE 'create' END, c_name FROM customer)
SELECT phase, CAST(depth AS BIGINT) AS depth, 1 AS step, kind, name, 'create_' || kind AS action, statement FROM rows_ WHERE action <> 'skip' UNION ALL SELECT phase, depth, 0, kind, name, 'drop_' || kind, NULL FROM rows_ WHERE action = 'recreate'""")
def restore_entities(spark, d):
    n, r, s, c = (table(spark, d, t) for t in ("nation", "region", "supplier", "customer"))
    named = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    k = F.col("n_nationkey")
    parent = F.when(k < 5, named("r", "n_regionkey")).otherwise(F.concat(F.lit("n"), F.expr("n_nationkey div 5").cast("string")))
    none = F.lit(None).cast("string")
    parts = [n.select(named("n", "n_nationkey").alias("name"), F.lit("workload").alias("type"), parent.alias("parent"), k.cast("long").alias("k")), r.select(named("r", "r_regionkey").alias("name"), F.lit("workload").alias("type"), none.alias("parent"), F.lit(2).cast("long").alias("k")), s.select(named("s", "s_suppkey").alias("name"), F.lit("resource").alias("type"), none.alias("parent"), F.col("s_suppkey").alias("k"))]
    entities = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("statement", F.concat(F.lit("CREATE "), "name"))
    live = entities.where("k % 3 < 2").select("name", "type", F.when(F.col("k") % 3 == 1, "other").otherwise(F.col("statement")).alias("statement"))
    collections = c.select(named("c", "c_custkey").alias("name"), F.col("c_name").alias("statement"), "c_custkey")
    return commands.restore_entities(entities, live, collections.drop("c_custkey"), collections.where("c_custkey % 4 = 0").drop("c_custkey"))


_KINDS = (
    "attach_database", "attach_table", "attach_part", "freeze_table", "freeze_partition", "unfreeze", "drop_table", "drop_dictionary", "drop_database", "drop_function", "drop_named_collection", "drop_workload",
    "drop_resource", "restore_replica", "drop_replica", "drop_database_replica", "rename_table", "reload_config", "show_create_database", "kill_freeze", "none",
)


@registry.add("action_statements", """WITH a AS (SELECT p_partkey AS k, CAST(p_partkey % 21 AS INT) AS i, '`d' || p_size || '`' AS d, '`t' || p_partkey || '`' AS t, p_partkey || '_1_1_0' AS part, 'n' || p_size AS n, '/zk/' || p_partkey AS path FROM part)
SELECT k AS p_partkey, CASE i WHEN 0 THEN 'ATTACH DATABASE ' || d WHEN 1 THEN 'ATTACH TABLE ' || d || '.' || t WHEN 2 THEN 'ALTER TABLE ' || d || '.' || t || ' ATTACH PART ''' || part || '''' WHEN 3 THEN 'ALTER TABLE ' || d || '.' || t || ' FREEZE WITH NAME ''' || n || ''''
WHEN 4 THEN 'ALTER TABLE ' || d || '.' || t || ' FREEZE PARTITION ID ''' || part || ''' WITH NAME ''' || n || '''' WHEN 5 THEN 'SYSTEM UNFREEZE WITH NAME ''' || n || '''' WHEN 6 THEN 'DROP TABLE IF EXISTS ' || d || '.' || t || ' NO DELAY'
WHEN 7 THEN 'DROP DICTIONARY IF EXISTS ' || d || '.' || t || ' NO DELAY' WHEN 8 THEN 'DROP DATABASE IF EXISTS ' || d || ' NO DELAY' WHEN 9 THEN 'DROP FUNCTION `' || n || '`' WHEN 10 THEN 'DROP NAMED COLLECTION `' || n || '`'
WHEN 11 THEN 'DROP WORKLOAD `' || n || '`' WHEN 12 THEN 'DROP RESOURCE `' || n || '`' WHEN 13 THEN 'SYSTEM RESTORE REPLICA ' || d || '.' || t WHEN 14 THEN 'SYSTEM DROP REPLICA ''' || n || ''' FROM ZKPATH ''' || path || ''''
WHEN 15 THEN 'SYSTEM DROP DATABASE REPLICA ''' || n || ''' FROM ZKPATH ''' || path || '''' WHEN 16 THEN 'RENAME TABLE ' || d || '.' || t || ' TO ' || d || '.`' || n || '`' WHEN 17 THEN 'SYSTEM RELOAD CONFIG' WHEN 18 THEN 'SHOW CREATE DATABASE ' || d
WHEN 19 THEN 'KILL QUERY WHERE query_kind=''Alter'' AND user=''' || n || ''' AND query ILIKE ''%ALTER TABLE%FREEZE%''' END AS statement FROM a""")
def action_statements(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        k, F.get(F.array(*map(F.lit, _KINDS)), (k % len(_KINDS)).cast("int")).alias("action"), F.concat(F.lit("d"), F.col("p_size").cast("string")).alias("database"), F.concat(F.lit("t"), k.cast("string")).alias("table"),
        F.concat(k.cast("string"), F.lit("_1_1_0")).alias("part"), F.concat(F.lit("n"), F.col("p_size").cast("string")).alias("name"), F.concat(F.lit("/zk/"), k.cast("string")).alias("path"),
    )
    return with_statements(rows).select("p_partkey", "statement")


@registry.add("freeze_plan", f"""WITH {fx.INV} SELECT DISTINCT 'ALTER TABLE `' || database || '`.`' || "table" || '` FREEZE PARTITION ID ''' || ym || ''' WITH NAME ''new''' AS statement FROM parts WHERE b <> 3 UNION ALL SELECT 'SYSTEM UNFREEZE WITH NAME ''new'''""")
def freeze_plan(spark, d):
    parts = fx.parts(spark, d).select("database", "table", F.col("ym").alias("partition_id"), (F.col("b") != 3).cast("int").alias("active"))
    plan = freezes(parts, parts, "new", by_partition=True).withColumn("path", F.lit(None).cast("string"))
    return with_statements(plan).select("statement")


@registry.add("list_backups", f"""WITH {fx.SNAP} SELECT name, hostname, start_time, coalesce(size, 0) AS size, coalesce(real_size, 0) AS real_size, coalesce(data_count, 0) AS data_count, coalesce(link_count, 0) AS link_count
FROM (SELECT backup AS name, * FROM catalog WHERE state = 'created') LEFT JOIN (SELECT backup, CAST(sum(bytes) AS BIGINT) AS size, CAST(sum(CASE WHEN link IS NULL THEN bytes ELSE 0 END) AS BIGINT) AS real_size, count(*) - count(link) AS data_count, count(link) AS link_count FROM snap GROUP BY 1) s USING (backup)""")
def list_backups(spark, d):
    return _catalog(spark, d).list_backups().select("name", "hostname", "start_time", "size", "real_size", "data_count", "link_count")


@registry.add("plan_delete", f"""WITH {fx.SNAP}, gone AS (SELECT backup FROM catalog WHERE backup = 'b1996' OR (state <> 'created' AND backup <> (SELECT backup FROM catalog ORDER BY start_time DESC LIMIT 1))),
refs AS (SELECT DISTINCT link AS backup, "table", coalesce(link_part_name, part) AS part FROM snap WHERE link IN (SELECT backup FROM gone) AND backup NOT IN (SELECT backup FROM gone)),
held AS (SELECT backup, backup IN (SELECT backup FROM refs) AS held FROM gone)
SELECT backup, 'delete_backup' AS action, NULL AS part, NULL AS next_state FROM held WHERE NOT held UNION ALL SELECT backup, 'set_state', NULL, 'partially_deleted' FROM held WHERE held
UNION ALL SELECT s.backup, 'delete_part', s.part, NULL FROM snap s JOIN held USING (backup) LEFT JOIN refs r ON r.backup = s.backup AND r."table" = s."table" AND r.part = s.part WHERE held AND link IS NULL AND r.part IS NULL""")
def plan_delete(spark, d):
    return _catalog(spark, d).plan_delete("b1996", purge_partial=True).select("backup", "action", "part", "next_state")


@registry.add("stored_statements", """SELECT CASE WHEN p_partkey % 3 = 0 THEN 'old db' ELSE 'd-' || p_brand END AS database, p_name || p_partkey AS "table", 'CREATE TABLE x (a ' || p_type || ')' AS statement FROM part""")
def stored_statements(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k, F.when(k % 3 == 0, "old db").otherwise(F.concat(F.lit("d-"), "p_brand")).alias("database"), F.concat("p_name", k.cast("string")).alias("table"), F.concat(F.lit("CREATE TABLE x (a "), "p_type", F.lit(")")).alias("statement"))
    none = p.select("database", "statement").limit(0)
    members = statement_members(p.where("database <> 'old db'"), none)
    old = p.select(F.concat(F.lit("root/b1/metadata/"), quote_path(F.col("database")), F.lit("/"), quote_path(F.col("table")), F.lit(".sql")).alias("path"), F.encode(F.when(k % 3 == 0, F.col("statement")).otherwise("stale"), "UTF-8").alias("content"))
    return table_statements(members, old)
