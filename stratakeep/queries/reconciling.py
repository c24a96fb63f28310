"""Queries that compare what is stored with what is live, and select and order objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratakeep.fixtures import table
from stratakeep.operators import reconcile as rc
from stratakeep.operators import selection, totals, workloads
from stratakeep.queries import Registry
from stratakeep.sources import scans

registry = Registry()

#: Engine names that rows are given by their key.
ENGINES = ("MergeTree", "ReplicatedReplacingMergeTree", "View", "MaterializedView", "Distributed", "Kafka", "IcebergS3", "Dictionary", "Log", "LiveView")
_ENGINE = "['" + "', '".join(ENGINES) + "'][CAST({} % 10 AS INT) + 1]"


def _engine(column: str):
    return F.get(F.array(*map(F.lit, ENGINES)), (F.col(column) % len(ENGINES)).cast("int"))


@registry.add("engine_flags", f"""SELECT p_partkey, e AS engine, contains(e, 'MergeTree') AS is_merge_tree, contains(e, 'MergeTree') AND contains(e, 'Replicated') AS is_replicated, e IN ('View', 'LiveView', 'MaterializedView') AS is_view,
e = 'Distributed' AS is_distributed, e = 'MaterializedView' AS is_materialized_view, e = 'Kafka' OR e LIKE 'Iceberg%' AS is_external, e = 'Dictionary' AS is_dictionary FROM (SELECT p_partkey, {_ENGINE.format('p_partkey')} AS e FROM part)""")
def engine_flags(spark, d):
    p = table(spark, d, "part").select("p_partkey", _engine("p_partkey").alias("engine"))
    return p.select("p_partkey", "engine", *[c.alias(n) for n, c in rc.engine_flags(F.col("engine")).items()])


@registry.add("db_flags", """SELECT s_suppkey, e IN ('Atomic', 'Replicated') AS is_atomic, e = 'Replicated' AS is_replicated, e = 'MySQL' AS is_external, n IN ('default', 'system') AS is_embedded
FROM (SELECT s_suppkey, ['Atomic', 'Replicated', 'MySQL', 'Lazy'][CAST(s_suppkey % 4 AS INT) + 1] AS e, ['default', 'system', 'db'][CAST(s_suppkey % 3 AS INT) + 1] AS n FROM supplier)""")
def db_flags(spark, d):
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (F.col("s_suppkey") % len(names)).cast("int"))
    flags = rc.database_flags(pick(("default", "system", "db")), pick(("Atomic", "Replicated", "MySQL", "Lazy")))
    return table(spark, d, "supplier").select("s_suppkey", *[c.alias(n) for n, c in flags.items()])


@registry.add("disk_type", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 's3' ELSE lower(p_brand) END AS disk_type, p_partkey % 2 = 0 AS skips_dedup FROM part")
def disk_type(spark, d):
    kind = rc.disk_type(F.when(F.col("p_partkey") % 2 == 0, "ObjectStorage").otherwise(F.col("p_brand")), F.lit("S3"))
    return table(spark, d, "part").select("p_partkey", kind.alias("disk_type"), (kind == "s3").alias("skips_dedup"))


@registry.add("restore_order_rank", f"SELECT p_partkey, CASE WHEN contains(e, 'MergeTree') THEN 0 WHEN e = 'Distributed' THEN 2 WHEN e IN ('View', 'LiveView', 'MaterializedView') THEN 3 ELSE 1 END AS rank FROM (SELECT p_partkey, {_ENGINE.format('p_partkey')} AS e FROM part)")
def restore_order_rank(spark, d):
    return table(spark, d, "part").select("p_partkey", rc.restore_rank(_engine("p_partkey")).alias("rank")).orderBy("rank", "p_partkey")


@registry.add("restore_state_action", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'skip' WHEN 'O' THEN 'attach' ELSE 'download' END AS action FROM orders")
def restore_state_action(spark, d):
    orders = table(spark, d, "orders")
    state = orders.where("o_orderstatus <> 'P'").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "restored").otherwise("downloaded").alias("state"))
    return rc.part_actions(orders.select("o_orderkey"), state, ["o_orderkey"])


@registry.add("reconcile_left_join", "SELECT c_custkey AS id, CASE WHEN s_suppkey IS NULL THEN 'create' WHEN c_nationkey = s_nationkey THEN 'skip' ELSE 'recreate' END AS action FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def reconcile_left_join(spark, d):
    stored = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("engine"))
    return rc.reconcile(stored, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("engine")), ["id"], "engine").select("id", "action")


@registry.add("table_actions", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'create' WHEN c_custkey % 5 = 1 THEN 'skip' ELSE 'recreate' END AS action FROM customer")
def table_actions(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey") % 5
    wanted = c.select("c_custkey", F.lit("db").alias("database"), F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("table"), F.col("c_custkey").alias("uuid"), F.format_string("CREATE TABLE db.t%d (a Int32)", "c_custkey").alias("statement"))
    # of five: absent, the same in other spelling, another schema, another name with the uuid (twice)
    live = c.where(k > 0).select(
        F.lit("db").alias("database"), F.concat(F.when(k >= 3, "u").otherwise("t"), F.col("c_custkey").cast("string")).alias("table"), F.col("c_custkey").alias("uuid"),
        F.when(k == 1, F.format_string("ATTACH TABLE `db`.t%d ( a Int32 )", "c_custkey")).otherwise("CREATE TABLE x (b Int8)").alias("statement"),
    )
    return rc.table_actions(wanted, live).select("c_custkey", "action")


@registry.add("two_key_match", """SELECT c_custkey, coalesce(a.o, b.o) AS o_orderkey FROM customer
LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey % 7 AS k, max(o_orderkey) AS o FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON b.k = c_custkey % 7""")
def two_key_match(spark, d):
    wanted = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("uuid"), (F.col("c_custkey") % 7).alias("name"))
    have = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("uuid"), (F.col("o_custkey") % 7).alias("name"), "o_orderkey")
    return rc.match_two_ways(wanted, have, ["uuid"], ["name"], "o_orderkey").select("c_custkey", "o_orderkey")


@registry.add("dup_uuid_keep_first", """SELECT doc_id, CASE WHEN row_number() OVER w = 1 THEN 'keep' WHEN first(source) OVER w = source THEN 'duplicate' ELSE 'conflict' END AS verdict
FROM documents WINDOW w AS (PARTITION BY md5(text) ORDER BY doc_id)""")
def dup_uuid_keep_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit("db").alias("database"), F.col("source").alias("table"), F.md5(F.encode("text", "UTF-8")).alias("uuid"))
    return rc.first_of_uuid(docs, ["doc_id"]).select("doc_id", "verdict")


@registry.add("longest_prefix_disk", """WITH disks AS (SELECT DISTINCT 'd' || r_regionkey AS disk, ['http://', 'https://', 'https://blog.', 'http://m.', 'https://www.'][r_regionkey + 1] AS disk_path FROM region)
SELECT page_id, arg_max(disk, length(disk_path)) AS disk FROM pages LEFT JOIN disks ON starts_with(url, disk_path) GROUP BY page_id""")
def longest_prefix_disk(spark, d):
    paths = F.array(*map(F.lit, ("http://", "https://", "https://blog.", "http://m.", "https://www.")))
    disks = table(spark, d, "region").select(F.concat(F.lit("d"), F.col("r_regionkey").cast("string")).alias("disk"), F.get(paths, F.col("r_regionkey")).alias("disk_path"))
    return rc.longest_prefix(table(spark, d, "pages").select("page_id", "url"), disks, "url", ["page_id", "url"]).select("page_id", "disk")


@registry.add("topo_depth", """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS name, CASE WHEN n_nationkey < 5 THEN 'r' || n_regionkey ELSE 'n' || (n_nationkey // 5) END AS parent FROM nation
UNION ALL SELECT 'r' || r_regionkey, NULL FROM region),
t AS (SELECT name, parent, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.name, e.parent, t.depth + 1 FROM e JOIN t ON e.parent = t.name)
SELECT name, parent, depth FROM t""")
def topo_depth(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    key = F.col("n_nationkey")
    parent = F.when(key < 5, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).otherwise(F.concat(F.lit("n"), F.expr("n_nationkey div 5").cast("string")))
    e = n.select(F.concat(F.lit("n"), key.cast("string")).alias("name"), parent.alias("parent"))
    e = e.unionByName(r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("name"), F.lit(None).cast("string").alias("parent")))
    return workloads.depths(e)


@registry.add("sources_matrix", """WITH b AS (SELECT unnest([TRUE, FALSE]) AS v), m AS (SELECT r_regionkey, a.v AS access, s.v AS schema_, t.v AS data_, o.v AS only_ FROM region, b a, b s, b t, b o)
SELECT r_regionkey, access, schema_, data_, only_, CASE WHEN access OR schema_ OR data_ THEN access ELSE TRUE END AS b_access, CASE WHEN access OR schema_ OR data_ THEN access ELSE FALSE END AS r_access,
CASE WHEN access OR schema_ OR data_ THEN schema_ OR data_ ELSE TRUE END AS b_schema, CASE WHEN access OR schema_ OR data_ THEN data_ ELSE NOT only_ END AS b_data, NOT (access OR schema_ OR data_) AS b_udf FROM m""")
def sources_matrix(spark, d):
    m = table(spark, d, "region").select("r_regionkey")
    for c in ("access", "schema_", "data_", "only_"):
        m = m.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias(c))
    flags = {"access": F.col("access"), "schema": F.col("schema_"), "data": F.col("data_"), "udf": F.lit(False)}
    backup, restore = selection.sources(flags, F.col("only_")), selection.sources(flags, F.col("only_"), for_restore=True)
    return m.select("*", backup["access"].alias("b_access"), restore["access"].alias("r_access"), backup["schema"].alias("b_schema"), backup["data"].alias("b_data"), backup["udf"].alias("b_udf"))


@registry.add("union_catalog", "SELECT 'R' AS kind, r_name AS name FROM region UNION ALL SELECT 'N', n_name FROM nation UNION ALL SELECT 'S', s_name FROM supplier")
def union_catalog(spark, d):
    parts = [(table(spark, d, t), k, c) for t, k, c in (("region", "R", "r_name"), ("nation", "N", "n_name"), ("supplier", "S", "s_name"))]
    return workloads.tagged([(df.select(F.col(c).alias("name")), k) for df, k, c in parts], "kind").select("kind", "name")


@registry.add("columns_per_table", "SELECT o_orderstatus AS \"table\", list_sort(list(DISTINCT o_orderpriority)) AS columns, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def columns_per_table(spark, d):
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem").select("l_orderkey")
    j = orders.select(F.col("o_orderstatus").alias("table"), F.col("o_orderpriority").alias("column"), "o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    n = j.groupBy("table").agg(F.count(F.lit(1)).alias("n"))
    return totals.names_by_table(j.select("table", "column").distinct()).join(n, "table")


_LIVE = "nation JOIN region ON n_regionkey = r_regionkey"


def _live(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("database"), F.col("n_name").alias("table"), "n_nationkey")


@registry.add("live_tables", f"SELECT r_name AS database, n_name AS \"table\", {_ENGINE.format('n_nationkey')} AS engine, n_nationkey % 3 <> 0 AS has_data FROM {_LIVE} WHERE r_name <> 'ASIA'")
def live_tables(spark, d):
    live = selection.without_databases(_live(spark, d).select("database", "table", _engine("n_nationkey").alias("engine"), "n_nationkey"), ["ASIA"])
    with_data = live.where("n_nationkey % 3 <> 0").select("database", "table", "engine").withColumn("has_data", F.lit(True))
    return with_data.unionByName(live.where("n_nationkey % 3 = 0").select("database", "table", "engine").withColumn("has_data", F.lit(False)))


@registry.add("live_databases", f"SELECT r_name AS database, count(*) AS tables, list_sort(list(n_name)) AS names FROM {_LIVE} WHERE r_name NOT IN ('ASIA', 'EUROPE') GROUP BY 1")
def live_databases(spark, d):
    return selection.without_databases(_live(spark, d), ["ASIA", "EUROPE"]).groupBy("database").agg(F.count(F.lit(1)).alias("tables"), F.array_sort(F.collect_list("table")).alias("names"))


@registry.add("catalog_points", """SELECT n_name, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AS there, coalesce((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey), 0) AS n FROM nation""")
def catalog_points(spark, d):
    found = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return totals.holds(table(spark, d, "nation"), found, ["n_nationkey"]).select("n_name", "there", "n")


@registry.add("detached_tables", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 5 = 1)")
def detached_tables(spark, d):
    s = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    n = table(spark, d, "nation")
    return n.join(s.where("s_suppkey % 2 = 0"), "n_nationkey", "left_semi").join(s.where("s_suppkey % 5 = 1"), "n_nationkey", "left_anti").select("n_name")


@registry.add("exclude_databases", f"SELECT r_name AS database, n_name AS \"table\" FROM {_LIVE} WHERE r_name NOT IN ('AFRICA', 'system')")
def exclude_databases(spark, d):
    return selection.without_databases(_live(spark, d), ["AFRICA", "system"]).select("database", "table")


@registry.add("select_tables", f"SELECT r_name AS database, n_name AS \"table\" FROM {_LIVE} WHERE r_name || '.' || n_name IN ('AFRICA.NATION_0', 'ASIA.NATION_2', 'ASIA.NATION_0', 'EUROPE.x.y', 'AMERICA.NATION_1')")
def select_tables(spark, d):
    return selection.chosen_tables(_live(spark, d), ["AFRICA.NATION_0", "ASIA.NATION_2", "ASIA.NATION_0", "EUROPE.x.y", "AMERICA.NATION_1"]).select("database", "table")


@registry.add("empty_means_all", "SELECT n_name AS \"table\", 'all' AS filter FROM nation UNION ALL SELECT n_name, 'some' FROM nation WHERE n_name IN ('NATION_1', 'NATION_3', 'FRANCE')")
def empty_means_all(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("table"))
    everything = selection.listed(n, []).withColumn("filter", F.lit("all"))
    nothing = selection.only(n, []).withColumn("filter", F.lit("none"))
    return everything.unionByName(nothing).unionByName(selection.listed(n, ["NATION_1", "NATION_3", "FRANCE"]).withColumn("filter", F.lit("some")))


@registry.add("unchanged_tables", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def unchanged_tables(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("mtime"), F.col("o_custkey").alias("ctime"))
    before = o.withColumn("mtime", F.when(F.col("o_orderkey") % 3 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")))
    return selection.unchanged(o, before, ["o_orderkey"], ["mtime", "ctime"]).select("o_orderkey")


@registry.add("ddl_queue_errors", "SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY event_id")
def ddl_queue_errors(spark, d):
    kind = F.col("event_type")
    code, status = F.when(kind == "error", "49").when(kind == "view", F.lit(None)).otherwise("0"), F.when(kind == "click", "Finished").otherwise("Active")
    queue = table(spark, d, "events").select(F.col("event_id").cast("string").alias("entry"), kind.alias("query"), status.alias("status"), code.alias("exception_code"), F.lit("").alias("exception_text"), F.lit("c").alias("cluster"))
    errors = scans.ddl_errors({"distributed_ddl_queue": queue}, "24.3", "c")
    return errors.select(F.col("entry").cast("long").alias("event_id"), F.col("query").alias("event_type"))


@registry.add("missing_ddl", "SELECT c_custkey, o IS NULL AS missing FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def missing_ddl(spark, d):
    ddl = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").cast("string").alias("statement"))
    return rc.with_statements(table(spark, d, "customer"), ddl, ["c_custkey"]).select("c_custkey", F.col("statement").isNull().alias("missing"))


@registry.add("missing_required", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_required(spark, d):
    return rc.missing(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@registry.add("skip_summary", "SELECT CASE o_orderstatus WHEN 'F' THEN 'duplicate_uuid' WHEN 'P' THEN 'missing_statement' END AS reason, count(*) AS n FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1")
def skip_summary(spark, d):
    reason = F.when(F.col("o_orderstatus") == "F", "duplicate_uuid").when(F.col("o_orderstatus") == "P", "missing_statement")
    return totals.skip_summary(table(spark, d, "orders").select(reason.alias("reason")), "reason")


@registry.add("workload_reconcile", "SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN 'create' WHEN s_suppkey % 3 = 0 THEN 'error' WHEN s_nationkey = c_nationkey THEN 'skip' ELSE 'recreate' END AS action FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def workload_reconcile(spark, d):
    stored = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("name"), F.lit("workload").alias("type"), F.col("c_nationkey").alias("statement"))
    live = table(spark, d, "supplier").select(F.col("s_suppkey").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "resource").otherwise("workload").alias("type"), F.col("s_nationkey").alias("statement"))
    return rc.workload_actions(stored, live).select("c_custkey", "action")


@registry.add("readonly_fix", "SELECT s_suppkey FROM supplier WHERE s_acctbal < 5000 AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 0) EXCEPT SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 0")
def readonly_fix(spark, d):
    s = table(spark, d, "supplier")
    wanted = table(spark, d, "nation").where("n_regionkey > 0").select(F.col("n_nationkey").alias("s_nationkey"))
    restored = s.join(wanted, "s_nationkey", "left_semi")
    return rc.still_readonly(s.where("s_acctbal < 5000"), restored, s.where("s_suppkey % 4 = 0"), ["s_suppkey"])


@registry.add("admin_duplicates", """WITH m AS (SELECT s_nationkey, min(s_suppkey) AS main FROM supplier GROUP BY 1)
SELECT s_nationkey AS name, s_suppkey AS id, CASE WHEN (s_suppkey % 2) = (main % 2) THEN 'delete' ELSE 'differs' END AS verdict FROM supplier JOIN m USING (s_nationkey) WHERE s_suppkey <> main""")
def admin_duplicates(spark, d):
    s = table(spark, d, "supplier")
    users = s.select(F.col("s_nationkey").alias("name"), F.col("s_suppkey").alias("id"), F.format_string("GRANT %d TO admin EXCEPT ID('%d')", F.col("s_suppkey") % 2, "s_suppkey").alias("statement"))
    return rc.duplicate_admins(users, users.groupBy("name").agg(F.min("id").alias("id")))
