"""Queries over restores: what needs what, trees of nodes, access entities, states of backups and restores, whole documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratakeep import fixtures as fx
from stratakeep.fixtures import table
from stratakeep.operators import dependencies, lifecycle, tree
from stratakeep.plans import access
from stratakeep.queries import Registry
from stratakeep.sources import metadata, restore_state
from stratakeep.sources.shared import shared_folder, stored

registry = Registry()

# Ten kinds of objects by their key's last digit: tables, a Distributed one, views, a materialized view with a target,
# a dictionary; views that need the one before them ten keys ago, each other, or what isn't there.
_EDGES = """objects AS (SELECT c_custkey AS k, c_custkey % 10 AS m, c_custkey // 10 AS q FROM customer), e AS (
  SELECT k, k - 4 AS s FROM objects WHERE m = 4 UNION SELECT k, k - 1 FROM objects WHERE m = 5 UNION SELECT k, k - 5 FROM objects WHERE m = 5 UNION SELECT k, k - 10 FROM objects WHERE m = 5 AND q % 4 <> 0
  UNION SELECT k, k - 1 FROM objects WHERE m = 6 UNION SELECT k, k - 3 FROM objects WHERE m = 6 UNION SELECT k, k - 1 FROM objects WHERE m = 7
  UNION SELECT k, CASE WHEN q % 3 = 0 THEN k + 1 ELSE k - 1 END FROM objects WHERE m = 8 UNION SELECT k, CASE WHEN q % 3 <> 0 AND q % 5 = 0 THEN -k ELSE k - 1 END FROM objects WHERE m = 9)"""


@registry.add("restore_rounds", f"""WITH RECURSIVE {_EDGES},
missing AS (SELECT e.k, min('db.t' || s) AS lacking FROM e WHERE s NOT IN (SELECT k FROM objects) GROUP BY e.k),
inner_e AS (SELECT k, s FROM e WHERE s IN (SELECT k FROM objects)),
reach(k, s) AS (SELECT k, s FROM inner_e UNION SELECT reach.k, inner_e.s FROM reach JOIN inner_e ON reach.s = inner_e.k),
bad AS (SELECT k FROM missing UNION SELECT k FROM reach WHERE k = s),
stuck AS (SELECT k FROM bad UNION SELECT reach.k FROM reach JOIN bad ON reach.s = bad.k),
far(k, d) AS (SELECT k, 0 FROM objects WHERE k NOT IN (SELECT k FROM stuck) UNION SELECT inner_e.k, d + 1 FROM far JOIN inner_e ON inner_e.s = far.k WHERE inner_e.k NOT IN (SELECT k FROM stuck)),
rounds AS (SELECT k, max(d) AS round FROM far GROUP BY k)
SELECT 'db' AS database, 't' || k AS "table", CAST(round AS BIGINT) AS round,
       CASE WHEN round IS NOT NULL THEN NULL WHEN lacking IS NOT NULL THEN 'missing' WHEN k IN (SELECT k FROM reach WHERE k = s) THEN 'cycle' ELSE 'blocked' END AS reason, lacking
FROM objects LEFT JOIN rounds USING (k) LEFT JOIN missing USING (k)""")
def restore_rounds(spark, d):
    k = F.col("c_custkey")
    m, q = k % 10, F.floor(k / 10)
    at = lambda off: F.concat(F.lit("t"), (k + off).cast("string"))
    view = lambda *names: F.concat(F.lit("CREATE VIEW db."), at(0), F.lit(" AS SELECT a FROM "), *names)
    statement = (
        F.when(m < 4, F.concat(F.lit("CREATE TABLE db."), at(0), F.lit(" (a String DEFAULT 'x FROM y') ENGINE = MergeTree ORDER BY a")))
        .when(m == 4, F.concat(F.lit("CREATE TABLE db."), at(0), F.lit(" (a Int32) ENGINE = Distributed('main', 'db', '"), at(-4), F.lit("', rand())")))
        .when(m == 5, view(F.lit("db."), at(-1), F.lit(" JOIN `db`.`"), at(-5), F.lit("` USING a"), F.when(q % 4 != 0, F.concat(F.lit(" LEFT JOIN "), at(-10), F.lit(" USING a"))).otherwise("")))
        .when(m == 6, F.concat(F.lit("CREATE MATERIALIZED VIEW db."), at(0), F.lit(" TO db."), at(-3), F.lit(" AS SELECT extract(YEAR FROM a) FROM db."), at(-1)))
        .when(m == 7, F.concat(F.lit("CREATE DICTIONARY db."), at(0), F.lit(" (a Int32) PRIMARY KEY a SOURCE(SERVER(HOST 'localhost' DB 'db' TABLE '"), at(-1), F.lit("')) LAYOUT(FLAT()) LIFETIME(0)")))
        .when(m == 8, view(F.lit("db."), F.when(q % 3 == 0, at(1)).otherwise(at(-1))))
        .otherwise(view(F.lit("db."), F.when((q % 3 != 0) & (q % 5 == 0), F.concat(F.lit("`t-"), k.cast("string"), F.lit("`"))).otherwise(at(-1))))
    )
    objects = table(spark, d, "customer").select(F.lit("db").alias("database"), at(0).alias("table"), statement.alias("statement"))
    return dependencies.restore_rounds(objects, dependencies.dependencies(objects))


# A log of nodes down to /t/<user>/<n>: creations, values, and deletions of nodes and of trees.
_LOG = """log AS (SELECT event_id AS version, CASE WHEN event_id % 997 = 500 OR event_id % 13 = 0 THEN 'delete_tree' WHEN event_id % 13 < 3 THEN 'delete' WHEN event_id % 13 < 6 THEN 'set' ELSE 'create' END AS op,
CASE WHEN event_id % 997 = 500 THEN '/t' WHEN event_id % 11 = 0 THEN '/t/' || (user_id % 50) ELSE '/t/' || (user_id % 50) || '/' || (event_id % 7) END AS path, event_type AS value FROM events)"""


@registry.add("kv_replay", f"""WITH {_LOG},
ops AS (SELECT version, op, path, value FROM log
  UNION ALL SELECT version, 'made', '/t', '' FROM log WHERE op = 'create' AND path <> '/t' UNION ALL SELECT version, 'made', regexp_extract(path, '^/t/[^/]+'), '' FROM log WHERE op = 'create' AND path LIKE '/t/%/%'),
nodes AS (SELECT path, max(version) FILTER (op IN ('create', 'set')) AS put, arg_max(value, version) FILTER (op IN ('create', 'set')) AS value, max(version) FILTER (op = 'made') AS made,
  max(version) FILTER (op LIKE 'delete%') AS gone FROM ops GROUP BY path),
cuts AS (SELECT path, greatest(gone, (SELECT max(version) FROM log WHERE op = 'delete_tree' AND starts_with(nodes.path, log.path || '/'))) AS last, put, value, made FROM nodes)
SELECT path, CASE WHEN put IS NOT NULL AND put >= coalesce(last, 0) THEN value ELSE '' END AS value, CASE WHEN put IS NOT NULL AND put >= coalesce(last, 0) THEN put ELSE made END AS version
FROM cuts WHERE put >= coalesce(last, 0) OR made >= coalesce(last, 0)""")
def kv_replay(spark, d):
    n = F.col("event_id")
    user = F.concat(F.lit("/t/"), (F.col("user_id") % 50).cast("string"))
    op = F.when((n % 997 == 500) | (n % 13 == 0), "delete_tree").when(n % 13 < 3, "delete").when(n % 13 < 6, "set").otherwise("create")
    path = F.when(n % 997 == 500, "/t").when(n % 11 == 0, user).otherwise(F.concat(user, F.lit("/"), (n % 7).cast("string")))
    return tree.replay(table(spark, d, "events").select(n.alias("version"), op.alias("op"), path.alias("path"), F.col("event_type").alias("value")))


# Entities whose names are given to several ids in turn, and a tree in which suppliers have some of the names.
_ACCESS = """links AS (SELECT c_custkey AS position, 'u' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'U' ELSE 'R' END AS char, 'user%2D' || (c_custkey % 100) AS name, c_name AS statement FROM customer),
there AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'U' ELSE 'R' END AS char, 'user%2D' || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'u' ELSE 'old' END || s_suppkey AS there FROM supplier),
olds AS (SELECT links.*, coalesce(lag(id) OVER (PARTITION BY char, name ORDER BY position), there) AS old FROM links LEFT JOIN there USING (char, name)),
plan AS (SELECT position, 0 AS step, 'create' AS op, '/ch/access/uuid/' || id AS path, statement AS value FROM olds
  UNION ALL SELECT position, 1, 'delete', '/ch/access/uuid/' || old, NULL FROM olds WHERE old <> id
  UNION ALL SELECT position, 2, 'create', '/ch/access/' || char || '/' || name, id FROM olds WHERE old IS NULL OR old <> id)"""


def _entities(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("position"), F.concat(F.lit("u"), k.cast("string")).alias("id"), F.when(k % 2 == 0, "U").otherwise("R").alias("char"), F.concat(F.lit("user-"), (k % 100).cast("string")).alias("name"), F.col("c_name").alias("statement")
    )


def _tree(spark, d):
    s = F.col("s_suppkey")
    id_ = F.concat(F.when(s % 3 == 0, "u").otherwise("old"), s.cast("string"))
    link = F.concat(F.lit("/ch/access/"), F.when(s % 2 == 0, "U").otherwise("R"), F.lit("/user%2D"), s.cast("string"))
    pair = F.explode(F.array(F.struct(link.alias("path"), id_.alias("value")), F.struct(F.concat(F.lit("/ch/access/uuid/"), id_).alias("path"), F.lit("before").alias("value"))))
    return table(spark, d, "supplier").select(pair.alias("p")).select("p.*")


@registry.add("access_restore_plan", f"WITH {_ACCESS} SELECT position, step, op, path, value FROM plan")
def access_restore_plan(spark, d):
    return access.restore_access(_entities(spark, d), _tree(spark, d), "/ch/access")


@registry.add("access_restored", f"""WITH {_ACCESS},
log AS (SELECT 0 AS version, 'create' AS op, '/ch/access/' || char || '/' || name AS path, there AS value FROM there UNION ALL SELECT 0, 'create', '/ch/access/uuid/' || there, 'before' FROM there
  UNION ALL SELECT position * 3 + step + 1, op, path, value FROM plan),
nodes AS (SELECT path, arg_max(value, version) FILTER (op = 'create') AS value, max(version) FILTER (op = 'create') AS put, max(version) FILTER (op = 'delete') AS gone FROM log GROUP BY path)
SELECT path, value FROM nodes WHERE put >= coalesce(gone, 0)
UNION ALL SELECT DISTINCT unnest(['/ch', '/ch/access', '/ch/access/uuid', '/ch/access/' || char]), '' FROM (SELECT char FROM links UNION SELECT char FROM there) WHERE char = 'U'
UNION ALL SELECT DISTINCT '/ch/access/' || char, '' FROM (SELECT char FROM links UNION SELECT char FROM there) WHERE char <> 'U'""")
def access_restored(spark, d):
    state = _tree(spark, d)
    plan = access.restore_access(_entities(spark, d), state, "/ch/access")
    return tree.replay(tree.as_log(state).unionByName(access.as_versions(plan))).select("path", "value")


_NAMES = ("begin", "renew", "finish", "fail", "delete", "remove", "keep_shared", "other")
_EVENT = "['" + "', '".join(_NAMES) + "'][CAST((event_id * 7 + user_id) % 8 AS INT) + 1]"
_RULES = ", ".join(f"('{a}', '{b}', '{c}')" for (a, b), c in lifecycle.NEXT.items())


@registry.add("backup_states", f"""WITH RECURSIVE rules(before, event, after) AS (VALUES {_RULES}),
e AS (SELECT 'u' || user_id AS backup, event_id AS seq, {_EVENT} AS event, event_id * 10.0 AS moment, CASE WHEN (event_id * 7 + user_id) % 8 < 2 THEN event_id * 10.0 + 500 * (event_id % 9) END AS until FROM events),
n AS (SELECT *, row_number() OVER w AS i, coalesce(moment > last_value(until IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS expired FROM e WINDOW w AS (PARTITION BY backup ORDER BY seq)),
run(backup, i, seq, event, state, legal) AS (
  SELECT backup, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), '', 'none', TRUE FROM (SELECT DISTINCT backup FROM n)
  UNION ALL SELECT n.backup, n.i, n.seq, n.event, coalesce(rules.after, CASE WHEN n.expired AND run.state = 'creating' THEN 'failed' ELSE run.state END), rules.after IS NOT NULL
  FROM run JOIN n ON n.backup = run.backup AND n.i = run.i + 1
  LEFT JOIN rules ON rules.event = n.event AND rules.before = CASE WHEN n.expired AND run.state = 'creating' THEN 'failed' ELSE run.state END)
SELECT backup, seq, event, state, legal FROM run WHERE i > 0""")
def backup_states(spark, d):
    n, kind = F.col("event_id"), (F.col("event_id") * 7 + F.col("user_id")) % 8
    events = table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("backup"), n.alias("seq"), F.get(F.array(*map(F.lit, _NAMES)), kind.cast("int")).alias("event"), (n * 10.0).alias("at"), F.when(kind < 2, 500.0 * (n % 9)).alias("lease")
    )
    return lifecycle.backup_states(events)


@registry.add("restore_state_document", """WITH o AS (SELECT 'd' || (o_custkey % 5) AS database, o_orderpriority AS "table", CAST(o_orderkey AS VARCHAR) AS part, o_orderstatus AS s, o_orderkey AS k FROM orders)
SELECT 'part' AS kind, database, "table", part, NULL AS path, CASE max(CASE s WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END) WHEN 3 THEN 'restored' WHEN 2 THEN 'downloaded' ELSE 'invalid' END AS value FROM o GROUP BY ALL
UNION ALL SELECT DISTINCT 'failure', database, "table", part, NULL, 'lost ' || part FROM o WHERE s = 'P' UNION ALL SELECT DISTINCT 'failure', database, "table", NULL, '/detached/' || part, NULL FROM o WHERE k % 50 = 0""")
def restore_state_document(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        F.concat(F.lit("d"), (F.col("o_custkey") % 5).cast("string")).alias("database"), F.col("o_orderpriority").alias("table"), k.cast("string").alias("part"), "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "restored").when(F.col("o_orderstatus") == "O", "downloaded").otherwise("invalid").alias("state"),
    )
    none = F.lit(None).cast("string")
    bad = o.where("state = 'invalid'").select("database", "table", "part", none.alias("path"), F.concat(F.lit("lost "), "part").alias("error"))
    bad = bad.unionByName(o.where("o_orderkey % 50 = 0").select("database", "table", none.alias("part"), F.concat(F.lit("/detached/"), "part").alias("path"), none.alias("error")))
    documents = stored(restore_state.to_documents(o.select("database", "table", "part", "state"), bad, line=200), "restore-state")
    parts = restore_state.parts_of(documents).select(F.lit("part").alias("kind"), "database", "table", "part", none.alias("path"), F.col("state").alias("value"))
    return parts.unionByName(restore_state.failures_of(documents).select(F.lit("failure").alias("kind"), "database", "table", "part", "path", F.col("error").alias("value")))


@registry.add("catalogue_round_trip", f"""WITH {fx.SNAP}
SELECT s.backup, c.hostname, c.state, 'v' || c.y AS label, 'uuid-' || s.database AS database_uuid, 'Atomic' AS database_engine, 'uuid-' || s."table" AS table_uuid, s.database, s."table", s.engine, s.part, s.checksum, s.bytes,
       [s.part || '.tar', 'f' || s.b] AS files, s.b = 1 AS tarball, s.link, s.link_part_name, CASE WHEN s.b = 2 THEN 's3' ELSE 'default' END AS disk_name, s.b <> 0 AS encrypted
FROM snap s JOIN catalog c ON c.backup = s.backup""")
def catalogue_round_trip(spark, d):
    parts = stored(fx.snap(spark, d), "snap")
    parts = parts.withColumn("files", F.array(F.concat("part", F.lit(".tar")), F.concat(F.lit("f"), F.col("b").cast("string")))).withColumn("tarball", F.col("b") == 1)
    parts = parts.withColumn("disk_name", F.when(F.col("b") == 2, "s3").otherwise("default")).withColumn("encrypted", F.col("b") != 0)
    databases = parts.select("backup", "database").distinct().select("*", F.lit("Atomic").alias("engine"), F.concat(F.lit("uuid-"), "database").alias("uuid"))
    tables = parts.select("backup", "database", "table", "engine").distinct().withColumn("uuid", F.concat(F.lit("uuid-"), "table"))
    backups = fx.catalog(spark, d).withColumnRenamed("backup", "name").withColumn("labels", F.create_map(F.lit("year"), F.concat(F.lit("v"), F.col("y").cast("string"))))
    root = f"{shared_folder(spark)}/catalogue-{uuid.uuid4().hex}"
    metadata.write_catalogue(metadata.Catalogue(backups, databases, tables, parts), root, piece=50)
    c = metadata.read_catalogue(spark, root)
    out = c.parts.join(c.databases.select("backup", "database", F.col("engine").alias("database_engine"), F.col("uuid").alias("database_uuid")), ["backup", "database"])
    out = out.join(c.tables.select("backup", "database", "table", F.col("uuid").alias("table_uuid")), ["backup", "database", "table"])
    return out.join(c.backups.select(F.col("name").alias("backup"), "hostname", "state", F.col("labels")["year"].alias("label")), "backup")
