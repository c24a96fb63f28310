"""Queries over the backup catalogue: parts, dedup, totals, retention, deletion."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratakeep import fixtures as fx
from stratakeep.functions.names import effective_link_name, part_name, physical_name, same_but_mutation
from stratakeep.functions.text import format_time, label, merged, parse_time
from stratakeep.operators import dedup, retention, totals
from stratakeep.operators.prefix import batches, running, text_key
from stratakeep.operators.stalls import stalled
from stratakeep.queries import Registry
from stratakeep.sources import metadata

registry = Registry()
_INV, _SNAP, _BACKUPS = f"WITH {fx.INV}", f"WITH {fx.SNAP}", f"WITH {fx.BACKUPS}"


@registry.add("part_inventory", _INV + ' SELECT database, "table", engine, part, bytes, checksum FROM parts')
def part_inventory(spark, d):
    return fx.parts(spark, d).select("database", "table", "engine", "part", "bytes", "checksum")


@registry.add("active_partitions", _INV + ' SELECT DISTINCT "table", ym FROM parts')
def active_partitions(spark, d):
    return totals.partitions(fx.parts(spark, d).withColumn("active", F.lit(1)), ["table"], "ym")


_SPLIT = """split_part(part, '_', 1) AS partition_id, CAST(split_part(part, '_', 2) AS BIGINT) AS min_block,
CAST(split_part(part, '_', 3) AS BIGINT) AS max_block, CAST(split_part(part, '_', 4) AS BIGINT) AS level"""


@registry.add("part_name_parse", _INV + f""", named AS (SELECT part || CASE WHEN b = 3 THEN '_7' WHEN b = 2 THEN '_x' ELSE '' END AS part, b FROM parts)
SELECT part, CASE WHEN b <> 2 THEN partition_id END AS partition_id, CASE WHEN b <> 2 THEN min_block END AS min_block, CASE WHEN b <> 2 THEN max_block END AS max_block,
       CASE WHEN b <> 2 THEN level END AS level, CASE WHEN b = 3 THEN CAST(7 AS BIGINT) WHEN b <> 2 THEN CAST(0 AS BIGINT) END AS mutation
FROM (SELECT part, b, {_SPLIT} FROM named)""")
def part_name_parse(spark, d):
    suffix = F.when(F.col("b") == 3, "_7").when(F.col("b") == 2, "_x").otherwise("")
    return fx.parts(spark, d).select(F.concat("part", suffix).alias("part")).select("part", part_name(F.col("part")).alias("p")).select("part", "p.*")


@registry.add("part_sort", _INV + f', s AS (SELECT "table", part, {_SPLIT} FROM parts) SELECT "table", part, row_number() OVER (PARTITION BY "table" ORDER BY partition_id, min_block, max_block, level) AS place FROM s')
def part_sort(spark, d):
    p = fx.parts(spark, d).withColumn("p", part_name(F.col("part")))
    placed = running(p.withColumn("key", text_key(F.col("p.partition_id"))), ["table"], "key", ["p"], place=(F.sum, F.lit(1).cast("long"), True))
    return placed.select("table", "part", "place")


@registry.add("mutation_rename", _INV + """, n AS (SELECT part, part || '_4' AS renamed, CASE WHEN b = 1 THEN replace(part, '_0', '_1') ELSE part || '_9' END AS other, b FROM parts)
SELECT part, renamed, other, b <> 1 AS same, CASE WHEN b = 0 THEN 'stored' ELSE part END AS link_name FROM n""")
def mutation_rename(spark, d):
    n = fx.parts(spark, d).select("part", F.concat("part", F.lit("_4")).alias("renamed"), F.when(F.col("b") == 1, F.replace("part", F.lit("_0"), F.lit("_1"))).otherwise(F.concat("part", F.lit("_9"))).alias("other"), "b")
    link = effective_link_name(F.when(F.col("b") == 0, "stored"), F.col("part"), F.col("renamed"))
    return n.select("part", "renamed", "other", same_but_mutation(F.col("renamed"), F.col("other")).alias("same"), link.alias("link_name"))


LINK_PLAN = _SNAP + """, current AS (
  SELECT database, "table", CASE WHEN b = 1 THEN part || '_5' WHEN b = 2 AND y % 2 = 0 THEN replace(part, '_3_3_', '_3_4_') ELSE part END AS part,
         CASE WHEN ym LIKE '%12' THEN md5(checksum) ELSE checksum END AS checksum
  FROM parts
), used AS (SELECT * FROM catalog WHERE start_time >= TIMESTAMP '1997-01-01' AND NOT schema_only),
flags AS (
  SELECT *, coalesce(bool_or(state = 'created') OVER w, FALSE) AS rc, coalesce(bool_or(state = 'created' AND hostname = 'host1') OVER w, FALSE) AS oc
  FROM used WINDOW w AS (ORDER BY start_time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), usable AS (
  SELECT s.*, f.start_time, coalesce(s.link, s.backup) AS supplier, s.link IS NOT NULL AS verified
  FROM snap s JOIN flags f USING (backup)
  WHERE CASE WHEN engine LIKE '%Replicated%' THEN NOT rc ELSE NOT oc AND hostname = 'host1' END
    AND (s.link IS NULL OR s.link IN (SELECT backup FROM used))
), stored AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY database, "table", part ORDER BY start_time DESC) = 1),
top AS (
  SELECT c.database, c."table", c.part, s.part AS stored_part, s.supplier, s.link_part_name AS stored_link
  FROM current c JOIN stored s USING (database, "table", checksum)
  QUALIFY row_number() OVER (PARTITION BY c.database, c."table", c.part ORDER BY s.supplier DESC, s.part <> c.part, s.part) = 1
), good AS (
  SELECT *, CASE WHEN coalesce(stored_link, '') <> '' THEN stored_link WHEN stored_part <> part THEN stored_part END AS link_part_name FROM top
  WHERE list_slice(string_split(part, '_'), 1, 4) = list_slice(string_split(stored_part, '_'), 1, 4)
)
SELECT database, "table", part, CASE WHEN supplier IS NULL THEN 'upload' ELSE 'link' END AS action, supplier AS link, link_part_name
FROM current LEFT JOIN good USING (database, "table", part)"""


@registry.add("dedup_link_plan", LINK_PLAN)
def dedup_link_plan(spark, d):
    """The flagship: which current parts are linked to a stored one, and which must be uploaded."""
    name = F.when(F.col("b") == 1, F.concat("part", F.lit("_5"))).when((F.col("b") == 2) & (F.col("y") % 2 == 0), F.replace("part", F.lit("_3_3_"), F.lit("_3_4_"))).otherwise(F.col("part"))
    parts = fx.parts_once(spark, d)
    current = parts.select("database", "table", name.alias("part"), F.when(F.col("ym").like("%12"), F.md5("checksum")).otherwise(F.col("checksum")).alias("checksum"))
    used = dedup.considered(fx.catalog(spark, d, parts), "1997-01-01")
    databases = used.select("backup", F.lit("sales").alias("database"), "hostname", "state", "start_time")
    return dedup.link_plan(current, dedup.candidates(fx.snap(spark, d, parts), databases, used, "host1"))


@registry.add("dedup_candidates", LINK_PLAN.split("top AS (")[0].rstrip().removesuffix(",") + ' SELECT database, "table", part, supplier, verified, link_part_name, bytes FROM stored')
def dedup_candidates(spark, d):
    parts = fx.parts_once(spark, d)
    used = dedup.considered(fx.catalog(spark, d, parts), "1997-01-01")
    databases = used.select("backup", F.lit("sales").alias("database"), "hostname", "state", "start_time")
    return dedup.candidates(fx.snap(spark, d, parts), databases, used, "host1").select("database", "table", "part", "supplier", "verified", "link_part_name", "bytes")


@registry.add("dedup_checksum_docs", """SELECT doc_id, first_id, doc_id <> first_id AS is_copy FROM (
SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first_id FROM documents)""")
def dedup_checksum_docs(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("checksum"))
    first = docs.groupBy("checksum").agg(F.min("doc_id").alias("first_id"))
    return docs.join(first, "checksum").select("doc_id", "first_id", (F.col("doc_id") != F.col("first_id")).alias("is_copy"))


@registry.add("size_real_size", _SNAP + " SELECT backup, CAST(sum(bytes) AS BIGINT) AS size, CAST(coalesce(sum(bytes) FILTER (WHERE link IS NULL), 0) AS BIGINT) AS real_size FROM snap GROUP BY backup")
def size_real_size(spark, d):
    return totals.sizes(fx.snap(spark, d))


@registry.add("data_link_count", _SNAP + " SELECT backup, count(*) FILTER (WHERE link IS NULL) AS data_count, count(link) AS link_count FROM snap GROUP BY backup")
def data_link_count(spark, d):
    return totals.counts(fx.snap(spark, d))


@registry.add("list_created", _BACKUPS + " SELECT name, start_time, hostname FROM backups WHERE state = 'created'")
def list_created(spark, d):
    return retention.newest_first(fx.backups(spark, d).where("state = 'created'")).select("name", "start_time", "hostname")


@registry.add("last_backup", _BACKUPS + " SELECT name, state FROM backups ORDER BY start_time DESC, name DESC LIMIT 1")
def last_backup(spark, d):
    return retention.newest_first(fx.backups(spark, d)).limit(1).select("name", "state")


@registry.add("min_interval_gate", _BACKUPS + """ SELECT hostname, arg_max(name, struct_pack(s := start_time, n := name)) AS newest,
coalesce(max(start_time) + INTERVAL 3600 SECOND <= TIMESTAMP '2024-01-31 00:00:00', TRUE) AS allowed FROM backups GROUP BY hostname""")
def min_interval_gate(spark, d):
    return totals.interval_gate(fx.backups(spark, d).withColumn("end_time", F.col("start_time")), "2024-01-31 00:00:00", 3600, ["hostname"])


_SEEN = "coalesce(sum(CASE WHEN state = 'created' THEN 1 ELSE 0 END) OVER (ORDER BY start_time DESC, name DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@registry.add("retention_plan", _BACKUPS + f" SELECT name, state, {_SEEN} < 7 OR start_time >= TIMESTAMP '2024-01-30' AS retained FROM backups")
def retention_plan(spark, d):
    return retention.retention(fx.backups(spark, d), 7, "2024-01-30").select("name", "state", "retained")


@registry.add("purge_partial_plan", _BACKUPS + " SELECT name, state, (state <> 'created' AND row_number() OVER (ORDER BY start_time DESC, name DESC) > 1) OR name = 'e00000003' AS deleting FROM backups")
def purge_partial_plan(spark, d):
    return retention.purge_partial(fx.backups(spark, d), "e00000003").select("name", "state", "deleting")


_SPLIT_BACKUPS = _SNAP + """, retained AS (SELECT backup FROM catalog WHERE y % 2 = 1), deleting AS (SELECT backup FROM catalog WHERE y % 2 = 0),
refs AS (
  SELECT DISTINCT link AS backup, database, "table", coalesce(nullif(link_part_name, ''), part) AS part
  FROM snap WHERE backup IN (SELECT backup FROM retained) AND link IN (SELECT backup FROM deleting)
)"""


def _split(spark, d):
    parts = fx.parts_once(spark, d)
    c = fx.catalog(spark, d, parts)
    return fx.snap(spark, d, parts), c.where("y % 2 = 1").select("backup"), c.where("y % 2 = 0").select("backup")


@registry.add("delete_refs", _SPLIT_BACKUPS + ' SELECT backup, database, "table", part FROM refs')
def delete_refs(spark, d):
    return retention.references(*_split(spark, d))


@registry.add("delete_parts", _SPLIT_BACKUPS + ' SELECT backup, database, "table", part, bytes FROM snap s WHERE link IS NULL AND backup IN (SELECT backup FROM deleting) AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.backup = s.backup AND r.database = s.database AND r."table" = s."table" AND r.part = s.part)')
def delete_parts(spark, d):
    parts, keep, gone = _split(spark, d)
    return retention.deletable_parts(parts, gone, retention.references(parts, keep, gone)).select("backup", "database", "table", "part", "bytes")


@registry.add("delete_mode", _SPLIT_BACKUPS + " SELECT backup, CASE WHEN backup IN (SELECT backup FROM refs) THEN 'parts' ELSE 'full' END AS mode, CASE WHEN backup IN (SELECT backup FROM refs) THEN 'partially_deleted' END AS next_state FROM deleting")
def delete_mode(spark, d):
    parts, keep, gone = _split(spark, d)
    return retention.deletion_modes(gone, retention.references(parts, keep, gone))


@registry.add("partial_delete_sizes", _SPLIT_BACKUPS + """, gone AS (SELECT s.* FROM snap s WHERE link IS NULL AND backup IN (SELECT backup FROM deleting) AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.backup = s.backup AND r."table" = s."table" AND r.part = s.part)),
rest AS (SELECT * FROM snap s WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.backup = s.backup AND g."table" = s."table" AND g.part = s.part))
SELECT backup, CAST(sum(bytes) AS BIGINT) AS size, CAST(coalesce(sum(bytes) FILTER (WHERE link IS NULL), 0) AS BIGINT) AS real_size FROM rest GROUP BY backup""")
def partial_delete_sizes(spark, d):
    parts, keep, gone = _split(spark, d)
    removed = retention.deletable_parts(parts, gone, retention.references(parts, keep, gone))
    return totals.sizes(retention.without_parts(parts, removed))


def _documents(spark, d):
    parts = fx.parts_once(spark, d)
    return metadata.to_documents(fx.snap(spark, d, parts), fx.catalog(spark, d, parts))


@registry.add("flatten_parts", _SNAP + ' SELECT backup, database, "table", part, bytes, link FROM snap')
def flatten_parts(spark, d):
    return metadata.parts(metadata.parse(_documents(spark, d))).select("backup", "database", "table", "part", "bytes", "link")


@registry.add("decode_catalog", _SNAP + " SELECT backup AS name, hostname, state, start_time, n AS parts FROM catalog JOIN (SELECT backup, count(*) AS n FROM snap GROUP BY backup) USING (backup)")
def decode_catalog(spark, d):
    full = metadata.parse(_documents(spark, d))
    n = metadata.parts(full).groupBy(F.col("backup").alias("name")).agg(F.count(F.lit(1)).alias("parts"))
    return metadata.light(full).join(n, "name").select("name", "hostname", "state", F.to_timestamp_ntz(F.date_format("start_time", "yyyy-MM-dd HH:mm:ss")).alias("start_time"), "parts")


@registry.add("show_filtered", _SNAP + """ SELECT part, bytes, checksum FROM snap WHERE backup = 'b1997' AND database = 'sales' AND "table" = 'lineitem'""")
def show_filtered(spark, d):
    full = metadata.parse(_documents(spark, d))
    return metadata.show(full, "b1997", "sales", "lineitem").select("part", "bytes", "checksum")


@registry.add("empty_backups", _SNAP + ", s AS (SELECT c.backup, sum(CASE WHEN s.ym LIKE '%01' THEN s.bytes ELSE 0 END) AS size FROM catalog c LEFT JOIN snap s USING (backup) GROUP BY 1) SELECT backup, size = 0 AS empty FROM s")
def empty_backups(spark, d):
    parts = fx.parts_once(spark, d)
    return totals.emptiness(fx.catalog(spark, d, parts), fx.snap(spark, d, parts).where("ym LIKE '%01'"))


@registry.add("physical_name", _SNAP + " SELECT backup, part, coalesce(nullif(link_part_name, ''), part) AS stored_as FROM snap")
def physical_part_name(spark, d):
    return fx.snap(spark, d).select("backup", "part", physical_name(F.col("link_part_name"), F.col("part")).alias("stored_as"))


@registry.add("stall_runs", """WITH p AS (SELECT user_id, event_id, ts, CAST(floor(value / 25) AS BIGINT) AS ptr FROM events),
l AS (SELECT *, ptr = coalesce(lag(ptr) OVER w, ptr) AS still FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(CASE WHEN still THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM l)
SELECT user_id, event_id, ptr, CAST(sum(CASE WHEN still THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS BIGINT) AS stall_count FROM g""")
def stall_runs(spark, d):
    polls = fx.table(spark, d, "events").select("user_id", "event_id", "ts", F.floor(F.col("value") / 25).cast("long").alias("ptr"))
    return stalled(polls, ["user_id"], ["ts", "event_id"], "ptr").select("user_id", "event_id", "ptr", "stall_count")


@registry.add("bulk_delete_batches", "SELECT batch, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) AS BIGINT) AS batch FROM orders) GROUP BY batch")
def bulk_delete_batches(spark, d):
    dealt = batches(fx.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", [], 1000)
    return dealt.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@registry.add("label_kv", "SELECT event_id, split_part(l, '=', 1) AS key, CASE WHEN contains(l, '=') THEN substr(l, strpos(l, '=') + 1) END AS value FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type || '=' || props ELSE event_type || '=a=b' END AS l FROM events)")
def label_kv(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, F.concat_ws("=", "event_type", "props")).otherwise(F.concat("event_type", F.lit("=a=b")))
    return fx.table(spark, d, "events").select("event_id", label(text).alias("l")).select("event_id", "l.*")


@registry.add("props_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, d):
    return fx.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@registry.add("label_merge", "SELECT event_id, event_type AS own, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'default' END AS type, 'x' AS extra FROM events")
def label_merge(spark, d):
    base = F.create_map(F.lit("type"), F.lit("default"), F.lit("extra"), F.lit("x"))
    own = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("type"), F.col("event_type"))).otherwise(F.create_map().cast("map<string,string>"))
    return fx.table(spark, d, "events").select("event_id", F.col("event_type").alias("own"), merged(base, own).alias("m")).select("event_id", "own", F.col("m")["type"].alias("type"), F.col("m")["extra"].alias("extra"))


@registry.add("acl_counts", "SELECT user_id, count(DISTINCT event_type) AS acl_count, count(*) AS udf_count FROM events GROUP BY user_id")
def acl_counts(spark, d):
    e = fx.table(spark, d, "events").groupBy(F.col("user_id").alias("name")).agg(F.collect_set("event_type").alias("access_control"), F.count(F.lit(1)).alias("udf_count"))
    counted = totals.object_counts(e.withColumn("functions", F.lit(None).cast("array<string>"))).drop("udf_count")
    return counted.join(e.select("name", "udf_count"), "name").withColumnRenamed("name", "user_id")


@registry.add("any_failed", _BACKUPS + " SELECT hostname, bool_or(state = 'failed') AS any_failed FROM backups GROUP BY hostname")
def any_failed(spark, d):
    b = fx.backups(spark, d)
    return totals.holds(b.select("hostname").distinct(), b.where("state = 'failed'"), ["hostname"], "any_failed").select("hostname", "any_failed")


@registry.add("time_roundtrip", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '.000000 +0000' AS text, o_orderdate - INTERVAL 3 HOUR AS at_moscow, o_orderdate AS naive FROM orders")
def time_roundtrip(spark, d):
    o = fx.table(spark, d, "orders")
    at = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    with_zone = parse_time(F.concat(at, F.lit(" +0300")), F.lit("%Y-%m-%d %H:%M:%S %z"))
    naive = parse_time(at, F.lit("%Y-%m-%d %H:%M:%S"))
    plain = lambda c: F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return o.select("o_orderkey", format_time(naive).alias("text"), plain(with_zone).alias("at_moscow"), plain(naive).alias("naive"))
