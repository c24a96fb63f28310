"""Queries over names, paths and statements; the texts are made of columns by the same rule on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratakeep.fixtures import table
from stratakeep.functions import ddl, names, text
from stratakeep.queries import Registry

registry = Registry()


def _hex_pairs(column: str, kept: str) -> str:
    """DuckDB: every byte outside of the kept class as %XX."""
    return f"""(SELECT string_agg(CASE WHEN regexp_matches(c, '[{kept}]') THEN c ELSE regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') END, '' ORDER BY i)
      FROM (SELECT unnest(string_split({column}, '')) AS c, unnest(range(len({column}))) AS i))"""


_NAMED = "p_name || '-' || p_brand || '.é~_' AS raw"


def _raw(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit("-"), "p_brand", F.lit(".é~_")).alias("raw"))


@registry.add("escape_name", f"SELECT p_partkey, {_hex_pairs('raw', 'A-Za-z0-9_')} AS name FROM (SELECT p_partkey, {_NAMED} FROM part)")
def escape_name(spark, d):
    return _raw(spark, d).select("p_partkey", names.escape_file_name(F.col("raw")).alias("name"))


@registry.add("quote_path", f"SELECT p_partkey, {_hex_pairs('raw', 'A-Za-z0-9_~')} AS name FROM (SELECT p_partkey, {_NAMED} FROM part)")
def quote_path(spark, d):
    return _raw(spark, d).select("p_partkey", names.quote_path(F.col("raw")).alias("name"))


@registry.add("sanitize_name", f"SELECT p_partkey, replace(raw, '-', '_') AS clean, replace(raw || '`x', '`', '\\`') AS escaped FROM (SELECT p_partkey, {_NAMED} FROM part)")
def sanitize_name(spark, d):
    return _raw(spark, d).select("p_partkey", names.sanitise_backup_name(F.col("raw")).alias("clean"), names.backtick_escape(F.concat("raw", F.lit("`x"))).alias("escaped"))


@registry.add("valid_names", "SELECT event_id, regexp_full_match(n, '[A-Za-z0-9_-]+') AS valid FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || ' x' WHEN 1 THEN '' ELSE event_type || '-' || event_id END AS n FROM events)")
def valid_names(spark, d):
    k = F.col("event_id") % 4
    n = F.when(k == 0, F.concat("event_type", F.lit(" x"))).when(k == 1, "").otherwise(F.concat_ws("-", "event_type", F.col("event_id").cast("string")))
    return table(spark, d, "events").select("event_id", names.valid_name(n).alias("valid"))


@registry.add("layout_paths", f"""SELECT p_partkey, 'root/b/metadata/' || q || '.tar' AS database_path, 'root/b/data/' || q || '/t%2E1/all_1_1_0/all_1_1_0.tar' AS part_path,
'root/b/disks/s3/' || q || '/t.tar.gz' AS disk_path, 'root/b/udf/' || q AS udf_path, 'root/b/backup_light_struct.json' AS light_path, 'root/b/backup_struct.json' AS full_path,
'root/b/access_control/access_control.tar' AS acl_path, 'root/b/metadata/databases.tar' AS databases_path, 'root/b/metadata/' || q || '/t.sql' AS legacy_table_path,
'root/b/named_collections/' || q || '.sql' AS collection_path, 'root/b/workload_entities/' || q || '.sql' AS workload_path, 'root/b/disks/s3.tar' AS legacy_disk_path
FROM (SELECT p_partkey, {_hex_pairs('raw', 'A-Za-z0-9_~')} AS q FROM (SELECT p_partkey, {_NAMED} FROM part))""")
def layout_paths(spark, d):
    n, b = F.col("raw"), F.lit("b")
    return _raw(spark, d).select(
        "p_partkey", names.database_path("root", b, n).alias("database_path"), names.part_path("root", b, n, F.lit("t.1"), F.lit("all_1_1_0")).alias("part_path"),
        names.disk_table_path("root", b, F.lit("s3"), n, F.lit("t"), True).alias("disk_path"), names.udf_path("root", b, n).alias("udf_path"), names.metadata_path("root", b, True).alias("light_path"),
        names.metadata_path("root", b).alias("full_path"), names.access_control_path("root", b).alias("acl_path"), names.databases_path("root", b).alias("databases_path"),
        names.legacy_table_path("root", b, n, F.lit("t")).alias("legacy_table_path"), names.named_collection_path("root", b, n).alias("collection_path"), names.workload_path("root", b, n).alias("workload_path"),
        names.legacy_disk_path("root", b, F.lit("s3")).alias("legacy_disk_path"),
    )


@registry.add("normalize_link", "SELECT page_id, nullif(list_extract(string_split(regexp_replace(l, '/+$', ''), '/'), -1), '') AS link FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '//' WHEN 1 THEN '/' ELSE 'plain' END AS l FROM pages)")
def normalize_link(spark, d):
    k = F.col("page_id") % 3
    link = F.when(k == 0, F.concat("url", F.lit("//"))).when(k == 1, "/").otherwise("plain")
    return table(spark, d, "pages").select("page_id", names.link_name(link).alias("link"))


@registry.add("legacy_link", "SELECT page_id, CASE WHEN l IS NULL OR contains(l, '/') THEN l ELSE regexp_replace(url, '/?[^/]*$', '') || '/' || l END AS link FROM (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'a/b' ELSE 'b' || page_id END AS l FROM pages)")
def legacy_link(spark, d):
    k = F.col("page_id") % 3
    link = F.when(k == 1, "a/b").when(k == 2, F.concat(F.lit("b"), F.col("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", names.legacy_link(F.col("url"), link).alias("link"))


@registry.add("macro_replace", r"""SELECT p_partkey, replace(replace('{' || p_brand || '} } ' || p_name || ' {shard}/{n} { {replica}', '{n}', '1'), '{replica}', 'r-1') AS out FROM part""")
def macro_replace(spark, d):
    t = F.concat(F.lit("{"), "p_brand", F.lit("} } {name} {shard}/{n} { {replica}"))
    t = F.replace(t, F.lit("{name}"), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", text.replace_macros(t, {"n": "1", "replica": "r-1"}).alias("out"))


@registry.add("version_ge", "SELECT p_partkey, v, list_transform(string_split(regexp_extract(v, '^[0-9]+(\\.[0-9]+)*'), '.'), lambda x: CAST(x AS INT)) >= [22, 8, 1] AS at_least FROM (SELECT p_partkey, (20 + p_size % 5) || '.' || (p_partkey % 12) || CASE WHEN p_partkey % 3 = 0 THEN '.2' ELSE '' END || '-lts' AS v FROM part)")
def version_ge(spark, d):
    v = F.concat((F.col("p_size") % 5 + 20).cast("string"), F.lit("."), (F.col("p_partkey") % 12).cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".2").otherwise(""), F.lit("-lts"))
    return table(spark, d, "part").select("p_partkey", v.alias("v")).withColumn("at_least", text.version_at_least(F.col("v"), "22.8.1"))


@registry.add("endpoint_equal", r"""WITH u AS (SELECT page_id, 'https://store.example/bucket/k/' || page_id AS a, CASE page_id % 3 WHEN 0 THEN 'https://bucket.store.example/k/' || page_id WHEN 1 THEN 'https://store.example/bucket/k/' || page_id ELSE 'https://bucket.store.example/k/' || page_id || 'x' END AS b FROM pages),
h AS (SELECT *, regexp_replace(a, '^([^/]*)//([^/]*)/([^/]*)/?(.*)$', '\1//\3.\2/\4') AS ha, regexp_replace(b, '^([^/]*)//([^/]*)/([^/]*)/?(.*)$', '\1//\3.\2/\4') AS hb FROM u)
SELECT page_id, a = b OR ha = b OR a = hb AS same FROM h""")
def endpoint_equal(spark, d):
    key = F.col("page_id").cast("string")
    path = F.concat(F.lit("https://store.example/bucket/k/"), key)
    hosted = F.concat(F.lit("https://bucket.store.example/k/"), key)
    k = F.col("page_id") % 3
    other = F.when(k == 0, hosted).when(k == 1, path).otherwise(F.concat(hosted, F.lit("x")))
    return table(spark, d, "pages").select("page_id", text.same_endpoint(path, other).alias("same"))


_STMT = "'CREATE TABLE db.t' || p_partkey || ' (  a Int32,  b String )  ENGINE = Distributed(''c'', db, t' || p_size || ') ' AS s"


def _statements(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", "p_brand", F.format_string("CREATE TABLE db.t%d (  a Int32,  b String )  ENGINE = Distributed('c', db, t%d) ", "p_partkey", "p_size").alias("s"))


@registry.add("ddl_normalize", "SELECT p_partkey, 'create table `db`.`t' || p_partkey || '` (a int32, b string) engine = distributed(''c'', ''db'', ''t' || p_size || ''')' AS normal, p_partkey % 2 = 0 AS same FROM part")
def ddl_normalize(spark, d):
    s = _statements(spark, d)
    again = F.format_string("ATTACH TABLE `db`.`t%d` UUID '123' (a Int32,\n b String) ENGINE = Distributed('c', 'db', 't%d')", F.col("p_partkey") + F.col("p_partkey") % 2, "p_size")
    return s.select("p_partkey", ddl.normalise(F.col("s")).alias("normal"), ddl.same_schema(F.col("s"), again).alias("same"))


@registry.add("ddl_attach", f"SELECT p_partkey, 'ATTACH' || substr(s, 7) AS attach, s AS back FROM (SELECT p_partkey, {_STMT} FROM part)")
def ddl_attach(spark, d):
    a = ddl.to_attach(F.col("s"))
    return _statements(spark, d).select("p_partkey", a.alias("attach"), ddl.to_create(a).alias("back"))


_UUID = "'0000' || lpad(CAST(p_partkey AS VARCHAR), 4, '0') || '-1111-2222-3333-444455556666'"


@registry.add("ddl_add_uuid", f"""SELECT p_partkey, 'CREATE TABLE db.t UUID ''' || {_UUID} || ''' (a Int32)' AS of_table,
'CREATE MATERIALIZED VIEW `db`.`v`  UUID ''' || {_UUID} || '''  AS SELECT 1' AS of_view, 'CREATE TABLE db.t UUID ''' || {_UUID} || ''' (a Int32)' AS twice FROM part""")
def ddl_add_uuid(spark, d):
    uuid = F.concat(F.lit("0000"), F.lpad(F.col("p_partkey").cast("string"), 4, "0"), F.lit("-1111-2222-3333-444455556666"))
    t = ddl.with_uuid(F.lit("CREATE TABLE db.t (a Int32)"), uuid, F.lit(False), F.lit("db"), F.lit("t"))
    v = ddl.with_uuid(F.lit("CREATE MATERIALIZED VIEW `db`.`v` AS SELECT 1"), uuid, F.lit(True), F.lit("db"), F.lit("v"))
    return table(spark, d, "part").select("p_partkey", t.alias("of_table"), F.regexp_replace(v, "`v` UUID", "`v`  UUID").alias("of_view"), ddl.with_uuid(t, uuid, F.lit(False), F.lit("db"), F.lit("t")).alias("twice"))


@registry.add("ddl_rewrite", r"""WITH s AS (SELECT p_partkey, 'CREATE TABLE _ (a Int32) ENGINE = ' || CASE p_partkey % 3 WHEN 0 THEN 'ReplicatedMergeTree(''/z/' || p_partkey || ''', ''r1'')' WHEN 1 THEN 'ReplicatedReplacingMergeTree(''/z/' || p_partkey || ''', ''r1'', ver)' ELSE 'MergeTree' END || ' ORDER BY a' AS s FROM part)
SELECT p_partkey, replace(regexp_replace(regexp_replace(s, 'Replicated(\w*MergeTree)\(''[^'']*'', ''[^'']*''\)', '\1'), 'Replicated(\w*MergeTree)\(''[^'']*'', ''[^'']*'', ', '\1('), 'TABLE _ ', 'TABLE `d`.`t` ') AS plain,
regexp_replace(s, '(Replicated\w*MergeTree\(''[^'']*'', '')[^'']*('')', '\1r2\2') AS moved FROM s""")
def ddl_rewrite(spark, d):
    k, key = F.col("p_partkey") % 3, F.col("p_partkey")
    engine = F.when(k == 0, F.format_string("ReplicatedMergeTree('/z/%d', 'r1')", key)).when(k == 1, F.format_string("ReplicatedReplacingMergeTree('/z/%d', 'r1', ver)", key)).otherwise("MergeTree")
    s = F.concat(F.lit("CREATE TABLE _ (a Int32) ENGINE = "), engine, F.lit(" ORDER BY a"))
    return table(spark, d, "part").select("p_partkey", ddl.qualified(ddl.un_replicate(s), F.lit("d"), F.lit("t")).alias("plain"), ddl.with_replica(s, "r2").alias("moved"))


@registry.add("ddl_database", r"""WITH s AS (SELECT p_partkey, replace('CREATE DATABASE _ ENGINE = Replicated(''/p'', ''s1'', ''r1'')', 'DATABASE _ ', 'DATABASE `db' || p_partkey || '` ') AS s FROM part)
SELECT p_partkey, regexp_replace(s, 'ENGINE = Replicated\(.*\)', 'ENGINE=Atomic') AS plain, regexp_replace(s, '''[^'']*''\)', '''r9'')') AS moved FROM s""")
def ddl_database(spark, d):
    s, name = F.lit("CREATE DATABASE _ ENGINE = Replicated('/p', 's1', 'r1')"), F.concat(F.lit("db"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", ddl.database_statement(s, name, non_replicated=True).alias("plain"), ddl.database_statement(s, name, replica="r9").alias("moved"))


@registry.add("ddl_default_db", "SELECT p_partkey, 'CREATE DATABASE `' || p_brand || '` Engine=' || p_type AS statement FROM part")
def ddl_default_db(spark, d):
    return table(spark, d, "part").select("p_partkey", ddl.embedded_database(F.col("p_brand"), F.col("p_type")).alias("statement"))


@registry.add("coord_path", r"""SELECT p_partkey, nullif(regexp_extract(CASE WHEN p_partkey % 2 = 0 THEN 'CREATE TABLE t ENGINE = ReplicatedSummingMergeTree(''/zk/' || p_brand || ''', ''{replica}'')' ELSE 'CREATE TABLE t ENGINE = MergeTree' END, 'Replicated\w*MergeTree\(''([^'']+)''', 1), '') AS path FROM part""")
def coord_path(spark, d):
    s = F.when(F.col("p_partkey") % 2 == 0, F.format_string("CREATE TABLE t ENGINE = ReplicatedSummingMergeTree('/zk/%s', '{replica}')", "p_brand")).otherwise("CREATE TABLE t ENGINE = MergeTree")
    return table(spark, d, "part").select("p_partkey", ddl.coordination_path(s).alias("path"))


@registry.add("db_engine_parts", r"""WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'Replicated(''/db/' || p_brand || ''', ''s' || p_size || ''', ''r'')' ELSE 'Atomic' END AS s FROM part)
SELECT p_partkey, nullif(string_split(s, '''')[2], '') AS path, nullif(string_split(s, '''')[4], '') AS shard, nullif(string_split(s, '''')[6], '') AS replica FROM s""")
def db_engine_parts(spark, d):
    s = F.when(F.col("p_partkey") % 3 > 0, F.format_string("Replicated('/db/%s', 's%d', 'r')", "p_brand", "p_size")).otherwise("Atomic")
    return table(spark, d, "part").select("p_partkey", ddl.replicated_database(s).alias("r")).select("p_partkey", "r.*")


@registry.add("engine_from_ddl", r"""SELECT p_partkey, nullif(regexp_extract(CASE WHEN p_partkey % 4 <> 0 THEN 'CREATE DATABASE x eNGINE =  E' || p_size || ' COMMENT ''c''' ELSE 'CREATE DATABASE x' END, '(?i)engine\s*=\s*(\S+)', 1), '') AS engine FROM part""")
def engine_from_ddl(spark, d):
    s = F.when(F.col("p_partkey") % 4 != 0, F.format_string("CREATE DATABASE x eNGINE =  E%d COMMENT 'c'", "p_size")).otherwise("CREATE DATABASE x")
    return table(spark, d, "part").select("p_partkey", ddl.database_engine(s).alias("engine"))


@registry.add("query_strip", r"""SELECT p_partkey, trim(regexp_replace(chr(10) || '  SELECT' || chr(9) || p_name || chr(10) || '   FROM   t ' || chr(10), '\s+', ' ', 'g')) AS query FROM part""")
def query_strip(spark, d):
    return table(spark, d, "part").select("p_partkey", ddl.strip_query(F.concat(F.lit("\n  SELECT\t"), "p_name", F.lit("\n   FROM   t \n"))).alias("query"))


@registry.add("strip_except_id", r"""SELECT p_partkey, regexp_replace('GRANT ALL TO ' || p_brand || ' EXCEPT ID(''' || p_name || ''')', 'EXCEPT ID\(''(.+)''\)', '') AS statement FROM part""")
def strip_except_id(spark, d):
    return table(spark, d, "part").select("p_partkey", ddl.strip_except_id(F.concat(F.lit("GRANT ALL TO "), "p_brand", F.lit(" EXCEPT ID('"), "p_name", F.lit("')"))).alias("statement"))


@registry.add("workload_parse", r"""WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'CREATE WORKLOAD `w' || p_partkey || '`;' WHEN 1 THEN 'create workload w' || p_partkey || chr(10) || ' IN all SETTINGS a = 1, b = 2' WHEN 2 THEN 'CREATE RESOURCE w' || p_partkey || ' (READ DISK s3, WRITE DISK s3);' ELSE 'CREATE TABLE x' END AS s FROM part)
SELECT p_partkey, nullif(regexp_extract(s, '(?is)^\s*create\s+(?:workload|resource)\s+`?(\w+)`?', 1), '') AS name, nullif(lower(regexp_extract(s, '(?is)^\s*create\s+(workload|resource)\s', 1)), '') AS type, nullif(regexp_extract(s, '(?is)\sin\s+(\w+)', 1), '') AS parent FROM s""")
def workload_parse(spark, d):
    k, key = F.col("p_partkey") % 4, F.col("p_partkey")
    s = (F.when(k == 0, F.format_string("CREATE WORKLOAD `w%d`;", key)).when(k == 1, F.format_string("create workload w%d\n IN all SETTINGS a = 1, b = 2", key))
         .when(k == 2, F.format_string("CREATE RESOURCE w%d (READ DISK s3, WRITE DISK s3);", key)).otherwise("CREATE TABLE x"))
    return table(spark, d, "part").select("p_partkey", ddl.workload_entity(s).alias("w")).select("p_partkey", "w.*")


@registry.add("udf_replace", r"""SELECT p_partkey, regexp_replace('CREATE FUNCTION f' || p_partkey || ' AS (a) -> ''CREATE FUNCTION''', 'CREATE FUNCTION', 'CREATE OR REPLACE FUNCTION') AS statement FROM part""")
def udf_replace(spark, d):
    return table(spark, d, "part").select("p_partkey", ddl.replace_function(F.format_string("CREATE FUNCTION f%d AS (a) -> 'CREATE FUNCTION'", "p_partkey")).alias("statement"))


@registry.add("option_types", "SELECT p_partkey, [p_brand, p_type] AS items, p_size * 3600 AS seconds, p_brand AS a, p_type AS b FROM part")
def option_types(spark, d):
    kv = text.key_values(F.concat(F.lit("a: x, b:"), "p_type", F.lit(" , a : "), "p_brand"))
    return table(spark, d, "part").select(
        "p_partkey", text.string_list(F.concat_ws(" , ", "p_brand", "p_type")).alias("items"), text.timespan_seconds(F.concat(F.col("p_size").cast("string"), F.lit(" h"))).alias("seconds"),
        kv["a"].alias("a"), kv["b"].alias("b"),
    )


def _glob(column: str) -> str:
    return f"(p_brand = 'Brand#1' AND regexp_full_match({column}, 'gr.*')) OR (p_brand = 'Brand#2' AND regexp_full_match({column}, '.*[aeiou]. .*'))"


_PATTERNS = ["Brand#1.gr*", "Brand#2.*[aeiou]? *"]


@registry.add("table_pattern_include", f"SELECT p_partkey, {_glob('p_name')} AS accepted FROM part")
def table_pattern_include(spark, d):
    from stratakeep.operators.selection import accepts

    return table(spark, d, "part").select("p_partkey", accepts(F.col("p_brand"), F.col("p_name"), _PATTERNS).alias("accepted"))


@registry.add("table_pattern_exclude", f"SELECT p_partkey, p_name FROM part WHERE NOT ({_glob('p_name')})")
def table_pattern_exclude(spark, d):
    from stratakeep.operators.selection import accepts

    return table(spark, d, "part").where(accepts(F.col("p_brand"), F.col("p_name"), _PATTERNS, inverted=True)).select("p_partkey", "p_name")
