"""Queries over object sizes, chunks, transfers and file sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratakeep import fixtures as fx
from stratakeep.fixtures import table
from stratakeep.functions import sizes
from stratakeep.operators import listing
from stratakeep.queries import Registry

registry = Registry()
_BYTES = "strlen(coalesce(text, ''))"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "lang", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))


@registry.add("aligned_size", f"SELECT source, CAST(sum((n + 511) // 512 * 512) AS BIGINT) AS size FROM (SELECT source, CAST({_BYTES} AS BIGINT) AS n FROM documents) GROUP BY source")
def aligned_size(spark, d):
    return _docs(spark, d).groupBy("source").agg(F.sum(sizes.aligned(F.col("n"))).alias("size"))


@registry.add("tar_size", f"""SELECT source, CAST(sum((n + 511) // 512 * 512 + CASE WHEN len(name) > 100 THEN ((len(name) + 511) // 512 + 2) * 512 ELSE 512 END) AS BIGINT) AS size
FROM (SELECT source, CAST({_BYTES} AS BIGINT) AS n, repeat('x', CAST(doc_id % 700 AS INT)) AS name FROM documents) GROUP BY source""")
def tar_size(spark, d):
    files = F.array(F.repeat(F.lit("x"), (F.col("doc_id") % 700).cast("int")))
    return _docs(spark, d).withColumn("tar", sizes.tar_size(sizes.aligned(F.col("n")), files)).groupBy("source").agg(F.sum("tar").alias("size"))


@registry.add("encrypted_size", f"SELECT doc_id, n + (n + 999) // 1000 * 40 AS sealed FROM (SELECT doc_id, CAST({_BYTES} AS BIGINT) AS n FROM documents)")
def encrypted_size(spark, d):
    return _docs(spark, d).select("doc_id", sizes.sealed_size(F.col("n"), 1000).alias("sealed"))


@registry.add("part_object_size", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN t + (t + 4095) // 4096 * 40 ELSE t END AS size FROM (SELECT doc_id, (n + 511) // 512 * 512 + 1024 AS t FROM (SELECT doc_id, CAST({_BYTES} AS BIGINT) AS n FROM documents))")
def part_object_size(spark, d):
    files = F.array(F.lit("checksums.txt"), F.lit("data.bin"))
    return _docs(spark, d).select("doc_id", sizes.part_object_size(sizes.aligned(F.col("n")), files, F.col("doc_id") % 2 == 0, 4096).alias("size"))


@registry.add("chunk_plan", f"""SELECT doc_id, (n + 99) // 100 AS chunks, CASE WHEN n > 100 AND (n + 99) // 100 > 10 THEN ((n + 99) // 100 + 9) // 10 * 100 ELSE 100 END AS chunk, n >= 100 AS multipart
FROM (SELECT doc_id, CAST({_BYTES} AS BIGINT) AS n FROM documents)""")
def chunk_plan(spark, d):
    n = F.col("n")
    return _docs(spark, d).select("doc_id", sizes.n_chunks(n, 100).cast("long").alias("chunks"), sizes.upload_chunk_size(n, 100, 10).alias("chunk"), sizes.is_multipart(n, 100).alias("multipart"))


@registry.add("range_plan", f"""SELECT doc_id, CAST(s AS BIGINT) AS start, least(CAST(s AS BIGINT) + 4096, n) AS "end" FROM (SELECT doc_id, n, unnest(range(0, n, 4096)) AS s FROM (SELECT doc_id, CAST({_BYTES} AS BIGINT) AS n FROM documents))""")
def range_plan(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(sizes.ranges(F.col("n"), 4096)).alias("r")).select("doc_id", "r.*")


@registry.add("rechunk", "SELECT page_id, CAST(i AS BIGINT) AS chunk, md5(substr(html, CAST(i * 1000 + 1 AS BIGINT), 1000)) AS checksum FROM (SELECT page_id, html, unnest(range(0, (length(html) + 999) // 1000)) AS i FROM pages)")
def rechunk(spark, d):
    r = F.posexplode(sizes.ranges(F.length("html"), 1000)).alias("chunk", "r")
    return table(spark, d, "pages").select("page_id", "html", r).select("page_id", F.col("chunk").cast("long").alias("chunk"), F.md5(F.encode(F.expr("substring(html, int(r.start + 1), int(r.end - r.start))"), "UTF-8")).alias("checksum"))


@registry.add("rate_limit_seconds", f"SELECT doc_id, greatest((n + 5320) // 5321 - 1, 0) AS seconds, CAST(0 AS BIGINT) AS unlimited FROM (SELECT doc_id, CAST({_BYTES} AS BIGINT) AS n FROM documents)")
def rate_limit_seconds(spark, d):
    return _docs(spark, d).select("doc_id", sizes.transfer_seconds(F.col("n"), 5321).alias("seconds"), sizes.transfer_seconds(F.col("n"), 0).alias("unlimited"))


@registry.add("backoff_bound", "SELECT r_regionkey, least(power(2, r_regionkey + 1) * 1.0, 8.0) AS bound FROM region")
def backoff_bound(spark, d):
    return table(spark, d, "region").select("r_regionkey", sizes.backoff_bound(F.col("r_regionkey") + 1, 8).alias("bound"))


@registry.add("encrypted_header", "SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 3 AS INT) END AS algorithm, CASE WHEN p_partkey % 5 > 0 THEN upper(lpad(printf('%x', p_partkey), 32, '0')) END AS iv FROM part")
def encrypted_header(spark, d):
    k = F.col("p_partkey")
    number = F.lpad(F.hex(k % 3), 2, "0")
    full = F.concat(F.lit("4142430200"), number, F.lit("00"), F.repeat(F.lit("11"), 16), F.lpad(F.hex(k), 32, "0"), F.repeat(F.lit("00"), 25))
    return table(spark, d, "part").select("p_partkey", sizes.encrypted_header(F.unhex(F.when(k % 5 > 0, full).otherwise("41424302"))).alias("h")).select("p_partkey", "h.*")


_PATHS = "wanted AS (SELECT DISTINCT 'd/' || (page_id % 997) AS path FROM pages), there AS (SELECT DISTINCT 'd/' || (doc_id % 997) AS path FROM documents)"


def _paths(spark, d):
    path = lambda c: F.concat(F.lit("d/"), (F.col(c) % 997).cast("string")).alias("path")
    return table(spark, d, "pages").select(path("page_id")).distinct(), table(spark, d, "documents").select(path("doc_id")).distinct()


@registry.add("path_intersect", f"WITH {_PATHS} SELECT path FROM wanted INTERSECT SELECT path FROM there")
def path_intersect(spark, d):
    wanted, there = _paths(spark, d)
    return wanted.intersect(there)


@registry.add("path_except", f"WITH {_PATHS} SELECT path FROM there EXCEPT SELECT path FROM wanted")
def path_except(spark, d):
    wanted, there = _paths(spark, d)
    return there.join(wanted, "path", "left_anti")


@registry.add("missing_files", """WITH f AS (SELECT source, list(DISTINCT lang) AS files FROM documents GROUP BY source)
SELECT source, array_to_string(list_sort(list_filter(['de', 'en', 'fr', 'es', 'xx'], lambda x: NOT list_contains(files, x))), ',') AS missing FROM f""")
def missing_files(spark, d):
    there = table(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("there"))
    wanted = F.array(*[F.lit(x) for x in ("de", "en", "fr", "es", "xx")])
    return there.select("source", F.array_join(F.array_sort(F.array_except(wanted, "there")), ",").alias("missing"))


@registry.add("object_exists", "SELECT page_id, doc_id IS NOT NULL AS there, CAST(strlen(text) AS BIGINT) AS size FROM pages LEFT JOIN documents ON doc_id = page_id * 3")
def object_exists(spark, d):
    objects = _docs(spark, d).select(F.col("doc_id").alias("path"), F.col("n").alias("size"))
    return listing.existence(table(spark, d, "pages").select("page_id", (F.col("page_id") * 3).alias("path")), objects, "path").select("page_id", "there", "size")


@registry.add("part_valid", f"""WITH {fx.INV}, p AS (SELECT part, bytes, b, CASE WHEN b = 0 THEN part || '.tar' ELSE 'data.bin' END AS stored FROM parts)
SELECT part, CASE b WHEN 0 THEN bytes % 128 = 0 WHEN 1 THEN FALSE ELSE TRUE END AS valid FROM p""")
def part_valid(spark, d):
    p = fx.parts(spark, d)
    tarball = F.col("b") == 0
    wanted = p.select("part", F.when(tarball, F.array(F.concat("part", F.lit(".tar")))).otherwise(F.array(F.lit("checksums.txt"), F.lit("data.bin"))).alias("files"), tarball.alias("tarball"), F.col("bytes").alias("size"), "b")
    stored = wanted.select("part", F.explode("files").alias("file"), F.when(F.col("size") % 128 == 0, F.col("size")).otherwise(F.col("size") + 1).alias("size"), "b")
    stored = stored.where("b <> 1 or file <> 'data.bin'").drop("b")
    return listing.valid_parts(wanted, stored, ["part"]).select("part", "valid")


@registry.add("files_of_parts", "SELECT l_orderkey AS part, count(*) AS n_files, CAST(sum((CAST(l_quantity AS BIGINT) + 511) // 512 * 512) AS BIGINT) AS size FROM lineitem GROUP BY l_orderkey")
def files_of_parts(spark, d):
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("part"), F.col("l_linenumber").cast("string").alias("file"), F.col("l_quantity").cast("long").alias("size"))
    return listing.frozen_parts(files, ["part"]).select("part", F.size("files").cast("long").alias("n_files"), "size")
