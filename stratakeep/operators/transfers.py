"""Reading objects by ranges, and what a store's listings look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakeep.operators.prefix import batches, text_key


def checked_reads(attempts: DataFrame) -> DataFrame:
    """(object, state, delivered, generation, total, failed_at) of what reading each object by ranges gave.

    attempts: (object, seq, generation, received, total), in the order of seq: seq 0 is the look at
    the object before it is read, and each other row is an answer of `received` bytes with the
    generation (null: not told) and total size of the object at that time. Before the first byte
    another generation is taken over, with its size; after it, it ends the reading: the state is
    overwritten, and failed_at is that answer. Otherwise the state is complete once `total` bytes
    are delivered, or partial. An answer without bytes ends nothing. What follows the end counts for
    nothing. Rows without an object or seq are left out; of rows of one seq the greatest counts.

    The first answer with bytes fixes the generation, so two aggregates say it all: no window, and
    an object that is read very often is aggregated before it is shuffled.
    """
    rows = attempts.where("object is not null and seq is not null").groupBy("object", "seq").agg(F.max(F.struct("generation", "received", "total")).alias("a")).select("object", "seq", "a.*")
    told = F.col("generation").isNotNull()
    begun = rows.groupBy("object").agg(F.min(F.when((F.col("seq") > 0) & (F.col("received") > 0), F.col("seq"))).alias("first"))
    early = rows.join(begun, "object").where(told & (F.col("first").isNull() | (F.col("seq") <= F.col("first"))))
    # the last generation taken over by then, with the size it had when it was first told
    fixed = early.groupBy("object").agg(F.max_by("generation", "seq").alias("generation"))
    size = early.join(fixed.withColumnRenamed("generation", "fixed"), "object").where("generation = fixed").groupBy("object").agg(F.min_by("total", "seq").alias("total"))
    held = begun.join(fixed, "object", "left").join(size, "object", "left")
    read = rows.where("seq > 0").withColumnRenamed("generation", "told").drop("total").join(held, "object")
    ended = read.where("seq > first and told is not null and told <> generation").groupBy("object").agg(F.min("seq").alias("failed_at"))
    got = read.join(ended, "object", "left").where("failed_at is null or seq < failed_at").groupBy("object").agg(F.sum(F.greatest(F.coalesce("received", F.lit(0)), F.lit(0))).alias("delivered"))
    out = held.join(ended, "object", "left").join(got, "object", "left").withColumn("delivered", F.coalesce("delivered", F.lit(0)).cast("long"))
    state = F.when(F.col("failed_at").isNotNull(), "overwritten").when(F.col("delivered") >= F.col("total"), "complete").otherwise("partial")
    return out.select("object", state.alias("state"), "delivered", "generation", "total", "failed_at")


def next_range(reads: DataFrame, length: int) -> DataFrame:
    """(object, start, end, generation): the half-open range to ask for next of what isn't complete; overwritten ones begin anew."""
    start = F.when(F.col("state") == "overwritten", F.lit(0)).otherwise(F.col("delivered")).cast("long")
    open_ = reads.where("state <> 'complete'")
    end = F.when(F.col("state") == "overwritten", start + length).otherwise(F.least(start + length, F.coalesce("total", start + length)))
    return open_.select("object", start.alias("start"), end.cast("long").alias("end"), F.when(F.col("state") != "overwritten", F.col("generation")).alias("generation"))


def _entry(path: Column, prefix: str, delimiter: str) -> Column:
    rest = F.substring(path, F.lit(len(prefix) + 1), F.length(path))
    cut = F.locate(delimiter, rest)
    return F.when(cut > 0, F.concat(F.lit(prefix), F.substring(rest, F.lit(1), cut + len(delimiter) - 1))).otherwise(path)


def delimited(objects: DataFrame, prefix: str = "", delimiter: str = "/", after: str | None = None, page: int = 1000) -> DataFrame:
    """(page, path, is_prefix, size, objects) of objects (path, size) below a prefix, as a store lists them in pages.

    Objects whose path has the delimiter behind the prefix are rolled up to what is before it: a
    common prefix, which comes once however many objects and pages of them it stands for, with their
    number and sum of sizes. Entries ascend by the bytes of their paths, `page` of them on a page,
    numbered from 0. `after` leaves out entries up to it, a common prefix if it is one it begins
    with. Without a delimiter every object is an entry. Repeated paths count once. Objects are rolled
    up before they are shuffled; pages are cut by ranges of paths, not by one task.
    """
    below = objects.where(F.col("path").startswith(prefix) & (F.col("path") != prefix)) if prefix else objects.where("path is not null")
    once = below.groupBy("path").agg(F.max("size").alias("size"))
    entry = _entry(F.col("path"), prefix, delimiter) if delimiter else F.col("path")
    entries = once.withColumn("entry", entry).groupBy("entry").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("objects"), (F.min("path") != F.col("entry")).alias("_rolled"))
    is_prefix = F.col("_rolled") | ((F.lit(delimiter or "") != "") & F.endswith("entry", F.lit(delimiter or "/"))) if delimiter else F.lit(False)
    entries = entries.select(F.col("entry").alias("path"), is_prefix.alias("is_prefix"), F.col("size").cast("long").alias("size"), "objects")
    if after is not None:
        entries = entries.where(F.col("path") > after)
    # paths below one prefix agree in it, so the key is taken behind it
    keyed = entries.withColumn("_key", text_key(F.substring("path", F.lit(len(prefix) + 1), F.length("path"))))
    return batches(keyed, "_key", ["path"], page, out="page").select("page", "path", "is_prefix", "size", "objects")


def exists_below(objects: DataFrame, path: str) -> bool:
    """Whether a folder is there: an object lies below it."""
    return not objects.where(F.col("path").startswith(path.rstrip("/") + "/")).limit(1).isEmpty()
