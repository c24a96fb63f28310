"""What objects need before they can be restored, and the rounds in which that works.

Which objects an object is made from is read from its statement. Restoring then goes in rounds:
every round takes all objects whose sources are there by now, and what is left in the end is on a
cycle, lacks a source, or needs an object that does. Rounds are as many as the longest chain, and
each costs as much as there is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakeep.sources.shared import forget, stored

_NAME = r"(?:`(?:[^`\\]|\\.)*+`|[\w$]++)"
#: database.name or name, not followed by the parenthesis of a function
_OBJECT = rf"{_NAME}(?:\.{_NAME})?+(?!\s*+[(.])"
#: Kinds of dictionary sources that are never tables of the server's own.
_ELSEWHERE = "MYSQL|POSTGRESQL|MONGODB|CASSANDRA|REDIS|HTTP|FILE|EXECUTABLE|EXECUTABLEPOOL|ODBC|JDBC|NULL"
_REFERENCE = "array<struct<database:string,table:string>>"


def _bare(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"\A`|`\z", ""), r"\\(.)", "$1")


def _named(text: Column, database: Column) -> Column:
    """struct(database, table) of database.name or name."""
    last, all_ = F.regexp_extract(text, rf"({_NAME})\z", 1), F.regexp_extract(text, rf"\A({_NAME})\.", 1)
    return F.struct(F.coalesce(F.nullif(_bare(all_), F.lit("")), database).alias("database"), _bare(last).alias("table"))


def _without_texts(statement: Column) -> Column:
    """The statement without comments, quoted texts, and functions that have FROM among their arguments."""
    out = F.regexp_replace(statement, r"(?s)/\*.*?\*/|--[^\n]*", " ")
    out = F.regexp_replace(out, r"(?s)'(?:[^'\\]|\\.)*+'", "''")
    return F.regexp_replace(out, r"(?i)\b(?:extract|trim|substring|overlay)\s*\([^()]*\)", " ")


def _selected(statement: Column, database: Column) -> Column:
    """What a query reads: the names after FROM and JOIN, but for those that it defines by WITH."""
    text = _without_texts(statement)
    read = F.transform(F.regexp_extract_all(text, F.lit(rf"(?is)\b(?:FROM|JOIN)\s+({_OBJECT})"), F.lit(1)), lambda x: _named(x, database))
    own = F.transform(F.regexp_extract_all(text, F.lit(rf"(?is)({_NAME})\s+AS\s*\("), F.lit(1)), _bare)
    qualified = F.transform(F.regexp_extract_all(text, F.lit(rf"(?is)\b(?:FROM|JOIN)\s+({_OBJECT})"), F.lit(1)), lambda x: F.contains(F.regexp_replace(x, r"`(?:[^`\\]|\\.)*`", ""), F.lit(".")))
    pairs = F.filter(F.arrays_zip(read.alias("read"), qualified.alias("qualified")), lambda x: x["qualified"] | ~F.array_contains(own, x["read"]["table"]))
    return F.transform(pairs, lambda x: x["read"])


def _call(statement: Column, engine: str, at: int, database: Column) -> Column:
    """The database and table that an engine's call has as its arguments `at` and the one after it."""
    arguments = F.regexp_extract(statement, rf"(?is)\bENGINE\s*=\s*{engine}\s*\(((?:[^()']|'(?:[^'\\]|\\.)*+'|\([^()]*\))*+)\)", 1)
    given = F.transform(F.regexp_extract_all(arguments, F.lit(r"(?s)\s*((?:[^,()']|'(?:[^'\\]|\\.)*+'|\([^()]*\))+)"), F.lit(1)), F.btrim)
    plain = lambda k: _bare(F.regexp_replace(F.get(given, F.lit(k)), r"\A'|'\z", ""))
    own = F.get(given, F.lit(at)).rlike(r"(?i)\AcurrentDatabase\(") | (plain(at) == "")
    found = F.struct(F.when(own, database).otherwise(plain(at)).alias("database"), plain(at + 1).alias("table"))
    return F.when(F.size(given) > at + 1, F.array(found)).otherwise(F.array().cast(_REFERENCE))


def _dictionary(statement: Column, database: Column) -> Column:
    """The table that a dictionary is filled from, if that is on this server."""
    source = F.regexp_extract(statement, r"(?is)\bSOURCE\s*\(\s*(?!(?:" + _ELSEWHERE + r")\b)\w+\s*\(((?:[^()']|'(?:[^'\\]|\\.)*+')*+)\)", 1)
    word = lambda key: F.regexp_extract(source, rf"(?is)\b{key}\s+'((?:[^'\\]|\\.)*+)'", 1)
    here = F.lower(word("HOST")).isin("", "localhost", "127.0.0.1", "::1")
    found = F.struct(F.coalesce(F.nullif(word("DB"), F.lit("")), database).alias("database"), word("TABLE").alias("table"))
    asked = _selected(F.concat(F.lit(" "), word("QUERY")), database)
    return F.when(here & (word("TABLE") != ""), F.array(found)).when(here, asked).otherwise(F.array().cast(_REFERENCE))


def sources_of(statement: Column, database: Column) -> Column:
    """array of (database, table) that an object's CREATE statement needs: what a view reads, where a
    materialized view writes TO, what a Distributed or Buffer table stands for, what fills a dictionary.

    Names without a database are of the object's own. A null statement needs nothing.
    """
    is_view = statement.rlike(r"(?is)\A\s*(?:CREATE|ATTACH)\s+(?:OR\s+REPLACE\s+)?(?:MATERIALIZED\s+|LIVE\s+|WINDOW\s+)?VIEW\b")
    target = F.regexp_extract(_without_texts(statement), rf"(?is)\A\s*(?:CREATE|ATTACH)\s+MATERIALIZED\s+VIEW\b(?:(?!\sAS\s).)*?\sTO\s++(?!INNER\s)({_NAME}(?:\.{_NAME})?+)", 1)
    body = F.regexp_replace(statement, r"(?is)\A.*?\sAS\s+(?=SELECT\b|WITH\b|\()", "")
    none = F.array().cast(_REFERENCE)
    found = F.concat(
        F.when(is_view, _selected(F.concat(F.lit(" "), body), database)).otherwise(none), F.when(target != "", F.array(_named(target, database))).otherwise(none),
        _call(statement, "Distributed", 1, database), _call(statement, "Buffer", 0, database), _dictionary(statement, database),
    )
    return F.coalesce(F.array_distinct(found), none)


def dependencies(objects: DataFrame) -> DataFrame:
    """(database, table, source_database, source_table) of objects (database, table, statement); none is its own source."""
    each = objects.select("database", "table", F.explode(sources_of(F.col("statement"), F.col("database"))).alias("s"))
    out = each.select("database", "table", F.col("s.database").alias("source_database"), F.col("s.table").alias("source_table")).distinct()
    return out.where("database <> source_database or `table` <> source_table")


_KEY, _SOURCE = ["database", "table"], ["source_database", "source_table"]


def _peel(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((database, table, round) of nodes that go, (database, table) of those that never do).

    A node goes in the first round in which none of its edges' sources is left; edges are among nodes.
    """
    left, open_, gone = stored(nodes, "left"), stored(edges, "edges"), []
    while True:
        held = open_.select(*_KEY).distinct().withColumn("_held", F.lit(True))
        marked = stored(left.join(held, _KEY, "left"), "marked")
        ready = marked.where("_held is null").select(*_KEY)
        forget(left)
        if ready.isEmpty():
            forget(open_)
            break
        gone.append(stored(ready.withColumn("round", F.lit(len(gone)).cast("long")), "round"))
        left = stored(marked.where("_held").select(*_KEY), "left")
        rest = stored(open_.join(ready.toDF(*_SOURCE), _SOURCE, "left_anti"), "edges")
        forget(open_, marked)
        open_ = rest
    out = nodes.withColumn("round", F.lit(0).cast("long")).limit(0)
    for part in gone:
        out = out.unionByName(part)
    return out, marked.select(*_KEY)


def restore_rounds(objects: DataFrame, edges: DataFrame, live: DataFrame | None = None, failing: DataFrame | None = None) -> DataFrame:
    """(database, table, round, reason, lacking) of objects (database, table): when each can be restored, or why not.

    edges: (database, table, source_database, source_table); live: objects (database, table) that are
    there already; failing: objects that are known to fail. Round 0 needs nothing that is still to be
    restored, and every later round only what those before it restore. Of what is left, round is null
    and reason is, in this order: failed (it is among failing), missing (a source is neither live nor
    among objects, the least such is `lacking`), cycle (it is on a cycle or between two), or blocked
    (it needs one of these). Repeated objects count once; edges of objects that aren't given, and an
    object's edge to itself, count for nothing.
    """
    names = lambda df: df.select(*_KEY).distinct()
    nodes = stored(names(objects), "objects")
    edges = edges.select(*_KEY, *_SOURCE).where("not (database <=> source_database and `table` <=> source_table)").distinct()
    if live is not None:
        edges = edges.join(names(live).toDF(*_SOURCE), _SOURCE, "left_anti")
    edges = stored(edges.join(nodes, _KEY, "left_semi"), "edges")
    sources = nodes.toDF(*_SOURCE)
    lacking = F.concat_ws(".", *_SOURCE)
    missing = edges.join(sources, _SOURCE, "left_anti").groupBy(*_KEY).agg(F.min(lacking).alias("lacking"))
    within = edges.join(sources, _SOURCE, "left_semi")
    bad = missing.select(*_KEY) if failing is None else missing.select(*_KEY).unionByName(names(failing).join(nodes, _KEY, "left_semi")).distinct()
    # what can't be restored itself stays as a source that never comes
    good, stuck = _peel(nodes, within.unionByName(bad.select("*", F.lit(None).cast("string").alias("source_database"), F.lit(None).cast("string").alias("source_table"))))
    inner = within.join(stuck, _KEY, "left_semi").join(stuck.toDF(*_SOURCE), _SOURCE, "left_semi")
    _, behind = _peel(stuck, inner)
    turned = inner.join(behind, _KEY, "left_semi").join(behind.toDF(*_SOURCE), _SOURCE, "left_semi").select(*[F.col(a).alias(b) for a, b in zip(_SOURCE + _KEY, _KEY + _SOURCE)])
    _, cyclic = _peel(behind, turned)
    out = nodes.join(good, _KEY, "left").join(missing, _KEY, "left").join(cyclic.withColumn("_cyclic", F.lit(True)), _KEY, "left")
    fails = F.lit(None).cast("boolean")
    if failing is not None:
        out = out.join(names(failing).withColumn("_fails", F.lit(True)), _KEY, "left")
        fails = F.col("_fails")
    reason = F.when(fails, "failed").when(F.col("lacking").isNotNull(), "missing").when(F.col("_cyclic"), "cycle").otherwise("blocked")
    return out.select(*_KEY, "round", F.when(F.col("round").isNull(), reason).alias("reason"), "lacking")
