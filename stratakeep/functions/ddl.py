"""Rewriting and comparing statements (text of CREATE and ATTACH) as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratakeep.functions.names import backtick_escape

#: One identifier: in backticks, or bare.
_IDENTIFIER = r"(?:`(?:[^`\\]|\\.)*`|[^\s.(`;]+)"
#: A statement of an object: verb, kind, database, object, UUID clause, and its body.
_OBJECT = rf"(?is)\A(CREATE|ATTACH)\s+((?:[a-z]+\s+)*?(?:TABLE|VIEW|DICTIONARY))\s+(?:({_IDENTIFIER})\.)?({_IDENTIFIER})(\s+UUID\s+'[^']*')?(?=\s|\(|\z)(.*)\z"
#: A replicated table engine's call: what is before it, its family, path and replica, and what follows these two.
_REPLICATED_TABLE = r"(?s)\A(.*?)Replicated(\w*MergeTree)\(\s*'([^']+)'\s*,\s*'([^']+)'\s*,?\s*(.*)\z"
#: A replicated database engine's call: what is before it, path, shard, replica, and what follows.
_REPLICATED_DATABASE = r"(?s)\A(.*?)Replicated\(\s*'([^']*)'\s*,\s*'([^']*)'\s*,\s*'([^']*)'\s*\)(.*)\z"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _split(statement: Column, pattern: str, *names: str) -> Column:
    """struct of the pattern's groups, by these names; null where the statement isn't of that form."""
    return F.when(statement.rlike(pattern), F.struct(*[F.regexp_extract(statement, pattern, k + 1).alias(name) for k, name in enumerate(names)]))


def _object(statement: Column) -> Column:
    return _split(statement, _OBJECT, "verb", "kind", "database", "object", "uuid", "body")


def _table_engine(statement: Column) -> Column:
    return _split(statement, _REPLICATED_TABLE, "before", "family", "path", "replica", "rest")


def _database_engine(statement: Column) -> Column:
    return _split(statement, _REPLICATED_DATABASE, "before", "path", "shard", "replica", "rest")


def _bare(identifier: Column) -> Column:
    return F.btrim(identifier, F.lit("`"))


def _ticked(identifier: Column) -> Column:
    return F.concat(F.lit("`"), identifier, F.lit("`"))


def _full_name(parts: Column) -> Column:
    return F.concat(F.when(parts["database"] != "", F.concat(parts["database"], F.lit("."))).otherwise(""), parts["object"])


def to_attach(statement: Column) -> Column:
    return F.regexp_replace(statement, r"\ACREATE", "ATTACH")


def to_create(statement: Column) -> Column:
    return F.regexp_replace(statement, r"\AATTACH", "CREATE")


def _quoted_arguments(body: Column) -> Column:
    """The second and third argument of a Distributed engine (database and table) in quotes; other bodies as they are."""
    call = F.regexp_extract(body, r"engine = distributed\(((?:[^()]|\([^()]*\))*)\)", 1)
    arguments = F.split(call, ", ")
    quoted = F.transform(arguments, lambda x, k: F.when((k == 1) | (k == 2), F.concat(F.lit("'"), F.btrim(x, F.lit("'")), F.lit("'"))).otherwise(x))
    return F.when(F.size(arguments) > 2, F.replace(body, call, F.array_join(quoted, ", "))).otherwise(body)


def normalise(statement: Column) -> Column:
    """A form in which two spellings of one table statement are equal.

    Lower case, single spaces and none inside of parentheses; CREATE, the name in backticks, no
    UUID clause, and the names that a Distributed engine is given in quotes.
    """

    def build(tight: Column, parts: Column) -> Column:
        name = F.concat(_ticked(_bare(parts["database"])), F.lit("."), _ticked(_bare(parts["object"])))
        named = F.concat_ws(" ", F.lit("create"), parts["kind"], name, F.nullif(F.ltrim(parts["body"]), F.lit("")))
        return F.when(parts["database"] != "", named).otherwise(F.regexp_replace(tight, r"\Aattach", "create"))

    words = F.regexp_replace(strip_query(F.lower(statement)), r"(?<=\() | (?=\))", "")
    return _let(_let(words, lambda tight: _let(_object(tight), lambda parts: build(tight, parts))), _quoted_arguments)


def same_schema(a: Column, b: Column) -> Column:
    return normalise(a) == normalise(b)


def un_replicate(statement: Column) -> Column:
    """A replicated table engine with arguments as its plain counterpart, with what arguments it has besides."""

    def build(engine: Column) -> Column:
        none_left = engine["rest"].startswith(")")
        rest = F.when(none_left, F.substring(engine["rest"], F.lit(2), F.length(engine["rest"]))).otherwise(F.concat(F.lit("("), engine["rest"]))
        return F.concat(engine["before"], engine["family"], rest)

    return _let(statement, lambda s: F.coalesce(_let(_table_engine(s), build), s))


def with_replica(statement: Column, replica: str) -> Column:
    """A replicated table engine with arguments, under another replica's name."""

    def build(engine: Column) -> Column:
        more = F.when(engine["rest"].startswith(")"), "").otherwise(", ")
        call = F.format_string("Replicated%s('%s', '%s'", engine["family"], engine["path"], F.lit(replica))
        return F.concat(engine["before"], call, more, engine["rest"])

    return _let(statement, lambda s: F.coalesce(_let(_table_engine(s), build), s))


def qualified(statement: Column, database: Column, table: Column) -> Column:
    """The bare or placeholder name of the object as `database`.`table`."""

    def build(parts: Column) -> Column:
        own = (parts["database"] == "") & ((parts["object"] == "_") | (_bare(parts["object"]) == backtick_escape(table)))
        name = F.concat(_ticked(backtick_escape(database)), F.lit("."), _ticked(backtick_escape(table)))
        return F.when(own, F.concat_ws(" ", parts["verb"], parts["kind"], F.concat(name, parts["uuid"]), F.ltrim(parts["body"])))

    return _let(statement, lambda s: F.coalesce(_let(_object(s), build), s))


def with_uuid(statement: Column, uuid: Column, is_view: Column, database: Column, table: Column, inner_uuid: Column | None = None) -> Column:
    """The statement with a UUID clause after the object's name (of a view, its inner table's too), unless it has one."""
    clause = F.format_string(" UUID '%s'", uuid)
    inner = F.coalesce(F.format_string("TO INNER UUID '%s'", inner_uuid), F.lit("")) if inner_uuid is not None else F.lit("")
    inner = F.when(is_view, F.concat(F.lit(" "), inner)).otherwise("")

    def build(parts: Column) -> Column:
        named = F.when(is_view, (_bare(parts["database"]) == database) & (_bare(parts["object"]) == table)).otherwise(parts["database"] != "")
        return F.when(named, F.concat(parts["verb"], F.lit(" "), parts["kind"], F.lit(" "), _full_name(parts), clause, inner, parts["body"]))

    return _let(statement, lambda s: F.when(s.rlike(r"UUID '\w+(-\w+){4}'"), s).otherwise(F.coalesce(_let(_object(s), build), s)))


def database_statement(statement: Column, database: Column, non_replicated: bool = False, replica: str | None = None) -> Column:
    """A database's statement under its own name, optionally without replication or with another replica."""

    def with_engine(engine: Column) -> Column:
        if non_replicated:
            return F.concat(F.regexp_replace(engine["before"], r"(?i)engine\s*=\s*\z", "ENGINE=Atomic"), engine["rest"])
        call = F.format_string("Replicated('%s', '%s', '%s')", engine["path"], engine["shard"], F.lit(replica))
        return F.concat(engine["before"], call, engine["rest"])

    def with_name(out: Column) -> Column:
        words = F.split(out, r"\s+", 4)
        unnamed = (F.array_join(F.slice(words, 1, 3), " ") == "CREATE DATABASE _") & (F.size(words) > 3)
        return F.when(unnamed, F.concat(F.lit("CREATE DATABASE "), _ticked(backtick_escape(database)), F.lit(" "), F.get(words, F.lit(3)))).otherwise(out)

    if not non_replicated and replica is None:
        return _let(statement, with_name)
    return _let(_let(statement, lambda s: F.coalesce(_let(_database_engine(s), with_engine), s)), with_name)


def embedded_database(name: Column, engine: Column) -> Column:
    return F.format_string("CREATE DATABASE `%s` Engine=%s", name, engine)


def placeholder_table(uuid: Column) -> Column:
    """A statement that stands for a detached table whose own is lost, so that the server forgets it."""
    return F.format_string("ATTACH TABLE _ UUID '%s' ( `a` UInt32 ) ENGINE = MergeTree ORDER BY a SETTINGS index_granularity = 8192", uuid)


def coordination_path(statement: Column) -> Column:
    """The coordination path of a replicated table; null if the statement has none."""
    return _table_engine(statement)["path"]


def replicated_database(engine_full: Column) -> Column:
    """struct(path, shard, replica) of a replicated database's engine text; null for another engine."""
    return _let(_database_engine(engine_full), lambda e: F.when(e.isNotNull(), F.struct(e["path"].alias("path"), e["shard"].alias("shard"), e["replica"].alias("replica"))))


def database_engine(statement: Column) -> Column:
    pattern = r"(?i)Engine\s*=\s*(\S+)"
    return F.when(statement.rlike(pattern), F.regexp_extract(statement, pattern, 1))


def strip_query(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def strip_except_id(text: Column) -> Column:
    return F.regexp_replace(text, r"EXCEPT ID\('(.+)'\)", "")


def replace_function(statement: Column) -> Column:
    """The first CREATE FUNCTION as CREATE OR REPLACE FUNCTION."""
    return F.regexp_replace(statement, r"(?s)\A(.*?)CREATE FUNCTION", "$1CREATE OR REPLACE FUNCTION")


def workload_entity(statement: Column) -> Column:
    """struct(name, type, parent) of a CREATE WORKLOAD or RESOURCE statement; null for anything else.

    The statement is taken apart from its left: verb and kind, the name, then what follows it:
    nothing, IN and a parent, SETTINGS, or a resource's list in parentheses.
    """
    head, name = r"(?is)\A\s*CREATE\s+(WORKLOAD|RESOURCE)\s+", rf"\A{_IDENTIFIER}"

    def rest(text: Column, start: Column) -> Column:
        return F.ltrim(F.substring(text, start, F.length(text)))

    def entity(kind: Column, first: Column, inside: Column, parent: Column, left: Column) -> Column:
        settled = (left == "") | F.lower(left).startswith("settings ")
        listed = left.startswith("(") & left.endswith(")") & ~inside
        fits = (first != "") & F.when(kind == "workload", settled & (~inside | (parent != ""))).when(kind == "resource", listed).otherwise(False)
        return F.when(fits, F.struct(_bare(first).alias("name"), kind.alias("type"), F.nullif(_bare(parent), F.lit("")).alias("parent")))

    def behind_name(kind: Column, first: Column, tail: Column) -> Column:
        inside = F.lower(F.substring(tail, 1, 3)) == "in "
        parent = F.when(inside, F.regexp_extract(rest(tail, F.lit(4)), name, 0)).otherwise("")
        return _let(parent, lambda up: _let(F.when(inside, rest(tail, 4 + F.length(up))).otherwise(tail), lambda left: entity(kind, first, inside, up, left)))

    def parse(kind: Column, text: Column) -> Column:
        return _let(F.regexp_extract(text, name, 0), lambda first: _let(strip_query(rest(text, F.length(first) + 1)), lambda tail: behind_name(kind, first, tail)))

    text = F.regexp_replace(F.regexp_replace(statement, head, ""), r"\s*;?\s*\z", "")
    return _let(F.lower(F.regexp_extract(statement, head, 1)), lambda kind: _let(text, lambda t: parse(kind, t)))


def _character_class(body: str) -> str:
    """What stands in a pattern's brackets; a range that runs backwards holds nothing."""
    negated, items, out, k = body.startswith("!"), body.removeprefix("!"), [], 0
    while k < len(items):
        is_range = items[k + 1 : k + 2] == "-" and k + 2 < len(items)
        ends = [items[k], items[k + 2]] if is_range else [items[k]]
        if ends == sorted(ends):
            out.append("-".join(f"\\{c}" if c in "\\[]^&-" else c for c in ends))
        k += 3 if is_range else 1
    if not out:
        return "." if negated else "(?!)"
    return f"[{'^' * negated}{''.join(out)}]"


def glob_to_regex(pattern: str) -> str:
    """A shell pattern (*, ?, [seq], [!seq]) as an anchored regular expression."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        end = pattern.find("]", k + 2 + (pattern[k + 1 : k + 2] == "!")) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            out.append(_character_class(pattern[k + 1 : end]))
            k = end
        else:
            out.append(re.escape(c))
        k += 1
    return rf"(?s)\A{''.join(out)}\z"
