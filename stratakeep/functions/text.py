"""Options, versions, endpoints and times as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: strftime formats that catalogues are written with, and how Spark spells them.
TIME_FORMATS = {
    "%Y-%m-%d %H:%M:%S.%f %z": "yyyy-MM-dd HH:mm:ss.SSSSSS Z",
    "%Y-%m-%d %H:%M:%S %z": "yyyy-MM-dd HH:mm:ss Z",
    "%Y-%m-%d %H:%M:%S.%f": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "%Y-%m-%d %H:%M:%S": "yyyy-MM-dd HH:mm:ss",
    "%Y-%m-%dT%H:%M:%S%z": "yyyy-MM-dd'T'HH:mm:ssZ",
}


def parse_time(text: Column, time_format: Column) -> Column:
    """An instant, by the row's own format; without a zone it is UTC, whatever the session's zone. Null if unreadable."""
    out = F.lit(None).cast("timestamp")
    for known, spark_format in TIME_FORMATS.items():
        zoned = "Z" in spark_format.split("'")[-1]
        at = F.try_to_timestamp(text if zoned else F.concat(text, F.lit(" +0000")), F.lit(spark_format if zoned else f"{spark_format} Z"))
        out = F.when(time_format == known, at).otherwise(out)
    return out


def format_time(at: Column) -> Column:
    """An instant in the default format, as UTC, whatever the session's zone."""
    return F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" +0000"))


def replace_macros(text: Column, macros: Mapping[str, str]) -> Column:
    """{name} becomes the macro's value; unknown names stay. One pass: values aren't looked into."""
    if not macros:
        return text
    return replace_from(text, F.create_map(*[F.lit(x) for kv in macros.items() for x in kv]))


def replace_from(text: Column, macros: Column) -> Column:
    """replace_macros by a row's own map; without one the text stays."""
    # text between macros and macros, in turn
    pieces = F.regexp_extract_all(text, F.lit(r"(\{[^{}]+\}|[^{]+|\{)"))
    name = lambda p: F.substring(p, F.lit(2), F.length(p) - 2)
    one = lambda p: F.when(p.rlike(r"\A\{[^{}]+\}\z"), F.coalesce(F.try_element_at(macros, name(p)), p)).otherwise(p)
    return F.when(macros.isNull(), text).otherwise(F.array_join(F.transform(pieces, one), ""))


def macro_names(text: Column) -> Column:
    """Names in braces that a text holds."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{([^{}]+)\}"), F.lit(1)))


def absolute_path(path: Column) -> Column:
    """A path with one slash before each name, without `.`, and with `..` taking the name before it away; from the root on."""
    names = F.filter(F.split(path, "/", -1), lambda x: ~x.isin("", "."))
    fold = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(names, F.array().cast("array<string>"), fold), "/"))


def version_at_least(version: Column, least: str) -> Column:
    """Dotted numbers compared in turn, as far as the version's leading numbers go."""
    head = F.regexp_extract(version, r"\A([0-9]+(?:\.[0-9]+)*)", 1)
    numbers = F.transform(F.filter(F.split(head, r"\."), lambda x: x != ""), lambda x: x.cast("int"))
    return numbers >= F.array(*[F.lit(int(x)) for x in least.split(".")])


def _as_hosted(url: Column) -> Column:
    """A URL read as scheme://provider/bucket/key, with the bucket put in front of the provider; null if it has no bucket."""
    parts = r"\A([^/]*)//([^/]*)/([^/]*)/?(.*)\z"
    scheme, provider, bucket, key = (F.regexp_extract(url, parts, k) for k in (1, 2, 3, 4))
    return F.when(url.rlike(parts), F.concat(scheme, F.lit("//"), bucket, F.lit("."), provider, F.lit("/"), key))


def same_endpoint(a: Column, b: Column) -> Column:
    """Whether two bucket URLs are one: as written, or with one read as path-style and the other as virtual-hosted."""
    return (a == b) | F.coalesce(_as_hosted(a) == b, F.lit(False)) | F.coalesce(a == _as_hosted(b), F.lit(False))


def label(text: Column) -> Column:
    """struct(key, value) of "key=value", split at the first =; value is null without one."""
    s = F.split(text, "=", 2)
    return F.struct(F.get(s, F.lit(0)).alias("key"), F.get(s, F.lit(1)).alias("value"))


def string_list(text: Column) -> Column:
    """Comma-separated values, trimmed."""
    return F.transform(F.split(text, ","), lambda x: F.btrim(x))


def key_values(text: Column) -> Column:
    """map of "key:value, key:value", trimmed; of equal keys the last stays."""
    pairs = F.transform(string_list(text), lambda kv: F.struct(F.btrim(F.get(F.split(kv, ":"), F.lit(0))).alias("key"), F.btrim(F.get(F.split(kv, ":"), F.lit(1))).alias("value")))
    at = F.sequence(F.lit(0), F.size(pairs) - 1)
    last = F.filter(at, lambda i: ~F.exists(at, lambda j: (j > i) & (F.get(pairs, j)["key"] == F.get(pairs, i)["key"])))
    return F.map_from_entries(F.transform(last, lambda i: F.get(pairs, i)))


#: Seconds of the units a time span may be given in.
UNITS = {"s": 1, "sec": 1, "second": 1, "seconds": 1, "m": 60, "min": 60, "minute": 60, "minutes": 60, "h": 3600, "hour": 3600, "hours": 3600, "d": 86400, "day": 86400, "days": 86400, "w": 604800, "week": 604800, "weeks": 604800}


def timespan_seconds(text: Column) -> Column:
    """Seconds of text like "90", "5 min" or "2h"; null if unreadable."""
    pattern = r"\A\s*([0-9]+)\s*([a-zA-Z]*)\s*\z"
    n = F.regexp_extract(text, pattern, 1).try_cast("long")
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    by = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.when(text.rlike(pattern), n * F.when(unit == "", F.lit(1)).otherwise(F.try_element_at(by, unit)).cast("long"))


def merged(*maps: Column) -> Column:
    """One map of several; of equal keys the value of the last map stays."""
    out = maps[0]
    for later in maps[1:]:
        out = F.map_concat(_without_keys(out, later), later)
    return out


def _without_keys(a: Column, b: Column) -> Column:
    return F.map_filter(a, lambda k, _: ~F.coalesce(F.map_contains_key(b, k), F.lit(False)))
