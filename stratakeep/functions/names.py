"""Names, paths and links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that stay as they are, as upper-case hex pairs.
_WORD = [f"{b:02X}" for b in (*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B))]
_TILDE = f"{0x7E:02X}"


def _percent(name: Column, kept: list[str]) -> Column:
    """Every UTF-8 byte that isn't kept as %XX. The hex of the bytes is cut in pairs, and pairs are decoded if kept."""
    pairs = F.regexp_extract_all(F.hex(F.encode(name, "UTF-8")), F.lit("(..)"))
    plain = F.array(*map(F.lit, kept))
    one = lambda p: F.when(F.array_contains(plain, p), F.decode(F.unhex(p), "UTF-8")).otherwise(F.concat(F.lit("%"), p))
    return F.array_join(F.transform(pairs, one), "")


def escape_file_name(name: Column) -> Column:
    """Metadata file name: letters, digits and _ stay, any other byte is %XX."""
    return _percent(name, _WORD)


def quote_path(name: Column) -> Column:
    """Path component in storage: as a file name, but ~ stays too."""
    return _percent(name, [*_WORD, _TILDE])


def unquoted(name: Column) -> Column:
    """What escape_file_name or quote_path made of a name, back; null where the bytes aren't UTF-8."""
    return F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def backtick_escape(name: Column) -> Column:
    """For use between backticks: each backtick gets a backslash."""
    return F.replace(name, F.lit("`"), F.lit("\\`"))


def sanitise_backup_name(name: Column) -> Column:
    return F.translate(name, "-", "_")


def valid_name(name: Column) -> Column:
    """ASCII letters, digits, _ and -; at least one."""
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9_-]+\z"), F.lit(False))


def link_name(link: Column) -> Column:
    """The last component of a link after trailing slashes go; null if nothing is left."""
    return F.nullif(F.element_at(F.split(F.regexp_replace(link, "/+$", ""), "/"), -1), F.lit(""))


def legacy_link(path: Column, link: Column) -> Column:
    """A bare link as a path beside `path`; one that has a slash stays; null stays null."""
    parent = F.regexp_replace(path, "/?[^/]*$", "")
    return F.when(link.isNull() | F.contains(link, F.lit("/")), link).otherwise(F.concat_ws("/", F.nullif(parent, F.lit("")), link))


def part_name(name: Column) -> Column:
    """struct(partition_id, min_block, max_block, level, mutation) of a part name; null if it isn't one."""
    s = F.split(name, "_", 6)
    number = lambda k: F.when(F.regexp(F.get(s, F.lit(k)), F.lit("^-?[0-9]+$")), F.get(s, F.lit(k)).try_cast("long"))
    n = F.size(s)
    mutation = F.when(n == 4, F.lit(0).cast("long")).otherwise(number(4))
    ok = ((n == 4) | (n == 5)) & number(1).isNotNull() & number(2).isNotNull() & number(3).isNotNull() & mutation.isNotNull()
    parts = F.struct(F.get(s, F.lit(0)).alias("partition_id"), number(1).alias("min_block"), number(2).alias("max_block"), number(3).alias("level"), mutation.alias("mutation"))
    return F.when(ok, parts)


def same_but_mutation(a: Column, b: Column) -> Column:
    """Whether two part names differ in their mutation at most; null if one isn't a part name."""
    x, y = part_name(a), part_name(b)
    out = F.lit(True)
    for c in ("partition_id", "min_block", "max_block", "level"):
        out = out & (x[c] == y[c])
    return out


def physical_name(link_part_name: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(link_part_name, F.lit("")), name)


def effective_link_name(stored_link_part_name: Column, stored_name: Column, current_name: Column) -> Column:
    """The name under which a linked part is stored, if it isn't the current name."""
    return F.when(stored_link_part_name.isNotNull() & (stored_link_part_name != ""), stored_link_part_name).otherwise(F.when(stored_name != current_name, stored_name))


# Places in storage, below the root folder


def _path(*parts: Column | str) -> Column:
    return F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def metadata_path(root: str, backup: Column, light: bool = False) -> Column:
    return _path(root, backup, "backup_light_struct.json" if light else "backup_struct.json")


def access_control_path(root: str, backup: Column) -> Column:
    return _path(root, backup, "access_control", "access_control.tar")


def udf_path(root: str, backup: Column, name: Column) -> Column:
    return _path(root, backup, "udf", quote_path(name))


def databases_path(root: str, backup: Column) -> Column:
    return _path(root, backup, "metadata", "databases.tar")


def database_path(root: str, backup: Column, database: Column) -> Column:
    return _path(root, backup, "metadata", F.concat(quote_path(database), F.lit(".tar")))


def legacy_table_path(root: str, backup: Column, database: Column, table: Column) -> Column:
    return _path(root, backup, "metadata", quote_path(database), F.concat(quote_path(table), F.lit(".sql")))


def named_collection_path(root: str, backup: Column, name: Column) -> Column:
    return _path(root, backup, "named_collections", F.concat(quote_path(name), F.lit(".sql")))


def workload_path(root: str, backup: Column, name: Column) -> Column:
    return _path(root, backup, "workload_entities", F.concat(quote_path(name), F.lit(".sql")))


def part_path(root: str, backup: Column, database: Column, table: Column, part: Column) -> Column:
    return _path(root, backup, "data", quote_path(database), quote_path(table), part, F.concat(part, F.lit(".tar")))


def disk_table_path(root: str, backup: Column, disk: Column, database: Column, table: Column, compressed: bool = False) -> Column:
    return _path(root, backup, "disks", disk, quote_path(database), F.concat(quote_path(table), F.lit(".tar.gz" if compressed else ".tar")))


def legacy_disk_path(root: str, backup: Column, disk: Column, compressed: bool = False) -> Column:
    return _path(root, backup, "disks", F.concat(disk, F.lit(".tar.gz" if compressed else ".tar")))
