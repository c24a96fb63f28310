import fnmatch
import re
from datetime import UTC, datetime
from urllib.parse import quote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratakeep.functions import crypto, ddl, names, sizes, text


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("all_1_1_0", ("all", 1, 1, 0, 0)), ("20200101_3_7_1_100", ("20200101", 3, 7, 1, 100)), ("all", None), ("all_1_2", None), ("", None),
        ("all_x_1_0", None), ("all_1_1_0_abc", None), ("all_1_1_0_4_2", None),
    ],
)
def test_part_name(values, name, want):
    got = values(names.part_name(F.lit(name)))[0]
    assert (tuple(got) if got else None) == want


def test_escapes(values):
    raw = "a b-c.d~é_/`"
    got = values(names.escape_file_name(F.lit(raw)), names.quote_path(F.lit(raw)), names.backtick_escape(F.lit("a`b")), names.sanitise_backup_name(F.lit("a-b")), names.escape_file_name(F.lit("")))
    strict = "".join(chr(b) if chr(b).isalnum() and b < 128 or b == 95 else f"%{b:02X}" for b in raw.encode())
    assert got == [strict, quote(raw, safe="").replace("-", "%2D").replace(".", "%2E"), "a\\`b", "a_b", ""]


def test_links(values):
    assert values(names.link_name(F.lit("x/y//")), names.link_name(F.lit("/")), names.legacy_link(F.lit("a/b"), F.lit("c")), names.legacy_link(F.lit("a/b"), F.lit("c/d"))) == ["y", None, "a/c", "c/d"]


@pytest.mark.parametrize(("name", "size", "want"), [("x", 512, 1024), ("x" * 100, 512, 1024), ("x" * 513, 512, 2560)])
def test_tar_size(values, name, size, want):
    assert values(sizes.tar_size(F.lit(size), F.array(F.lit(name)))) == [want]


def test_golden_sizes(values):
    tar = sizes.tar_size(F.lit(1024), F.array(F.lit("x" * 101), F.lit("x" * 102)))
    aligned = [sizes.aligned(F.lit(n)) for n in (0, 1, 512, 513)]
    sealed = [sizes.sealed_size(F.lit(n), c, o) for n, c, o in ((1, 1, 1), (100, 10, 10), (101, 10, 10), (512, 100, 10))]
    waits = [sizes.transfer_seconds(F.lit(n), r) for n, r in ((10, 1), (10, 10), (10, 4), (123456, 5321), (7, 0))]
    assert values(tar, *aligned, *sealed, *waits) == [4096, 0, 512, 512, 1024, 2, 200, 211, 572, 9, 0, 2, 23, 0]


def test_chunks(values):
    got = values(sizes.upload_chunk_size(F.lit(1000), 10, 10), sizes.upload_chunk_size(F.lit(90), 10, 10), sizes.ranges(F.lit(5), 2), sizes.ranges(F.lit(0), 2))
    assert got[:2] == [100, 10] and [tuple(r) for r in got[2]] == [(0, 2), (2, 4), (4, 5)] and got[3] == []


def test_header(values):
    data = bytes([0, 0, 0, 0, 0, 2, 0]) + bytes(16) + bytes(range(16)) + bytes(25)
    good, short = values(sizes.encrypted_header(F.lit(data)), sizes.encrypted_header(F.lit(b"x")))
    assert tuple(good) == (2, bytes(range(16)).hex().upper()) and short is None


def test_aes_ctr(values):
    # the counter-mode example of NIST SP 800-38A, F.5.1
    key, iv = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes.fromhex("f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff")
    plain = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")
    want = bytes.fromhex("874d6191b620e3261bef6864990db6ce9806f66b7970fdff8617187bb9fffdff")
    args = F.lit(key), F.lit(iv)
    full, part, back = values(crypto.aes_ctr(F.lit(plain), *args), crypto.aes_ctr(F.lit(plain[:21]), *args), crypto.aes_ctr(crypto.aes_ctr(F.lit(plain), *args), *args))
    assert (bytes(full), bytes(part), bytes(back)) == (want, want[:21], plain)


def test_aes_ctr_counter_carries(values):
    key, iv = F.lit(bytes(32)), F.lit(b"\xff" * 16)
    zero = F.lit(bytes(16))
    two, second = values(crypto.aes_ctr(F.lit(bytes(32)), key, iv), crypto.aes_ctr(zero, key, zero))
    assert bytes(two)[16:] == bytes(second)


def test_seal(values):
    data, key = F.lit(b"abc"), F.lit(bytes(16))
    sealed, back = values(crypto.seal(data, key), crypto.unseal(crypto.seal(data, key), key))
    assert len(sealed) == 3 + crypto.GCM_OVERHEAD and bytes(back) == b"abc"


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("CREATE TABLE db.t (a Int32) ENGINE = Log", "ATTACH TABLE `db`.`t` UUID 'x-y' ( a  Int32 )\nENGINE = Log", True),
        ("CREATE TABLE db.t (a Int32)", "CREATE TABLE db.u (a Int32)", False),
        ("CREATE TABLE d.t (a Int32) ENGINE = Distributed('c', d, t)", "CREATE TABLE d.t (a Int32) ENGINE = Distributed('c', 'd', 't')", True),
        ("CREATE TABLE d.t (a Int32)", "CREATE TABLE d.t (a Int64)", False),
    ],
)
def test_same_schema(values, a, b, same):
    assert values(ddl.same_schema(F.lit(a), F.lit(b))) == [same]


def test_rewrites(values):
    r = F.lit("CREATE TABLE _ (a Int32) ENGINE = ReplicatedReplacingMergeTree('/p', 'r1', ver) ORDER BY a")
    plain = F.lit("CREATE TABLE db.t (a Int32)")
    uuid = F.lit("12345678-1234-1234-1234-123456789012")
    once = ddl.with_uuid(plain, uuid, F.lit(False), F.lit("db"), F.lit("t"))
    got = values(ddl.un_replicate(r), ddl.with_replica(r, "r2"), ddl.qualified(r, F.lit("d`b"), F.lit("t")), once, ddl.with_uuid(once, uuid, F.lit(False), F.lit("db"), F.lit("t")), ddl.coordination_path(r), ddl.coordination_path(plain))
    assert got[0] == "CREATE TABLE _ (a Int32) ENGINE = ReplacingMergeTree(ver) ORDER BY a"
    assert "'/p', 'r2', ver" in got[1] and got[2].startswith("CREATE TABLE `d\\`b`.`t` (a")
    assert got[3] == got[4] == "CREATE TABLE db.t UUID '12345678-1234-1234-1234-123456789012' (a Int32)"
    assert got[5:] == ["/p", None]


U, INNER = "f8456d96-67fe-45bf-9126-61f83c4b2682", "00000000-1111-2222-3333-444444444444"
#: (statement, is it a view, without replication?, with a UUID?, what it becomes); the replica's name becomes {replica}.
REWRITTEN = [
    ("CREATE TABLE d.t (p Int32, n Int32) ENGINE = MergeTree PARTITION BY p ORDER BY (p, n)", False, True, False, None),
    ("CREATE TABLE d.t (s String) ENGINE = MergeTree ORDER BY n", False, True, True, f"CREATE TABLE d.t UUID '{U}' (s String) ENGINE = MergeTree ORDER BY n"),
    ("CREATE TABLE d.t (n Int32) ENGINE = ReplicatedMergeTree('/tables/d/t', 'replica1') ORDER BY (p, n)", False, True, False, "CREATE TABLE d.t (n Int32) ENGINE = MergeTree ORDER BY (p, n)"),
    ("CREATE TABLE d.t (n Int32) ENGINE = ReplicatedMergeTree('/tables/d/t', 'replica1') ORDER BY n", False, False, False, "CREATE TABLE d.t (n Int32) ENGINE = ReplicatedMergeTree('/tables/d/t', '{replica}') ORDER BY n"),
    ("CREATE TABLE d.t (n Int32) ENGINE = ReplicatedReplacingMergeTree('/t', 'r', ver) ORDER BY n", False, False, False, "CREATE TABLE d.t (n Int32) ENGINE = ReplicatedReplacingMergeTree('/t', '{replica}', ver) ORDER BY n"),
    ("CREATE TABLE d.t (n Int32) ENGINE = ReplicatedMergeTree ORDER BY n", False, True, False, None),
    ("CREATE TABLE d.t (a DateTime) ENGINE = Distributed('c', 'd', 'l')", False, True, True, f"CREATE TABLE d.t UUID '{U}' (a DateTime) ENGINE = Distributed('c', 'd', 'l')"),
    ("CREATE TABLE d.t ENGINE = Distributed('c', 'd', 'l')", False, True, True, f"CREATE TABLE d.t UUID '{U}' ENGINE = Distributed('c', 'd', 'l')"),
    ("CREATE DICTIONARY d.t (n1 UInt32)", False, True, False, None),
    ("CREATE DICTIONARY d.t (n1 UInt32)", False, True, True, f"CREATE DICTIONARY d.t UUID '{U}' (n1 UInt32)"),
    ("CREATE TABLE _ (n Int32) ENGINE = MergeTree", False, True, False, "CREATE TABLE `d`.`t` (n Int32) ENGINE = MergeTree"),
    ("CREATE TABLE t (n Int32) ENGINE = MergeTree", False, True, False, "CREATE TABLE `d`.`t` (n Int32) ENGINE = MergeTree"),
    ("CREATE VIEW _ AS SELECT n FROM d.table_01", True, True, False, "CREATE VIEW `d`.`t` AS SELECT n FROM d.table_01"),
    ("CREATE LIVE VIEW _ AS SELECT n FROM d.table_01", True, True, False, "CREATE LIVE VIEW `d`.`t` AS SELECT n FROM d.table_01"),
    ("CREATE MATERIALIZED VIEW `d`.`t` AS SELECT 1", True, False, True, f"CREATE MATERIALIZED VIEW `d`.`t` UUID '{U}' TO INNER UUID '{INNER}' AS SELECT 1"),
    ("ATTACH TABLE `d`.`t` (n Int32) ENGINE = MergeTree", False, True, True, f"ATTACH TABLE `d`.`t` UUID '{U}' (n Int32) ENGINE = MergeTree"),
    (f"CREATE TABLE _ (n Int32) UUID '{INNER}' ENGINE = MergeTree", False, True, True, f"CREATE TABLE `d`.`t` (n Int32) UUID '{INNER}' ENGINE = MergeTree"),
    (f"ATTACH TABLE _ UUID '{INNER}' (n Int32) ENGINE = MergeTree", False, True, True, f"ATTACH TABLE `d`.`t` UUID '{INNER}' (n Int32) ENGINE = MergeTree"),
]


def test_table_statements(values):
    def rewritten(statement, is_view, plain, uuid):
        s, d, t = F.lit(statement), F.lit("d"), F.lit("t")
        s = ddl.with_replica(ddl.un_replicate(s) if plain else s, "{replica}")
        return ddl.qualified(ddl.with_uuid(s, F.lit(U), F.lit(is_view), d, t, F.lit(INNER)) if uuid else s, d, t)

    got = values(*[rewritten(*row[:4]) for row in REWRITTEN])
    assert got == [row[4] or row[0] for row in REWRITTEN]


ALIKE = [
    ("CREATE TABLE b.t (`d` Date) ENGINE = Distributed('f-f', 'b_b', 't_b')", "CREATE TABLE b.t (`d` Date) ENGINE = Distributed('f-f', b_b, t_b)", True),
    ("CREATE TABLE b.t (`d` Date) ENGINE = Distributed('f-f', 'b_b', 't_b')", "CREATE TABLE b.t (`d` Date) ENGINE = Distributed('f-f', b_z, t_z)", False),
    ("CREATE TABLE b.t (`d` Date) ENGINE = Distributed('f-f', 'b_b', 't_b')", "CREATE TABLE b.t (`d` Date) ENGINE = Distributed('b-b', b_b, t_b)", False),
    ("CREATE TABLE b.t (`d` Date) ENGINE = Distributed('f', 'b', 't', rand(), p) SETTINGS a=b", "CREATE TABLE b.t (`d` Date) ENGINE = Distributed('f', b, t, rand(), p) SETTINGS a=b", True),
    ("CREATE TABLE b.t (`d` Date) ENGINE = Distributed('f', 'b', 't', k, p) SETTINGS a=b", "CREATE TABLE b.t (`d` Date) ENGINE = Distributed('f', b, t, k, p) SETTINGS c=b", False),
    ("CREATE TABLE `b`.t_all (`a` UInt32) ENGINE = Distributed('{c}', 'b', 't')", "ATTACH TABLE `b`.`t_all` (`a` UInt32) ENGINE = Distributed('{c}', 'b', 't')", True),
    ("CREATE TABLE b.t (`a` UInt32) ENGINE = Log", f"ATTACH TABLE `b`.`t` UUID '{U}' (`a` UInt32) ENGINE = Log", True),
    ("CREATE TABLE b.t (`n` Int32, PROJECTION p (SELECT n, COUNT(*) AS c GROUP BY n)) ENGINE = MergeTree", "CREATE TABLE b.t (`n` Int32, PROJECTION p (SELECT n, count(*) AS c GROUP BY n)) ENGINE = MergeTree", True),
    ("CREATE MATERIALIZED VIEW b.m TO b.base (`n` UInt64) AS SELECT * FROM s.n LIMIT 10", "ATTACH MATERIALIZED VIEW `b`.`m` TO b.base (`n` UInt64) AS SELECT * FROM s.n LIMIT 10", True),
]


def test_alike_statements(values):
    assert values(*[ddl.same_schema(F.lit(a), F.lit(b)) for a, b, _ in ALIKE]) == [same for *_, same in ALIKE]


def test_database_statements(values):
    s = F.lit("CREATE DATABASE _ ENGINE = Replicated('/p', 's', 'r') COMMENT 'x'")
    got = values(ddl.database_statement(s, F.lit("a`b"), True), ddl.database_statement(s, F.lit("d"), replica="r2"), ddl.database_statement(F.lit("CREATE DATABASE x ENGINE = Atomic"), F.lit("d"), True, "r2"))
    assert got == ["CREATE DATABASE `a\\`b` ENGINE=Atomic COMMENT 'x'", "CREATE DATABASE `d` ENGINE = Replicated('/p', 's', 'r2') COMMENT 'x'", "CREATE DATABASE x ENGINE = Atomic"]


ENTITIES = {
    "CREATE RESOURCE `io res` (WRITE DISK a, READ DISK b);": ("io res", "resource", None),
    "CREATE WORKLOAD prod IN `all of it` SETTINGS weight = 3;": ("prod", "workload", "all of it"),
    "CREATE WORKLOAD x SETTINGS weight = 3": ("x", "workload", None),
    "CREATE WORKLOAD inner": ("inner", "workload", None),
    "CREATE WORKLOAD x y": None,
    "CREATE RESOURCE r": None,
    "": None,
}


def test_entities(values):
    got = values(*[ddl.workload_entity(F.lit(s)) for s in ENTITIES])
    assert [tuple(g) if g else None for g in got] == list(ENTITIES.values())


def test_workload(values):
    got = values(*[ddl.workload_entity(F.lit(s)) for s in ("CREATE WORKLOAD all;", "create workload `a b` in all settings x = 1", "CREATE RESOURCE r (READ DISK d)", "DROP WORKLOAD x")])
    assert [tuple(g) if g else None for g in got] == [("all", "workload", None), ("a b", "workload", "all"), ("r", "resource", None), None]


@settings(max_examples=200, deadline=None)
@given(st.text("ab*?[]!-.", max_size=8), st.text("ab-.![", max_size=6))
def test_glob(pattern, name):
    ours = re.fullmatch(ddl.glob_to_regex(pattern).replace(r"\z", r"\Z"), name) is not None
    if not re.search(r"\[.*-", pattern):  # ranges that run backwards are read differently
        assert ours == fnmatch.fnmatchcase(name, pattern)


def test_text(values):
    macros = text.replace_macros(F.lit("{a},{c} } {a} {"), {"a": "1", "b": "{a}"})
    times = [text.timespan_seconds(F.lit(t)) for t in ("90", "5 min", "2h", "x", "1.5 h")]
    got = values(macros, *times, text.version_at_least(F.lit("22.8.5.1-lts"), "22.8"), text.version_at_least(F.lit("22.3"), "22.8"))
    assert got == ["1,{c} } 1 {", 90, 300, 7200, None, None, True, False]


def test_endpoints(values):
    pairs = [("https://s/b/k", "https://b.s/k", True), ("https://b.s/k", "https://s/b/k", True), ("https://s/b/k", "https://s/b/k", True), ("https://s/b/k", "https://b.s/x", False), ("a", "a/b", False)]
    assert values(*[text.same_endpoint(F.lit(a), F.lit(b)) for a, b, _ in pairs]) == [w for *_, w in pairs]


def test_times(values):
    got = values(text.parse_time(F.lit("2024-01-02 03:04:05 +0300"), F.lit("%Y-%m-%d %H:%M:%S %z")), text.parse_time(F.lit("2024-01-02 03:04:05"), F.lit("%Y-%m-%d %H:%M:%S")), text.parse_time(F.lit("x"), F.lit("%Y-%m-%d %H:%M:%S")))
    as_utc = [None if g is None else g.astimezone(UTC).replace(tzinfo=None) for g in got]
    assert as_utc == [datetime(2024, 1, 2, 0, 4, 5), datetime(2024, 1, 2, 3, 4, 5), None]


def test_maps_and_lists(values):
    got = values(text.key_values(F.lit("a:1, b : 2,a:3")), text.string_list(F.lit("x, y")), text.label(F.lit("k")), text.label(F.lit("k=a=b")))
    assert got[0] == {"a": "3", "b": "2"} and got[1] == ["x", "y"] and tuple(got[2]) == ("k", None) and tuple(got[3]) == ("k", "a=b")
