"""Restores: dependencies, trees of nodes, access entities, states of backups and restores, documents written whole."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratakeep.operators import dependencies, lifecycle, tree
from stratakeep.operators.prefix import running
from stratakeep.operators.stalls import stalled
from stratakeep.plans import access
from stratakeep.sources import metadata
from stratakeep.sources.restore_state import FAILURES, PARTS, RestoreState, any_failed, failures_of, parts_of, to_documents
from stratakeep.streaming.lifecycle import stream_states

# ---- running aggregates and stalls


@pytest.mark.parametrize("buckets", [1, 7])
def test_running_is_the_loop(spark, buckets):
    rng = random.Random(buckets)
    data = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, *range(30)]), k, rng.choice([None, *range(9)])) for k in range(400)]
    df = spark.createDataFrame(data, "g string, k long, t long, v long")
    got = running(df, ["g"], "k", ["t"], buckets=buckets, total=(F.sum, F.col("v"), True), before=(F.max, F.struct("k", "t", "v"), False), least=(F.min, F.col("v"), True)).collect()
    want = {}
    for g in {d[0] for d in data}:
        rows = sorted((d for d in data if d[0] == g), key=lambda d: (d[1] is not None, d[1] or 0, d[2]))
        for i, d in enumerate(rows):
            seen = [r[3] for r in rows[: i + 1] if r[3] is not None]
            want[d[2]] = (sum(seen) if seen else None, min(seen) if seen else None, (rows[i - 1][1], rows[i - 1][2], rows[i - 1][3]) if i else None)
    assert {r.t: (r.total, r.least, tuple(r.before) if r.before else None) for r in got} == want
    assert running(df.limit(0), ["g"], "k", ["t"], total=(F.sum, F.col("v"), True)).count() == 0


def test_stalls_of_a_hot_series(spark):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    polls = [("hot" if k % 4 else f"s{k % 3}", start + timedelta(seconds=k), rng.choice([None, 1, 1, 1, 2])) for k in range(500)]
    got = stalled(spark.createDataFrame(polls, "db string, at timestamp_ntz, pointer long"), ["db"], ["at"], "pointer").collect()
    want, last, run = {}, {}, {}
    for db, at, pointer in polls:
        run[db] = run[db] + 1 if db in run and last[db] == pointer else 0 if db in run else 1
        last[db] = pointer
        want[at] = run[db]
    assert {r["at"]: r.stall_count for r in got} == want


# ---- dependencies

STATEMENTS = {
    "CREATE TABLE db.a (x String DEFAULT 'FROM db.b') ENGINE = MergeTree ORDER BY x": [],
    "CREATE VIEW db.v AS SELECT * FROM a JOIN other.`b c` USING x": [("db", "a"), ("other", "b c")],
    "CREATE VIEW v AS WITH t AS (SELECT 1 FROM src) SELECT extract(YEAR FROM d) FROM t JOIN db.t USING x -- FROM comment\n": [("db", "src"), ("db", "t")],
    "CREATE VIEW v AS SELECT * FROM numbers(10) WHERE s = 'x FROM y' /* JOIN z */": [],
    "CREATE VIEW v AS SELECT * FROM (SELECT 1 FROM `a.b`) AS s": [("db", "a.b")],
    "CREATE MATERIALIZED VIEW db.m TO db.t (x Int32) AS SELECT x FROM db.s": [("db", "s"), ("db", "t")],
    "CREATE MATERIALIZED VIEW db.m TO INNER UUID 'u' (x Int32) ENGINE = MergeTree AS SELECT x FROM s": [("db", "s")],
    "ATTACH TABLE d (x Int32) ENGINE = Distributed('c', 'remote', 't', rand())": [("remote", "t")],
    "CREATE TABLE d (x Int32) ENGINE = Distributed(c, currentDatabase(), t)": [("db", "t")],
    "CREATE TABLE d (x Int32) ENGINE = Buffer('', 'dest', 1, 10)": [("db", "dest")],
    "CREATE DICTIONARY dd (k Int32) PRIMARY KEY k SOURCE(SERVER(HOST 'localhost' DB 'x' TABLE 'y')) LAYOUT(FLAT())": [("x", "y")],
    "CREATE DICTIONARY dd (k Int32) PRIMARY KEY k SOURCE(SERVER(HOST 'far' DB 'x' TABLE 'y')) LAYOUT(FLAT())": [],
    "CREATE DICTIONARY dd (k Int32) PRIMARY KEY k SOURCE(MYSQL(HOST 'localhost' DB 'x' TABLE 'y')) LAYOUT(FLAT())": [],
    "CREATE DICTIONARY dd (k Int32) PRIMARY KEY k SOURCE(SERVER(QUERY 'SELECT k FROM q.r')) LAYOUT(FLAT())": [("q", "r")],
    "": [],
    None: [],
}


def test_sources_of_statements(spark):
    df = spark.createDataFrame([(k, s) for k, s in enumerate(STATEMENTS)], "k int, statement string")
    got = {r.k: sorted(map(tuple, r.s)) for r in df.select("k", dependencies.sources_of(F.col("statement"), F.lit("db")).alias("s")).collect()}
    assert got == {k: sorted(want) for k, want in enumerate(STATEMENTS.values())}


def rounds_by_trying(objects, edges, live, failing):
    """Again and again, restore what can be."""
    needs = {o: {s for d, s in edges if d == o and s != o and s not in live} for o in objects}
    done, at = {}, 0
    while ready := [o for o in needs if o not in done and o not in failing and all(s in done for s in needs[o])]:
        done |= dict.fromkeys(ready, at)
        at += 1
    left = {o for o in objects if o not in done}
    reach = {o: {s for s in needs[o] if s in left} for o in left}
    for _ in left:
        reach = {o: r | {x for s in r for x in reach[s]} for o, r in reach.items()}
    on = {o for o in left if o in reach[o]}
    between = {o for o in left if reach[o] & on and any(o in reach[c] for c in on)}
    out = {}
    for o in objects:
        lacking = min((s for s in needs[o] if s not in objects), default=None)
        reason = None if o in done else "failed" if o in failing else "missing" if lacking else "cycle" if o in on | between else "blocked"
        out[o] = (done.get(o), reason, f"d.{lacking}" if lacking else None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rounds_are_what_trying_gives(spark, seed):
    rng = random.Random(seed)
    objects = [f"o{k:02}" for k in range(24)]
    edges = {(rng.choice(objects), rng.choice([*objects, "gone", "live"])) for _ in range(20)} | {(objects[k + 1], objects[k]) for k in range(5)}
    failing = {objects[9]} if seed else set()
    o = spark.createDataFrame([("d", x) for x in [*objects, objects[0]]], "database string, table string")
    e = spark.createDataFrame([("d", a, "d", b) for a, b in edges] + [("d", "stranger", "d", "o01")], "database string, table string, source_database string, source_table string")
    one = lambda names: spark.createDataFrame([("d", x) for x in names], "database string, table string")
    got = dependencies.restore_rounds(o, e, live=one(["live"]), failing=one(failing) if failing else None).collect()
    assert {r.table: (r.round, r.reason, r.lacking) for r in got} == rounds_by_trying(set(objects), edges, {"live"}, failing)
    assert len(got) == len(objects)


def test_rounds_of_nothing(spark):
    none = spark.createDataFrame([], "database string, table string, statement string")
    assert dependencies.restore_rounds(none, dependencies.dependencies(none)).count() == 0


# ---- trees of nodes


def replayed(log):
    nodes = {}
    for version, op, path, value in log:
        names = [n for n in path.split("/") if n]
        path = "/" + "/".join(names)
        if op in ("create", "set"):
            for k in range(1, len(names) if op == "create" else 0):
                nodes.setdefault("/" + "/".join(names[:k]), ("", version))
            if path != "/":
                nodes[path] = (value or "", version)
        else:
            for p in list(nodes):
                if p == path or op == "delete_tree" and p.startswith(path.rstrip("/") + "/"):
                    del nodes[p]
    return nodes


def last_made(nodes, log):
    """A node without a value of its own has the version of the last creation below it since it was deleted."""
    return {p: v for p, (v, _) in nodes.items()}


@pytest.mark.parametrize("seed", range(3))
def test_replay_is_the_loop(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "ab", "é"]
    path = lambda: "/" + "/".join(rng.choice(names) for _ in range(rng.randint(0, 3)))
    log = [(v, rng.choice(["create", "create", "create", "set", "delete", "delete_tree"]), path() + rng.choice(["", "/"]), rng.choice(["x", "y", None])) for v in range(1, 120)]
    rows = [*log, (None, "set", "/a", "no"), (500, "set", None, "no")]
    rng.shuffle(rows)
    got = {r.path: r.value for r in tree.replay(spark.createDataFrame(rows, "version long, op string, path string, value string")).collect()}
    assert got == last_made(replayed(log), log)


def test_tree_edges(spark):
    log = lambda rows: spark.createDataFrame(rows, "version long, op string, path string, value string")
    assert tree.replay(log([])).count() == 0
    with pytest.raises(Exception, match="no such operation"):
        tree.replay(log([(1, "move", "/a", None)])).collect()
    same = [(1, "delete", "/a", None), (1, "set", "/a", "v"), (1, "set", "/a", "w")]
    assert [tuple(r) for r in tree.replay(log(same)).collect()] == [("/a", "w", 1)]
    state = spark.createDataFrame([("/a/b", "1"), ("/a/b/c", "2"), ("/ab", "3"), ("/a/d", "4")], "path string, value string")
    assert sorted(map(tuple, tree.children(state, "a/").collect())) == [("b", "1"), ("d", "4")]
    assert {r.name for r in tree.children(state, "/").collect()} == {"ab"}
    assert tree.replay(tree.as_log(state)).count() == 5  # with /a


# ---- access entities

ENTITY = "position long, id string, name string, char string, statement string"


@pytest.mark.parametrize("seed", range(3))
def test_access_restore_is_the_loop(spark, seed):
    rng = random.Random(seed)
    entities = [(k, f"i{k}", rng.choice(["x", "y-z", "é"]), rng.choice("UR"), f"s{k}") for k in range(12)] + [(12, "i12", None, "U", "s"), (13, None, "x", "U", "s")]
    state = {f"/r/uuid/{i}": "old" for i in ("i1", "i5", "o1", "o2")} | {"/r/U/x": "o1", "/r/R/y%2Dz": "i5"}
    nodes = dict(state)
    for _, i, name, char, statement in sorted(e for e in entities if e[1] and e[2]):
        nodes[f"/r/uuid/{i}"] = statement
        link = f"/r/{char}/{ {'x': 'x', 'y-z': 'y%2Dz', 'é': '%C3%A9'}[name] }"
        if nodes.get(link) not in (None, i):
            nodes.pop(f"/r/uuid/{nodes[link]}", None)
        nodes[link] = i
    before = spark.createDataFrame(list(state.items()), "path string, value string")
    plan = access.restore_access(spark.createDataFrame(rng.sample(entities, len(entities)), ENTITY), before, "/r")
    got = tree.replay(tree.as_log(before).unionByName(access.as_versions(plan)))
    assert {r.path: r.value for r in got.where("path not in ('/r', '/r/uuid', '/r/U', '/r/R')").collect()} == nodes
    again = access.restore_access(spark.createDataFrame([(0, "i5", "y-z", "R", "s")], ENTITY), before, "/r")
    assert [(r.step, r.path) for r in again.collect()] == [(0, "/r/uuid/i5")]


def test_access_saved_and_local(spark):
    state = spark.createDataFrame([("/r/uuid/a", "A"), ("/r/uuid/b", "B")], "path string, value string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert {tuple(r) for r in access.save_access(ids("a", "a", None), state, "r").collect()} == {("a.sql", "A")}
    local = spark.createDataFrame([("c.sql", "C"), ("a.sql", "no")], "file string, content string")
    assert {tuple(r) for r in access.save_access(ids("a", "c"), state, "r", local).collect()} == {("a.sql", "A"), ("c.sql", "C")}
    with pytest.raises(Exception, match="no statement of access entity z"):
        access.save_access(ids("z"), state, "r").collect()
    entities = spark.createDataFrame([("a", "A"), ("b", "B"), (None, "x")], "id string, statement string")
    got = sorted(tuple(r) for r in access.restore_local_access(entities, "/acc").collect())
    assert [g[:3] for g in got] == [(0, "clear_folder", "/acc"), (1, "write_file", "/acc/a.sql"), (1, "write_file", "/acc/b.sql"), (2, "write_file", "/acc/need_rebuild_lists.mark")]
    assert access.restore_local_access(entities.limit(0), "/acc").count() == 0


def test_fix_user(spark):
    rows = [("/r/U/admin", "u1"), ("/r/uuid/u1", "ATTACH USER admin GRANT x EXCEPT ID('u1')"), ("/r/uuid/u2", "ATTACH USER admin GRANT x EXCEPT ID('u2')"), ("/r/uuid/u3", "ATTACH USER admin2 y"), ("/r/uuid/u4", "ATTACH ROLE admin")]
    df = lambda rows: spark.createDataFrame(rows, "path string, value string")
    assert [r.id for r in access.linked_id(df(rows), "r", "admin").collect()] == ["u1"]
    assert {tuple(r) for r in access.fix_user(df(rows), "r", "/acc").collect()} == {("delete", "/r/uuid/u2"), ("delete_file", "/acc/u2.sql")}
    assert access.fix_user(df(rows[:2]), "r", "/acc").count() == 0
    with pytest.raises(ValueError, match="differs"):
        access.fix_user(df([*rows, ("/r/uuid/u5", "ATTACH USER `admin` OTHER")]), "r", "/acc")
    for broken in (rows[1:], [rows[0], *rows[2:]]):
        with pytest.raises(ValueError, match="isn't among"):
            access.fix_user(df(broken), "r", "/acc")


# ---- states of backups

EVENT = "backup string, seq long, event string, at double, lease double"


def lives(rng, backups=6, length=30):
    out = []
    for b in range(backups):
        at = 0.0
        for seq in range(length if b else 6 * length):
            at += rng.choice([1, 5, 40])
            event = rng.choice(["begin", "renew", "finish", "fail", "delete", "remove", "keep_shared", "odd"])
            out.append((f"b{b}", seq, event, at, float(rng.choice([10, 30])) if event in ("begin", "renew") else None))
    return out


def folded(rows, now=None):
    out, state, until = [], {}, {}
    for b, seq, event, at, lease in sorted(rows):
        before = state.get(b, "none")
        if b in until and at > until[b] and before == "creating":
            before = "failed"
        after = lifecycle.NEXT.get((before, event))
        state[b] = before if after is None else after
        if lease is not None:
            until[b] = at + lease
        out.append((b, seq, event, state[b], after is not None))
    last = {b: seq for b, seq, *_ in sorted(rows)}
    return out + [(b, last[b], "expired", "failed", True) for b in state if now is not None and state[b] == "creating" and until.get(b, now) < now]


@pytest.mark.parametrize("seed", range(2))
def test_states_are_the_fold(spark, seed):
    rng = random.Random(seed)
    rows = lives(rng)
    df = spark.createDataFrame(rng.sample(rows, len(rows)), EVENT)
    assert sorted(map(tuple, lifecycle.backup_states(df, now=1e9).collect())) == sorted(folded(rows, 1e9))
    odd = df.limit(0).unionByName(spark.createDataFrame([(None, 1, "begin", 0.0, None), ("x", None, "begin", 0.0, None), ("x", 0, None, 0.0, None), ("y", 0, "begin", 2.0, 1.0), ("y", 0, "begin", 2.0, 1.0)], EVENT))
    assert sorted(map(tuple, lifecycle.backup_states(odd).collect())) == [("x", 0, "", "none", False), ("y", 0, "begin", "creating", True)]
    assert lifecycle.backup_states(df.limit(0)).count() == 0


def test_stream_of_states_agrees(spark, tmp_path):
    """Shuffled micro-batches, events that come twice, and leases that end while nothing comes."""
    rng = random.Random(4)
    rows = lives(rng, 4, 12) + [("late", 0, "begin", 1.0, 5.0), ("kept", 0, "begin", 1.0, 5.0), ("kept", 1, "renew", 4.0, 1e7)]
    mixed = rng.sample(rows, len(rows)) + rows[:5]
    out, source = [], tmp_path / "in"
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(0, len(mixed) + 40, 40):
            batch = mixed[k : k + 40] or [("clock", 0, "odd", 1e5, None)]
            spark.createDataFrame(batch, EVENT).coalesce(1).write.mode("append").parquet(str(source))
            stream = stream_states(spark.readStream.schema(EVENT).parquet(str(source)), late="2 hours")
            q = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).start()
            q.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    events = [r for r in out if r[2] != "expired" and r[0] != "clock"]
    assert sorted(events) == sorted(folded(rows))
    expired = {r for r in out if r[2] == "expired"}
    assert expired == {r for r in folded(rows, 9e4) if r[2] == "expired"} and ("late", 0, "expired", "failed", True) in expired


# ---- states of a restore

UPDATE = "database string, table string, part string, path string, seconds double, state string, error string"


def test_restore_documents(spark):
    parts = [("d", "t", f"p{k}", "restored" if k % 2 else "downloaded") for k in range(30)] + [("d", "u", 'q"\\é', "invalid"), ("d", "t", "p0", "restored"), (None, "t", "x", "restored")]
    failures = [("d", "t", "p1", None, "why"), ("d", "t", None, "/path", None), ("d", "t", None, "/path", None), ("e", "t", "p", None, None)]
    documents = to_documents(spark.createDataFrame(parts, PARTS), spark.createDataFrame(failures, FAILURES), line=10)
    assert documents.count() >= 6  # no line holds a whole table
    want = {(d, t, p): s for d, t, p, s in parts[:-1]}
    assert {(r.database, r.table, r.part): r.state for r in parts_of(documents).collect()} == want
    assert {tuple(r) for r in failures_of(documents).collect()} == {("d", "t", "p1", None, "why"), ("d", "t", None, "/path", None), ("e", "t", "p", None, "")}
    assert any_failed(failures_of(documents)) and not any_failed(failures_of(documents).where("part is null"))
    assert to_documents(spark.createDataFrame([], PARTS)).count() == 0
    old = spark.createDataFrame([('{"databases": {"d": {"t": {"p": "restored"}}}, "failed": {"d": {"t": {"failed_paths": ["x"], "failed_parts": {"p": "e"}}}}}',), ("{}",)], "document string")
    assert [tuple(r) for r in parts_of(old).collect()] == [("d", "t", "p", "restored")] and failures_of(old).count() == 2


def test_restore_state_sink(spark, tmp_path):
    df = lambda *rows: spark.createDataFrame(list(rows), UPDATE)
    seen = lambda s: {(r.table, r.part): r.state for r in s.parts().collect()}
    folder = str(tmp_path / "state")
    sink = RestoreState(spark, folder)
    assert sink.versions() == [] and sink.parts().count() == 0
    first = df(("d", "t", "p", None, 1.0, "downloaded", None), ("d", "t", "q", None, 1.0, "downloaded", None), ("d", "t", "q", None, 2.0, "invalid", None), ("d", "t", "z", None, 1.0, None, "broken"))
    sink.update(first, 0)
    assert seen(sink) == {("t", "p"): "downloaded", ("t", "q"): "invalid"} and [r.error for r in sink.failures().collect()] == ["broken"]
    second = df(("d", "t", "p", None, 0.5, "restored", None), ("d", "t", "y", None, 1.0, None, "lost"), ("d", "t", None, "/own", 1.0, None, None))
    for _ in range(2):  # the same batch again changes nothing
        sink.update(second, 1)
        assert seen(sink) == {("t", "p"): "restored", ("t", "q"): "invalid"}
        assert {(r.part, r.path) for r in sink.failures().collect()} == {("z", None), ("y", None), (None, "/own")}
    # a crash before a commit: what was written isn't a version
    (tmp_path / "state/version=000000000002").mkdir()
    (tmp_path / "state/version=000000000002/part-0.txt").write_text('{"databases": {"d": {"t": {"p": "broken"}}}}\n')
    later = RestoreState(spark, folder)
    assert later.versions() == [0, 1] and seen(later)["t", "p"] == "restored"
    later.update(df(("d", "t", "q", None, 9.0, "downloaded", None)), 2)
    assert seen(later) == {("t", "p"): "restored", ("t", "q"): "downloaded"} and later.failures().count() == 0
    assert later.versions() == [1, 2]


def test_restore_state_as_a_stream_sink(spark, tmp_path):
    source, sink = tmp_path / "in", RestoreState(spark, str(tmp_path / "state"))
    for k in range(3):
        spark.createDataFrame([("d", "t", f"p{k}", None, float(k), "downloaded", None), ("d", "t", "p0", None, float(k), "restored" if k == 2 else "invalid", None)], UPDATE).coalesce(1).write.mode("append").parquet(str(source))
        q = spark.readStream.schema(UPDATE).parquet(str(source)).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(sink.sink()).start()
        q.awaitTermination(120)
    assert {r.part: r.state for r in sink.parts().collect()} == {"p0": "restored", "p1": "downloaded", "p2": "downloaded"}


# ---- whole documents


@pytest.fixture
def catalogue(spark):
    backups = spark.createDataFrame(
        [("b 1+%", "v", "c", "h", {"k": "x"}, datetime(2024, 1, 1, 5, 0, 0, 123), datetime(2024, 1, 2), 7, 5, "created", None, False, True, ["u1"], ["f"], ["n"], ["w"]),
         ("20240101", None, None, "g", {}, datetime(2024, 2, 1), None, 0, 0, "failed", "Error: x", True, False, [], [], [], []), (None, None, None, None, None, None, None, 0, 0, "failed", None, False, True, None, None, None, None)],
        "name string, version string, ch_version string, hostname string, labels map<string,string>, start_time timestamp_ntz, end_time timestamp_ntz, bytes long, real_bytes long, state string, exception string, "
        "schema_only boolean, encrypted boolean, access_control array<string>, functions array<string>, named_collections array<string>, workload_entities array<string>",
    )
    databases = spark.createDataFrame([("b 1+%", "d", "Atomic", "u-d", "/m", "Atomic()"), ("b 1+%", "empty", "Lazy", None, None, None), ("20240101", "d", None, None, None, None)], "backup string, database string, engine string, uuid string, metadata_path string, engine_full string")
    tables = spark.createDataFrame([("b 1+%", "d", "t", "MergeTree", "u-t"), ("b 1+%", "d", "none", "Log", None)], "backup string, database string, table string, engine string, uuid string")
    rows = [("b 1+%", "d", "t", "MergeTree", f"p{k}", f"c{k}", k, [f"p{k}.tar", "x"], k % 2 == 0, "l" if k % 3 else None, "q" if k % 5 == 0 else None, "s3" if k % 4 else "default", k % 7 > 0) for k in range(60)]
    parts = spark.createDataFrame(rows, "backup string, database string, table string, engine string, part string, checksum string, bytes long, files array<string>, tarball boolean, link string, link_part_name string, disk_name string, encrypted boolean")
    return metadata.Catalogue(backups, databases, tables, parts)


def rows_of(df, columns):
    return sorted((tuple(str(r[c]) for c in columns) for r in df.collect()), key=str)


def test_catalogue_comes_back_whole(spark, tmp_path, catalogue):
    root = str(tmp_path / "root")
    metadata.write_catalogue(catalogue, root, piece=7)
    back = metadata.read_catalogue(spark, root)
    for name in ("databases", "tables", "parts"):
        frame = getattr(catalogue, name)
        assert rows_of(getattr(back, name), frame.columns) == rows_of(frame, frame.columns), name
    known = catalogue.backups.where("name is not null")
    times = lambda df: df.withColumn("start_time", F.unix_micros(F.col("start_time").cast("timestamp"))).withColumn("end_time", F.unix_micros(F.col("end_time").cast("timestamp")))
    assert rows_of(times(back.backups), known.columns) == rows_of(times(known), known.columns)
    assert rows_of(metadata.read_light(spark, root), ["name", "state"]) == [("20240101", "failed"), ("b 1+%", "created")]
    one = metadata.read_catalogue(spark, root, ["20240101"])
    assert one.parts.count() == 0 and [r.database for r in one.databases.collect()] == ["d"] and metadata.read_catalogue(spark, root, []).backups.count() == 0


def test_later_writings_replace_whole_backups(spark, tmp_path, catalogue):
    root = str(tmp_path / "root")
    metadata.write_catalogue(catalogue, root)
    smaller = metadata.Catalogue(catalogue.backups.where("name = 'b 1+%'").withColumn("state", F.lit("deleting")), catalogue.databases.limit(0), catalogue.tables.limit(0), catalogue.parts.where("bytes = 3"))
    metadata.write_catalogue(smaller, root)
    back = metadata.read_catalogue(spark, root)
    assert [r.part for r in back.parts.collect()] == ["p3"] and {r.name: r.state for r in back.backups.collect()} == {"b 1+%": "deleting", "20240101": "failed"}
    # a writing that breaks off before its light documents counts for nothing
    full = tmp_path / "root/full"
    (full / "write=99999999999999999999-x/kind=part/backup=20240101").mkdir(parents=True)
    (full / "write=99999999999999999999-x/kind=part/backup=20240101/part-0.txt").write_text('{"meta": {"name": "20240101", "state": "created"}, "databases": {"d": {"tables": {"t": {"parts": {"lost": {}}}}}}}\n')
    assert [r.part for r in metadata.read_catalogue(spark, root).parts.collect()] == ["p3"]


def test_documents_of_whole_backups(spark, tmp_path, catalogue):
    documents = metadata.to_documents(catalogue.parts, catalogue.backups.where("name is not null"), catalogue.databases, catalogue.tables)
    named = documents.select(F.get_json_object("document", "$.meta.name").alias("backup"), "document")
    metadata.write_documents(named, str(tmp_path / "root"))
    read = metadata.read_documents(spark, str(tmp_path / "root"))
    assert {r.backup for r in read.collect()} == {"b 1+%", "20240101"}
    parsed = metadata.parse(read)
    for name in ("databases", "tables", "parts"):
        frame = getattr(catalogue, name)
        assert rows_of(getattr(metadata, name)(parsed), frame.columns) == rows_of(frame, frame.columns), name
    assert metadata.read_documents(spark, str(tmp_path / "nothing")).count() == 0
