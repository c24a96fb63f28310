import random

import numpy as np
import pyarrow as pa
import pytest

from llm.conftest import WORDS, rows_of
from stratakeep.llm import links
from stratakeep.llm.components import components, roots
from stratakeep.llm.lines import SHINGLE, Lines, _signatures, dedup_lines, removed_lines
from stratakeep.llm.links import crowded_bands, min_max, multipliers
from stratakeep.llm.near_documents import near_documents


def brute_components(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for x in sorted(near):
        if x not in out:
            todo = [x]
            while todo:
                y = todo.pop()
                if y not in out:
                    out[y] = x
                    todo += near[y]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(0, 60)] + [(500, k) for k in range(600, 640)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    edges += edges[:5]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components([e for e in edges if e[0] != e[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets_of(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def corpus(seed):
    rng, docs = random.Random(seed), []
    for _ in range(6):
        base = [rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(rng.choice((3, 40, 120)))]
        for _ in range(rng.randrange(1, 30)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            docs.append(" ".join(copy))
    docs += [None, "", "  ", docs[0], docs[0].upper()]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed, words", [(0, 4), (1, 5), (2, 4)])
def test_near_documents_is_brute_force(spark, monkeypatch, seed, words):
    docs = corpus(seed)
    sets = {k: sets_of(t, words) for k, t in docs}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(edges)
    got = near_documents(spark.createDataFrame(docs, "doc_id long, text string"), shingle=words)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(((k, len(sets[k]), want.get(k, k), want.get(k, k) == k) for k in sets), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_star_rounds(spark, seed):
    """Tasks of 20 edges: contraction within tasks isn't enough, and rounds between them follow."""
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(0, 80)] + [(500, k) for k in range(600, 660)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    rng.shuffle(edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), edges_a_task=20).collect()}
    assert got == brute_components([e for e in edges if e[0] != e[1]])


def hub_and_leaves():
    """A hub that members link to one by one, though mostly not to each other."""
    import numpy as np

    rng = np.random.default_rng(1)
    hub = np.sort(rng.integers(1, 1 << 60, 100, dtype=np.uint64))
    return [(0, hub)] + [(k, np.sort(np.r_[hub[rng.permutation(100)[:88]], rng.integers(1, 1 << 60, 6, dtype=np.uint64)])) for k in range(1, 20)]


@pytest.mark.parametrize("component", [lambda k: k, lambda k: 100 if 2 < k < 15 else k])
def test_blocks_lose_no_link(spark, component):
    """Of every two components that a link joins, the forest tells; in blocks of 3."""
    import numpy as np

    bodies = hub_and_leaves()
    open_ = spark.createDataFrame([(7, k, component(k)) for k, _ in bodies], "key long, id long, component long")
    stored = spark.createDataFrame([(k, x.tobytes()) for k, x in bodies], "id long, body binary")
    want = [(component(a), component(b)) for a, x in bodies for b, y in bodies if a < b and component(a) != component(b) and 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))]
    groups = links.dealt(open_, block=3)
    got = links.across_components(groups, stored, 80).collect()
    assert brute_components([(r.a, r.b) for r in got]) == brute_components(want)
    assert {(r.a, r.b) for r in got} <= {(min(c, d), max(c, d)) for c, d in brute_pairs(want)}
    sizes = [r["count"] for r in groups.groupBy("i", "j").count().collect()]
    assert max(sizes) < 20
    seen = {(x, y) for rows in by_group(groups) for x in rows for y in rows}
    assert all((a, b) in seen for a, _ in bodies for b, _ in bodies if component(a) != component(b))


def brute_pairs(edges):
    """All pairs of nodes of one component."""
    of = brute_components(edges)
    return {(a, b) for a in of for b in of if of[a] == of[b] and a != b}


def by_group(groups):
    out = {}
    for r in groups.collect():
        out.setdefault((r.key, r.i, r.j), []).append(r.id)
    return out.values()


def test_a_large_component_is_not_paired_with_itself(spark):
    """2,000 members of one component and 5 others: each of the 2,000 stands in one group alone."""
    open_ = spark.createDataFrame([(1, k, 0 if k < 2000 else k) for k in range(2005)], "key long, id long, component long")
    assert links.dealt(open_, block=100).where("component = 0").count() == 2000


def test_parity_never_hides_a_link():
    """Bitmaps differ in no more bits than the sets in elements, whatever their sizes."""
    import numpy as np

    rng = np.random.default_rng(5)
    for size in (1, 3, 15, 16, 17, 60, 128, 129, 500, 4000):
        base = rng.integers(1, 1 << 60, size, dtype=np.uint64)
        sets = [np.unique(np.r_[base[rng.random(size) < share], rng.integers(1, 1 << 60, extra, dtype=np.uint64)]) for share in (0.5, 0.85, 1) for extra in (1, 1 + size // 10, 1 + size)]
        for k, others, differ in links._each_unlike([links.parity(s) for s in sets]):
            for other, bits in zip(others, differ):
                assert bits <= len(np.setxor1d(sets[k], sets[other]))


def test_recall_at_the_threshold():
    """Pairs of sets at J = 0.8 exactly share a band of the documents' signatures, and 99.6 in 100 one of the lines'."""
    import numpy as np

    rng = np.random.default_rng(11)
    for permutations, dtype, rows, least in ((224, np.uint64, 7, 1.0), (35, np.uint32, 5, 0.985)):
        by, met = links.multipliers(permutations, dtype), []
        for n in (8, 40, 200):
            for _ in range(200):
                x = rng.integers(1, np.iinfo(dtype).max, n + n // 4, dtype=dtype)
                s, t = x[: n + n // 8], np.r_[x[: n], x[n + n // 8 :]]
                met.append(bool((links.band_keys(links.min_max(s, by), rows) == links.band_keys(links.min_max(t, by), rows)).any()))
        assert np.mean(met) >= least


def test_one_id_with_two_texts(spark):
    """Each text of a repeated doc_id has its own links."""
    rng = random.Random(8)
    a, b = (" ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(60)) for _ in range(2))
    got = near_documents(spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "else")], "doc_id long, text string"))
    assert rows_of(got, "doc_id", "component_id", "kept") == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_odd_documents(spark, odd):
    got = near_documents(odd)
    assert got.count() == odd.count()
    rows = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert rows[4].component_id == 3 and rows[5].component_id == 5 and not rows[4].kept
    assert rows[0].n_shingles == 0 and rows[0].kept and rows[6].n_shingles > 50_000
    assert near_documents(odd.limit(0)).count() == 0


def test_lines(spark, odd):
    base = "the quick brown fox jumps over the lazy dog again and again until it is dark outside"
    docs = [(1, f"Title\n{base}\nend"), (2, f"  {base.upper()} \nother"), (3, base.replace("dark", "dork")), (4, "Title\nTitle"), (5, None), (6, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.removed for r in removed_lines(df, least_bytes=24).where("size(removed) > 0").collect()} == {2: [0], 3: [0]}
    assert rows_of(dedup_lines(df, least_bytes=24), "doc_id", "text") == sorted([docs[0], (2, "other"), (3, ""), *docs[3:]], key=str)
    # by default lines of any length are compared
    assert {r.doc_id: r.removed for r in removed_lines(df).where("size(removed) > 0").collect()} == {2: [0], 3: [0], 4: [0, 1]}
    assert rows_of(dedup_lines(df), "doc_id", "text") == sorted([docs[0], (2, "other"), (3, ""), (4, ""), *docs[4:]], key=str)
    out = dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert dedup_lines(odd.limit(0)).count() == 0


def test_short_lines(spark, tmp_path):
    """The query compares every line that isn't blank: short ones exactly, and by shingles where they have some."""
    from stratakeep.llm.queries import op3_line_dedup

    docs = [(1, "Read more\nAll rights reserved.\n\nOK\n Read   more"), (2, "READ MORE \nall rights reserved\n\nok\nOK!"), (3, "x\ny\nx\n  \n"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_line_dedup(spark, str(tmp_path))
    assert rows_of(got, "doc_id", "n_compared", "removed_lines") == [(1, 4, []), (2, 4, [0, 1, 3]), (3, 3, [2]), (4, 0, [])]


def test_lines_are_brute_force(spark):
    """Random lines: copies with a few letters changed, whose shingles agree in far more or far fewer than 80 in 100."""
    rng = random.Random(4)
    bases = [" ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(rng.choice((3, 12, 40)))) for _ in range(12)]

    def changed(line):
        at = rng.randrange(len(line))
        return rng.choice((line, line.upper(), f"  {line}\t", line[:at] + "#" + line[at + 1 :]))

    docs = [(k, "\n".join(changed(rng.choice(bases)) if rng.random() < 0.7 else rng.choice(("", " ", f"own {k} line {rng.random()}", "ok")) for _ in range(rng.randrange(1, 9)))) for k in range(60)]
    lines = [(k, j, x.strip().lower().encode()) for k, t in docs for j, x in enumerate(t.split("\n")) if x.strip()]
    distinct = sorted({x for *_, x in lines})
    sets = {x: {x[i : i + 8] for i in range(len(x) - 7)} for x in distinct}
    share = {(x, y): len(sets[x] & sets[y]) / len(sets[x] | sets[y]) for x in distinct for y in distinct if x < y and sets[x] and sets[y]}
    near = [(x, y) for (x, y), j in share.items() if j >= 0.8]
    of = brute_components(near)
    first = {}
    for k, j, x in lines:
        first.setdefault(of.get(x, x), (k, j))
    want = {k: sorted(j for d, j, x in lines if d == k and first[of.get(x, x)] != (d, j)) for k, _ in docs}
    got = removed_lines(spark.createDataFrame(docs, "doc_id long, text string"), least_bytes=1)
    rows = {r.doc_id: (r.n_compared, r.removed) for r in got.collect()}
    assert near and rows == {k: (sum(d == k for d, *_ in lines), want[k]) for k in want if any(d == k for d, *_ in lines)}


def test_groups_of_any_size_give_one_forest():
    """Pairs of a batch at once, and member by member in larger groups, connect the same."""
    import pyarrow as pa

    rows = [(7, 0, 0, k, k % 4, 0, x) for k, x in hub_and_leaves()] + [(8, 0, 1, 50 + k, k % 3, k % 2, x) for k, x in hub_and_leaves()]
    names = ("key", "i", "j", "id", "component", "block")
    table = pa.table({name: [r[c] for r in rows] for c, name in enumerate(names)} | {"n": [len(r[6]) for r in rows], "parity": [links.parity(r[6]) for r in rows]})
    groups = [(0, 20), (20, 40)]
    made = [brute_components(list(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))) for out in (links._families(80, few)(table, groups) for few in (2, 48))]
    assert made[0] == made[1] and len(made[0]) > 20


def test_crowded_bands_are_whole_however_keys_are_dealt(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [int(k) for k in rng.integers(-40, 40, 3) * (1 << 56)] + [7]) for i in rng.integers(-500, 500, 400)]
    rows = [*{i: (i, k) for i, k in rows}.values()]
    rows += rows[:50] + [(1001, None), (1002, [])]  # repeated, without keys
    of = {}
    for i, keys in rows:
        for k in keys or []:
            of.setdefault(k, set()).add(i)
    of = {k: ids for k, ids in of.items() if len(ids) > 1}
    bands = spark.createDataFrame(rows, "id long, bands array<long>").repartition(5)
    for n in (1, 64, 1_000_000):
        found = {}
        for r in crowded_bands(bands, 4 * len(rows), keys_a_task=n).collect():
            found.setdefault(r.key, []).append((r.head, r.id))
        assert {k: {i for _, i in pairs} for k, pairs in found.items()} == of
        for pairs in found.values():  # heads lead to the least
            node, root = roots(*np.array(pairs, np.int64).T)
            assert set(root.tolist()) == {int(node[0])}
    assert crowded_bands(bands.limit(0), 0).count() == 0


def test_signatures_of_lines_are_those_of_their_shingles():
    texts = pa.array(["Abcdefgh\nabcdefghijk\n" + "long line " * 90, None, "", "é" * 40])
    lines, by = Lines(texts), multipliers(6, np.uint32)
    chosen = np.flatnonzero(lines.of_bytes(SHINGLE))
    runs = (lines.words.windows(SHINGLE) >> np.uint64(32)).astype(np.uint32)
    want = [min_max(runs[lines.starts[k] : lines.ends[k] - SHINGLE + 1], by) for k in chosen]
    for block in (5, 64, 1 << 16):
        assert np.array_equal(_signatures(lines, chosen, SHINGLE, by, block), want)
