"""Links between similar sets: banded min-max signatures propose, full sets decide.

Min-max hashing keeps of every permutation both the least and the greatest value, so that P
permutations give 2P signature values, each equal between two sets with probability J.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakeep.llm.components import components, roots
from stratakeep.llm.store import discard, materialise, observed
from stratakeep.llm.words import mix

_U = np.uint64
_BLOCK = 4096
#: Band keys that one task sorts in memory (16 bytes each with their ids, and a few times that while at work).
KEYS_A_TASK = 1_000_000


def multipliers(permutations: int, dtype=np.uint64) -> np.ndarray:
    """Odd multipliers, one for each permutation."""
    rng = np.random.default_rng(977)
    return (rng.integers(1, np.iinfo(dtype).max >> 1, permutations, dtype=dtype) * dtype(2) + dtype(1))[:, None]


def min_max(elements: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Signature of one non-empty set: the minima of all permutations, then the maxima."""
    low = high = None
    for k in range(0, len(elements), _BLOCK):
        values = elements[None, k : k + _BLOCK] * by
        a, b = values.min(axis=1), values.max(axis=1)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band of `rows` signature values (int64); the band's number is part of it.

    signature: the values of one set, or a row for each of several.
    """
    count = signature.shape[-1] // rows
    bands = signature[..., : count * rows].astype(np.uint64).reshape(*signature.shape[:-1], count, rows)
    key = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), bands.shape[:-1])
    for k in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) ^ bands[..., k])
    return key.view(np.int64)


def sorted_sets(bodies: pa.Array) -> list[np.ndarray]:
    """The sets whose sorted uint64 elements these bytes are."""
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in bodies]


def parity(s: np.ndarray) -> bytes:
    """A bitmap of four to eight bits an element; each element turns one bit over.

    Two such bitmaps of one size differ in no more bits than there are elements in one of the
    sets alone, so that many differing bits prove two sets unlike. The halves of a bitmap,
    xored, are the set's bitmap of half the size.
    """
    bits = max(64, 1 << (4 * len(s) - 1).bit_length())
    odd = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _alike(s: np.ndarray, t: np.ndarray, threshold: int) -> bool:
    if 100 * min(len(s), len(t)) < threshold * max(len(s), len(t)):
        return False
    both = np.concatenate([s, t])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= threshold * (len(s) + len(t) - shared)


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _held(threshold: int, to_sets: Callable) -> Callable:
    """Rows (head, salt, member, id, body) come sorted, each head's own row in front of its members'."""

    def run(batches):
        head = None
        for batch in batches:
            heads, member, ids = (batch.column(c).to_pylist() for c in ("head", "member", "id"))
            a, b = [], []
            for k, s in enumerate(to_sets(batch.column("body"))):
                if not member[k]:
                    head = s.copy()
                elif _alike(head, s, threshold):
                    a.append(heads[k])
                    b.append(ids[k])
            yield _pairs(a, b)

    return run


def held_against_heads(pairs: DataFrame, bodies: DataFrame, threshold: int, to_sets: Callable = sorted_sets, share: int = 2048) -> DataFrame:
    """Of the pairs (head, id) those, as (a, b), whose full sets meet 100 * |intersection| >= threshold * |union|.

    A member's set goes to its head's task, not both sets to each pair; a head of very many has
    its members dealt to tasks of about `share`, each with the head's set in front.
    """
    many = pairs.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / share).alias("salts"))
    salted = pairs.join(many, "head").select("head", F.pmod(F.xxhash64("id"), "salts").alias("salt"), F.lit(1).alias("member"), "id")
    own = salted.select("head", "salt").distinct().select("head", "salt", F.lit(0).alias("member"), F.col("head").alias("id"))
    full = salted.unionByName(own).join(bodies.select("id", "body"), "id").select("head", "salt", "member", "id", "body")
    return full.repartition("head", "salt").sortWithinPartitions("head", "salt", "member").mapInArrow(_held(threshold, to_sets), "a long, b long")


def _with_parity(to_sets: Callable) -> Callable:
    def run(batches):
        for batch in batches:
            sets = to_sets(batch.column(1))
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], n, pa.array([parity(s) for s in sets], pa.binary())], ["id", "body", "n", "parity"])

    return run


def _in_groups(work: Callable[[pa.Table, list[tuple[int, int]]], pa.RecordBatch]) -> Callable:
    """Groups come sorted by (key, i, j), many to a batch; one that a batch cuts off waits for the next."""

    def groups(rows: pa.Table) -> pa.RecordBatch:
        edges = [0, *_starts(rows).tolist(), rows.num_rows]
        return work(rows, [(a, b) for a, b in zip(edges[:-1], edges[1:]) if b - a > 1])

    def run(batches):
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            starts = _starts(rows)
            cut = int(starts[-1]) if len(starts) else 0
            if cut:
                yield groups(rows.slice(0, cut))
            rest = rows.slice(cut)
        if rest is not None and rest.num_rows:
            yield groups(rest)

    return run


def _starts(rows: pa.Table) -> np.ndarray:
    """Where a new group begins, but for the first."""
    key, i, j = (rows.column(c).to_numpy() for c in ("key", "i", "j"))
    return np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1


def _each_unlike(bitmaps: list[bytes]):
    """For each member k: the members from k on whose bitmaps compare with its own, and in how many bits they differ."""
    width = np.array([len(x) for x in bitmaps])
    for w in np.unique(width):
        same, twice = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        own = np.frombuffer(b"".join(bitmaps[k] for k in same), np.uint8).reshape(len(same), w)
        rows = np.frombuffer(b"".join(bitmaps[k] for k in twice), np.uint8).reshape(len(twice), 2, w)
        rows = np.concatenate([own, rows[:, 0] ^ rows[:, 1]]).view(np.uint64)
        at = np.concatenate([same, twice])
        for k in range(len(same)):
            yield same[k], at[k + 1 :], np.bitwise_count(rows[k + 1 :] ^ rows[k]).sum(axis=1, dtype=np.int64)


def _pairs_inside(groups: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places inside of each group, for groups of few members."""
    starts, sizes = np.array([a for a, _ in groups]), np.array([b - a for a, b in groups])
    low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(sizes):
        i, j = np.triu_indices(size, 1)
        low.append((starts[sizes == size, None] + i).ravel())
        high.append((starts[sizes == size, None] + j).ravel())
    return np.concatenate(low), np.concatenate(high)


def _differ(i: np.ndarray, j: np.ndarray, width: np.ndarray, bitmaps: list[bytes]) -> np.ndarray:
    """In how many bits the bitmaps of each pair differ; one is at most twice as wide as the other."""
    out, least = np.zeros(len(i), np.int64), np.minimum(width[i], width[j])
    for w in np.unique(least):
        same, twice = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        wide = np.frombuffer(b"".join(bitmaps[k] for k in twice), np.uint8).reshape(len(twice), 2, w)
        rows = np.frombuffer(b"".join(bitmaps[k] for k in same), np.uint8).reshape(len(same), w)
        rows = np.concatenate([rows, wide[:, 0] ^ wide[:, 1]]).view(np.uint64)
        place = np.zeros(len(width), np.int64)
        place[same], place[twice] = np.arange(len(same)), len(same) + np.arange(len(twice))
        at = np.flatnonzero(least == w)
        for k in range(0, len(at), step := max(1, (1 << 22) // int(w))):
            part = at[k : k + step]
            out[part] = np.bitwise_count(rows[place[i[part]]] ^ rows[place[j[part]]]).sum(axis=1, dtype=np.int64)
    return out


def _near_sizes(n: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= threshold * np.maximum(n, m)


def _families(threshold: int, few: int = 48) -> Callable:
    """A forest (a, b) that joins the members of a group in different components that bitmaps don't prove unlike."""

    def work(rows: pa.Table, groups: list[tuple[int, int]]) -> pa.RecordBatch:
        ids, component, block, n = (rows.column(c).to_numpy() for c in ("id", "component", "block", "n"))
        two_blocks = rows.column("i").to_numpy() != rows.column("j").to_numpy()  # pairs inside of either are another group's
        bitmaps, a_, b_ = rows.column("parity").to_pylist(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        i, j = _pairs_inside([(a, b) for a, b in groups if b - a <= few])
        ok = (component[i] != component[j]) & ~(two_blocks[i] & (block[i] == block[j])) & _near_sizes(n[i], n[j], threshold)
        i, j = i[ok], j[ok]
        ok = _differ(i, j, np.array([len(x) for x in bitmaps], np.int64), bitmaps) * (100 + threshold) <= (n[i] + n[j]) * (100 - threshold)
        a_.append(ids[i[ok]])
        b_.append(ids[j[ok]])
        for a, b in groups:
            if b - a <= few:
                continue
            across, family, own, dealt_to, size = two_blocks[a], np.arange(b - a), component[a:b], block[a:b], n[a:b]
            for k, others, differ in _each_unlike(bitmaps[a:b]):
                ok = (own[others] != own[k]) & (differ * (100 + threshold) <= (size[others] + size[k]) * (100 - threshold)) & _near_sizes(size[others], size[k], threshold)
                if across:
                    ok &= dealt_to[others] != dealt_to[k]
                met = np.unique(family[np.r_[others[ok], k]])
                if len(met) > 1:
                    family[np.isin(family, met)] = met[0]
            a_.append(ids[a:b])
            b_.append(ids[a:b][family])
        node, root = roots(np.concatenate(a_), np.concatenate(b_))
        return _pairs(root[node != root], node[node != root])

    return work


def _group_links(component: np.ndarray, block: np.ndarray, sets: list[np.ndarray], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the links across components between one group's members (with two blocks, across these too)."""
    sizes = np.array([len(s) for s in sets])
    apart = component[:, None] != component[None, :]
    if block.min() != block.max():  # pairs inside of either block are another group's
        apart &= block[:, None] != block[None, :]
    apart = np.triu(apart)
    if len(sets) <= 12:
        found = [(i, j) for i, j in zip(*np.nonzero(apart)) if _alike(sets[i], sets[j], threshold)]
        return np.array([i for i, _ in found], np.int64), np.array([j for _, j in found], np.int64)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    often = counts[column] > 1  # what only one member has, no two share
    owner, column = owner[often], np.unique(column[often], return_inverse=True)[1]
    width, total = max(1, (8 << 20) // len(sets)), int(column.max()) + 1 if len(column) else 0
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, total, width):
        here = (column >= low) & (column < low + width)
        has = np.zeros((len(sets), min(width, total - low)), np.float32)
        has[owner[here], column[here] - low] = 1
        shared += has @ has.T
    return np.nonzero(apart & (100 * shared >= threshold * (sizes[:, None] + sizes[None, :] - shared)))


def _linker(threshold: int, to_sets: Callable) -> Callable:
    def work(rows: pa.Table, groups: list[tuple[int, int]]) -> pa.RecordBatch:
        component, block = (rows.column(c).to_numpy() for c in ("component", "block"))
        sets = [s for chunk in rows.column("body").chunks for s in to_sets(chunk)]
        low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in groups:
            i, j = _group_links(component[a:b], block[a:b], sets[a:b], threshold)
            low.append(component[a:b][i])
            high.append(component[a:b][j])
        node, root = roots(np.concatenate(low), np.concatenate(high))
        return _pairs(root[node != root], node[node != root])

    return work


def dealt(open_: DataFrame, block: int = 2048) -> DataFrame:
    """Members (key, id, component) of each key in groups (key, i, j, id, component, block), for comparing across components.

    A key's members are dealt into blocks of about `block`, those of its largest component into
    blocks of their own, and two blocks are one group: any two of the others', or one of the
    others' and one of the largest's. So no group grows with the key, and where all but a few
    members are of one component, rows don't grow with the square of its size.
    """
    sizes = open_.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.groupBy("key").agg(F.sum("size").alias("members"), F.max(F.struct("size", "component")).alias("bulk"))
    of = F.ceil((F.col("members") - F.col("bulk.size")) / block)
    sizes = sizes.where(F.col("members") > F.col("bulk.size")).select("key", F.col("bulk.component").alias("largest"), of.alias("rest"), F.ceil(F.col("bulk.size") / block).alias("bulk"))
    is_bulk = F.col("component") == F.col("largest")
    mine = F.when(is_bulk, F.col("rest") + F.pmod(F.xxhash64("id", "key"), "bulk")).otherwise(F.pmod(F.xxhash64("id", "key"), "rest"))
    last = F.when(is_bulk, F.col("rest")).otherwise(F.col("rest") + F.col("bulk")) - 1
    rows = open_.join(sizes, "key").select("key", "id", "component", mine.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    return rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "component", "block")


def _grouped(rows: DataFrame, bodies: DataFrame, work: Callable, *columns: str) -> DataFrame:
    full = rows.join(bodies.select("id", *columns), "id").select("key", "i", "j", "id", "component", "block", *columns)
    return full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_in_groups(work), "a long, b long")


def families(open_: DataFrame, bodies: DataFrame, threshold: int) -> DataFrame:
    """(key, id, component): members of all bands regrouped, so that each is in one group alone.

    A family is what pairs connect that share a band, are in different components, and that
    neither their sizes nor their bitmaps prove unlike; every pair that may be linked is inside
    of one. Members of no family are left out.
    """
    forest = _grouped(dealt(open_), bodies, _families(threshold), "n", "parity")
    own = components(forest).select("id", F.col("component").alias("key"))
    return own.join(open_.select("id", "component").distinct(), "id").select("key", "id", "component")


def across_components(rows: DataFrame, bodies: DataFrame, threshold: int, to_sets: Callable = sorted_sets) -> DataFrame:
    """A forest (a, b) of the components that links join, of members of one group of `dealt`.

    The sets are compared inside the group, and of the components joined there only a forest comes out.
    """
    return _grouped(rows, bodies, _linker(threshold, to_sets), "body")


def _one_to_a_key(parts: int, gather: int) -> Callable:
    """Of (id, bands), some `gather` keys at a time, rows (part, pairs, members) of packed int64.

    Ids that share a key here are members (id, key, head) with the least of them as head, dealt
    out evenly. A key goes on to its part once, as a pair (key, id) with that head or its only id.
    """

    def dealt_out(ids: np.ndarray, lists: pa.Array) -> pa.RecordBatch:
        ids, first = np.unique(ids, return_index=True)
        lists = lists.take(pa.array(first))
        keys = lists.flatten().to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, ids = keys[order], np.repeat(ids, pc.list_value_length(lists).to_numpy())[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        many = np.diff(np.r_[starts, len(keys)])
        heads = np.minimum.reduceat(ids, starts)
        shared = np.repeat(many > 1, many)
        members = np.stack([ids[shared], keys.view(np.int64)[shared], np.repeat(heads, many)[shared]], axis=1)
        keys = keys[starts]
        pairs = np.stack([keys.view(np.int64), heads], axis=1)
        part = (keys >> _U(32)) * _U(parts) >> _U(32)  # keys are hashes, and ascend
        cuts, even = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64)), np.arange(parts + 1) * len(members) // parts
        columns = [pa.array(np.arange(parts, dtype=np.int32)), _packed(pairs, cuts), _packed(members, even)]
        return pa.RecordBatch.from_arrays(columns, ["part", "pairs", "members"]).filter(pa.array((np.diff(cuts) > 0) | (np.diff(even) > 0)))

    def run(batches):
        waiting, n = [], 0
        for batch in batches:
            batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch.column(1)), 0), 0))
            waiting.append(batch)
            n += len(batch.column(1).flatten())
            if n >= gather:
                yield dealt_out(*_columns(waiting))
                waiting, n = [], 0
        if n:
            yield dealt_out(*_columns(waiting))

    return run


def _columns(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.Array]:
    rows = pa.Table.from_batches(batches)
    return rows.column(0).to_numpy(), rows.column(1).combine_chunks()


def _packed(rows: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The rows from each cut to the next, as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * rows.strides[0]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x.as_buffer(), np.int64) for x in column if len(x.as_buffer())]]).reshape(-1, width)


def _members(ids: np.ndarray, keys: np.ndarray, heads: np.ndarray):
    for k in range(0, len(ids), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in (ids, keys, heads)], ["id", "key", "head"])


def _met(batches):
    """Members as they come, and those of the keys that more than one pair (key, id) of the task has."""
    kept = []
    for batch in batches:
        yield from _members(*_unpacked(batch.column("members"), 3).T)
        kept.append(_unpacked(batch.column("pairs"), 2))
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *kept])
    kept.clear()
    if not len(pairs):  # the task may have got members alone
        return
    pairs = pairs[np.argsort(pairs[:, 0])]
    same = pairs[1:, 0] == pairs[:-1, 0]
    pairs = np.unique(pairs[np.r_[False, same] | np.r_[same, False]], axis=0)
    if len(pairs):
        starts = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]])
        many = np.diff(np.r_[starts, len(pairs)])
        shared = np.repeat(many > 1, many)
        yield from _members(pairs[shared, 1], pairs[shared, 0], np.repeat(pairs[starts, 1], many)[shared])


def crowded_bands(bands: DataFrame, n_keys: int, keys_a_task: int = KEYS_A_TASK) -> DataFrame:
    """(id, key, head) of the band keys that different items share; bands: (id long, bands array<long>) with n_keys keys in all.

    A task's keys are sorted in memory, `keys_a_task` at a time. Each goes to its part once for
    that many, so that a key that very many items share comes to no task with all of them; a head
    is the least of the items met together, and heads of one key are members of their least. So an
    item may come twice, with two heads. Parts grow in number with the keys.
    """
    parts = max(1, math.ceil(n_keys / keys_a_task))
    dealt_out = bands.mapInArrow(_one_to_a_key(parts, keys_a_task), "part int, pairs binary, members binary")
    return materialise(dealt_out.repartitionById(parts, "part").mapInArrow(_met, "id long, key long, head long"), "bands")


def linked(bands: DataFrame, n_keys: int, bodies_of: Callable[[DataFrame, int], DataFrame], threshold: int = 80, to_sets: Callable = sorted_sets) -> DataFrame:
    """(id, component) of every item that has a link; component is the least id reachable.

    bands: (id long, bands array<long>), an item's band keys, n_keys in all; repeated rows do no harm. bodies_of gets a
    frame of ids and their number and gives (id, body binary), one row for each, of an array of which
    to_sets makes the items' sorted sets.

    Sets that share a band are candidates. First the members of a band are held against a
    head, the least of those met together, so that a group of near copies has few heads over all its bands. Where the links found leave a band's members in more than one component,
    its members are compared across components: bitmaps, which can only tell apart what isn't
    linked, sort them into families, in which the full sets decide. No candidate pair that could
    join two components is left out, and no pairs but those with a head become rows.
    """
    members = crowded_bands(bands, n_keys)
    ids, about = observed(members.select("id").distinct(), "ids")
    bodies = materialise(bodies_of(ids, about["n"]).mapInArrow(_with_parity(to_sets), "id long, body binary, n long, parity binary"), "bodies")
    pairs = materialise(members.where(F.col("id") != F.col("head")).select("head", "id").distinct(), "pairs")
    first = materialise(components(held_against_heads(pairs, bodies, threshold, to_sets)), "first")

    placed = members.join(first, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    open_ = materialise(placed.join(mixed, "key").distinct(), "open")
    near = materialise(families(open_, bodies, threshold), "families")
    second = materialise(components(across_components(dealt(near), bodies, threshold, to_sets)), "second")
    discard(members, ids, bodies, pairs, open_, near)
    own = first.unionByName(second.select("id", F.col("id").alias("component"))).distinct()
    return own.join(second.select(F.col("id").alias("component"), F.col("component").alias("whole")), "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
