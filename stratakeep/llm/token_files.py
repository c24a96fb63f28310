"""Token-ID output in fixed-width bit packing (operator 6): the file format, and Spark's way to it.

A data set is a folder of shard files and a folder manifest, which is written last: JSON rows that
number and name the shards. A shard file holds

    the blocks: 4096 ids each (the last may be shorter), packed least bit first, padded to whole bytes
    int64[blocks + 1]: byte offsets of the blocks within the file
    int64[documents]: doc_id of each document (the least int64: null)
    int64[documents + 1]: position of each document's first id within the shard
    8 bytes magic, then 6 int64: version, bits of an id, ids of a block, ids, blocks, documents

with all integers little-endian. What describes the blocks comes last, as object stores take
files from front to back only,

so a reader gets any id range from the blocks that hold it, and unpacks them with numpy at once.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, VERSION, BLOCK_IDS = b"PACKIDS1", 1, 4096
NO_ID = -(1 << 63)
#: A row of the manifest.
SHARD = "number long, name string, ids long, documents long"
_FOOT = struct.Struct("<8s6q")
#: Documents of one shard at most, about: its index is in a task's memory as it is written.
SHARD_DOCUMENTS = 500_000


def bits_for(vocabulary: int) -> int:
    """The fewest bits that tell `vocabulary` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids (unsigned, below 2**bits, bits at most 32) at fixed width, least bit first."""
    n = len(ids)
    lanes = np.zeros((-(-n // 8), 8), np.uint64)
    lanes.ravel()[:n] = ids
    out = np.zeros((len(lanes), bits + 8), np.uint8)  # eight ids take `bits` bytes; the rest takes the last lane's tail
    for k in range(8):
        at, shift = divmod(k * bits, 8)
        part = (lanes[:, k] << np.uint64(shift)).astype("<u8").view(np.uint8).reshape(-1, 8)
        out[:, at : at + 8] |= part[:, : bits + 8 - at]
    return out[:, :bits].tobytes()[: -(-n * bits // 8)]


def unpack(packed: bytes, n: int, bits: int) -> np.ndarray:
    """The n ids (uint32) that `pack` made these bytes of."""
    groups = -(-n // 8)
    data = np.zeros(groups * bits, np.uint8)
    data[: len(packed)] = np.frombuffer(packed, np.uint8)
    wide = np.zeros((groups, bits + 8), np.uint8)
    wide[:, :bits] = data.reshape(groups, bits)
    out = np.empty((groups, 8), np.uint32)
    for k in range(8):
        at, shift = divmod(k * bits, 8)
        word = np.zeros((groups, 8), np.uint8)
        piece = wide[:, at : at + 8]
        word[:, : piece.shape[1]] = piece
        out[:, k] = (word.view("<u8")[:, 0] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.ravel()[:n]


class ShardWriter:
    """Streams documents into one shard file; memory stays at a block and the document index."""

    def __init__(self, sink, bits: int, block: int = BLOCK_IDS):
        self.sink, self.bits, self.block = sink, bits, block
        self.rest, self.waiting = [], 0
        self.doc_ids, self.starts, self.offsets, self.n = array("q"), array("q", [0]), array("q"), 0
        self.at = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"id {int(ids.max())} doesn't fit {self.bits} bits")
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)
        self.n += len(ids)
        self.starts.append(self.n)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 64 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // self.block * self.block
        for k in range(0, whole, self.block):
            data = pack(ids[k : min(k + self.block, whole)], self.bits)
            self.offsets.append(self.at)
            self.sink.write(data)
            self.at += len(data)
        self.rest, self.waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        """Write the indexes and the footer."""
        self._flush(True)
        for values in ([*self.offsets, self.at], self.doc_ids, self.starts):
            self.sink.write(np.array(values, "<i8").tobytes())
        self.sink.write(_FOOT.pack(MAGIC, VERSION, self.bits, self.block, self.n, len(self.offsets), len(self.doc_ids)))


class ShardReader:
    """Random access to one shard through an open seekable file."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - _FOOT.size)
        magic, version, self.bits, self.block, self.n, blocks, docs = _FOOT.unpack(source.read(_FOOT.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of packed ids")
        tail = 8 * (blocks + 1 + docs + docs + 1)
        source.seek(size - _FOOT.size - tail)
        index = np.frombuffer(source.read(tail), "<i8")
        self.offsets, self.doc_ids, self.starts = index[: blocks + 1], index[blocks + 1 : blocks + 1 + docs], index[blocks + 1 + docs :]

    def ids(self, start: int, end: int) -> np.ndarray:
        """ids start..end of the shard, from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        # a block's ids are a multiple of 8, so blocks follow each other without gaps
        n = min((last + 1) * self.block, self.n) - first * self.block
        return unpack(data, n, self.bits)[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


@dataclass
class Shard:
    number: int
    name: str
    ids: int
    documents: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path within it of a whole URI: local, hdfs:// or an object store."""
    return fs.FileSystem.from_uri(path)


def uri_of(spark: SparkSession, path: str) -> str:
    """A folder's whole URI as Spark resolves it: a path without a scheme is on Spark's default file system.

    The names that Hadoop has for S3 are those that Arrow has for it.
    """
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()
    scheme, rest = whole.split(":", 1)
    return f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }:{rest if rest.startswith('//') else '//' + rest}"


def _range_of(column: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are below the column; of many, only one stretch is looked at closely."""
    below = lambda values: F.size(F.filter(values, lambda b: b < column))
    array_ = lambda values: F.array(*[F.lit(b).cast("long") for b in values])
    if len(bounds) <= 64:
        return below(array_(bounds)) if bounds else F.lit(0)
    step = int(len(bounds) ** 0.5) + 1
    pieces = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    piece = F.greatest(below(array_([p[0] for p in pieces])) - 1, F.lit(0))
    return piece * step + below(F.get(F.array(*[array_(p) for p in pieces]), piece))


def _write(path: str, bits: int, dtype: str):
    """Takes (shard, doc_id, ids) sorted by these, a shard number from one task alone; gives a row a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, folder), done = _open(path), []
        now = sink = writer = None
        for batch in batches:
            for number, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if now is None or number != now.number:
                    if writer:
                        writer.close()
                        sink.close()
                    store.create_dir(folder, recursive=True)
                    now = Shard(number, f"shard-{number:06d}-{uuid.uuid4().hex}.bin", 0, 0)
                    done.append(now)
                    sink = store.open_output_stream(f"{folder}/{now.name}")
                    writer = ShardWriter(sink, bits)
                got = np.frombuffer(ids.as_buffer(), dtype) if ids.is_valid else np.zeros(0, dtype)
                writer.add(doc_id, got)
                now.ids += len(got)
                now.documents += 1
        if writer:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([s.number for s in done], pa.int64()), pa.array([s.name for s in done]), pa.array([s.ids for s in done], pa.int64()), pa.array([s.documents for s in done], pa.int64())],
                ["number", "name", "ids", "documents"],
            )

    return run


def _read(path: str, shards: list[Shard], pieces: list[int]):
    """Takes numbers of pieces, counted through all shards; gives the documents of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open(path)
        before, starts_at = np.cumsum([0, *pieces]), np.cumsum([0, *[s.ids for s in shards]])
        for number in (n for batch in batches for n in batch.column(0).to_pylist()):
            at = int(np.searchsorted(before, number, "right")) - 1
            k, to_end = (shards[at].documents * int(n - before[at]) // pieces[at] for n in (number, number + 1))
            with store.open_input_file(f"{folder}/{shards[at].name}") as source:
                shard = ShardReader(source)
                while k < to_end:
                    to = int(np.searchsorted(shard.starts, shard.starts[k] + (1 << 20), "right"))
                    to = min(max(to - 1, k + 1), to_end)
                    starts = shard.starts[k : to + 1]
                    body = shard.ids(int(starts[0]), int(starts[-1])).astype("<u4")
                    ids = pa.array([body[a - starts[0] : b - starts[0]].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())], pa.binary())
                    doc_ids = pa.array([None if d == NO_ID else d for d in shard.doc_ids[k:to].tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts[:-1] + int(starts_at[at])), ids], ["doc_id", "start", "ids"])
                    k = to

    return run


def write_tokens(tokens: DataFrame, keys: DataFrame, path: str, vocabulary: int, dtype: str = "<u4", order: str = "doc_id") -> None:
    """Write tokens (doc_id long, ids: of this type, as binary) in ascending order of the column `order` (long; nulls first), ties by ids.

    Shards are ranges of it between quantiles of keys (the same values, without the work that
    tokens take), so that tokens are computed once; a range goes to one task, which may get several.
    There are as many as keep each to about SHARD_DOCUMENTS documents. Rows of one value share a shard.
    Only the manifest, which Spark commits after all tasks succeeded, makes shards part of the data
    set, so a task that runs twice leaves an unnamed file at most.
    """
    spark = tokens.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, -(-keys.count() // SHARD_DOCUMENTS))
    row = keys.agg(F.percentile_approx(order, [k / shards for k in range(1, shards)], max(10_000, 4 * shards)).alias("q")).first()
    number = _range_of(F.col(order), sorted(set(row.q or ())))
    dealt = tokens.withColumn("shard", F.when(F.col(order).isNull(), 0).otherwise(number)).repartition("shard")
    ordered = dealt.sortWithinPartitions("shard", F.asc_nulls_first(order), "ids").select("shard", "doc_id", "ids")
    ordered.mapInArrow(_write(uri_of(spark, path), bits_for(vocabulary), dtype), SHARD).write.json(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, ids_per_task: int = 4_000_000) -> DataFrame:
    """(doc_id, start: ids before the document, ids: uint32 as binary) of all documents in a data set.

    The driver gets a row a shard; a task reads about ids_per_task ids of one shard.
    """
    shards = [Shard(*r) for r in spark.read.schema(SHARD).json(f"{path}/manifest").orderBy("number").collect()]
    pieces = [min(s.documents, s.ids // ids_per_task + 1) for s in shards]
    tasks = sum(pieces)
    return spark.range(0, tasks, 1, max(tasks, 1)).mapInArrow(_read(uri_of(spark, path), shards, pieces), "doc_id long, start long, ids binary")
