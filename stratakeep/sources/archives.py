"""Tar and gzip of file contents, by Arrow batches in tasks; tar files hold no end-of-archive blocks."""

from __future__ import annotations

import gzip
import io
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _tar(table: pa.Table) -> pa.Table:
    out = io.BytesIO()
    rows = sorted(zip(table.column("name").to_pylist(), table.column("content").to_pylist()))
    for name, content in rows:
        info = tarfile.TarInfo(name)
        info.size = len(content or b"")
        out.write(info.tobuf(tarfile.GNU_FORMAT, "utf-8", "surrogateescape"))
        out.write(content or b"")
        out.write(bytes(-info.size % tarfile.BLOCKSIZE))
    return pa.table({"archive": table.column("archive")[:1], "content": pa.array([out.getvalue()], pa.binary())})


def tarballs(files: DataFrame) -> DataFrame:
    """(archive, content): one tarball of the files (archive, name, content) of each archive, in order of name.

    An archive is a data part, whose size the planner bounds; it is made in one task.
    """
    return files.select("archive", "name", "content").groupBy("archive").applyInArrow(_tar, f"archive {files.schema['archive'].dataType.simpleString()}, content binary")


def _members(batches):
    for batch in batches:
        archives, names, contents = [], [], []
        for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            with tarfile.open(fileobj=io.BytesIO((content or b"") + bytes(2 * tarfile.BLOCKSIZE)), mode="r:") as tar:
                for member in tar:
                    if member.isfile():
                        archives.append(archive)
                        names.append(member.name)
                        contents.append(tar.extractfile(member).read())
        yield pa.RecordBatch.from_arrays([pa.array(archives, batch.schema.field(0).type), pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["archive", "name", "content"])


def members(archives: DataFrame) -> DataFrame:
    """(archive, name, content) of the files in tarballs (archive, content), empty files too."""
    kind = archives.schema["archive"].dataType.simpleString()
    return archives.select("archive", "content").mapInArrow(_members, f"archive {kind}, name string, content binary")


def _each(f):
    def run(batches):
        for batch in batches:
            done = [None if x is None else f(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.binary())], batch.schema.names)

    return run


def gzipped(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, content) with each content as a gzip stream."""
    kind = files.schema[key].dataType.simpleString()
    return files.select(key, F.col(content).alias("content")).mapInArrow(_each(lambda x: gzip.compress(x, mtime=0)), f"`{key}` {kind}, content binary")


def gunzipped(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    kind = files.schema[key].dataType.simpleString()
    return files.select(key, F.col(content).alias("content")).mapInArrow(_each(gzip.decompress), f"`{key}` {kind}, content binary")
