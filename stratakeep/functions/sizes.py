"""Sizes of stored objects as column expressions, on longs throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAR_BLOCK = 512
#: Bytes that sealing a chunk adds: a 24-byte nonce and a 16-byte tag.
SEAL_OVERHEAD = 40
ENCRYPTED_HEADER_BYTES = 64


def _long(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("long")


def aligned(n: Column, alignment: int = TAR_BLOCK) -> Column:
    """n rounded up to a multiple of the alignment."""
    n = _long(n)
    rest = n % alignment
    return F.when(rest == 0, n).otherwise(n - rest + alignment)


def tar_header_size(name: Column) -> Column:
    """One block, or for names over 100 characters the long-name blocks too."""
    length = F.length(name).cast("long")
    full = length + (TAR_BLOCK - length % TAR_BLOCK) % TAR_BLOCK
    return F.when(length > 100, full + 2 * TAR_BLOCK).otherwise(F.lit(TAR_BLOCK).cast("long"))


def tar_size(aligned_size: Column, files: Column) -> Column:
    """Size of a tarball of files (array of names) whose contents take aligned_size."""
    return _long(aligned_size) + F.aggregate(files, F.lit(0).cast("long"), lambda a, f: a + tar_header_size(f))


def sealed_size(n: Column, chunk: int, overhead: int = SEAL_OVERHEAD) -> Column:
    """Size after each chunk has been encrypted."""
    n = _long(n)
    rest = n % chunk
    chunks = (n - rest) / chunk + F.when(rest > 0, 1).otherwise(0)
    return (n + chunks * overhead).cast("long")


def part_object_size(aligned_size: Column, files: Column, encrypted: Column, chunk: int, overhead: int = SEAL_OVERHEAD) -> Column:
    """Expected size of a part's tarball in storage."""
    tar = tar_size(aligned_size, files)
    return F.when(encrypted, sealed_size(tar, chunk, overhead)).otherwise(tar)


def n_chunks(n: Column, chunk: Column | int) -> Column:
    n, chunk = _long(n), _long(chunk)
    rest = n % chunk
    return ((n - rest) / chunk).cast("long") + F.when(rest > 0, 1).otherwise(0)


def upload_chunk_size(source: Column, chunk: int, most_chunks: int) -> Column:
    """The chunk size with which a source takes no more than most_chunks parts."""
    n = n_chunks(source, chunk)
    factor = n_chunks(n, most_chunks)
    return F.when((_long(source) > chunk) & (n > most_chunks), factor * chunk).otherwise(F.lit(chunk).cast("long"))


def is_multipart(n: Column, chunk: Column | int) -> Column:
    return _long(n) >= _long(chunk)


def ranges(n: Column, chunk: int) -> Column:
    """array<struct(start, end)> of half-open ranges that cover n bytes in steps of chunk; empty for none."""
    n = _long(n)
    starts = F.sequence(F.lit(0).cast("long"), n - 1, F.lit(chunk).cast("long"))
    cover = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + chunk, n).alias("end")))
    return F.when(n > 0, cover).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def transfer_seconds(n: Column, rate: int) -> Column:
    """Whole seconds of waiting when `rate` bytes are granted each second; a rate of 0 is no limit."""
    if not rate:
        return F.lit(0).cast("long")
    return F.greatest(n_chunks(n, rate) - 1, F.lit(0).cast("long"))


def backoff_bound(attempt: Column, most: float, multiplier: float = 1.0) -> Column:
    """Upper bound of the random wait before a retry: min(2^attempt * multiplier, most)."""
    return F.least(F.pow(F.lit(2.0), attempt.cast("double")) * multiplier, F.lit(float(most)))


def encrypted_header(data: Column) -> Column:
    """struct(algorithm, iv) of an encrypted file's header; null for data shorter than a header.

    The algorithm is the little-endian number in bytes 5-6, the IV is bytes 23-38 (from 0).
    """
    number = F.conv(F.concat(F.hex(F.substring(data, 7, 1)), F.hex(F.substring(data, 6, 1))), 16, 10).cast("int")
    return F.when(F.octet_length(data) >= ENCRYPTED_HEADER_BYTES, F.struct(number.alias("algorithm"), F.hex(F.substring(data, 24, 16)).alias("iv")))
