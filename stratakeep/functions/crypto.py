"""Encryption as column expressions: AES-CTR (for existing data), and AES-GCM for new data, as one value or in numbered chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that AES-GCM adds to a chunk: a 12-byte nonce and a 16-byte tag.
GCM_OVERHEAD = 28
_WORD = 2**64


def _word(hex16: Column) -> Column:
    return F.conv(hex16, 16, 10).cast("decimal(20,0)")


def _hex16(n: Column) -> Column:
    return F.lpad(F.conv(n.cast("string"), 10, 16), 16, "0")


def aes_ctr(data: Column, key: Column, iv: Column) -> Column:
    """AES in counter mode; encrypts and decrypts. key: 16, 24 or 32 bytes, iv: 16 bytes.

    Spark has no counter mode, but it has the block cipher: the key stream is the encryption of
    the counter values, of which ECB's padding block is cut off.
    """
    high, low = _word(F.hex(F.substring(iv, 1, 8))), _word(F.hex(F.substring(iv, 9, 8)))
    word = F.lit(str(_WORD)).cast("decimal(21,0)")

    def block(i: Column) -> Column:
        total = low + i.cast("decimal(20,0)")
        over = total >= word
        counter = F.concat(_hex16(F.pmod(high + F.when(over, 1).otherwise(0), word).cast("decimal(20,0)")), _hex16(F.when(over, total - word).otherwise(total).cast("decimal(20,0)")))
        stream = F.hex(F.substring(F.aes_encrypt(F.unhex(counter), key, F.lit("ECB"), F.lit("PKCS")), 1, 16))
        text = F.hex(F.substring(data, (i * 16 + 1).cast("int"), F.lit(16)))
        pieces = F.sequence(F.lit(0), F.ceil(F.length(text) / 8).cast("int") - 1)
        return F.array_join(F.transform(pieces, lambda k: _xor(text, stream, k)), "")

    blocks = F.sequence(F.lit(0).cast("long"), F.ceil(F.octet_length(data) / 16) - 1)
    return F.when(F.octet_length(data) == 0, data).otherwise(F.unhex(F.array_join(F.transform(blocks, block), "")))


def _xor(text: Column, stream: Column, k: Column) -> Column:
    """Four bytes of text and stream, in hex, by exclusive or; the last may be fewer."""
    a = F.substring(text, k * 8 + 1, F.lit(8))
    b = F.substring(stream, k * 8 + 1, F.length(a))
    mixed = F.conv(a, 16, 10).cast("long").bitwiseXOR(F.conv(b, 16, 10).cast("long"))
    return F.right(F.concat(F.lit("00000000"), F.hex(mixed)), F.length(a))


def seal(data: Column, key: Column) -> Column:
    """AES-GCM under a fresh nonce; 28 bytes longer than data."""
    return F.aes_encrypt(data, key, F.lit("GCM"))


def unseal(data: Column, key: Column) -> Column:
    return F.aes_decrypt(data, key, F.lit("GCM"))


#: Fixed value: what data that is sealed in chunks begins with.
MAGIC = b"SKCHUNK1"
CHUNK = 8 << 20


def _label(number: Column, last: Column, context: Column) -> Column:
    """What a chunk is bound to: its number, whether it is the last, and what it is a chunk of."""
    return F.concat_ws(":", number.cast("string"), F.when(last, "last").otherwise("more"), context)


def seal_chunk(data: Column, key: Column, number: Column, last: Column, context: Column) -> Column:
    """One chunk, 28 bytes longer. Under another number, another context, or as an end where it was none, it can't be opened."""
    return F.aes_encrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), _label(number, last, context).cast("binary"))


def open_chunk(sealed: Column, key: Column, number: Column, last: Column, context: Column) -> Column:
    """A chunk's data; null if it was changed, moved, or isn't what it is taken for."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), _label(number, last, context).cast("binary"))


def _joined(pieces: Column) -> Column:
    """The binaries of an array in one; null if one is null."""
    return F.when(F.exists(pieces, lambda p: p.isNull()), F.lit(None).cast("binary")).otherwise(F.unhex(F.array_join(F.transform(pieces, F.hex), "")))


def seal_chunks(data: Column, key: Column, chunk: int = CHUNK, context: Column | None = None) -> Column:
    """data as MAGIC and its sealed chunks of `chunk` bytes, the last of what is left (of no bytes for empty data).

    context is what the data belongs to, such as its path: elsewhere it can't be opened. Null stays null.
    """
    context = F.lit("") if context is None else context
    count = F.greatest(F.ceil(F.octet_length(data) / chunk), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda k: seal_chunk(F.substring(data, k * chunk + 1, F.lit(chunk)), key, k, k == count - 1, context))
    return F.when(data.isNotNull(), F.concat(F.lit(MAGIC), _joined(pieces)))


def is_sealed(data: Column) -> Column:
    return F.coalesce(F.substring(data, F.lit(1), F.lit(len(MAGIC))) == F.lit(MAGIC), F.lit(False))


def open_range(sealed: Column, key: Column, start: Column | int = 0, end: Column | int | None = None, chunk: int = CHUNK, context: Column | None = None) -> Column:
    """Bytes from start up to end (by default all) of data that seal_chunks sealed; only the chunks that hold them are opened.

    Null if one of these can't be opened; for a whole reading, also if chunks are missing or too many.
    """
    context = F.lit("") if context is None else context
    start = (F.lit(start) if isinstance(start, int) else start).cast("long")
    body = F.octet_length(sealed) - len(MAGIC)
    count = F.ceil(body / (chunk + GCM_OVERHEAD)).cast("int")
    size = body - count * GCM_OVERHEAD
    end = size.cast("long") if end is None else F.least((F.lit(end) if isinstance(end, int) else end).cast("long"), size.cast("long"))
    whole = (start <= 0) & (end >= size)
    first = F.when(whole, 0).otherwise(F.floor(start / chunk)).cast("int")
    last = F.when(whole, count - 1).otherwise(F.floor((end - 1) / chunk)).cast("int")
    at = lambda k: F.substring(sealed, F.lit(len(MAGIC) + 1) + k * (chunk + GCM_OVERHEAD), F.lit(chunk + GCM_OVERHEAD))
    pieces = F.transform(F.sequence(first, last), lambda k: open_chunk(at(k), key, k, k == count - 1, context))
    cut = F.substring(_joined(pieces), (start - first * chunk + 1).cast("int"), (end - start).cast("int"))
    usable = is_sealed(sealed) & (body >= GCM_OVERHEAD) & (size >= 0)
    return F.when(usable & (whole | (start < end)), cut).when(usable & (start >= end), F.lit(b""))


def open_or_plain(data: Column, key: Column, chunk: int = CHUNK, context: Column | None = None) -> Column:
    """Data that may be sealed: opened if it is, as it is if it isn't. Sealed data that can't be opened is an error, not plain text."""
    opened = open_range(data, key, chunk=chunk, context=context)
    return F.when(is_sealed(data), F.coalesce(opened, F.raise_error(F.lit("sealed data can't be opened")).cast("binary"))).otherwise(data)
