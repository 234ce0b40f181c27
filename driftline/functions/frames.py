"""Frame prefixes and chunk packets as bytes."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

#: Fixed values of the wire format.
MAGIC, PROTOCOL, CODEC, LITTLE, PREFIX = b"SPS1", 2, 1, 1, 16
#: Lengths before and after compression, flags.
PACKET, PACKET_SIZE = ">IIB", 9


def word(n: Column, digits: int = 8) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), digits, "0"))


def encoded(header: Column, payload: Column, protocol: int = PROTOCOL, codec: int = CODEC, endianness: int = LITTLE) -> Column:
    """A frame: 16-byte big-endian prefix (magic, protocol, codec, endianness, two lengths), header and payload."""
    head = MAGIC + struct.pack(">HBB", protocol, codec, endianness)
    return F.concat(F.lit(head), word(F.octet_length(header)), word(F.octet_length(payload)), header, payload)


def decoded(frame: Column, protocol: int = PROTOCOL, codec: int = CODEC, endianness: int = LITTLE) -> Column:
    """struct(error, header, payload); checks in order: prefix, magic, protocol, codec, endianness, length."""
    number = lambda at, n: F.conv(F.hex(F.substring(frame, at, n)), 16, 10).cast("long")
    size, head, body = F.octet_length(frame), number(9, 4), number(13, 4)
    error = (
        F.when(size < PREFIX, "short prefix").when(F.substring(frame, 1, 4) != F.lit(MAGIC), "magic").when(number(5, 2) != protocol, "protocol")
        .when(number(7, 1) != codec, "codec").when(number(8, 1) != endianness, "endianness").when(size != PREFIX + head + body, "length")
    )
    part = lambda at, n: F.when(error.isNull(), F.substring(frame, at, n))
    return F.struct(error.alias("error"), part(F.lit(PREFIX + 1), head.cast("int")).alias("header"), part((head + PREFIX + 1).cast("int"), body.cast("int")).alias("payload"))


PACKETS = T.StructType([T.StructField("chunk_index", T.IntegerType()), T.StructField("raw_len", T.LongType()), T.StructField("compressed", T.BooleanType()), T.StructField("data", T.BinaryType())])


@udtf(returnType=PACKETS)
class ChunkPackets:
    """Packets of a chunk batch: raw length, encoded length, flags, data. All bytes must be used, and as many packets as expected."""

    def eval(self, batch: bytes, expected: int):
        at, batch = 0, bytes(batch)
        for k in range(expected):
            if at + PACKET_SIZE > len(batch):
                raise ValueError("chunk batch ends within a packet")
            raw, n, flags = struct.unpack_from(PACKET, batch, at)
            at += PACKET_SIZE
            if at + n > len(batch):
                raise ValueError("chunk batch ends within a packet")
            yield k, raw, bool(flags & 1), batch[at : at + n]
            at += n
        if at != len(batch):
            raise ValueError("bytes after the last packet")


def packet(raw_len: Column, compressed: Column, data: Column) -> Column:
    """One packet of a chunk batch."""
    return F.concat(word(raw_len), word(F.octet_length(data)), F.when(compressed, F.lit(b"\x01")).otherwise(F.lit(b"\x00")), data)


def hello(version: Column, protocol: Column, codec: Column, endianness: Column, want: tuple[str, int, int, int]) -> Column:
    """struct(accepted, message) of a handshake: protocol, codec, endianness and version, in this order."""
    own, p, c, e = want
    message = F.when(protocol != p, "protocol mismatch").when(codec != c, "codec mismatch").when(endianness != e, "endianness mismatch").when(version != own, "version mismatch")
    return F.struct(message.isNull().alias("accepted"), F.coalesce(message, F.lit("ok")).alias("message"))
