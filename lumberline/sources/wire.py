"""Bytes: protobuf fields, Snappy blocks, gzip and zlib bodies, and the framing of messages in byte streams."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

BODY_BYTES = 32 << 20


class Malformed(ValueError):
    pass


def varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(buf) or shift >= 64:
            raise Malformed("malformed protobuf")
        byte = buf[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7


def messages(buf: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field, wire type, value) of each field; fixed-width values as integers."""
    at = 0
    while at < len(buf):
        key, at = varint(buf, at)
        wire = key & 7
        if wire == 0:
            value, at = varint(buf, at)
        elif wire == 2:
            size, at = varint(buf, at)
            if at + size > len(buf):
                raise Malformed("malformed protobuf")
            value, at = buf[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            if at + size > len(buf):
                raise Malformed("malformed protobuf")
            value, at = int.from_bytes(buf[at : at + size], "little"), at + size
        else:
            raise Malformed("malformed protobuf")
        yield key >> 3, wire, value


def signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def double(n: int) -> float:
    return struct.unpack("<d", struct.pack("<Q", n))[0]


def text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def unsnapped(buf: bytes, most: int = BODY_BYTES) -> bytes:
    """A raw Snappy block: literals and copies, which may overlap what they write."""
    try:
        size, at = varint(buf, 0)
    except Malformed:
        raise Malformed("truncated snappy block") from None
    if size > most:
        raise Malformed("snappy block too large")
    out = bytearray()
    while at < len(buf):
        tag = buf[at]
        at += 1
        kind, length = tag & 3, (tag >> 2) + 1
        if kind == 0:
            if length > 60:
                wide = length - 60
                length, at = int.from_bytes(buf[at : at + wide], "little") + 1, at + wide
            if at + length > len(buf):
                raise Malformed("truncated snappy block")
            out += buf[at : at + length]
            at += length
        else:
            wide = (1, 2, 4)[kind - 1]
            if at + wide > len(buf):
                raise Malformed("truncated snappy block")
            back = int.from_bytes(buf[at : at + wide], "little")
            if kind == 1:
                length, back = 4 + (tag >> 2 & 7), back | tag >> 5 << 8
            at += wide
            if not 0 < back <= len(out):
                raise Malformed("corrupt snappy block")
            piece = bytes(out[-back:])[:length]
            out += (piece * (length // len(piece) + 1))[:length]
        if len(out) > size:
            raise Malformed("corrupt snappy block")
    if len(out) != size:
        raise Malformed("corrupt snappy block")
    return bytes(out)


def inflated(data: bytes, most: int = BODY_BYTES) -> bytes:
    """gzip (all members) or zlib data, most bytes of it; anything else as it is."""
    gzip = data[:2] == b"\x1f\x8b"
    if not gzip and not (len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0):
        return data
    out = b""
    try:
        while data:
            z = zlib.decompressobj(31 if gzip else 15)
            out += z.decompress(data, most - len(out) + 1)
            if len(out) > most:
                raise Malformed("compressed body too large")
            if not z.eof:
                raise Malformed("truncated compressed body")
            data = z.unused_data if gzip and z.unused_data[:2] == b"\x1f\x8b" else b""
    except zlib.error:
        raise Malformed("invalid compressed body") from None
    return out


_COUNT = re.compile(rb"(\d{1,7}) (?=<)")


def syslog_frames(data: bytes, most: int = 65_536, last: bool = True) -> tuple[list[str], bytes]:
    """Messages counted in octets or ended by newlines, told apart message by message; and what is not whole yet."""
    out, at = [], 0
    while True:
        while at < len(data) and data[at] in b"\r\n":
            at += 1
        if at >= len(data):
            break
        if m := _COUNT.match(data, at):
            size = int(m[1])
            if not 0 < size <= most:
                raise Malformed("frame too long")
            if m.end() + size > len(data):
                break
            out.append(text(data[m.end() : m.end() + size]))
            at = m.end() + size
            continue
        if not last and re.fullmatch(rb"\d{1,7} ?", data[at:]):
            break
        end = data.find(b"\n", at)
        if (end if end >= 0 else len(data)) - at > most:
            raise Malformed("frame too long")
        if end < 0:
            break
        if line := text(data[at:end]).rstrip("\r"):
            out.append(line)
        at = end + 1
    rest = data[at:]
    if last and rest:
        tail = text(rest).rstrip("\r\n")
        return out + [tail] * bool(tail), b""
    return out, rest


def gelf_frames(data: bytes) -> list[bytes]:
    """Messages ended by NUL or newline."""
    return [x for x in re.split(rb"[\x00\n]", data) if x.strip()]


def grpc_messages(data: bytes, most: int = BODY_BYTES) -> list[bytes]:
    """Messages of a gRPC body: a byte that tells if the message is compressed, its length in four bytes, the message."""
    out, at = [], 0
    while at < len(data):
        if at + 5 > len(data):
            raise Malformed("truncated gRPC message")
        packed, size = struct.unpack_from(">BI", data, at)
        message = data[at + 5 : at + 5 + size]
        if packed > 1 or size > most or len(message) < size:
            raise Malformed("malformed gRPC message")
        out.append(inflated(message, most) if packed else message)
        at += 5 + size
    return out
