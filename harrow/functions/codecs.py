"""Integer and string codecs of the inverted index: size formulas as Columns, byte-exact forms in plain Python.

Parquet does the actual compression of the tables; the byte forms serve exports and round-trip checks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def varint_size(value: Column) -> Column:
    """Bytes of a positive integer in groups of seven bits; null for null and for values below 1."""
    bits = F.length(F.bin(value))
    return F.when(value >= 1, F.ceil(bits / 7).cast("int"))


def byte_length(value: Column) -> Column:
    """Whole bytes of a positive integer; null for null and for values below 1."""
    return F.when(value >= 1, F.ceil(F.length(F.bin(value)) / 8).cast("int"))


def group_varint_total(numbers: Column, byte_sum: Column) -> Column:
    """Bytes of `numbers` integers with `byte_sum` bytes in groups of four: a length byte each, padding zeros a byte."""
    groups = F.ceil(numbers / 4)
    return (groups + byte_sum + groups * 4 - numbers).cast("long")


def varint_encode(value: int) -> bytes:
    """Low seven bits first; the high bit marks the last byte. Positive integers only."""
    if value < 1:
        raise ValueError("varint holds positive integers")
    out = bytearray()
    while value > 127:
        out.append(value & 127)
        value >>= 7
    out.append(value | 128)
    return bytes(out)


def varint_decode(data: bytes) -> Iterator[int]:
    """All integers of a byte string."""
    value = shift = 0
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if byte & 128:
            yield value
            value = shift = 0


def group_varint_encode(values: Iterable[int]) -> bytes:
    """Groups of four: a byte with four two-bit lengths (first number highest), then the big-endian numbers.

    The last group is filled with zeros of one byte each. Integers from 1 to 2**32 - 1 only.
    """
    numbers = list(values)
    if any(not 0 < n < 1 << 32 for n in numbers):
        raise ValueError("group varint holds integers from 1 to 2**32 - 1")
    numbers += [0] * (-len(numbers) % 4)
    out = bytearray()
    for at in range(0, len(numbers), 4):
        parts = [n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big") for n in numbers[at : at + 4]]
        out.append(sum((len(p) - 1) << shift for p, shift in zip(parts, (6, 4, 2, 0), strict=True)))
        out += b"".join(parts)
    return bytes(out)


def group_varint_decode(data: bytes) -> Iterator[int]:
    """Inverse of group_varint_encode(); padding is left out."""
    at = 0
    while at < len(data):
        lengths, at = data[at], at + 1
        for shift in (6, 4, 2, 0):
            size = (lengths >> shift & 3) + 1
            if value := int.from_bytes(data[at : at + size], "big"):
                yield value
            at += size


def group_varint_encode_rows(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """group_varint_encode() of many rows at once: counts[i] of the numbers belong to row i. Gives all bytes, as uint8, and
    the number of bytes of each row.
    """
    if len(numbers) and not (numbers.min() > 0 and numbers.max() < 1 << 32):
        raise ValueError("group varint holds integers from 1 to 2**32 - 1")
    quads = -(-counts // 4)
    padded = np.zeros(4 * int(quads.sum()), np.int64)
    shift = 4 * (np.cumsum(quads) - quads) - (np.cumsum(counts) - counts)
    padded[np.arange(len(numbers)) + np.repeat(shift, counts)] = numbers
    padded = padded.reshape(-1, 4)
    size = 1 + (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    cells = np.zeros((len(padded), 17), np.uint8)
    cells[:, 0] = ((size - 1) << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1)
    cells[:, 1:] = padded.astype(">u4").view(np.uint8).reshape(-1, 16)
    kept = np.ones((len(padded), 17), bool)
    kept[:, 1:] = (np.arange(4) >= 4 - size[:, :, None]).reshape(-1, 16)
    upto = np.append(0, np.cumsum(1 + size.sum(axis=1, dtype=np.int64)))
    ends = np.cumsum(quads)
    return cells[kept], upto[ends] - upto[ends - quads]


#: For each length byte, the lengths of the four numbers and the bytes of the whole group.
_SIZES = (np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3) + 1
_GROUP = (_SIZES.sum(axis=1) + 1).tolist()


def group_varint_decode_rows(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of group_varint_encode_rows(): all numbers, and how many each row has; sizes: the bytes of each row."""
    heads, at, end = [], 0, len(data)
    while at < end:
        heads.append(at)
        at += _GROUP[data[at]]
    heads, raw = np.array(heads, np.int64), np.append(np.frombuffer(data, np.uint8), np.zeros(4, np.uint8))
    length = _SIZES[raw[heads]]
    starts = heads[:, None] + 1 + np.cumsum(length, axis=1) - length
    values = np.zeros(length.shape, np.int64)
    for i in range(4):
        values = np.where(length > i, values << 8 | raw[starts + i], values)
    whole = values > 0
    row = np.searchsorted(np.cumsum(sizes), heads, side="right")
    return values[whole], np.bincount(row, whole.sum(axis=1), len(sizes)).astype(np.int64)


def front_encode(terms: Iterable[str], block: int = 4) -> tuple[str, list[tuple[int, int, int]]]:
    """The joined suffixes and, for each term, (suffix position, prefix length, suffix length).

    The first of every `block` terms is stored whole; the others drop what they share with the term before.
    """
    out, marks, position, before = [], [], 0, ""
    for i, term in enumerate(terms):
        keep = 0
        if i % block:
            while keep < min(len(term), len(before)) and term[keep] == before[keep]:
                keep += 1
        out.append(term[keep:])
        marks.append((position, keep, len(term) - keep))
        position += len(term) - keep
        before = term
    return "".join(out), marks


def front_decode(joined: str, marks: Iterable[tuple[int, int, int]]) -> Iterator[str]:
    """Inverse of front_encode()."""
    before = ""
    for position, keep, size in marks:
        before = before[:keep] + joined[position : position + size]
        yield before
