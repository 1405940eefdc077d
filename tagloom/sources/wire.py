"""Protocol buffer wire format: fields of a message, and packed numbers decoded with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def varint(data: bytes, at: int) -> tuple[int, int]:
    """The number at this place and the place behind it."""
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("a number of more than ten bytes")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) in order: an int for numbers, bytes for all that has a length."""
    at, end = 0, len(data)
    while at < end:
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
            yield key >> 3, value
        elif kind == 2:
            size, at = varint(data, at)
            if at + size > end:
                raise ValueError("a message ends within a field")
            yield key >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, int.from_bytes(data[at : at + size], "little")
            at += size
        else:
            raise ValueError(f"wire type {kind} isn't known")


def signed(value: int) -> int:
    """int32 and int64 fields as they are meant."""
    return value - (1 << 64) if value >= 1 << 63 else value


def zigzag(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def packed(data: bytes) -> np.ndarray:
    """All numbers of a packed field, as uint64."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    if not len(ends):
        return np.empty(0, np.uint64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts + 1
    out = np.zeros(len(ends), np.uint64)
    for i in range(int(sizes.max())):
        has = sizes > i
        out[has] |= (raw[starts[has] + i].astype(np.uint64) & np.uint64(0x7F)) << np.uint64(7 * i)
    return out


def unzigzag(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).view(np.int64) ^ -(values & np.uint64(1)).view(np.int64)


def packed_lists(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of several packed fields at once, and where each field's numbers end."""
    data = b"".join(parts)
    numbers = packed(data)
    done = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) < 0x80)])
    return numbers, done[np.cumsum([len(p) for p in parts], dtype=np.int64)] if parts else np.empty(0, np.int64)


def sums_within(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Running sums that start anew behind each end."""
    total = np.cumsum(values)
    if not len(ends):
        return total
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    before = np.where(starts > 0, total[np.maximum(starts, 1) - 1] if len(total) else 0, 0)
    return total - np.repeat(before, ends - starts)
