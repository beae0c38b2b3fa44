"""Counting quotient filters over permuted keys: exact counters in little more than the bits of their keys.

A key of ``3 * bits`` bits, three word ids, is permuted by an invertible network into a left part of ``bits`` and a
right part of ``2 * bits``. A filter keeps the top bits of the left part as quotient, that is as a position, and the
rest in full as remainder, so the key can be read back and two keys never share a counter. Entries lie sorted by
(quotient, remainder); filters are merged like sorted lists.
"""

from __future__ import annotations

import struct

import numpy as np

Entries = tuple[np.ndarray, np.ndarray, np.ndarray]
_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        return x * np.uint64(0xC4CEB9FE1A85EC53)


def permute(left: np.ndarray, right: np.ndarray, bits: int, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Four rounds of an unbalanced Feistel network on (``bits``, ``2 * bits``); ``back`` inverts them. bits: 1 to 32."""
    for at in reversed(range(4)) if back else range(4):
        if at % 2 == 0:
            left = left ^ _mix(right, _ROUNDS[at]) >> np.uint64(64 - bits)
        else:
            right = right ^ _mix(left, _ROUNDS[at]) >> np.uint64(64 - 2 * bits)
    return left, right


def tally(left: np.ndarray, right: np.ndarray, times: np.ndarray | None, bits: int) -> Entries:
    """Sorted, distinct (left, right) with their summed ``times`` (None: one each)."""
    if not len(left):
        return left, right, np.zeros(0, np.int64)
    if 3 * bits <= 64:
        key = left << np.uint64(2 * bits) | right
        order = None if times is None else np.argsort(key)
        key = np.sort(key) if order is None else key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        left, right = key[first] >> np.uint64(2 * bits), key[first] & np.uint64((1 << 2 * bits) - 1)
    else:
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        first = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1]))))
        left, right = left[first], right[first]
    if times is None:
        return left, right, np.diff(np.append(first, len(key) if 3 * bits <= 64 else len(order)))
    return left, right, np.add.reduceat(times[order], first)


def _packed(values: np.ndarray, bits: int) -> bytes:
    """Whole bytes of the lower ``bits`` of unsigned numbers."""
    width = (bits + 7) // 8
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(data: memoryview, n: int, bits: int) -> tuple[np.ndarray, memoryview]:
    width = (bits + 7) // 8
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data[:n * width], np.uint8).reshape(n, width)
    return out.reshape(-1).view("<u8").astype(np.uint64), data[n * width:]


def encode(entries: Entries, bits: int, prefix: int = 0) -> bytes:
    """The filter of sorted, distinct entries whose left parts agree in their top ``prefix`` bits (these are left out).

    Two bit vectors stand for the quotients: which of them occur, and which entry ends a run of one quotient. A counter
    of one takes a bit, one of up to 256 another byte, a larger one eight more.
    """
    left, right, times = entries
    n, rest = len(left), bits - prefix
    quotient = min(rest, max(n - 1, 0).bit_length())
    low = rest - quotient
    left = left & np.uint64((1 << rest) - 1)
    at = (left >> np.uint64(low)).astype(np.int64)
    occurs = np.zeros(1 << quotient, bool)
    occurs[at] = True
    ends = np.append(at[1:] != at[:-1], True)[:n]
    many = times > 1
    small = np.minimum(times[many] - 2, 255).astype(np.uint8)
    parts = [struct.pack("<QBBQQ", n, quotient, prefix, len(small), int((small == 255).sum())), np.packbits(occurs).tobytes(),
             np.packbits(ends).tobytes(), _packed(left & np.uint64((1 << low) - 1), low), _packed(right, 2 * bits),
             np.packbits(many).tobytes(), small.tobytes(), times[many][small == 255].astype("<u8").tobytes()]
    return b"".join(parts)


def decode(data: bytes, bits: int, top: int = 0) -> Entries:
    """Entries of a filter; ``top`` is the value of the left-out prefix."""
    n, quotient, prefix, more, large = struct.unpack_from("<QBBQQ", data)
    rest, view = bits - prefix, memoryview(data)[struct.calcsize("<QBBQQ"):]
    low = rest - quotient

    def flags(size: int) -> np.ndarray:
        nonlocal view
        own, view = view[:(size + 7) // 8], view[(size + 7) // 8:]
        return np.unpackbits(np.frombuffer(own, np.uint8), count=size).astype(bool)

    occurs, ends = flags(1 << quotient), flags(n)
    run = np.cumsum(ends) - ends
    lower, view = _unpacked(view, n, low)
    right, view = _unpacked(view, n, 2 * bits)
    left = np.flatnonzero(occurs).astype(np.uint64)[run] << np.uint64(low) | lower | np.uint64(top << rest)
    times, many = np.ones(n, np.int64), flags(n)
    counters = np.frombuffer(view[:more], np.uint8).astype(np.int64) + 2
    counters[counters == 257] = np.frombuffer(view[more:more + 8 * large], "<u8").astype(np.int64)
    times[many] = counters
    return left, right, times


def merge(filters: list[bytes], bits: int, top: int = 0) -> Entries:
    """Entries of several filters of one prefix, equal keys added up."""
    parts = [decode(f, bits, top) for f in filters]
    return tally(*(np.concatenate([p[k] for p in parts]) for k in range(3)), bits)
