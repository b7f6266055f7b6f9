"""Compressed bitmaps over the ordinals 0..65535 of a block.

A bitmap is bytes: one letter for the container, then its content. ``A`` holds the set ordinals as
little-endian uint16, ``R`` runs as (start, length - 1) pairs of uint16, ``B`` the packed bits. The
smallest of the three is kept, so that a full, an empty and a sparse block all take a few bytes.
"""

from __future__ import annotations

import numpy as np


def pack(present: np.ndarray) -> bytes:
    """The bitmap of a boolean vector."""
    on = np.flatnonzero(present).astype("<u2")
    if len(on) == 0:
        return b"A"
    breaks = np.flatnonzero(np.diff(on.astype(np.int64)) != 1)
    starts = on[np.r_[0, breaks + 1]]
    lengths = on[np.r_[breaks, len(on) - 1]] - starts
    forms = {
        b"A": 2 * len(on),
        b"R": 4 * len(starts),
        b"B": (int(on[-1]) + 8) // 8,
    }
    kind = min(forms, key=lambda k: (forms[k], k))
    if kind == b"A":
        return kind + on.tobytes()
    if kind == b"R":
        return kind + np.stack([starts, lengths.astype("<u2")], axis=1).tobytes()
    return kind + np.packbits(present[: int(on[-1]) + 1], bitorder="little").tobytes()


def unpack(data: bytes, size: int) -> np.ndarray:
    """The boolean vector of ``size`` ordinals."""
    out = np.zeros(size, dtype=bool)
    kind, body = data[:1], data[1:]
    if kind == b"A":
        out[np.frombuffer(body, "<u2")] = True
    elif kind == b"R":
        for start, more in np.frombuffer(body, "<u2").reshape(-1, 2).astype(np.int64):
            out[start : start + more + 1] = True
    else:
        bits = np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little").astype(bool)[:size]
        out[: len(bits)] = bits
    return out


def _runs(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of runs, ends exclusive."""
    runs = np.frombuffer(body, "<u2").reshape(-1, 2).astype(np.int64)
    return runs[:, 0], runs[:, 0] + runs[:, 1] + 1


def _bits(data: bytes, size: int) -> np.ndarray:
    """A run or bit container as packed bytes, eight ordinals each."""
    out = np.zeros((size + 7) // 8, np.uint8)
    kind, body = data[:1], data[1:]
    if kind == b"B":
        packed = np.frombuffer(body, np.uint8)[: len(out)]
        out[: len(packed)] = packed
        return out
    for start, end in zip(*_runs(body), strict=True):
        first, last = start // 8, (end - 1) // 8
        head, tail = (255 << (start % 8)) & 255, 255 >> (7 - (end - 1) % 8)
        if first == last:
            out[first] |= head & tail
        else:
            out[first] |= head
            out[first + 1 : last] = 255
            out[last] |= tail
    return out


def _set(packed: np.ndarray) -> np.ndarray:
    """The ordinals of packed bytes; bytes of no bits are passed over."""
    at = np.flatnonzero(packed)
    inner = np.unpackbits(packed[at], bitorder="little").reshape(-1, 8)
    row, bit = np.nonzero(inner)
    return at[row] * 8 + bit


def _contains(data: bytes, ordinals: np.ndarray) -> np.ndarray:
    """Whether each ordinal is set, without unpacking."""
    kind, body = data[:1], data[1:]
    if kind == b"A":
        return np.isin(ordinals, np.frombuffer(body, "<u2"))
    if kind == b"R":
        starts, ends = _runs(body)
        run = np.searchsorted(starts, ordinals, side="right") - 1
        return (run >= 0) & (ordinals < ends[np.maximum(run, 0)])
    packed = np.frombuffer(body, np.uint8)
    byte = ordinals // 8
    inside = byte < len(packed)
    return inside & ((packed[np.where(inside, byte, 0)] >> (ordinals % 8).astype(np.uint8)) & 1).astype(bool)


def _array(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], "<u2").astype(np.int64)


def and_not(a: bytes, b: bytes, size: int) -> np.ndarray:
    """Ordinals set in ``a`` and not in ``b``: an array is probed, other containers are combined byte by byte."""
    if a[:1] == b"A":
        on = _array(a)
        return on[~_contains(b, on)]
    left = _bits(a, size)
    if b[:1] == b"A":
        off = _array(b)
        np.bitwise_and.at(left, off // 8, ~(np.uint8(1) << (off % 8).astype(np.uint8)))
        return _set(left)
    return _set(left & ~_bits(b, size))


def both(a: bytes, b: bytes, size: int) -> np.ndarray:
    """Ordinals set in both."""
    if b[:1] == b"A":
        a, b = b, a
    if a[:1] == b"A":
        on = _array(a)
        return on[_contains(b, on)]
    return _set(_bits(a, size) & _bits(b, size))


def ranks(a: bytes, ordinals: np.ndarray) -> np.ndarray:
    """Place of each ordinal, which is set in ``a``, among those set there: its index in a column that skips absent rows."""
    kind, body = a[:1], a[1:]
    if kind == b"A":
        return np.searchsorted(_array(a), ordinals)
    if kind == b"R":
        starts, ends = _runs(body)
        before = np.concatenate([[0], np.cumsum(ends - starts)])
        run = np.searchsorted(starts, ordinals, side="right") - 1
        return before[run] + ordinals - starts[run]
    packed = np.frombuffer(body, np.uint8)
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
    lower = ((np.uint16(1) << (ordinals % 8).astype(np.uint16)) - 1).astype(np.uint8)
    return before[ordinals // 8] + np.bitwise_count(packed[ordinals // 8] & lower)
