"""Counting quotient filters over 64-bit fingerprints, as numpy arrays.

A fingerprint's upper bits are its quotient, the rest its remainder. Remainders are kept in the order of their
quotients, sorted within each run. ``occupied`` has a bit per quotient, ``run_end`` a bit per slot, so a run is found by
rank and select. A fingerprint seen more than once is followed by a slot that holds its count. Nothing is lost: all
bits of a fingerprint can be read back, so filters with different quotient sizes merge exactly.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<BBBQQ")  # segment bits, quotient bits, bytes per slot, segment, slots


def counted(fingerprints: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints and the sums of their counts."""
    if counts is None:
        return np.unique(fingerprints, return_counts=True)
    order = np.argsort(fingerprints, kind="stable")  # merges runs that are sorted already
    fingerprints, counts = fingerprints[order], counts[order]
    first = np.flatnonzero(np.r_[True, fingerprints[1:] != fingerprints[:-1]]) if len(fingerprints) else np.zeros(0, np.int64)
    return fingerprints[first], np.add.reduceat(counts, first) if len(first) else counts


def build(fingerprints: np.ndarray, counts: np.ndarray, segment_bits: int = 0) -> bytes:
    """A filter of sorted, distinct fingerprints that share their first ``segment_bits`` bits."""
    n = len(fingerprints)
    quotient_bits = min(32, max(1, (max(n, 1) - 1).bit_length()))
    rest = 64 - segment_bits
    segment = int(fingerprints[0]) >> rest if n and segment_bits else 0
    inner = fingerprints & np.uint64((1 << rest) - 1)
    remainder_bits = rest - quotient_bits
    quotients = (inner >> np.uint64(remainder_bits)).astype(np.int64)
    remainders = inner & np.uint64((1 << remainder_bits) - 1)
    many = counts > 1
    at = np.arange(n) + np.r_[0, np.cumsum(many)[:-1]].astype(np.int64) if n else np.zeros(0, np.int64)
    slots = np.zeros(n + int(many.sum()), np.uint64)
    slots[at] = remainders
    slots[at[many] + 1] = counts[many].astype(np.uint64)
    is_count = np.zeros(len(slots), bool)
    is_count[at[many] + 1] = True
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotients] = True
    run_end = np.zeros(len(slots), bool)
    last = np.flatnonzero(np.r_[quotients[1:] != quotients[:-1], True]) if n else np.zeros(0, np.int64)
    run_end[at[last] + many[last]] = True
    width = max((remainder_bits + 7) // 8, (int(counts.max() if n else 0).bit_length() + 7) // 8)
    head = _HEAD.pack(segment_bits, quotient_bits, width, segment, len(slots))
    body = np.ascontiguousarray(slots).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return head + b"".join(np.packbits(x).tobytes() for x in (occupied, run_end, is_count)) + body


def _parts(data: bytes):
    segment_bits, quotient_bits, width, segment, n = _HEAD.unpack_from(data)
    at = _HEAD.size
    bits = []
    for size in (1 << quotient_bits, n, n):
        length = (size + 7) // 8
        bits.append(np.unpackbits(np.frombuffer(data, np.uint8, length, at), count=size).astype(bool))
        at += length
    slots = np.zeros((n, 8), np.uint8)
    slots[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    return segment_bits, quotient_bits, segment, *bits, slots.view(np.uint64).ravel()


def entries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a filter in order, and their counts."""
    segment_bits, quotient_bits, segment, occupied, run_end, is_count, slots = _parts(data)
    run = np.cumsum(np.r_[0, run_end[:-1]]).astype(np.int64) if len(slots) else np.zeros(0, np.int64)
    held = ~is_count
    rest = 64 - segment_bits
    quotients = np.flatnonzero(occupied)[run[held]].astype(np.uint64)
    fingerprints = (quotients << np.uint64(rest - quotient_bits)) | slots[held]
    if segment_bits:
        fingerprints |= np.uint64(segment << rest)
    counts = np.ones(int(held.sum()), np.int64)
    at = np.flatnonzero(is_count)
    counts[np.cumsum(held)[at - 1] - 1] = slots[at].astype(np.int64)
    return fingerprints, counts


def count(data: bytes, fingerprint: int) -> int:
    """How often one fingerprint was added, found through its run."""
    segment_bits, quotient_bits, segment, occupied, run_end, is_count, slots = _parts(data)
    rest = 64 - segment_bits
    if segment_bits and fingerprint >> rest != segment:
        return 0
    inner = fingerprint & ((1 << rest) - 1)
    quotient, remainder = inner >> (rest - quotient_bits), inner & ((1 << (rest - quotient_bits)) - 1)
    if not occupied[quotient]:
        return 0
    rank, ends = int(occupied[:quotient].sum()), np.flatnonzero(run_end)
    for i in range(int(ends[rank - 1]) + 1 if rank else 0, int(ends[rank]) + 1):
        if not is_count[i] and int(slots[i]) == remainder:
            return int(slots[i + 1]) if i + 1 < len(slots) and is_count[i + 1] else 1
    return 0


def merge(filters: list[bytes], segment_bits: int = 0) -> bytes:
    """One filter that holds all that the given ones hold."""
    parts = [entries(x) for x in filters]
    if not parts:
        return build(np.zeros(0, np.uint64), np.zeros(0, np.int64), segment_bits)
    return build(*counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])), segment_bits)
