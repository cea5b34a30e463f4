"""XXH64 of many slices of one byte buffer at once, in numpy.

Slices are ordered by length, so each 8-byte step of the hash runs over one
contiguous run of them.  Slices of 256 bytes or more go to ``xxhash``.
"""

from __future__ import annotations

import numpy as np
import xxhash

# Fixed values of the XXH64 definition.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
    0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
LONG = 256


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _rotl(acc + word * P2, 31) * P1


def _merge(h: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return (h ^ _round(np.zeros_like(lane), lane)) * P1 + P4


def xxh64(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """Unsigned XXH64 of ``buf[start[i] : start[i] + length[i]]`` for each i."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    order = np.argsort(np.minimum(length, LONG).astype(np.uint16), kind="stable")  # radix sort
    n, at = length[order].astype(np.int64), start[order].astype(np.int64)
    cut = int(np.searchsorted(n, LONG))
    raw = memoryview(buf)
    for i in order[cut:]:
        out[i] = xxhash.xxh64_intdigest(raw[start[i]:start[i] + length[i]], seed)
    order, n, at = order[:cut], n[:cut], at[:cut]
    if not cut:
        return out
    # word8[i] is the little-endian 8-byte word at byte i (zero-padded at the end)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    word8 = np.ascontiguousarray(
        np.ndarray(len(buf), np.dtype("<u8"), buffer=padded.data, strides=(1,)))
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        h = np.full(cut, s + P5, np.uint64)
        done = np.zeros(cut, np.int64)
        first = int(np.searchsorted(n, 32))
        if first < cut:
            m, a = n[first:], at[first:]
            v = [np.full(len(m), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            for k in range(int(m[-1]) // 32):
                b = int(np.searchsorted(m, 32 * (k + 1)))
                for j in range(4):
                    v[j][b:] = _round(v[j][b:], word8[a[b:] + (32 * k + 8 * j)])
            x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for j in range(4):
                x = _merge(x, v[j])
            h[first:] = x
            done[first:] = m // 32 * 32
        h += n.astype(np.uint64)
        rest = n - done
        for k in range(3):
            i = np.flatnonzero(rest >= 8 * (k + 1)) if first < cut else slice(
                int(np.searchsorted(n, 8 * (k + 1))), cut)
            w = word8[at[i] + done[i] + 8 * k]
            h[i] = _rotl(h[i] ^ _round(np.zeros_like(w), w), 27) * P1 + P4
        pos = at + done + rest // 8 * 8
        i = np.flatnonzero(rest % 8 >= 4)
        w = word8[pos[i]] & np.uint64(0xFFFFFFFF)
        h[i] = _rotl(h[i] ^ (w * P1), 23) * P2 + P3
        pos[i] += 4
        for k in range(3):
            i = np.flatnonzero(rest % 4 > k)
            h[i] = _rotl(h[i] ^ (buf[pos[i] + k].astype(np.uint64) * P5), 11) * P1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    out[order] = h
    return out
