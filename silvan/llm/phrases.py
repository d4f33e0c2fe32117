"""Prefix-free parsing of byte strings: rolling-hash triggers and the phrases between them."""

from __future__ import annotations

import numpy as np
import xxhash

#: Length of the repeated strings looked for.
LENGTH = 400
#: Bytes of the rolling hash that sets triggers; neighbouring phrases share so many.
TRIGGER = 16
#: One place in so many is a trigger.
SPACING = 64
_TABLE = np.random.default_rng(20240101).integers(0, 1 << 64, 256, dtype=np.uint64)
_LIMIT = np.uint64((1 << 64) // SPACING)
#: Places whose hashes are held at a time.
_CHUNK = 1 << 20
#: A string without a trigger goes by the least hash of so many places in its middle (a power of two), and so many bytes to either side.
WINDOW, SIDE = 16, 192
_LEAD = (LENGTH - WINDOW) // 2


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hashes of all substrings of TRIGGER bytes, by doubling."""
    h, power, size = _TABLE[data], 0x9E3779B97F4A7C15, 1
    while size < TRIGGER:
        h = h[: len(h) - size] + h[size:] * np.uint64(power)
        power = power * power % (1 << 64)
        size *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def triggers(raw: bytes) -> np.ndarray:
    """Places where a trigger string of TRIGGER bytes starts; they depend on those bytes alone."""
    data = np.frombuffer(raw, np.uint8)
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(data) - TRIGGER + 1, _CHUNK):
        found.append(np.flatnonzero(_rolling(data[at : at + _CHUNK + TRIGGER - 1]) < _LIMIT) + at)
    return np.concatenate(found)


def inner_runs(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, place) of the runs of starts whose strings hold no trigger past their first byte.

    Such a string lies inside a phrase. The starts of a run share the place of
    the least hash in the middle of their strings, and so what stands around it.
    """
    n = len(raw)
    limits = np.minimum(np.append(ends[:-1] - LENGTH, n - LENGTH + 1), n - LENGTH + 1)
    firsts, lasts, places = ([np.zeros(0, np.int64)] for _ in range(3))
    for k in np.flatnonzero(limits > starts).tolist():
        for at in range(int(starts[k]), int(limits[k]), _CHUNK):
            count = min(int(limits[k]) - at, _CHUNK)
            h = _rolling(np.frombuffer(raw, np.uint8)[at + _LEAD : at + _LEAD + count + WINDOW + TRIGGER - 2])
            # the place takes the low bits, so that of equal hashes the first is least
            low = np.uint64((1 << 22) - 1)
            h = (h & ~low) | np.arange(len(h), dtype=np.uint64)
            size = 1
            while size < WINDOW:
                h = np.minimum(h[: len(h) - size], h[size:])
                size *= 2
            place = (h & low).astype(np.int64)
            cuts = np.flatnonzero(place[1:] != place[:-1]) + 1
            first = np.append(0, cuts)
            firsts.append(first + at)
            lasts.append(np.append(cuts, count) - 1 + at)
            places.append(place[first] + at + _LEAD)
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(places)


def parse(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the phrases: from one trigger to the end of the next, the text's edges included.

    No suffix of a phrase that reaches over its last trigger's start is a proper
    prefix of another such suffix, since a trigger stands at its end and nowhere
    after its first byte before.
    """
    found = triggers(raw)
    found = found[found > 0]
    return np.concatenate([[0], found]).astype(np.int64), np.concatenate([found + TRIGGER, [len(raw)]]).astype(np.int64)


def hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit hashes of substrings as rows of two signed 64-bit numbers."""
    digest = xxhash.xxh3_128_digest
    joined = b"".join([digest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(joined, ">i8").reshape(-1, 2).astype(np.int64)
