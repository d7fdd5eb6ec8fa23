"""Hashes of words and of shingles, for whole Arrow batches at once with numpy."""

from __future__ import annotations

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
_RNG = np.random.default_rng(20240229)
BYTES = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PRIME = np.uint64(0x100000001B3)
PLACES = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK = 1 << 18
KEYS = np.uint64((1 << 62) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of x reaches every bit of the result (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of raw."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~SPACES[data]
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.zeros(len(data), np.int32)
    at[starts] = np.diff(starts, prepend=0)
    place = np.arange(len(data), dtype=np.int32) - np.cumsum(at, dtype=np.int32)
    powers = np.cumprod(np.full(int((ends - starts).max()) + 1, PRIME))
    value = BYTES[data] * np.where(word, powers[np.minimum(place, len(powers) - 1)], np.uint64(0))
    return mixed(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64)), starts


def _long_words(raw: bytes) -> np.ndarray:
    """Word hashes of one long text, cut at spaces so that memory stays bounded."""
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        while end < len(raw) and not SPACES[raw[end]]:
            end += 1
        parts.append(_words(raw[at:end])[0])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _windows(words: np.ndarray, n: int) -> np.ndarray:
    """62-bit keys of all windows of n words."""
    g = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n if len(g) else 0):
        g = mixed(g * PLACES[k % 64] + words[k : len(words) - n + 1 + k])
    return (g & KEYS).astype(np.int64)


def _short(words: np.ndarray) -> np.ndarray:
    """The key of fewer than n words, all together; nothing for none."""
    g = np.array([len(words)] if len(words) else [], np.uint64)
    for w in words:
        g = mixed(g * PLACES[0] + w)
    return (g & KEYS).astype(np.int64)


def keys_of(texts, n: int):
    """For each text (bytes or None) the keys of its windows of n words with A-Z in lower case, with
    repeats; those of fewer words have one key. Yields lists for runs of texts, in order."""
    held: list[bytes] = []
    size = 0

    def flush() -> list[np.ndarray]:
        nonlocal held, size
        hashes, starts = _words(b" ".join(held))
        cuts = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in held]))
        g = _windows(hashes, n)
        held, size = [], 0
        return [g[a : b - n + 1] if b - a >= n else _short(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    for t in texts:
        raw = (t or b"").lower()
        if len(raw) > CHUNK:
            if held:
                yield flush()
            words = _long_words(raw)
            yield [_windows(words, n) if len(words) >= n else _short(words)]
            continue
        held.append(raw)
        size += len(raw)
        if size > CHUNK:
            yield flush()
    if held:
        yield flush()
