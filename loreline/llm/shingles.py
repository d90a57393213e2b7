"""Word shingles of many texts at once, as arrays of hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_WORD = np.zeros(256, np.uint64)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _WORD[_c] = _c
#: Texts are taken together up to this many bytes; a longer one is cut between words for hashing.
BATCH_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


def _hash_words(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each maximal run of a-z and 0-9."""
    code = _WORD[np.frombuffer(buf, np.uint8)]
    inside = code > 0
    pos = np.flatnonzero(inside)
    if not len(pos):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(np.diff(pos, prepend=-2) > 1)
    starts = pos[first]
    lengths = np.diff(np.append(first, len(pos)))
    rel = np.arange(len(pos)) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(rel.max()) + 1, _MULT, np.uint64))
    sums = np.add.reduceat(code[pos] * powers[rel], first)
    return mix(sums), starts


def _pieces(buf: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(buf):
        end = min(len(buf), at + BATCH_BYTES)
        while end < len(buf) and _WORD[buf[end - 1]] and _WORD[buf[end]]:
            end += 1
        yield buf[at:end]
        at = end


def words_of(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, word hashes, offsets) of successive groups of texts; words are runs of a-z and 0-9 of the lower-cased text."""
    group: list[bytes] = []
    first, size = 0, 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        if len(group) == 1 and size > BATCH_BYTES:
            parts = [_hash_words(p)[0] for p in _pieces(group[0])]
            h = np.concatenate(parts)
            return h, np.array([0, len(h)])
        h, starts = _hash_words(b"\0".join(group))
        ends = np.cumsum([len(b) + 1 for b in group])
        return h, np.concatenate([[0], np.searchsorted(starts, ends)])

    for i, text in enumerate(texts):
        b = text.lower().encode("utf-8", "replace")
        if group and size + len(b) > BATCH_BYTES:
            h, off = flush()
            yield first, i, h, off
            group, first, size = [], i, 0
        group.append(b)
        size += len(b)
    if group:
        h, off = flush()
        yield first, len(texts), h, off


def shingle_sets(texts: list[str], width: int, least_words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of each text with at least least_words and width words."""
    for first, last, h, off in words_of(texts):
        if len(h) < width:
            continue
        n = len(h) - width + 1
        s = h[:n].copy()
        for k in range(1, width):
            s = (s * _MULT) + h[k : n + k]
        s = mix(s)
        for i in range(last - first):
            a, b = int(off[i]), int(off[i + 1])
            if b - a >= max(width, least_words):
                yield first + i, np.unique(s[a : b - width + 1])
