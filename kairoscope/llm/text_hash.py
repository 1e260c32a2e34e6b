"""Word and shingle hashes of whole batches of texts, in numpy arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
#: Element ids have so many bits; the bits above number the documents of a batch.
BITS = 52
MASK = U((1 << BITS) - 1)
BATCH_DOCS = 4000
BATCH_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def batches(texts: list[bytes]):
    """Slices of a list of texts with bounded bytes (or one text alone)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > BATCH_BYTES or i - start >= BATCH_DOCS):
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word; words are runs of other bytes than white space."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, U)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * up[:-1], out=total[1:])
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return np.searchsorted(first, start, "right") - 1, mix((total[end] - total[start]) * down[start])


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (document << BITS | shingle) keys and their counts.

    A text of fewer words than ``size`` has one shingle of all its words.
    """
    doc, word = words(texts)
    n = len(word)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    odd = [U((2 * k + 1) * 0xD6E8FEB86659FD93 % (1 << 64)) for k in range(size)]
    parts = []
    if n >= size:
        h = word[: n - size + 1] * odd[0]
        for k in range(1, size):
            h = h + word[k : n - size + 1 + k] * odd[k]
        whole = doc[: n - size + 1] == doc[size - 1 :]
        parts.append((doc[: n - size + 1][whole], mix(h[whole])))
    count = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        at = np.concatenate([[0], np.cumsum(count)])
        h = [sum((int(word[at[d] + k]) * int(odd[k]) for k in range(count[d])), int(count[d])) & (2**64 - 1) for d in short]
        parts.append((short, mix(np.array(h, U))))
    key = np.concatenate([(d.astype(U) << U(BITS)) | (h >> U(64 - BITS)) for d, h in parts])
    return np.unique(key, return_counts=True)
