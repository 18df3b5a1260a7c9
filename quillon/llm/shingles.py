"""Words, shingle sets and parity sketches of texts as numpy arrays."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

SHINGLE = 5
SKETCH_BITS = 1024
#: Distinct words whose hashes a task remembers.
KNOWN_WORDS = 1 << 18
_ROLL = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Known(dict):
    """The 64-bit hash of each word, worked out once: BLAKE2, so that no texts can be built to collide."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


_KNOWN = _Known()


def words_of(text: str) -> list[bytes]:
    """The words of ``text`` in UTF-8, A-Z lower-cased; only ASCII white space parts them."""
    return text.encode("utf-8", "replace").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_KNOWN.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the ``k``-word shingles; of fewer words, of the whole sequence."""
    w = word_hashes(words)
    if not len(w):
        return w
    n = len(w) - k + 1
    if n < 1:
        k, n = len(w), 1
    h = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        h = (h + w[i : i + n]) * _ROLL
    return np.unique(mix(h))


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


def overlap(x: np.ndarray, y: np.ndarray, k: int = SHINGLE) -> tuple[int, int, int]:
    """Sizes of two shingle sets and of their intersection, from the texts' words as numbers, without any hash.

    Runs of words are told apart by exact ranks, of two words, of four, then of five.
    """
    if len(x) < k or len(y) < k:
        a, b = (len(np.unique(_windows(z, k))) if len(z) >= k else int(len(z) > 0) for z in (x, y))
        return a, b, int(len(x) == len(y) > 0 and bool((x == y).all()))
    both = _windows(np.concatenate((x, y)), k)
    a, b = np.unique(both[: len(x) - k + 1]), np.unique(both[len(x) :])
    return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))


def _windows(w: np.ndarray, k: int) -> np.ndarray:
    """The rank of the run of ``k`` numbers that starts at each place."""
    rank = first = _ranks(w)
    depth = 1
    while depth < k:
        step = min(depth, k - depth)
        tail = (rank if step == depth else _windows(first, step))[depth:]
        rank, depth = _ranks(rank[: len(tail)] * (int(tail.max()) + 1) + tail), depth + step
    return rank


def sketch(s: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity of the set's hashes in each of ``bits`` cells: two sketches differ in at most as many bits as the sets in elements."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def difference(a: np.ndarray, b: np.ndarray) -> int:
    """In how many bits two sketches differ, the larger one folded to the size of the other."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())  # of signed numbers it would count the absolute value's bits
