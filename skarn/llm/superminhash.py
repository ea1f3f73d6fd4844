"""SuperMinHash signatures (Ertl, 2017) over word shingles, vectorised over the texts of a batch."""

from __future__ import annotations

import numpy as np
import xxhash

from skarn.llm.common import NOT_SPACE, hash_words, mix, text_chunks

#: Components of a signature, bands and rows a band: at a similarity of 0.8 a pair shares no band once in 20 million.
M, BANDS, ROWS = 128, 32, 4
_R = 25  # bits of the random part of a component; the level stands above them


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the ``k``-word shingles, sorted; fewer words are one shingle, no word none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    h = words[: n - k + 1].copy()
    for i in range(1, k):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[i : n - k + 1 + i])
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def shingle_sets(column, k: int):
    """Yield ``(row, sorted distinct shingle hashes)`` of every text of an Arrow column; null is empty text."""
    for row, buf, ends in text_chunks(column):
        words, upto = hash_words(buf, ends, NOT_SPACE)
        start = 0
        for i, stop in enumerate(upto.tolist()):
            yield row + i, shingle_hashes(words[start:stop], k)
            start = stop


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), M) uint32. An empty set keeps the largest value everywhere.

    Level j gives each element one random value in [j, j+1) at the j-th place of its own random permutation of the
    components. A set is done when all its components lie below the next level: later levels can't lower them.
    """
    n = len(sets)
    h = np.full(n * M, 0xFFFFFFFF, np.uint32)
    lens = np.fromiter(map(len, sets), np.int64, n)
    x = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(n), lens)
    perm: np.ndarray | None = None
    for j in range(M):
        if j:
            open_ = h.reshape(n, M).max(1) >= np.uint32(j << _R)
            stay = open_[owner]
            if not stay.any():
                break
            if not stay.all():
                x, owner = x[stay], owner[stay]
                perm = perm[stay] if perm is not None else None
                if perm is None:
                    first = first[stay]
            if perm is None:
                rows = np.arange(len(x))
                perm = np.tile(np.arange(M, dtype=np.uint8), (len(x), 1))
                perm[rows, first] = 0
                perm[:, 0] = first
        r = mix(x + np.uint64((0x632BE59BD9B4E019 * (j + 1)) & (2**64 - 1)))
        k = j + ((r >> np.uint64(32)) % np.uint64(M - j)).astype(np.int64)
        value = (r & np.uint64((1 << _R) - 1)).astype(np.uint32) | np.uint32(j << _R)
        if perm is None:
            first = place = k
        else:
            rows = np.arange(len(x))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = place
        np.minimum.at(h, owner * M + place, value)
    return h.reshape(n, M)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) int64 keys of signature bands."""
    x = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F), x.shape[:2])
    for i in range(ROWS):
        key = mix(key * np.uint64(0xE7037ED1A0B428DB) + x[:, :, i])
    return key.view(np.int64)


def set_digest(s: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(s.tobytes())


def linked(a: np.ndarray, b: np.ndarray, percent: int = 80) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted distinct arrays, neither of them empty."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)
