"""Word shingles of whole texts as sorted arrays of 64-bit hashes, made a batch at a time.

A text is put in lower case, white space collapsed, everything but ASCII letters, digits and blanks deleted; its
shingles are the set of its runs of ``width`` words (all words joined, if there are fewer). Words are hashed once per
worker, runs are mixed from the word hashes in one array operation for a whole batch.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Deleted from the encoded text: all ASCII but letters, digits and the blank (other characters are gone already).
_DROP = bytes(c for c in range(128) if not (chr(c).isalnum() or c == 32))
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_words: dict[bytes, int] = {}


def words_of(text: str | None) -> list[bytes]:
    if not text:
        return []
    return " ".join(text.lower().split()).encode("ascii", "ignore").translate(None, _DROP).split()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiply-xorshift hash."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= _K[3]
    h ^= h >> np.uint64(29)
    h *= _K[4]
    h ^= h >> np.uint64(32)
    return h


def _hash_words(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    if len(_words) > 2_000_000:  # a cache only: forgetting changes no hash
        _words.clear()
    flat = []
    for words in docs:
        for w in words:
            h = _words.get(w)
            if h is None:
                h = _words[w] = xxhash.xxh64_intdigest(w)
            flat.append(h)
    return np.array(flat, dtype=np.uint64), np.array([len(w) for w in docs], dtype=np.int64)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Hashes of all words one after another, number of words per text, the words."""
    docs = [words_of(t) for t in texts]
    flat, n = _hash_words(docs)
    return flat, n, docs


def windows(flat: np.ndarray, n_words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, doc, first word) of all runs of ``width`` words, in order; of a shorter text all its words."""
    n_docs = len(n_words)
    starts = np.concatenate(([0], np.cumsum(n_words)[:-1])) if n_docs else np.zeros(0, np.int64)
    runs = np.where(n_words > 0, np.maximum(n_words - width + 1, 1), 0)
    doc = np.repeat(np.arange(n_docs), runs)
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum()) if n_docs else np.zeros(0, np.int64)
    left = n_words[doc] - (first - starts[doc])
    padded = np.concatenate((flat, np.zeros(width, np.uint64)))
    h = np.zeros(len(doc), np.uint64)
    for i in range(width):
        h = mix(h + np.where(left > i, padded[first + i], np.uint64((1 << 40) + i)) * _K[i % 3])
    return h, doc, first


def shingle_sets(flat: np.ndarray, n_words: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, doc): the distinct shingles of each text, sorted by text and hash."""
    h, doc, _ = windows(flat, n_words, width)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


def set_ids(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that are equal for equal sets: two sums of differently mixed hashes."""
    a, b = np.zeros(n_docs, np.uint64), np.zeros(n_docs, np.uint64)
    np.add.at(a, doc, mix(h ^ _K[0]))
    np.add.at(b, doc, mix(h ^ _K[1]))
    return mix(a).view(np.int64), mix(b).view(np.int64)


def rest_bitmaps(h: np.ndarray, ends: np.ndarray, lanes: int) -> np.ndarray:
    """(len(h), lanes) uint32: of what follows each shingle in its text, which ends before ``ends``: each shingle flips one of the bits.

    The bits in which two of them differ are at most the symmetric difference of what follows.
    """
    bit = (h >> np.uint64(20)).astype(np.int64) % (32 * lanes)
    one = np.zeros((len(h), lanes), np.uint32)
    one[np.arange(len(h)), bit >> 5] = np.uint32(1) << (bit & 31).astype(np.uint32)
    so_far = np.bitwise_xor.accumulate(one, axis=0)
    return so_far[ends - 1] ^ so_far


def plain_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """As word_hashes, of texts that are normalised already (words joined by blanks)."""
    docs = [t.encode().split() for t in texts]
    flat, n = _hash_words(docs)
    return flat, n, docs


def overlaps(x: list[str], y: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of normalised texts: common shingles, shingles of x, shingles of y, by 64-bit hashes. Each distinct text is cut once."""
    place: dict[str, int] = {}
    at = np.array([place.setdefault(t, len(place)) for t in (*x, *y)], np.int64).reshape(2, -1)
    flat, n, _ = plain_hashes(list(place))
    h, d = shingle_sets(flat, n, width)
    size = np.bincount(d, minlength=len(place))
    begin = np.cumsum(size) - size
    sides = []
    for ids in at:
        pair = np.repeat(np.arange(len(ids)), size[ids])
        sides.append((pair, h[np.arange(len(pair)) - np.repeat(np.cumsum(size[ids]) - size[ids], size[ids]) + begin[ids][pair]]))
    pair, both = np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides])
    order = np.lexsort((both, pair))
    both, pair = both[order], pair[order]
    twice = (both[1:] == both[:-1]) & (pair[1:] == pair[:-1])
    return np.bincount(pair[1:][twice], minlength=len(x)), size[at[0]], size[at[1]]
