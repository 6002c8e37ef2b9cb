"""Shingle sets of texts as arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .suffix_dedup import mix, prefix_hash, span_hash

#: Bytes that are hashed at once; longer texts are cut at white space.
PART = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9FB21C651E98DF25)
_SET = np.uint64(0xC2B2AE3D27D4EB4F)
_GRAY = np.array([0, 1, 3, 2], np.uint8)
#: Parts into which fixed pivots cut the hashes of a set; a power of two.
PARTS = 512


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and ends of the words [^\\x20\\x09-\\x0D]+, A-Z lower-cased."""
    space = _SPACE[data]
    out, ends, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = min(at + PART, len(data))
        if end < len(data):  # on to the next white space
            more = space[end:]
            stop = int(more.argmax())
            end = end + stop if more[stop] else len(data)
        gap = np.ones(end - at + 2, bool)
        gap[1:-1] = space[at:end]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        if len(edge):
            p = prefix_hash(_LOWER[data[at:end]])
            s, e = edge[::2], edge[1::2]
            out.append(mix(span_hash(p, s, e) + (e - s).astype(np.uint64)))
            ends.append(e + at)
        at = end
    return np.concatenate(out), np.concatenate(ends)


def shingle_sets(texts: list[str], size: int) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its ``size``-word shingles; a
    text of fewer words is one shingle, one without words none."""
    raw = [t.encode() for t in texts]
    h, ends = _hash_words(np.frombuffer(b"\n".join(raw), np.uint8))
    bounds = np.cumsum([len(t) + 1 for t in raw])
    cut = np.searchsorted(ends, bounds)  # words of the texts so far
    n = max(0, len(h) - size + 1)
    whole = np.full(n, size, np.uint64)
    for i in range(size):
        whole *= _STEP
        whole += h[i:n + i]
        whole = mix(whole)
    a = 0
    for b in cut.tolist():
        if b - a >= size:
            yield np.unique(whole[a:b - size + 1])
        elif b > a:
            x = np.uint64(b - a)
            for w in h[a:b]:
                x = mix(np.array([x], np.uint64) * _STEP + w)[0]
            yield np.array([x], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
        a = b


def signature(s: np.ndarray) -> int:
    """A hash of a whole set and its size."""
    total = mix(s * _SET).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total * _STEP + np.uint64(len(s))).view(np.int64)[0])


def parts(s: np.ndarray) -> bytes:
    """Sizes (255 at most) of the PARTS parts of a set's hashes.  Two sets differ at
    least by the sum of their parts' differences."""
    shift = np.uint64(65 - PARTS.bit_length())
    return np.minimum(np.bincount((s >> shift).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes()


def sketches(sizes: np.ndarray) -> np.ndarray:
    """Rows of PARTS part sizes as rows of PARTS / 32 longs: every size modulo 4 in
    Gray code.  No more bits of two rows differ than their parts' sizes do in sum."""
    code = _GRAY[sizes & 3]
    return np.packbits(np.concatenate([code & 1, code >> 1], axis=1), axis=1).view(np.int64)
