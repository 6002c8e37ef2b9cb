"""Byte-pair encoding over a public rank table.

Texts are cut at spaces into chunks, each but the first read with its space
before it.  The pre-token pattern never crosses such a cut unless white space
follows the space, so each distinct chunk is merged once per process and looked
up afterwards; chunks that begin with white space are never stored and send
their text through the whole pattern.  The look-up tables are bounded.
"""

from __future__ import annotations

import base64
import heapq
import json
import re

import regex

#: Fixed value: the public pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a look-up table before it is emptied.
CACHE = 900_000

_LOADED: dict[str, tuple] = {}


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the rest for code points from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> tuple[dict[bytes, int], dict[bytes, tuple[int, int]], dict[str, int]]:
    """Ids of byte strings; (rank, bytes of the left part) of each string that
    a merge makes (left 0: any two parts); ids of added special strings.  From
    a tokenizers file (.json) or a rank file (.tiktoken)."""
    if path not in _LOADED:
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                j = json.load(f)
            back = _byte_chars()
            special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
            ids = {bytes(back[c] for c in k): v for k, v in j["model"]["vocab"].items() if k not in special}
            merges = j["model"]["merges"]
            pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
            ranks = {}
            for i, (a, b) in enumerate(pairs):
                ranks.setdefault(bytes(back[c] for c in a + b), (i, len(a)))
        else:
            with open(path, "rb") as f:
                ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            ranks = {k: (v, 0) for k, v in ids.items() if len(k) > 1}
            special = {}
        _LOADED[path] = (ids, ranks, special)
    return _LOADED[path]


def merge_count(piece: bytes, ranks: dict[bytes, tuple[int, int]]) -> int:
    """Tokens of one pre-token: initial bytes minus merges.

    A heap holds (rank, left position, middle, end) of adjacent pairs, a linked
    list the live symbols.  The lowest rank, leftmost first, is popped and
    merged unless one of its symbols has changed since; no ids are made."""
    n = len(piece)
    if n < 2:
        return n
    nxt = list(range(1, n + 1))
    prv = list(range(-1, n - 1))
    get, heap = ranks.get, []
    for i in range(n - 1):
        r = get(piece[i:i + 2])
        if r is not None:
            heap.append((r[0], i, i + 1, i + 2))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    left = n
    while heap:
        _, i, mid, end = pop(heap)
        if nxt[i] != mid or mid >= n or nxt[mid] != end:
            continue
        nxt[i], nxt[mid] = end, 0
        left -= 1
        if end < n:
            prv[end] = i
            r = get(piece[i:nxt[end]])
            if r is not None and (not r[1] or r[1] == end - i):
                push(heap, (r[0], i, end, nxt[end]))
        p = prv[i]
        if p >= 0:
            r = get(piece[p:end])
            if r is not None and (not r[1] or r[1] == i - p):
                push(heap, (r[0], p, i, end))
    return left


class Counter:
    """Token counts of whole texts by heap-and-linked-list merging."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        _, self.ranks, special = load(path)
        self.library, self.back = ByteLevel(add_prefix_space=False), _byte_chars()
        self.find = regex.compile(PATTERN).findall
        self.split = re.compile("|".join(map(re.escape, special))).split if special else None
        self.special = list(special)
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def _one(self, piece: str) -> int:
        c = self.pieces.get(piece)
        if c is None:
            c = merge_count(piece.encode(), self.ranks)
            if len(piece) < 64:
                self.pieces[piece] = c
        return c

    def _pieces(self, text: str) -> int:
        if text.isascii() or text.isprintable():
            return sum(map(self._one, self.find(text)))
        # Code points that one Unicode version names and another does not:
        # the cuts come from the library's own tables.
        return sum(merge_count(bytes(map(self.back.__getitem__, p)), self.ranks)
                   for p, _ in self.library.pre_tokenize_str(text))

    def _plain(self, text: str) -> int:
        cut = text.split(" ")
        words = self.words
        got = list(map(words.get, cut))
        got[0] = self._pieces(cut[0])
        if None in got:
            for i, c in enumerate(got):
                if c is None:
                    w = cut[i]
                    c = words.get(w)
                    if c is None:
                        if not w or w[0].isspace():
                            return self._pieces(text)
                        c = self._one(" " + w) if w.isalpha() and w.isprintable() else self._pieces(" " + w)
                        if len(w) < 64:
                            words[w] = c
                    got[i] = c
        return sum(got)

    def count(self, text: str) -> int:
        if len(self.words) > CACHE:
            self.words.clear()
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        if self.split and any(s in text for s in self.special):
            parts = self.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter per process and vocabulary (workers are reused by tasks)."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


class Encoder:
    """Ids of whole texts, and where sentences end among them."""

    def __init__(self, path: str):
        import numpy as np
        import tiktoken

        ids, _, self.special = load(path)
        self.enc = tiktoken.Encoding("quarry", pat_str=PATTERN, mergeable_ranks=dict(ids), special_tokens={})
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.spaced = np.zeros(max([*ids.values(), *self.special.values()]) + 1, bool)
        self.ending = self.spaced.copy()
        self.spaced[[v for k, v in ids.items() if k[:1] in (b" ", b"\n")]] = True
        self.ending[[v for k, v in ids.items() if k[-1:] in (b".", b"!", b"?")]] = True

    def ids(self, text: str):
        """Little-endian unsigned 32-bit ids as an array."""
        import numpy as np

        if self.split and any(s in text for s in self.special):
            return np.concatenate([np.array([self.special[p]] if p in self.special else self.enc.encode_ordinary(p),
                                            dtype="<u4") for p in self.split(text)])
        return np.array(self.enc.encode_ordinary(text), dtype="<u4")

    def sentence_ends(self, ids, gap: int) -> list[int]:
        """Offsets after a sentence's last token, the first of each ``gap``."""
        at = (self.ending[ids[:-1]] & self.spaced[ids[1:]]).nonzero()[0] + 1
        if len(at) > 1:
            bins = at // gap
            keep = bins[1:] != bins[:-1]
            at = at[1:][keep] if bins[0] == 0 else at[[0, *(keep.nonzero()[0] + 1)]]
        return at.tolist()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
