"""Operator 3: language by segmentation-marginalised unigrams.

Words are cut into pieces of a fixed public vocabulary in every possible way; a
language gives a word the sum over its segmentations of the products of piece
probabilities (forward algorithm), and a text the product over its words.  Piece
probabilities are fitted per language by expectation maximisation over the same
segmentations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

#: Letters of a piece at most, and letters after which a word is cut.
PIECE, WORD = 16, 32
#: Learning documents of a language (expected; chosen by a hash of the id).
LEARN = 1500
ROUNDS, SMOOTH = 3, 0.02
#: Words whose scores a process keeps.
CACHE = 600_000
#: ASCII that is no letter becomes a space; other bytes stay.
_CUT = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

_TRIES: dict[str, "Trie"] = {}


class Trie:
    """Letter pieces of a sentencepiece vocabulary, walked for many words at once."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = sorted({p for i in range(sp.get_piece_size())
                         if (p := sp.id_to_piece(i).lstrip("▁").lower()).isalpha() and len(p) <= PIECE})
        self.alphabet = np.array(sorted({ord(c) for p in pieces for c in p}), np.uint32)
        code = {chr(c): i + 1 for i, c in enumerate(self.alphabet.tolist())}
        self.size, width = len(pieces), len(code) + 1
        nodes, ends = {}, [-1]
        for k, p in enumerate(pieces):
            at = 0
            for c in p:
                key = at * width + code[c]
                if key not in nodes:
                    nodes[key] = len(ends)
                    ends.append(-1)
                at = nodes[key]
            ends[at] = k
        self.keys = np.array(sorted(nodes), np.int64)
        self.child = np.array([nodes[k] for k in self.keys.tolist()], np.int64)
        self.ends, self.width = np.array(ends), width

    def matches(self, words: list[str]) -> tuple[np.ndarray, dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]]:
        """Lengths, and per (start, end) the words that have a piece there and
        its id; the id after the last is that of a letter on its own."""
        size = np.array([len(w) for w in words])
        longest = int(size.max(initial=0))
        codes = np.zeros((len(words), longest + 1), np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, flat), len(self.alphabet) - 1)
        known = np.where(self.alphabet[at] == flat, at + 1, 0)
        codes[np.arange(longest + 1) < size[:, None]] = known
        out = {}
        for i in range(longest):
            live = np.flatnonzero(size > i)
            node = np.zeros(len(live), np.int64)
            out[i, i + 1] = (live, np.full(len(live), self.size))
            for j in range(i, min(longest, i + PIECE)):
                key = node * self.width + codes[live, j]
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = (self.keys[k] == key) & (codes[live, j] > 0)
                live, node = live[ok], self.child[k[ok]]
                if not len(live):
                    break
                piece = self.ends[node]
                has = piece >= 0
                if has.any():
                    w, p = live[has], piece[has]
                    if j == i:  # a letter that is a piece stands for itself
                        own = out[i, i + 1]
                        own[1][np.searchsorted(own[0], w)] = p
                    else:
                        out[i, j + 1] = (w, p)
        return size, out


def trie(path: str) -> Trie:
    if path not in _TRIES:
        _TRIES[path] = Trie(path)
    return _TRIES[path]


def forward(size, spans, prob: np.ndarray) -> np.ndarray:
    """alpha[word, place, language]: the sum over segmentations up to there."""
    longest = int(size.max(initial=0))
    alpha = np.zeros((len(size), longest + 1, prob.shape[1]))
    alpha[:, 0] = 1
    for j in range(1, longest + 1):
        for i in range(max(0, j - PIECE), j):
            got = spans.get((i, j))
            if got is not None:
                alpha[got[0], j] += alpha[got[0], i] * prob[got[1]]
    return alpha


def expected(words: list[str], counts: np.ndarray, tree: Trie, prob: np.ndarray) -> np.ndarray:
    """Expected piece counts per language over all segmentations of words that
    a language has ``counts`` of."""
    size, spans = tree.matches(words)
    alpha = forward(size, spans, prob)
    beta = np.zeros_like(alpha)
    beta[np.arange(len(size)), size] = 1
    for i in range(alpha.shape[1] - 2, -1, -1):
        for j in range(i + 1, min(alpha.shape[1], i + PIECE + 1)):
            got = spans.get((i, j))
            if got is not None:
                beta[got[0], i] += beta[got[0], j] * prob[got[1]]
    weight = counts / alpha[np.arange(len(size)), size]
    out = np.zeros_like(prob)
    for (i, j), (w, p) in spans.items():
        part = alpha[w, i] * prob[p] * beta[w, j] * weight[w]
        for k in range(prob.shape[1]):
            out[:, k] += np.bincount(p, part[:, k], minlength=len(prob))
    return out


def words_of(text: str) -> list[bytes]:
    """Lower-case words; what is not ASCII belongs to a word."""
    return text.lower().encode().translate(_CUT).split()


def letters(word: bytes) -> list[str]:
    """The word's letters, cut to WORD at most each."""
    w = "".join(filter(str.isalpha, word.decode()))
    return [w[i:i + WORD] for i in range(0, len(w), WORD)]


def remainder(id_: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit(""))), F.lit(4))


def learn(docs: DataFrame, vocab_path: str, learn_rows: int = LEARN) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (piece, language) from documents
    (id, text, lang) whose remainder is not 2.

    The fit reads about ``learn_rows`` documents of a language, chosen by a hash
    of the id; what comes to the driver is one number per piece and language."""
    rows = docs.where((remainder(F.col("id")) != 2) & F.col("lang").isNotNull())
    share = {r["lang"]: min(1.0, learn_rows / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(share)
    tree = trie(vocab_path)
    prob = np.full((tree.size + 1, len(langs)), 1 / (tree.size + 1))
    if not langs:
        return langs, prob
    rate = F.create_map(*[F.lit(x) for k in langs for x in (k, share[k] * 1e6)])[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < rate).select("lang", F.coalesce("text", F.lit("")).alias("t"))

    def split(it):
        for b in slices(it):
            seen: dict[tuple, int] = {}
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for x in words_of(t):
                    seen[lang, x] = seen.get((lang, x), 0) + 1
            out: dict[tuple, int] = {}
            for (lang, x), n in seen.items():
                for w in letters(x):
                    out[lang, w] = out.get((lang, w), 0) + n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()),
                                              pa.array(list(out.values()), pa.int64())], ["lang", "w", "n"])

    counts = materialize(chosen.mapInArrow(split, "lang string, w string, n bigint").groupBy("lang", "w").agg(F.sum("n").alias("n")),
                         "learned-words")
    for _ in range(ROUNDS):
        bc = docs.sparkSession.sparkContext.broadcast(prob)

        def step(it, bc=bc):
            tree, prob = trie(vocab_path), bc.value
            total = np.zeros_like(prob)
            for b in slices(it, 20_000):
                at = np.array([langs.index(x) for x in b.column(0).to_pylist()], np.int64)
                words = b.column(1).to_pylist()
                n = np.zeros((len(words), len(langs)))
                n[np.arange(len(words)), at] = b.column(2).to_numpy(zero_copy_only=False)
                total += expected(words, n, tree, prob)
            p, k = total.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(total[p, k])], ["p", "k", "x"])

        got = counts.mapInArrow(step, "p int, k int, x double").groupBy("p", "k").agg(F.sum("x").alias("x")).toArrow()
        fresh = np.full_like(prob, SMOOTH)
        fresh[got.column(0).to_numpy(), got.column(1).to_numpy()] += got.column(2).to_numpy()
        prob = fresh / fresh.sum(axis=0)
        bc.unpersist()
    return langs, prob


class Scorer:
    """Log probabilities of words per language, kept in a bounded table."""

    def __init__(self, path: str, prob: np.ndarray):
        self.tree, self.prob = trie(path), prob
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((CACHE * 2, prob.shape[1]), np.float32)
        self.lettered = np.zeros(CACHE * 2, bool)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the summed log probabilities, and whether it has a letter."""
        out, has = np.zeros((len(texts), self.prob.shape[1])), np.zeros(len(texts), bool)
        parts, many = [], 0
        for i, t in enumerate(texts):
            words = words_of(t)
            for a in range(0, len(words), CACHE // 2):
                parts.append((i, words[a:a + CACHE // 2]))
                many += len(parts[-1][1])
                if many > CACHE // 2:
                    self._sum(parts, out, has)
                    parts, many = [], 0
        self._sum(parts, out, has)
        return out, has

    def _sum(self, parts, out, has):
        """Look new words up for all parts at once, then add up each part."""
        fresh = dict.fromkeys(w for _, x in parts for w in x if w not in self.at)
        if len(self.at) + len(fresh) > CACHE:
            self.at.clear()
            fresh = dict.fromkeys(w for _, x in parts for w in x)
        self._add(list(fresh))
        for i, x in parts:
            rows = np.fromiter(map(self.at.__getitem__, x), np.int64, len(x))
            out[i] += self.rows[rows].sum(axis=0, dtype=np.float64)
            has[i] |= bool(self.lettered[rows].any())

    def _add(self, words: list[bytes]):
        cut = [(k, x) for k, w in enumerate(words) for x in letters(w)]
        logs, known = np.zeros((len(words), self.prob.shape[1])), np.zeros(len(words), bool)
        for a in range(0, len(cut), 20_000):
            part = cut[a:a + 20_000]
            size, spans = self.tree.matches([x for _, x in part])
            alpha = forward(size, spans, self.prob)
            own = np.array([k for k, _ in part])
            np.add.at(logs, own, np.log(alpha[np.arange(len(size)), size]))
            known[own] = True
        start = len(self.at)
        self.rows[start:start + len(words)] = logs
        self.lettered[start:start + len(words)] = known
        self.at.update(zip(words, range(start, start + len(words)), strict=True))


def identify(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             learn_rows: int = LEARN) -> DataFrame:
    """Per document: ``id_col``, held_out (crc32 of the id as text, modulo 4, is
    2), lang_pred, score (the prediction's share of the probability).

    Predictions use the text alone.  ``und`` with score 0 if the text is null or
    has no letter, or if nothing could be learned.  A null id counts as an empty
    string; ties go to the language first in order; repeated rows each give a
    row; an empty table gives none; other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    langs, prob = learn(src, vocab_path, learn_rows)
    bc = src.sparkSession.sparkContext.broadcast(prob)

    def run(it):
        scorer, names = None, [*langs, "und"]
        for b in _batches(slices(it, 512)):
            texts = b.column(2).to_pylist()
            if langs:
                scorer = scorer or Scorer(vocab_path, bc.value)
                logs, has = scorer.score(texts)
                best = logs.argmax(axis=1)
                share = 1 / np.exp(np.minimum(logs - logs.max(axis=1, keepdims=True), 0)).sum(axis=1)
                best, share = np.where(has, best, len(langs)), np.where(has, share, 0.0)
            else:
                best, share = np.zeros(len(texts), int), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([names[k] for k in best.tolist()], pa.string()),
                                              pa.array(share, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    out = src.select("id", (remainder(F.col("id")) == 2).alias("held_out"), F.coalesce("text", F.lit("")).alias("t"))
    return (out.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double")
            .withColumnRenamed("id", id_col))


def _batches(it):
    return (b for b in it if b.num_rows)
