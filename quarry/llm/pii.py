"""Operator 13: personal data, also where it is disguised.

Base identifiers are found in the source text.  Besides, transducers rewrite the
text: look-alike characters, digits spelled as words, "(at)" and "dot" and their
like.  Each keeps, for every character it writes, the source characters it
stands for, so that identifiers that the same detectors find in the rewritten
text are mapped back to spans of the source.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")

# ---------------------------------------------------------------- detectors

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits that fails at its first digit fails at all of them.
_DOTS = re.compile(r"\.[0-9]++\.[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = {c: None for c in range(128) if not 48 <= c <= 57}


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, in time linear in the text: from each @ to both sides."""
    lo, at = 0, text.find("@")
    while at >= 0:
        before = text[lo:at]
        start = lo + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        lo = m.end() if m else at + 1
        at = text.find("@", lo)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text) if _DOTS.search(text) else ():
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 4 and int(p or "0") <= 255 for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m.group().translate(_NO_DIGIT)
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(m.group().translate(_NO_DIGIT)) <= 15:
            yield m.span()


_DETECT = (emails, ips, cards, phones)
_DIGIT = re.compile("[0-9]")


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind and start."""
    out = [(0, *s) for s in emails(text)]
    if _DIGIT.search(text):
        out += [(k, *s) for k in (1, 2, 3) for s in _DETECT[k](text)]
    return out


# ---------------------------------------------------------------- transducers

#: Letters of other scripts that look like the Latin letter below them.
_LOOKS = ("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧονɡı",
          "ABESIJKMHOPCTYXaesijopcyxdqwhABEZHIKMNOPTYXovgi")
#: Signs that stand for the one below them.
_SIGNS = ("‐‑‒–—−﹣。․·｡﹒﹫＋﹢", "-------....@++")
#: Characters without width, dropped.
_HIDDEN = "­​‌‍⁠﻿"
#: Words for the digits 0 to 9 in English, French, German and Spanish.
_DIGITS = ("zero zéro null cero", "one un une eins uno", "two deux zwei zwo dos", "three trois drei tres",
           "four quatre vier cuatro", "five cinq fünf cinco", "six sechs seis", "seven sept sieben siete",
           "eight huit acht ocho", "nine neuf neun nueve")
#: Top-level names that end an address which is told in bare words.
_TOP = ("com|org|net|edu|gov|mil|info|biz|io|co|ai|app|dev|eu|uk|de|fr|es|nl|ca|au|ch|jp|cn|br|mx|ru|tv|pl|se|dk|fi|pt|cz|kr|nz|ie|example|test")
_AT, _DOT, _PLUS = "at|arobase|arroba|ät", "dot|point|punkt|punto", "plus|más"


def _characters() -> dict[int, str]:
    """One character for one: compatibility forms of ASCII, decimal digits and
    spaces of all scripts, look-alikes and signs."""
    out = {}
    for c in (*range(0x80, 0x10000), *range(0x1D400, 0x1D800)):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Nd":
            out[c] = str(unicodedata.decimal(ch))
        elif kind == "Zs":
            out[c] = " "
        elif kind not in ("No", "Cs"):
            plain = unicodedata.normalize("NFKC", ch)
            if len(plain) == 1 and " " < plain <= "~":
                out[c] = plain
    for odd, plain in (_LOOKS, _SIGNS):
        out.update({ord(a): b for a, b in zip(odd, plain)})
    return out


_CHARACTERS = _characters()
_ODD = frozenset(map(chr, _CHARACTERS)) | frozenset(_HIDDEN)
_DROP = re.compile(f"[{_HIDDEN}]+")
_WORD_DIGIT = {w: str(d) for d, words in enumerate(_DIGITS) for w in words.split()}
_SPELLED = "|".join(sorted(_WORD_DIGIT, key=len, reverse=True))
#: Four or more digits in a row, of which one at least is spelled, with points among them.
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:{_SPELLED}|[0-9]+)(?:[ ,-]{{1,2}}(?:{_SPELLED}|[0-9]+|{_DOT})(?!\w))++", re.I)
_RUN_PART = re.compile(rf"([ ,-]*)(?:({_SPELLED})|([0-9]+)|({_DOT}))(?!\w)", re.I)
_PLUS_SIGN = re.compile(rf"(?<!\w)(?:{_PLUS})[ ]+(?=[0-9])", re.I)
_LETTER_DIGITS = re.compile(r"(?<![A-Za-z0-9])(?:[0-9]+[OolI]|[OolI]+[0-9])[0-9OolI]*+(?![A-Za-z0-9])"
                            r"|(?<=[0-9]\.)[OolI](?![A-Za-z0-9])|(?<![A-Za-z0-9])[OolI](?=\.[0-9])")
_LETTER_DIGIT = str.maketrans("OolI", "0011")
_OPEN, _CLOSE = r"[ \t]{0,3}[(\[{<][ \t]{0,3}", r"[ \t]{0,3}[)\]}>][ \t]{0,3}"
_BRACKETS = re.compile(rf"{_OPEN}(?:({_AT}|@)|({_DOT}|\.)){_CLOSE}", re.I)
_DIGIT_DOT = re.compile(rf"(?<=[0-9])[ ]+(?:{_DOT})[ ]+(?=[0-9])", re.I)
_LABEL = r"[A-Za-z0-9-]+"
_SAID_HOST = rf"{_LABEL}(?:(?:\.|[ ]+(?:{_DOT})[ ]+){_LABEL})*(?:\.|[ ]+(?:{_DOT})[ ]+)(?:{_TOP})(?![A-Za-z0-9-])"
_SAID_AT = re.compile(rf"(?<=[A-Za-z0-9])[ ]+(?:{_AT})[ ]+(?={_SAID_HOST})", re.I)
_HOST, _SAID_DOMAIN = re.compile(_SAID_HOST, re.I), re.compile(f"@{_SAID_HOST}", re.I)
_SAID_DOT = re.compile(rf"[ ]+(?:{_DOT})[ ]+", re.I)
_DOT_BEFORE = re.compile(rf"[ ]{{1,3}}(?:{_DOT})[ ]{{1,3}}\Z", re.I)
#: What a lower-cased text must have for a transducer of words to rewrite it.
_SAID = tuple(f" {w} " for w in _DOT.split("|"))
_BRACKETED = re.compile(rf"[(\[{{<][ \t]{{0,3}}(?:{_AT}|{_DOT}|@|\.)[ \t]{{0,3}}[)\]}}>]")
_LETTER_NEAR = re.compile(r"(?<=[OolI])[0-9]|(?<=[OolI]\.)[0-9]|[0-9]\.?[OolI]")


def look_odd(text: str) -> bool:
    return not text.isascii() and not _ODD.isdisjoint(set(text))


def disguises(text: str) -> bool:
    """Whether a transducer of words may rewrite the text: cheap tests that none
    of their patterns passes by."""
    low = text.lower()
    if any(w in low for w in _SAID) or _BRACKETED.search(low) or _LETTER_NEAR.search(text):
        return True
    words = low.replace("-", " ").replace(",", " ").split()
    spelled = [i for i, w in enumerate(words) if w in _WORD_DIGIT]
    return any(w in _WORD_DIGIT or w[0].isdecimal() for i in spelled for w in words[max(0, i - 1):i] + words[i + 1:i + 2])


class Rewritten:
    """A text and, of each of its characters, the source characters it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text))
        self.ends = self.starts + 1

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace stretches (start, end, new), in order and apart from each other;
        each new character stands for all that the stretch stood for."""
        if not edits:
            return
        pieces, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            pieces += [self.text[at:a], new]
            starts += [self.starts[at:a], np.full(len(new), self.starts[a])]
            ends += [self.ends[at:a], np.full(len(new), self.ends[b - 1])]
            at = b
        self.text = "".join([*pieces, self.text[at:]])
        self.starts = np.concatenate([*starts, self.starts[at:]])
        self.ends = np.concatenate([*ends, self.ends[at:]])

    def disguised(self, at: int) -> bool:
        """Whether the character stands for more than one of the source."""
        return self.ends[at] - self.starts[at] > 1

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())


def look_alikes(t: Rewritten) -> None:
    """Characters that look like ASCII ones, and characters without width."""
    if look_odd(t.text):
        t.text = t.text.translate(_CHARACTERS)
        t.edit([(*m.span(), "") for m in _DROP.finditer(t.text)])


def letter_digits(t: Rewritten) -> None:
    """O, o, l and I among digits."""
    t.text = _LETTER_DIGITS.sub(lambda m: m.group().translate(_LETTER_DIGIT), t.text)


def spelled_digits(t: Rewritten) -> None:
    """Runs of four or more digits that are spelled, with points and a plus sign."""
    edits = []
    for run in _SPELLED_RUN.finditer(t.text):
        found, at = [], run.start()
        while at < run.end() and (m := _RUN_PART.match(t.text, at, run.end())):
            found.append(m)
            at = m.end()
        if sum(1 for m in found if m.group(2)) >= 1 and sum(len(m.group(3) or "1") for m in found if not m.group(4)) >= 4:
            for k, m in enumerate(found):
                new = _WORD_DIGIT[m.group(2).lower()] if m.group(2) else m.group(3) or "."
                # A separator stays between two numbers that are both written in digits.
                a = m.start() if k and not (m.group(3) and found[k - 1].group(3)) else m.start() + len(m.group(1))
                edits.append((a, m.end(), new))
    t.edit(edits)
    t.edit([(*m.span(), "+") for m in _PLUS_SIGN.finditer(t.text) if t.disguised(m.end())])


def at_and_dot(t: Rewritten) -> None:
    """(at), [dot] and their like anywhere; the bare words only where they make a
    whole address: "name at host dot org"."""
    t.edit([(*m.span(), "@" if m.group(1) else ".") for m in _BRACKETS.finditer(t.text)])
    t.edit([(*m.span(), ".") for m in _DIGIT_DOT.finditer(t.text)])


    def bare(m: re.Match) -> bool:
        host = _HOST.match(t.text, m.end())
        return _SAID_DOT.search(host.group()) is not None or any(
            t.disguised(host.start() + k) for k, c in enumerate(host.group()) if c == ".")

    t.edit([(*m.span(), "@") for m in _SAID_AT.finditer(t.text) if bare(m)])
    t.edit([(m.start() + d.start(), m.start() + d.end(), ".") for m in _SAID_DOMAIN.finditer(t.text)
            for d in _SAID_DOT.finditer(m.group())])
    t.edit([(*d, ".") for d in _dots_before(t)])


def _dots_before(t: Rewritten) -> list[tuple[int, int]]:
    """Spelled dots in the local parts before disguised @ signs."""
    out, lo, at = [], 0, t.text.find("@")
    while at >= 0:
        found, s = [], at
        while t.disguised(at):
            first = s
            while s > lo and t.text[s - 1] in _LOCAL:
                s -= 1
            m = _DOT_BEFORE.search(t.text, max(lo, s - 16), s) if s < first else None
            if not m or m.start() == lo or t.text[m.start() - 1] not in _LOCAL:
                break
            found.append(m.span())
            s = m.start()
        out += found[::-1]
        lo, at = at + 1, t.text.find("@", at + 1)
    return out


TRANSDUCERS: tuple[Callable[[Rewritten], None], ...] = (look_alikes, letter_digits, spelled_digits, at_and_dot)


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans of the source, and further ones of its rewriting that no base span
    of their kind holds; (kind number, start, end) by kind and start."""
    base = detect(text)
    if not look_odd(text) and not disguises(text):
        return base, []
    t = Rewritten(text)
    for rewrite in TRANSDUCERS:
        rewrite(t)
    if t.text == text:
        return base, []
    held = [[s for k, *s in base if k == kind] for kind in range(len(KINDS))]
    more = set()
    for kind, a, b in detect(t.text):
        a, b = t.source(a, b)
        # The last base span that does not start after a; spans of a kind are apart.
        k = _last(held[kind], a)
        if k < 0 or held[kind][k][1] < b:
            more.add((kind, a, b))
    return base, sorted(more)


def _last(spans: list[list[int]], at: int) -> int:
    lo, hi = 0, len(spans)
    while lo < hi:
        mid = (lo + hi) // 2
        if spans[mid][0] <= at:
            lo = mid + 1
        else:
            hi = mid
    return lo - 1


# ---------------------------------------------------------------- Spark


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, spans (array of kind, start, end, base; by kind as in
    KINDS, then start, then end).  Places are code points of the text, the end
    exclusive; base spans match in the text itself, the others in its rewriting.

    A null or empty text has no spans; a null id is passed on; repeated rows each give
    a row; spans of different kinds, or a longer one of a rewriting over a base
    span, may overlap; an empty table gives none; other columns are not read.  Texts
    are taken whole, in time linear in their length; a text that is rewritten takes
    some 40 bytes more a character, so very long ones need room in one task.  One
    pass, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(it):
        for b in slices(it):
            rows = []
            for text in b.column(1).to_pylist():
                base, more = find(text) if text else ([], [])
                found = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": own} for k, s, e, own in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(span))], ["id", "spans"])

    out = src.mapInArrow(run, f"id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, base: boolean>>")
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns, with each stretch of ``text_col`` that spans cover replaced by the
    kind of its first span in square brackets; null texts stay null, rows of equal
    id are held apart by carrying the whole row."""
    row = F.struct(*[docs[c] for c in docs.columns])
    found = personal_data(docs.select(row.alias("id"), F.col(text_col).alias("t")), "id", "t")
    # Spans of all kinds by start; those that overlap are one stretch.
    merged = F.aggregate(
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"]))),
        F.array().cast("array<struct<start: bigint, end: bigint, kind: string>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                F.element_at(acc, -1)["kind"].alias("kind"))))).otherwise(F.concat(acc, F.array(s))))
    text = F.col(f"id.{text_col}")
    cut = F.aggregate("__m", F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("at")), lambda acc, s: F.struct(
        F.concat(acc["t"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"],
                 F.lit("]")).alias("t"), s["end"].alias("at")))
    out = found.withColumn("__m", merged).withColumn("__c", F.when(text.isNotNull(), cut))
    clean = F.concat(F.col("__c.t"), F.substring(text, (F.col("__c.at") + 1).cast("int"), F.lit(2**31 - 1)))
    return out.select(*[(clean if c == text_col else F.col(f"id.`{c}`")).alias(c) for c in docs.columns])


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans, the SHA-256 of their list, and the list of all spans."""
    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str):
        return lambda s: s["base"] & (s["kind"] == kind)

    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        id_col, *[F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
