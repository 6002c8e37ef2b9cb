"""Operator 7: licence scan by an exact set-similarity join, in DataFrame
functions only.

Phrases are counted in every text.  Besides, all windows of as many words as a
licence template has, whatever line breaks they hold, are joined with the
templates by containment.  Words that tell a notice from others are required.
Template tokens are ordered by
their frequency in all documents, rarest first; a block that has enough of a
template's tokens has one of the template's prefix tokens; blocks are joined on
these, pass the length and positional filters and are verified exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public licence notices that blocks are held against.
TEMPLATES = {
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "bsd-clause": "redistribution and use in source and binary forms with or without modification are permitted "
                  "provided that the following conditions are met",
    "cc-by-nc-4.0-notice": "licensed under cc by nc 4 0",
    "gpl-3-notice": "this work is licensed under the gnu general public license version 3",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                 "associated documentation files",
    "mit-notice": "released under the mit license",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
#: Words without which a window is not the notice, whatever else it shares.
REQUIRED = {"apache-2.0-notice": "apache", "cc-by-nc-4.0-notice": "cc nc", "gpl-3-notice": "gnu general public",
            "mit-notice": "mit", "mpl-2.0-notice": "mozilla"}
#: Least share of a template's tokens that a block must have, in percent.
CONTAINMENT = 80
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal(text: Column) -> Column:
    """Words of the lower-cased text, joined by one space."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.trim(F.regexp_replace(low, _GAP, " "))


def _words(norm: Column) -> Column:
    return F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "))) + 1).cast("long")


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" ")))


def _phrases(d: DataFrame) -> DataFrame:
    """n_base, first_word, last_word and base labels (array) of column norm.

    In ``wide`` each word has a space of its own on both sides, so that places
    of phrases are apart and words before a place are half the spaces there."""
    d = d.withColumn("pad", F.concat(F.lit(" "), "norm", F.lit(" ")))
    hit = None
    for p in PHRASES:
        has = F.contains("pad", F.lit(f" {p} "))
        hit = has if hit is None else hit | has
    d = d.withColumn("wide", F.when(hit, F.concat(F.lit(" "), F.replace("norm", F.lit(" "), F.lit("  ")), F.lit(" ")))).drop("pad")
    wide, total, firsts, lasts, labels = F.col("wide"), F.lit(0), [], [], []
    for p, label in PHRASES.items():
        pat = f" {p.replace(' ', '  ')} "
        n = (F.length(wide) - F.length(F.replace(wide, F.lit(pat)))) / len(pat)
        total = total + F.coalesce(n, F.lit(0))
        firsts.append(F.when(n > 0, _spaces(F.substring_index(wide, pat, 1)) / 2))
        lasts.append(F.when(n > 0, F.col("n_words") - _spaces(F.substring_index(wide, pat, -1)) / 2 - len(p.split())))
        labels.append(F.when(n > 0, F.lit(label)))
    return (d.withColumn("n_base", total.cast("long")).withColumn("first_word", F.least(*firsts).cast("long"))
            .withColumn("last_word", F.greatest(*lasts).cast("long"))
            .withColumn("base", F.array_compact(F.array(*labels))).drop("wide"))


def _template_prefixes(norm: DataFrame, templates: dict[str, str], percent: int) -> list[tuple]:
    """(token, template, place in rare-first order, template's size, least
    common tokens) of prefix tokens.  Frequencies are over all documents; there
    are as many as the fixed templates have tokens."""
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    found = F.array_intersect(F.split("norm", " "), F.array(*[F.lit(w) for w in vocabulary]))
    df = {r["w"]: r["n"] for r in norm.select(F.explode(found).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    out = []
    for name, text in templates.items():
        tokens = sorted(set(text.split()), key=lambda w: (df.get(w, 0), w))
        need = -(-percent * len(tokens) // 100)
        out += [(w, name, i, len(tokens), need) for i, w in enumerate(tokens[:len(tokens) - need + 1])]
    return out


def _blocks(docs: DataFrame, text_col: str, templates: dict[str, str], percent: int, required: dict[str, str]) -> DataFrame:
    """(__k1, __k2, template, share): windows that meet the containment and have
    all words that are required."""
    keys = row_key(F.col("doc"), F.col("raw"))
    d = docs.select(*keys, "raw", normal(F.col("raw")).alias("norm"))
    prefixes = _template_prefixes(d.select("norm"), templates, percent)
    rare = F.array(*[F.lit(w) for w in sorted({p[0] for p in prefixes})])
    # A fixed number of rows: the templates'.
    table = F.broadcast(docs.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(w).alias("token"), F.lit(name).alias("template"), F.lit(i).alias("place"), F.lit(n).alias("size"),
                 F.lit(need).alias("need"), F.array(*[F.lit(x) for x in sorted(set(templates[name].split()))]).alias("tokens"),
                 F.lit(len(templates[name].split())).alias("length"),
                 F.array(*[F.lit(x) for x in sorted(set(required.get(name, "").split()))]).cast("array<string>").alias("asked"))
        for w, name, i, n, need in prefixes]))))
    # The words around each place of a prefix token hold all windows with it.
    # Exploded, so that the split is not repeated for each word.
    longest = max(len(t.split()) for t in templates.values())
    words = (d.where(F.arrays_overlap(F.split("norm", " "), rare))
             .select("__k1", "__k2", F.explode(F.array(F.split("norm", " "))).alias("words")))
    places = F.filter(F.transform("words", lambda x, i: F.struct(x.alias("token"), i.alias("i"))),
                      lambda h: F.array_contains(rare, h["token"]))
    near = words.select("__k1", "__k2", F.inline(F.transform(places, lambda h: F.struct(h["token"].alias("token"), F.slice(
        "words", F.greatest(h["i"] + 2 - longest, F.lit(1)), F.lit(2 * longest - 1)).alias("near")))))
    found = near.join(table, "token").where(F.size(F.array_intersect("near", "tokens")) >= F.col("need"))
    found = found.where(F.size(F.array_except("asked", "near")) == 0)

    def held(i):
        window = F.slice("near", i, F.col("length"))
        return F.when(F.size(F.array_except("asked", window)) == 0, F.size(F.array_intersect(window, F.col("tokens")))).otherwise(0)

    most = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size("near") - F.col("length") + 1, F.lit(1))), held))
    by_window = found.withColumn("most", most).where("most >= need").withColumn("share", F.col("most") / F.col("size"))
    return by_window.select("__k1", "__k2", "template", "share")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 templates: dict[str, str] | None = None, percent: int = CONTAINMENT,
                 required: dict[str, str] | None = None) -> DataFrame:
    """Per document: ``id_col``, n_words, n_base (places of the phrases),
    first_word and last_word (their least and greatest start), base_labels,
    labels (with the names of templates of which a window of the template's length,
    or a shorter text, has ``percent`` of the different words and all that are
    ``required``),
    score (1 with a phrase, else the greatest containment that meets the
    threshold, else 0).

    Null texts are empty; a text without words has no places; ties among
    templates all count; repeated rows each give a row; an empty table gives
    none; other columns are not read.  Of a very long text the words around each
    prefix token are held at once, some 40 words a place."""
    if templates is None:
        templates, required = TEMPLATES, REQUIRED if required is None else required
    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("raw"))
    blocks = materialize(_blocks(src, text_col, templates, percent, required or {}).groupBy("__k1", "__k2").agg(
        F.collect_set("template").alias("more"), F.max("share").alias("share")), "licence-blocks")
    norm = src.select(*row_key(F.col("doc"), F.col("raw")), F.col("doc"), normal(F.col("raw")).alias("norm"))
    base = _phrases(norm.withColumn("n_words", _words(F.col("norm")))).drop("norm")
    out = base.join(blocks, ["__k1", "__k2"], "left")
    return out.select(
        F.col("doc").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
