"""License notices in whole texts, by an exact set-similarity join with templates; DataFrame functions only.

A text block is a window of BLOCK neighbouring words, one from every half BLOCK words on, so a notice of up to half a
block lies whole inside one, however its lines are broken. A block meets a template when it holds at least THRESHOLD of
the template's distinct words. Words of blocks and templates are ordered by how many blocks of the whole corpus hold
them, rarest first. With o the words that a template asks for, both sides meet in the first (size - o + 1) words or not
at all (prefix filter); a block of fewer words than o can't meet it (length filter), nor can one that has too few words
left behind the place where they meet (positional filter). What passes is counted whole.

Words that no template holds never count, so blocks are kept without them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import doc_texts, stored

BLOCK, THRESHOLD = 64, 0.8
#: what parts words, as a Java character class
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Phrase:
    label: str
    words: tuple[str, ...]


@dataclass(frozen=True)
class Template:
    label: str
    text: str

    @property
    def words(self) -> tuple[str, ...]:
        """Distinct words, in order."""
        low = "".join(c if c.isalnum() else " " for c in self.text.lower())
        return tuple(dict.fromkeys(low.split()))

    def asks(self, threshold: float) -> int:
        return max(1, math.ceil(threshold * len(self.words) - 1e-9))


# fixed values: the base phrases, and sentences of public licenses and notices of at most half a block
BASE = (
    Phrase("mit", ("mit", "license")),
    Phrase("apache", ("apache", "license")),
    Phrase("gpl", ("general", "public", "license")),
)
TEMPLATES = (
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                    "associated documentation files, to deal in the Software without restriction"),
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("gpl", "licensed under the GNU General Public License, version 3"),
    Template("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                    "published by the Free Software Foundation"),
    Template("lgpl", "licensed under the GNU Lesser General Public License"),
    Template("agpl", "licensed under the GNU Affero General Public License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met"),
    Template("mpl", "subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("warranty", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; the plain function does it where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _with(value: Column, use) -> Column:
    """use(value), where value is made once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _places(words: Column, phrases: tuple[Phrase, ...]) -> Column:
    """(word, label number) of every place where a phrase stands."""

    firsts = [p.words[0] for p in phrases]
    starts = F.filter(F.transform(words, lambda w, i: F.when(w.isin(firsts), i)), lambda i: i.isNotNull())

    def of(phrase: Phrase, label: int) -> Column:
        def stands(i: Column) -> Column:
            out = F.lit(True)
            for k, word in enumerate(phrase.words):
                out = out & F.get(words, i + k).eqNullSafe(F.lit(word))
            return out

        return F.transform(F.filter(starts, stands), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    return F.concat(*[of(phrase, label) for label, phrase in enumerate(phrases)])


def _blocks(words: Column, vocabulary: list[str], least: int, block: int) -> Column:
    """(number, distinct template words) of the blocks that hold at least `least` of them."""
    half = block // 2
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(words) - 1) / half)).cast("int"))
    made = F.transform(numbers, lambda k: F.struct(
        k.alias("number"),
        F.array_distinct(F.filter(F.slice(words, k * half + 1, F.lit(block)), lambda w: w.isin(vocabulary))).alias("words")))
    return F.filter(made, lambda b: F.size(b["words"]) >= least)


def license_scan(
    docs: DataFrame,
    phrases: tuple[Phrase, ...] = BASE,
    templates: tuple[Template, ...] = TEMPLATES,
    block: int = BLOCK,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: doc_id, n_words, places, met.

    places: (at, label) of every place of a phrase, at the number of its first word. met: (label, block, overlap, size)
    of every template that a block meets; several templates of a label and both blocks that hold a notice each count.
    Null and empty texts have no words and empty lists. Rows are judged each on its own, whatever their ids.
    """
    for template in templates:
        if not template.words or len(template.text.split()) > block // 2:
            raise ValueError(f"a template needs 1 to {block // 2} words: {template.text!r}")
    vocabulary = sorted({w for t in templates for w in t.words})
    least = min(t.asks(threshold) for t in templates)
    words = F.filter(F.split(lower_ascii(F.col("text")), GAP), lambda w: w != "")
    view = _with(words, lambda ws: F.struct(
        F.size(ws).alias("n_words"), _places(ws, phrases).alias("places"), _blocks(ws, vocabulary, 1, block).alias("blocks")))
    rows = doc_texts(docs).select("doc_id", view.alias("v")).select("doc_id", "v.*")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "license-blocks")
    blocks = rows.select("row", F.inline("blocks"))
    found = _joined(blocks, templates, vocabulary, least, threshold)
    met = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", "block", "overlap", "size"))).alias("met"))
    empty = F.array().cast("array<struct<label: string, block: int, overlap: int, size: int>>")
    out = rows.select("row", "doc_id", "n_words", "places").join(met, "row", "left")
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "places", F.coalesce("met", empty).alias("met"))


def _joined(blocks: DataFrame, templates: tuple[Template, ...], vocabulary: list[str], least: int, threshold: float) -> DataFrame:
    """(row, block, label, overlap, size) of every block and template that meet."""
    spark = blocks.sparkSession
    counts = blocks.select(F.explode("words").alias("word")).groupBy("word").count()
    held = {r["word"]: r["count"] for r in counts.collect()}  # one row for each template word at most
    order = sorted(vocabulary, key=lambda w: (held.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    index, wholes = [], []
    for number, template in enumerate(templates):
        ranked = sorted(template.words, key=rank.__getitem__)
        asks = template.asks(threshold)
        wholes.append((number, template.label, asks, ranked))
        index += [(word, number, place, asks, len(ranked)) for place, word in enumerate(ranked[: len(ranked) - asks + 1])]
    index = spark.createDataFrame(index, "word string, template int, place int, asks int, size int")
    wholes = spark.createDataFrame(wholes, "template int, label string, asks int, ranked array<string>")
    opening = sorted({r["word"] for r in index.collect()})
    ranked = F.array_intersect(F.array(*map(F.lit, order)), "words")
    sets = blocks.where(F.size("words") >= least).select("row", F.col("number").alias("block"), ranked.alias("words"))
    # of a block's prefix under the least a template asks for, the words that open a template
    prefix = F.transform(F.slice("words", 1, F.size("words") - least + 1), lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    prefix = F.filter(prefix, lambda p: p["word"].isin(opening))
    met = sets.select("row", "block", "words", F.size("words").alias("n"), F.inline(prefix))
    met = met.join(F.broadcast(index), "word")  # both tables have a row for each word of the templates at most
    met = met.where(
        (F.col("n") >= F.col("asks"))
        & (F.col("at") <= F.col("n") - F.col("asks"))
        & (F.least(F.col("n") - F.col("at"), F.col("size") - F.col("place")) >= F.col("asks"))
    )
    pairs = met.join(F.broadcast(wholes.drop("asks")), "template")
    pairs = pairs.withColumn("overlap", F.size(F.array_intersect("words", "ranked"))).where("overlap >= asks")
    return pairs.select("row", "block", "template", "label", "overlap", "size").distinct()


def base_labels(places: Column, phrases: tuple[Phrase, ...] = BASE) -> Column:
    names = F.array(*[F.lit(p.label) for p in phrases])
    return F.array_sort(F.array_distinct(F.transform(places, lambda p: F.get(names, p["label"]))))


def score(places: Column, met: Column) -> Column:
    """1 where a base phrase stands, else the largest share of a template that a block holds, else 0."""
    shares = F.transform(met, lambda m: m["overlap"] / m["size"])
    return F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(shares), F.lit(0.0)))
