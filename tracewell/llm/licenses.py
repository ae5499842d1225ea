"""Licence notices by diagonal voting.

Every text's rolling word k-gram hashes are joined to the positions of the same grams in the
templates. A hit votes for its diagonal (place in the text minus place in the template);
neighbouring diagonals, which an added or missing word sets apart, are merged; and a merged
span is verified word by word: which words of the template stand in it, how many words it has
besides, and whether the licence's name stands there unchanged. Of spans that overlap, the one
with more words of its template stays. Exact phrases need all grams on one diagonal.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches

#: Fixed phrases, found only as they stand: label, words.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
#: Templates, found also with some words changed: label, text. What stands in brackets names the licence and
#: must stand in the text word by word. Sentences of public licences are fixed values.
TEMPLATES = [
    ("apache-2.0", "licensed under the [apache license version 2 0]"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at [www apache org licenses license 2 0]"),
    ("gpl-3.0", "licensed under the [gnu general public license version 3]"),
    ("gpl-2.0", "licensed under the [gnu general public license version 2]"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the [gnu general public license] as published by the free software foundation either [version 3] of the license or at your option any later version"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the [gnu general public license] as published by the free software foundation either [version 2] of the license or at your option any later version"),
    ("lgpl-3.0", "licensed under the [gnu lesser general public license version 3]"),
    ("agpl-3.0", "licensed under the [gnu affero general public license version 3]"),
    ("cc-by-4.0", "licensed under [cc by 4 0]"),
    ("cc-by-nc", "licensed under [cc by nc 4 0]"),
    ("cc-by-sa", "licensed under [cc by sa 4 0]"),
    ("cc-by-nd", "licensed under [cc by nd 4 0]"),
    ("cc-by-nc-sa", "licensed under [cc by nc sa 4 0]"),
    ("cc-by-nc-nd", "licensed under [cc by nc nd 4 0]"),
    ("cc-by-4.0", "this work is licensed under a [creative commons attribution 4 0] international license"),
    ("cc-by-nc", "this work is licensed under a [creative commons attribution noncommercial 4 0] international license"),
    ("cc-by-sa", "this work is licensed under a [creative commons attribution sharealike 4 0] international license"),
    ("cc-by-nd", "this work is licensed under a [creative commons attribution noderivatives 4 0] international license"),
    ("cc-by-nc-sa", "this work is licensed under a [creative commons attribution noncommercial sharealike 4 0] international license"),
    ("cc-by-nc-nd", "this work is licensed under a [creative commons attribution noncommercial noderivatives 4 0] international license"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the [mit license]"),
    ("mit", "licensed under the [mit license]"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the [mozilla public license v 2 0]"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("no-copying", "no part of this publication may be reproduced or transmitted in any form or by any means"),
]
#: Words in a gram; the shortest phrase has two.
K = 2
#: Words that a span must share with its template, of the longer of the two, and the distance of diagonals that merge.
COVER, NEAR = 0.8, 2
#: Stands for the row itself in the join, so that texts without hits stay.
ROW = 0

WORDS = re.compile(rb"[a-z0-9\x80-\xff]+")


def words(text: str) -> list[bytes]:
    """A-Z in lower case, then runs of ASCII letters, digits and all other than ASCII characters."""
    return WORDS.findall(text.encode().lower())


def grams(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes of all K-grams."""
    out = np.zeros(max(0, len(hashes) - K + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(K):
            out = (out ^ hashes[k : len(out) + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    out[out == ROW] = 1
    return out.view(np.int64)


class Hashes:
    """Word hashes that a Python worker keeps."""

    def __init__(self):
        self.kept: dict[bytes, int] = {}

    def of(self, found: list[bytes]) -> np.ndarray:
        kept = self.kept
        if len(kept) > 1_000_000:
            kept.clear()
        try:
            return np.fromiter(map(kept.__getitem__, found), np.uint64, len(found))
        except KeyError:
            for w in found:
                if w not in kept:
                    kept[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(kept.__getitem__, found), np.uint64, len(found))


@lru_cache(maxsize=1)
def hashes() -> Hashes:
    return Hashes()


def parsed(text: str) -> tuple[str, list[int]]:
    """A template's words, and for each bracket the bits of its grams."""
    plain, names, at = [], [], None
    for word in text.replace("[", " [ ").replace("]", " ] ").split():
        if word == "[":
            at = len(plain)
        elif word == "]":
            names.append(sum(1 << p for p in range(at, len(plain) - K + 1)))
        else:
            plain.append(word)
    return " ".join(plain), names


def template_rows(base: list, templates: list) -> list[tuple[int, int, int]]:
    """(gram, template, place) of all templates, and the row that stands for a text."""
    out = [(ROW, -1, 0)]
    for t, (_, text) in enumerate([*base, *templates]):
        for place, gram in enumerate(grams(Hashes().of(words(parsed(text)[0]))).tolist()):
            out.append((gram, t, place))
    return out


def scan(docs: DataFrame, base: list = BASE, templates: list = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, spans) of every row, with spans a list of (label, exact, first, last, cover):
    label of the template, whether it is a fixed phrase, first and last word (from 0) and the
    words shared with the template, as a share of the longer of the two.

    Null and empty texts have no words and no spans. Rows that repeat, or share an id, are
    scanned each. Templates must have K to 62 words.
    Only the templates (a fixed list) are broadcast; a text's hits alone are gathered.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def start():
        kept = hashes()

        def work(keys, texts):
            out = {"id": keys, "n_words": [], "grams": []}
            for text in texts:
                found = words(text or "")
                out["n_words"].append(len(found))
                out["grams"].append(np.concatenate(([ROW], grams(kept.of(found)))).astype(np.int64))
            return out

        return work

    places = spark.createDataFrame(template_rows(base, templates), "gram long, template int, place int")
    rolled = map_rows(docs, [id_col, text_col], "id long, n_words long, grams array<long>", start, rows=200)
    all_grams = rolled.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "n_words", F.posexplode("grams").alias("pos", "gram"))
    # the templates are a fixed list of at most a few hundred grams
    votes = (
        all_grams.join(F.broadcast(places), "gram")
        .groupBy("row", "id", "n_words", "template", (F.col("pos") - 1 - F.col("place")).alias("diagonal"))
        .agg(F.expr("bit_or(shiftleft(1L, least(place, 62)))").alias("places"))
    )
    per_row = votes.groupBy("row", "id", "n_words").agg(F.sort_array(F.collect_list(F.when(F.col("template") >= 0, F.struct("template", "diagonal", "places")))).alias("hits"))
    labels = [(label, len(words(parsed(t)[0])), exact, parsed(t)[1]) for exact, kind in ((True, base), (False, templates)) for label, t in kind]

    def merge():
        def spans(hits):
            out, found, island = [], [], []

            def close():
                label, n, exact, names = labels[island[0][0]]
                shared = {w for _, _, m in island for p in range(63) if m >> p & 1 for w in (p, p + K - 1)}
                at = [d + p for _, d, m in island for p in range(63) if m >> p & 1]
                first, last = min(at), max(at) + K - 1
                cover = len(shared) / max(n, last - first + 1)
                if exact:
                    if len(shared) == n:
                        out.append((label, exact, first, last, cover))
                elif cover >= COVER and all(any(m & name == name for _, _, m in island) for name in names):
                    found.append((-len(shared), -cover, first, last, label))

            for t, d, m in hits:
                if island and (t != island[0][0] or labels[t][2] or d - island[-1][1] > NEAR):
                    close()
                    island = []
                island.append((t, d, m))
            if island:
                close()
            taken = []
            for _, cover, first, last, label in sorted(found):
                if all(last < a or b < first for a, b in taken):
                    taken.append((first, last))
                    out.append((label, False, first, last, -cover))
            return out

        def work(ids, n, hits):
            out = {k: [] for k in ("id", "n_words", "label", "exact", "first", "last", "cover")}
            for i, k, h in zip(ids, n, hits, strict=True):
                found = spans([(x["template"], x["diagonal"], x["places"]) for x in h])
                out["id"].append(i)
                out["n_words"].append(k)
                for j, name in enumerate(("label", "exact", "first", "last", "cover")):
                    out[name].append([int(s[j]) if name == "exact" else s[j] for s in found])
            return out

        return work

    ddl = "id long, n_words long, label array<string>, exact array<int>, first array<long>, last array<long>, cover array<double>"
    flat = map_rows(per_row, ["id", "n_words", "hits"], ddl, merge)
    zipped = F.arrays_zip("label", "exact", "first", "last", "cover")
    return flat.select(F.col("id").alias(id_col), "n_words", zipped.alias("spans"))
