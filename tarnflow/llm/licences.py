"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then nearest-ancestor inheritance.

Every line of a whole text is a segment (long lines are cut into overlapping windows of ``WINDOW`` words, so a notice inside
a paragraph is one too), compared with every template; a whole text is compared as well. Terms are runs of letters, digits
and non-ASCII characters, A-Z lower-cased. Terms of the templates weigh by their document frequency in all texts, counted in
a pass of its own; other terms weigh 1, as the most frequent ones do. A segment whose template terms can't carry a cosine of
``THRESHOLD`` is skipped; that bound is exact.

A file named LICENSE, COPYING or the like that has a licence, or a text that as a whole is one (``WHOLE``), speaks for its
directory. A file without a licence of its own inherits from the nearest ancestor directory that has one: each directory's
ancestors are joined with the licensed directories, the deepest wins. Ties go to the larger cosine, then the name, then the
path. Nulls and empty texts have no licence of their own; a null path has no directory. Rows may repeat. Other columns stay,
those with an output name are replaced and the text is left behind: it passes no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.llm import common as C

# Notices by which public licences are declared, and beginnings of their texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE for details."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the 3-clause BSD License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License (CC BY 4.0)."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0)."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."),
)
THRESHOLD, WHOLE = 0.6, 0.8
WINDOW = 32
MOST_BROADCAST = 50_000
FILE_NAMES = r"(?i)(^|/)(un)?(licen[cs]es?|copying|copyright|notice)(\.[a-z]+|-[a-z0-9.]+)?$"
FIELDS = "own_licence string, own_similarity double, whole_licence string, whole_similarity double"


def _terms(texts: list[bytes]) -> tuple[C.Words, np.ndarray]:
    w = C.Words(texts, C.WORD, lower=True)
    return w, w.hashes()


class Templates:
    """Unit TF-IDF vectors of the templates over their terms."""

    def __init__(self, frequency: dict[int, int] | None = None, documents: int = 0) -> None:
        found = [_terms([t.encode()])[1] for _, t in TEMPLATES]
        self.terms = np.unique(np.concatenate(found))
        df = np.array([(frequency or {}).get(int(t), 0) for t in self.terms.view(np.int64)], float)
        self.idf = np.log((documents + 1) / (df + 1)) + 1
        self.names = [n for n, _ in TEMPLATES]
        rows = np.zeros((len(found), len(self.terms)))
        for i, hashes in enumerate(found):
            np.add.at(rows[i], np.searchsorted(self.terms, hashes), 1)
        rows *= self.idf
        self.vectors = rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the terms, or -1."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def best(self, segment: np.ndarray, place: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, cosine, template) of the segments whose best cosine reaches ``least``. Each word has a segment and a place."""
        if not len(segment):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        size = len(self.terms)
        other = np.bincount(segment[place < 0], minlength=segment.max() + 1).astype(float)
        keys, counts = np.unique(segment[place >= 0] * size + place[place >= 0], return_counts=True)
        s, t = keys // size, keys % size
        weight = counts * self.idf[t]
        known = np.bincount(s, weight**2, minlength=len(other))
        whole = known + other
        able = np.flatnonzero(known >= least**2 * np.maximum(whole, 1e-12) * (1 - 1e-9))
        able = able[known[able] > 0]
        mine = np.searchsorted(able, s)
        kept = (mine < len(able)) & (able[np.minimum(mine, max(len(able) - 1, 0))] == s) if len(able) else np.zeros(len(s), bool)
        cosines = np.zeros((len(able), len(self.names)))
        for at in range(0, int(kept.sum()), 1 << 15):
            part = np.flatnonzero(kept)[at : at + (1 << 15)]
            np.add.at(cosines, mine[part], weight[part][:, None] * self.vectors[:, t[part]].T)
        cosines /= np.sqrt(whole[able])[:, None]
        top = cosines.argmax(axis=1) if len(able) else np.zeros(0, np.int64)
        value = cosines[np.arange(len(able)), top]
        good = value >= least - 1e-12
        return able[good], value[good], top[good]


def segments(w: C.Words) -> list[np.ndarray]:
    """Numberings of the words by segment: lines, cut each ``WINDOW`` words, and the same cut half a window later."""
    ends = np.cumsum(w.data == ord("\n"))
    line = ends[w.start]
    fresh = np.diff(line, prepend=-1) != 0
    first = np.flatnonzero(fresh)
    at = np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))
    out = []
    for shift in (0, WINDOW // 2):
        cut = fresh | ((at + shift) % WINDOW == 0)
        out.append(np.cumsum(cut) - 1 if len(cut) else np.zeros(0, np.int64))
    return out


def scan_run(texts: list[bytes], templates: Templates) -> list[tuple[str | None, float | None, str | None, float | None]]:
    """Of each text: the best licence of its segments and of the text as a whole."""
    w, hashes = _terms(texts)
    place = templates.places(hashes)
    own: dict[int, tuple[float, str]] = {}
    for numbering in segments(w):
        owner = np.zeros(int(numbering.max(initial=-1)) + 1, np.int64)
        owner[numbering] = w.doc
        for s, value, top in zip(*templates.best(numbering, place, THRESHOLD), strict=True):
            found = (-round(float(value), 9), templates.names[top])
            own[int(owner[s])] = min(own.get(int(owner[s]), found), found)
    whole = {int(d): (round(float(v), 9), templates.names[t]) for d, v, t in zip(*templates.best(w.doc, place, WHOLE), strict=True)}
    out = []
    for i in range(len(texts)):
        a, b = own.get(i), whole.get(i)
        out.append((a and a[1], a and -a[0], b and b[1], b and b[0]))
    return out


def _frequencies(files: DataFrame, text: str) -> Templates:
    """Templates weighted by how many of all texts hold each of their terms: (term, texts) is at most a row a term and task."""
    bare = Templates()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(bare.terms), np.int64), 0
        for batch in batches:
            for _, texts in C.runs(batch["text"]):
                w, hashes = _terms(texts)
                place = bare.places(hashes)
                held = np.unique(w.doc[place >= 0] * len(df) + place[place >= 0]) % len(df)
                df += np.bincount(held, minlength=len(df))
                n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([*bare.terms.view(np.int64), None], pa.int64()), pa.array([*df, n], pa.int64())], names=["term", "texts"])

    counted = files.select(F.col(text).alias("text")).mapInArrow(count, "term long, texts long").groupBy("term").agg(F.sum("texts").alias("texts")).collect()
    found = {r.term: r.texts for r in counted}
    return Templates({k: v for k, v in found.items() if k is not None}, found.get(None, 0))


def directory(path: Column) -> Column:
    """The directory of a path; '' for a name alone."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Adds ``licence``, ``similarity``, ``origin`` (own, inherited or null) and ``licence_directory`` (of an inherited one)."""
    kept = [c for c in files.columns if c not in ("licence", "similarity", "origin", "licence_directory", text)]
    inner = files.select(*(F.col(c).alias(f"_in_{i}") for i, c in enumerate(kept)), F.col(path).alias("_path"), F.col(text).alias("_text"))
    shared: Any = files.sparkSession.sparkContext.broadcast(_frequencies(files, text))

    def new(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = [r for _, texts in C.runs(batch["_text"]) for r in scan_run(texts, shared.value)]
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.string(), pa.float64()))]

    found = C.checkpointed(C.mapped(inner, FIELDS, new, ("_text",)))
    found = found.withColumn("_dir", directory(F.col("_path")))
    named = F.col("_path").rlike(FILE_NAMES)
    speaks = F.when(F.col("whole_licence").isNotNull(), F.struct(F.col("whole_similarity").alias("s"), F.col("whole_licence").alias("l"))).when(named & F.col("own_licence").isNotNull(), F.struct(F.col("own_similarity").alias("s"), F.col("own_licence").alias("l")))
    licensed = found.select("_dir", "_path", speaks.alias("x")).filter(F.col("x").isNotNull() & F.col("_dir").isNotNull())
    licensed = licensed.groupBy("_dir").agg(F.min(F.struct((-F.col("x.s")).alias("s"), F.col("x.l").alias("l"))).alias("best")).select(F.col("_dir").alias("_up"), F.col("best.l").alias("_l"), (-F.col("best.s")).alias("_s"))

    # Every directory once, whatever the number of its files, with itself and all its ancestors.
    parts = F.split("_dir", "/")
    ups = F.when(F.col("_dir") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("_up")))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("_up"))))
    above = found.filter(F.col("_dir").isNotNull()).select("_dir").distinct().select("_dir", F.explode(ups).alias("u")).select("_dir", "u.depth", "u._up")
    nearest = above.join(licensed, "_up").groupBy("_dir").agg(F.max(F.struct("depth", "_up", "_l", "_s")).alias("n"))
    # A row a directory below a licence: broadcast up to a counted number, else a join that may split a full directory.
    nearest = C.checkpointed(nearest)
    few = nearest.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    out = found.join(F.broadcast(nearest) if few else nearest, "_dir", "left")
    own = F.coalesce("own_licence", "whole_licence")
    return out.select(
        *(F.col(f"_in_{i}").alias(c) for i, c in enumerate(kept)),
        F.coalesce(own, F.col("n._l")).alias("licence"),
        F.when(own.isNotNull(), F.coalesce("own_similarity", "whole_similarity")).otherwise(F.col("n._s")).alias("similarity"),
        F.when(own.isNotNull(), "own").when(F.col("n").isNotNull(), "inherited").alias("origin"),
        F.when(own.isNull(), F.col("n._up")).alias("licence_directory"),
    )
