"""Licence scans: sparse TF-IDF cosine of lines and whole files to templates, then nearest-ancestor inheritance.

A line, a run of two or three lines (notices are wrapped) or a whole file and a template are vectors
of log(1 + uses) times inverse document frequency, counted over all files.  A whole file that matches
a notice or the full text of a licence (licence_texts/) is a licence file and covers its directory; a file without a header of its own inherits from the nearest ancestor
directory that has one, found by joining directories with the prefixes of their paths.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small
from .words import Words, pieces

#: Licence names and the notices and openings that are looked for.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Proprietary", "All rights reserved."),
)
#: Full texts of licences, for whole files.
TEXTS = tuple((f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))
THRESHOLD = 0.75
#: Lines of the longest run that is compared.
RUN = 3

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _tokens(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), _WORD).hash


class Matcher:
    """Cosines to the templates, with idf known for their words; any other word counts as the rarest."""

    def __init__(self, templates, idf: dict[int, float], rare: float, threshold: float):
        self.names = sorted({n for n, _ in templates})
        self.name_of = np.array([self.names.index(n) for n, _ in templates])
        self.vocabulary = np.array(sorted(idf), np.uint64)
        self.idf = np.array([idf[h] for h in sorted(idf)])
        self.rare, self.threshold = rare, threshold
        self.weights = np.zeros((len(self.vocabulary), len(templates)))
        for k, (_, text) in enumerate(templates):
            h, n = np.unique(_tokens(text), return_counts=True)
            at = np.searchsorted(self.vocabulary, h)
            self.weights[at, k] = np.log1p(n) * self.idf[at]
        self.weights /= np.sqrt((self.weights**2).sum(0))
        # Words so common that a line of only such words stays below the threshold with every template.
        order = np.argsort(self.idf, kind="stable")
        mass = np.cumsum(self.weights[order] ** 2, 0).max(1)
        self.telling = np.ones(len(order), bool)
        self.telling[order[mass < threshold**2 * 0.999]] = False

    def look_up(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place in the vocabulary, whether it is there) of each word."""
        at = np.minimum(np.searchsorted(self.vocabulary, w.hash), len(self.vocabulary) - 1)
        return at, self.vocabulary[at] == w.hash

    def best(self, hashes: np.ndarray, at: np.ndarray, known: np.ndarray, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(best template or -1, cosine) of each of n units of words; unit holds each word's unit, ascending."""
        best, cos = np.full(n, -1), np.zeros(n)
        rows = np.unique(unit[known & self.telling[at]])
        if not len(rows):
            return best, cos
        place = np.full(n, -1)
        place[rows] = np.arange(len(rows))
        use = np.flatnonzero(place[unit] >= 0)
        row, h, a, k = place[unit[use]], hashes[use], at[use], known[use]
        order = np.lexsort((h, row))
        row, h, a, k = row[order], h[order], a[order], k[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]))
        tf = np.log1p(np.diff(np.append(new, len(h))))
        row, a, k = row[new], a[new], k[new]
        value = tf * np.where(k, self.idf[a], self.rare)
        norm = np.sqrt(np.bincount(row, value**2, minlength=len(rows)))
        dot = np.column_stack([np.bincount(row[k], value[k] * self.weights[a[k], t], minlength=len(rows)) for t in range(self.weights.shape[1])])
        dot /= norm[:, None]
        best[rows], cos[rows] = dot.argmax(1), dot.max(1)
        best[cos < self.threshold] = -1
        return best, cos


def _runs(match: Matcher, w: Words, at: np.ndarray, known: np.ndarray, line_doc: np.ndarray, best: np.ndarray, cos: np.ndarray) -> None:
    """Put runs of lines that match, of which no line and no shorter run does, into best and cos at their first line."""
    n = len(line_doc)
    telling = np.zeros(n, bool)
    telling[w.doc[known & match.telling[at]]] = True
    docs = np.unique(line_doc[telling])
    if not len(docs):
        return
    some = np.isin(line_doc, docs)[w.doc]  # words of rows that have a telling word
    h, a, k, line = w.hash[some], at[some], known[some], w.doc[some]
    order = np.arange(n) - np.searchsorted(line_doc, line_doc)  # a line's place in its row
    taken = best >= 0
    for size in range(2, RUN + 1):
        found = []
        for phase in range(size):
            new = (order % size == phase) | (order == 0)
            unit = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            b, c = match.best(h, a, k, unit[line], len(first))
            lines = np.diff(np.append(first, n))
            hit = np.flatnonzero((b >= 0) & (lines == size))
            found += [(-c[u], first[u], b[u]) for u in hit]
        for c, u, b in sorted(found):
            if not taken[u : u + size].any():
                taken[u : u + size] = True
                best[u], cos[u] = b, -c


def _matchers(files: DataFrame, templates, threshold: float) -> tuple[Matcher, Matcher]:
    """For lines and runs of lines, and for whole files."""
    whole = (*templates, *TEXTS)
    vocabulary = np.unique(np.concatenate([_tokens(t) for _, t in whole]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary), np.int64), 0
        for b in batches:
            n += b.num_rows
            for _, _, data, offs in pieces(b.column(0)):
                w = Words(data, offs, _WORD)
                at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
                ok = vocabulary[at] == w.hash
                df += np.bincount(np.unique(w.doc[ok] * len(vocabulary) + at[ok]) % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(df)), -1], pa.int32()), pa.array([*df.tolist(), n], pa.int64())], names=["w", "n"])

    # as many rows as template words, whatever the size of the corpus
    got = {r.w: r.n for r in files.select("text").mapInArrow(run, "w int, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    n = got.get(-1, 0)
    idf = {int(h): float(np.log((n + 1) / (got.get(k, 0) + 1)) + 1) for k, h in enumerate(vocabulary)}
    # A word outside the templates counts as one that a hundredth of the files use.
    rare = float(np.log(100) + 1)
    own = {int(h) for _, t in templates for h in _tokens(t)}
    return Matcher(templates, {h: v for h, v in idf.items() if h in own}, rare, threshold), Matcher(whole, idf, rare, threshold)


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(file_id, path, license, similarity, n_headers, is_license_file) for rows (file_id, path, text).

    license: the template of the best line or run of up to RUN lines, by cosine, then template order;
    without one, that of the whole file; null without any at or above the threshold.  n_headers counts
    lines, and runs without a line or shorter run that matches.  Null and empty texts match nothing.
    Every line of every file is compared.
    """
    m = files.sparkSession.sparkContext.broadcast(_matchers(files, templates, threshold))
    schema = files.select("file_id", "path").schema.add("license", "string").add("similarity", "double").add("n_headers", "long").add("is_license_file", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, full = m.value
        for b in batches:
            names, cos, heads, whole = [], [], [], []
            for a, e, data, offs in pieces(b.column(2)):
                n = e - a
                lines = np.unique(np.concatenate([offs, np.flatnonzero(data == 10) + 1]))
                if lines[-1] < len(data):
                    lines = np.append(lines, len(data))
                doc = np.searchsorted(offs, lines[:-1], side="right") - 1
                best, c = np.full(len(doc), -1), np.zeros(len(doc))
                all_, sure = np.full(n, -1), np.zeros(n)
                if len(doc) and len((w := Words(data, lines, _WORD)).hash):
                    at, known = match.look_up(w)
                    best, c = match.best(w.hash, at, known, w.doc, len(doc))
                    _runs(match, w, at, known, doc, best, c)
                    all_, sure = full.best(w.hash, *full.look_up(w), doc[w.doc], n)
                hit = best >= 0
                order = np.lexsort((best[hit], -c[hit], doc[hit]))
                d, t, v = doc[hit][order], best[hit][order], c[hit][order]
                first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, int)
                name, sim = np.full(n, -1), np.zeros(n)
                name[d[first]], sim[d[first]] = match.name_of[t[first]], v[first]
                lone = (name < 0) & (all_ >= 0)
                sim[lone] = sure[lone]
                names += [match.names[k] if k >= 0 else full.names[full.name_of[f]] if f >= 0 else None for k, f in zip(name, all_)]
                cos += sim.tolist()
                heads += np.bincount(d, minlength=n).tolist()
                whole += (all_ >= 0).tolist()
            cols = [pa.array(names, pa.string()), pa.array([c if k is not None else None for c, k in zip(cos, names)], pa.float64()), pa.array(heads, pa.int64()), pa.array(whole, pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=schema.fieldNames())

    return files.select("file_id", "path", "text").mapInArrow(run, schema)


def _parent(path):
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(scanned: DataFrame) -> DataFrame:
    """The columns of scan() with effective_license and license_from ('header', 'directory' or null) and license_dir.

    Directories are resolved once each: its prefixes are joined with the directories that hold a
    licence file (best similarity, then path, then smallest file_id), the deepest wins.  A null path
    inherits nothing.  The file join is on the directory; its other side has one row for each.
    """
    files = scanned.withColumn("__dir", _parent(F.col("path")))
    best = F.struct(-F.col("similarity"), F.col("path"), F.col("file_id"), F.col("license").alias("name"))
    # a licence file covers the directory that it lies in
    licensed = files.where("is_license_file AND license IS NOT NULL AND __dir IS NOT NULL").groupBy("__dir").agg(F.min(best)["name"].alias("dir_license"))
    licensed = licensed.select(F.col("__dir").alias("anc"), "dir_license")
    dirs = files.where("__dir IS NOT NULL").select("__dir").distinct()
    parts = F.split("__dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    up = dirs.select("__dir", F.posexplode(F.array_distinct(ancestors)).alias("depth", "anc"))
    found = up.join(small(licensed), "anc").groupBy("__dir").agg(F.max_by(F.struct("anc", "dir_license"), "depth").alias("f"))
    found = found.select("__dir", F.col("f.anc").alias("license_dir"), F.col("f.dir_license").alias("dir_license"))
    out = files.join(small(found), "__dir", "left")
    own = F.col("license").isNotNull()
    return out.select(
        *scanned.columns,
        F.coalesce("license", "dir_license").alias("effective_license"),
        F.when(own, "header").when(F.col("dir_license").isNotNull(), "directory").alias("license_from"),
        F.when(~own, F.col("license_dir")).alias("license_dir"),
    )
