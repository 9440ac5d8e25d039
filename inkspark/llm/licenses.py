"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

A template is a license notice.  A document's words are cut into windows of
twice the template's length at strides of its length, so every stretch as long
as the template lies whole in some window.  If such a stretch holds at least
``CONTAINMENT`` of the template's m distinct shingles, window and template have a
Jaccard similarity of at least ``CONTAINMENT * m / (all shingles of both)``, and a
band of one MinHash agrees with that probability; the number of bands is the
least for which a match is missed with probability at most ``MISS`` (here the
seed is fixed, so results repeat).  Retrieved windows are verified exactly: the
share of the template's shingles that a stretch of at most ``SLACK`` times its length
holds, and the first and last word of the stretch.  All occurrences that do not
overlap are found.

Templates are notices that come with the code, or a table of whole license texts; they go to the tasks in blocks of
``BLOCK_BYTES`` of text, each block a pass over the documents.  Documents never leave their task, so there is no shuffle and no skew.

Defined results: null, empty and shorter texts match nothing but templates that
fit in them; a template of fewer words than a shingle is one shingle; equal
templates all match; of occurrences that overlap the first counts; rows are
independent, so repeated rows and null ids give rows of their own; very long
texts are scanned whole; columns besides id and text are not looked at.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed
from .textkernel import ALNUM, U, chunks, column, hashes, mix, shingles, words

K = 5
CONTAINMENT = 0.8
MISS = 1e-4
SLACK = 1.25
BLOCK_BYTES = 4_000_000

#: License notices by SPDX name (fixed values: the licenses' own words).
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "GNU General Public License, version 3",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL": "under the terms of the GNU Lesser General Public License",
    "AGPL-3.0": "GNU Affero General Public License",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}


def bands_for(m, window):
    """Bands of one MinHash each for a template of m shingles and windows of ``window``."""
    similarity = CONTAINMENT * m / (m + window - CONTAINMENT * m)
    return max(1, ceil(log(MISS) / log(1 - similarity))) if similarity < 1 else 1


class Template:
    def __init__(self, name, text, k=K):
        data, at = column(pa.array([text], pa.string()))
        starts, ends, w = words(data, at, ALNUM)
        word = hashes(data, starts, ends)
        self.name, self.words = name, len(word)
        self.k = min(k, self.words)
        self.shingles = np.unique(shingles(word, w, self.k)[0])


class Group:
    """Templates of nearly the same length, which share windows and MinHash functions."""

    def __init__(self, templates):
        self.templates, self.k = templates, templates[0].k
        self.stride = max(t.words for t in templates)
        self.window = 2 * self.stride - self.k + 1  # shingles of a window of twice the longest template's words
        bands = max(bands_for(len(t.shingles), self.window) for t in templates)
        self.factors = mix(np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(self.stride)) | U(1)
        self.minima = [[(t.shingles * f).min() for f in self.factors] for t in templates]


def grouped(templates):
    """Groups in which no template is over a third longer than the shortest."""
    out, own = [], []
    for t in sorted((t for t in templates if t.words), key=lambda t: (t.k, t.words)):
        if own and (t.k != own[0].k or 3 * t.words > 4 * own[0].words):
            out.append(Group(own))
            own = []
        own.append(t)
    return [*out, Group(own)] if own else out


def matches(data, at, groups):
    """(doc, template, shared shingles, first word, end word, template's shingles) of all occurrences in one chunk of whole docs."""
    starts, ends, w = words(data, at, ALNUM)
    word = hashes(data, starts, ends)
    found, by_k = [], {}
    for group in groups:
        k, window, stride = group.k, group.window, group.stride
        if k not in by_k:
            by_k[k] = shingles(word, w, k)
        sh, o = by_k[k]
        counts = np.diff(o)
        # windows: every doc's [0, window), [stride, stride + window), ... until its last shingle is in one;
        # a doc of fewer words than a shingle has none that a template has
        per = np.where(np.diff(w) >= k, 1 + np.maximum(0, -(-(counts - window) // stride)), 0)
        total = int(per.sum())
        if not total:
            continue
        doc = np.repeat(np.arange(len(per)), per)
        begin = o[doc] + (np.arange(total) - np.repeat(np.cumsum(per) - per, per)) * stride
        end = np.minimum(begin + window, o[doc + 1])
        edges = np.stack([begin, end], 1).reshape(-1)
        retrieved = [set() for _ in group.templates]
        value = np.full(len(sh) + 1, ~U(0))
        for b, factor in enumerate(group.factors):
            np.multiply(sh, factor, out=value[:-1])
            low = np.minimum.reduceat(value, edges)[::2]
            for g in range(len(retrieved)):
                retrieved[g].update(np.flatnonzero(low == group.minima[g][b]).tolist())
        for t, wins in zip(group.templates, retrieved):
            reach = max(1, int(SLACK * t.words) - k + 1)
            of_doc = {}
            for x in sorted(wins):
                of_doc.setdefault(int(doc[x]), []).append((int(begin[x]), int(end[x])))
            for d, spans in of_doc.items():
                near = np.zeros(int(o[d + 1] - o[d]), bool)
                for b, e in spans:
                    near[b - o[d] : e - o[d]] = True
                held = np.flatnonzero(near)
                held = held[np.isin(sh[o[d] + held], t.shingles)]
                for first, last, shared in occurrences(held, sh[o[d] + held], CONTAINMENT * len(t.shingles), reach):
                    found.append((d, t.name, shared, first, last + k, len(t.shingles)))
    return sorted(found)


def occurrences(places, values, need, reach):
    """(first place, last place, different values) of stretches of less than ``reach`` places that hold ``need`` different values or more.

    Stretches do not overlap; each begins as early as it can, but for places that it does not need, and ends with its last new value.
    """
    i, n = 0, len(places)
    while i < n:
        j = int(np.searchsorted(places, places[i] + reach))
        if j - i < need or len(set(values[i:j].tolist())) < need:
            i += 1
            continue
        # the best stretch that begins before the first possible one ends
        best = max(((len(set(values[a : (b := int(np.searchsorted(places, places[a] + reach)))].tolist())), -a, a, b) for a in range(i, j)), key=lambda x: x[:2])
        shared, _, a, b = best
        new = set()
        for z in range(a, b):
            if values[z] not in new:
                new.add(values[z])
                last = z
        yield int(places[a]), int(places[last]), shared
        i = last + 1


SCHEMA = "license string, n_shared long, n_template long, first_word long, end_word long"


def _blocks(templates):
    """Blocks of (name, text) pairs of at most ``BLOCK_BYTES`` of text, a longer one alone."""
    own, held = [], 0
    for name, text in templates:
        if own and held + len(text) > BLOCK_BYTES:
            yield own
            own, held = [], 0
        own.append((name, text))
        held += len(text)
    if own:
        yield own


def scan(docs: DataFrame, templates: dict | DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(doc_id, license, n_shared, n_template, first_word, end_word) for every occurrence of a template in a document.

    templates: texts by name, or a table (name, text); notices of usual licenses if there are none.
    """
    if isinstance(templates, DataFrame):
        pairs = ((r["name"], r["text"] or "") for r in templates.select("name", "text").toLocalIterator())
    else:
        pairs = iter((TEMPLATES if templates is None else templates).items())
    out = [_scan(docs, grouped([Template(n, t, k) for n, t in block]), doc_id, text) for block in _blocks(pairs)]
    return reduce(DataFrame.unionByName, out) if out else _scan(docs, [], doc_id, text)


def _scan(docs, ready, doc_id, text):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            data, at = column(batch.column(1))
            for i, j, d, a in chunks(data, at):
                got = matches(d, a, ready)
                if got:
                    rows = list(zip(*got))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([i + x for x in rows[0]])), pa.array(rows[1]), *(pa.array(rows[c], pa.int64()) for c in (2, 5, 3, 4))],
                        names=["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))],
                    )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(trimmed(run), f"doc_id {kind}, {SCHEMA}")
