"""License scans: winnowed fingerprints pick candidates, a banded alignment measures them.

The templates' word three-grams go into an inverted index (three-gram to template and place), which
is small and travels with the tasks; those of templates over ``SHORT`` words are winnowed. A text's
three-grams are all looked up, so a shared run of ``GRAM + WINNOW - 1`` words is always found, and
one of three words of a shorter template. With a fifth of its words changed or left out a template
of 6 to 15 words keeps a run of three words and a longer one a run of four; one of five words keeps
only two, so such templates are indexed by two-grams. Words added in between can still break all
runs, and the local alignment may leave out an end behind several differing words. Hits of one template on neighbouring
diagonals make a candidate; a banded alignment of the template with the text around that diagonal
then gives the matched share of the template and the matched span of the text.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, worker_cache

GRAM, WINNOW, BAND, COVERAGE = 3, 2, 8, 0.8
#: Templates up to so many words are indexed by all their three-grams, and up to so many also by two-grams.
SHORT, SHORTEST = 15, 5

# Notices as licenses and their stewards publish them.
TEMPLATES = {
    "AGPL-3.0": "Licensed under the GNU Affero General Public License v3.",
    "AGPL-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-or-later-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License v3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# Identifiers of the licenses that are named by a line of their own.
SPDX = ("AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only "
        "GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense")
TEMPLATES |= {f"SPDX-{name}": f"SPDX-License-Identifier: {name}" for name in SPDX.split()}

_SIGNS = b".,;:()[]{}<>\"'`*#/!?-"
_BLANKS = bytes.maketrans(_SIGNS, b" " * len(_SIGNS))


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().translate(_BLANKS).split()


class Index:
    """Word numbers of the templates and the inverted index of their winnowed three-grams."""

    def __init__(self, templates: dict[str, str]):
        import numpy as np

        self.names = sorted(templates)
        split = [words_of(templates[n].encode()) for n in self.names]
        self.vocab = {w: i + 1 for i, w in enumerate(sorted({w for ws in split for w in ws}))}
        self.base = len(self.vocab) + 1
        self.templates = [np.array([self.vocab[w] for w in ws], np.int64) for ws in split]
        index: dict[int, list[tuple[int, int]]] = {}
        for t, ids in enumerate(self.templates):
            grams = self.grams(ids).tolist()
            ranks = [int.from_bytes(hashlib.blake2b(str(g).encode(), digest_size=8).digest()) for g in grams]
            width = min(WINNOW if len(ids) > SHORT else 1, len(grams))
            kept = {min(range(i, i + width), key=lambda j: (ranks[j], -j)) for i in range(len(grams) - width + 1)} if grams else set()
            for at in sorted(kept):
                index.setdefault(grams[at], []).append((t, at))
            if len(ids) <= SHORTEST:
                # Numbers below zero are two-grams.
                for at in range(len(ids) - 1 if len(ids) >= GRAM else 0):
                    index.setdefault(-int(ids[at] * self.base + ids[at + 1]), []).append((t, at))
        self.index = index
        self.keys = np.array(sorted(index), np.int64)

    def grams(self, ids):
        import numpy as np

        out = np.zeros(max(0, len(ids) - GRAM + 1), np.int64)
        for k in range(GRAM):
            out = out * self.base + ids[k:len(ids) - GRAM + 1 + k] if len(out) else out
        return out


def banded(pattern, text, band: int = BAND) -> tuple[int, int, int]:
    """Local alignment within ``band`` of the main diagonal: matched words, and the span in ``text``.

    A match is worth 2, a differing word or a gap costs 1; the first of equal results wins.
    """
    rows: dict[int, tuple] = {}
    best = (0, 0, 0, 0)
    for i, word in enumerate(pattern):
        now: dict[int, tuple] = {}
        for j in range(max(0, i - band), min(len(text), i + band + 1)):
            hit = word == text[j]
            score, matched, start = rows.get(j - 1, (0, 0, j))
            if score <= 0:
                score, matched, start = 0, 0, j
            options = [(score + (2 if hit else -1), matched + hit, start)]
            if j in rows:
                options.append((rows[j][0] - 1, rows[j][1], rows[j][2]))
            if j - 1 in now:
                options.append((now[j - 1][0] - 1, now[j - 1][1], now[j - 1][2]))
            top = max(options, key=lambda o: o[0])
            if top[0] > 0:
                now[j] = top
                if top[0] > best[0]:
                    best = (top[0], top[1], top[2], j + 1)
        rows = now
    return best[1:]


def scan_text(raw: bytes, index: Index, coverage: float = COVERAGE, band: int = BAND) -> list[tuple[str, float, int, int]]:
    """``template, coverage, first word, end word`` of every notice in a text."""
    import itertools

    import numpy as np

    words = words_of(raw)
    ids = np.fromiter(map(index.vocab.get, words, itertools.repeat(0)), np.int64, len(words))
    # A three-gram with a word of no template can't be in the index.
    inside = ids > 0
    if len(ids) < GRAM:
        return []
    pairs = np.flatnonzero(inside[:-1] & inside[1:])
    if not len(pairs):
        return []
    threes = pairs[:-1][np.diff(pairs) == 1]
    grams = np.concatenate([(ids[threes] * index.base + ids[threes + 1]) * index.base + ids[threes + 2], -(ids[pairs] * index.base + ids[pairs + 1])])
    places = np.concatenate([threes, pairs])
    order = np.argsort(places, kind="stable")
    places, grams = places[order], grams[order]
    hit = np.isin(grams, index.keys)
    # Places that line up with one template within the band are one candidate.
    candidates: dict[int, list[int]] = {}
    for at, gram in zip(places[hit].tolist(), grams[hit].tolist()):
        for t, place in index.index[gram]:
            begin = at - place
            starts = candidates.setdefault(t, [])
            if not starts or begin - starts[-1] > band:
                starts.append(begin)
    found = []
    for t, starts in sorted(candidates.items()):
        pattern = index.templates[t].tolist()
        end_before = -1
        for begin in starts:
            low = max(0, begin - band // 2)
            part = ids[low:max(0, begin) + len(pattern) + band].tolist()
            matched, a, b = banded(pattern, part, band + band // 2)
            if matched >= coverage * len(pattern) and low + a >= end_before:
                found.append((index.names[t], matched / len(pattern), low + a, low + b, matched / max(len(pattern), b - a)))
                end_before = low + b
    return closest(found)


def closest(found: list[tuple[str, float, int, int, float]]) -> list[tuple[str, float, int, int]]:
    """The finds without those that share half of their words or more with a closer one: related licenses differ in few words.

    The last number of a find tells how close it is: matched words to those of the template or, if
    words were added in between, of the span.
    """
    return [f[:4] for f in found if not any(g[4] > f[4] and 2 * (min(f[3], g[3]) - max(f[2], g[2])) >= f[3] - f[2] for g in found)]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, template, coverage, first_word, end_word``: one row per notice in each row of ``docs``.

    Words are counted from 0 over the text without punctuation; ``end_word`` lies behind the span.
    A shorter notice inside a longer one is reported beside it; of related notices on the same words
    the closest is (:func:`closest`; equally close ones are all reported). Null and empty texts hold none;
    templates under three words find nothing; repeated rows are reported each; a null id stays
    null; other columns are ignored; an empty table gives no rows.
    """
    chosen = TEMPLATES if templates is None else templates

    def run(frames):
        cache = worker_cache("licenses")
        key = tuple(sorted(chosen.items()))
        if key not in cache:
            cache[key] = Index(chosen)
        index = cache[key]
        for frame in frames:
            rows = [(i, *x) for i, t in zip(frame["doc_id"], frame["text"]) if t is not None for x in scan_text(t.encode(), index, coverage)]
            if rows:
                out = pd.DataFrame(rows, columns=["doc_id", "template", "coverage", "first_word", "end_word"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, template string, coverage double, first_word long, end_word long")
