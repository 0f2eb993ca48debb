"""License scans by patience alignment.

A template is found where its words line up with the text's: words that come once in both sides of a
gap are anchors, the longest increasing run of anchors splits the gap, and the parts are aligned in
turn, after equal words at their ends. Coverage is the share of template words aligned; a license is
found at `least` or more. A text may hold a notice many times, which leaves no word unique: so each
place of the template words that are rarest in the text is aligned on its own, within a window of
twice the template's length to either side: a find that other words stretch over more is none.

Null texts and texts without words have no licenses. Repeated rows and null ids give rows each.
Other columns are dropped.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import importable, pieces, utf8

#: Notices as their licenses word them.
TEMPLATES = {
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
}
#: Words are letters, digits and characters outside ASCII, with A-Z lower-cased.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORDS).split()


def rising(places: list[int]) -> list[int]:
    """Which of the places make a longest increasing run."""
    tops: list[int] = []
    top_at: list[int] = []
    before = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        before[i] = top_at[k - 1] if k else -1
        tops[k : k + 1] = [p]
        top_at[k : k + 1] = [i]
    out = []
    i = top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Pairs of places of aligned equal words, rising in both."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, j, k, m = gaps.pop()
        while i < j and k < m and a[i] == b[k]:
            pairs.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            pairs.append((j, m))
        if i >= j or k >= m:
            continue
        once: dict[bytes, int] = {}
        for x in range(i, j):
            once[a[x]] = -1 if a[x] in once else x
        theirs: dict[bytes, int] = {}
        for y in range(k, m):
            theirs[b[y]] = -1 if b[y] in theirs else y
        both = sorted((y, once[w]) for w, y in theirs.items() if y >= 0 and once.get(w, -1) >= 0)
        anchors = [both[r] for r in rising([x for _, x in both])]
        pairs += [(x, y) for y, x in anchors]
        if anchors:
            ends = [(k - 1, i - 1), *anchors, (m, j)]
            gaps += [(x1 + 1, x2, y1 + 1, y2) for (y1, x1), (y2, x2) in zip(ends, ends[1:])]
    return sorted(pairs)


def scan_words(words: list[bytes], templates: list[tuple[str, list[bytes]]], least: float) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, word after the last) of each find, the best of overlapping ones: that of most coverage, then of most words, the shortest, the first, the first license by name."""
    have = set(words)
    out: list[tuple[str, float, int, int, int]] = []
    for name, t in templates:
        own = set(t)
        if sum(w in have for w in t) < least * len(t) - 1e-9:
            continue
        places: dict[bytes, list[int]] = {w: [] for w in own & have}
        for i, w in enumerate(words):
            if w in places:
                places[w].append(i)
        # a find may lack some words of the template: with one more than it may lack, the rarest, one is in it
        lack = len(t) - ceil(least * len(t) - 1e-9) + 1
        rare = sorted(places, key=lambda w: (len(places[w]), w))[:lack]
        for at in sorted({p for w in rare for p in places[w]}):
            lo, hi = max(0, at - 2 * len(t)), min(len(words), at + 2 * len(t))
            pairs = align(words[lo:hi], t)
            if len(pairs) >= least * len(t) - 1e-9:
                out.append((name, len(pairs) / len(t), lo + pairs[0][0], lo + pairs[-1][0] + 1, len(pairs)))
    best: list[tuple[str, float, int, int]] = []
    for find in sorted(out, key=lambda f: (-f[1], -f[4], f[3] - f[2], f[2], f[0])):
        if not any(f[2] < find[3] and find[2] < f[3] for f in best):
            best.append(find[:4])
    return sorted(best, key=lambda f: (f[2], f[0]))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """(id, finds): finds are structs of license, coverage, and the span of words."""
    importable(docs.sparkSession)
    known = [(name, words_of(t.encode())) for name, texts in (templates or TEMPLATES).items() for t in texts]
    kind = dict(docs.dtypes)[id_col]
    find = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            at, data = utf8(batch.column("t"))
            rows = [[dict(zip(("license", "coverage", "start", "end"), f)) for f in scan_words(words_of(data[a:b].tobytes()), known, least)] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(find))], ["id", "finds"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, finds array<struct<license:string,coverage:double,start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)
