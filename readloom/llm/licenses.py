"""License scans by patience alignment.

Template and text are words (runs of letters and digits, lower case). A window of the text is aligned with a template by
anchors: words that occur once in both. The longest chain of anchors that increases in both is kept, and the gaps between
consecutive anchors are aligned in the same way; runs of equal words next to anchors and at the ends count as well.
Coverage is the share of the template's words that are matched, or of the matched span's where that is longer. A match is
the run of aligned words of highest coverage, so a stray word far from the notice can't lower it.

Like notices differ in few words, so those must agree: each name or version word of a template has to be aligned, and a
match may not hold a word of another variant (lesser, noncommercial, sharealike ..) that its template lacks.

Windows come first from a bound that loses none: a match with coverage t lies in a stretch of ``STRETCH`` times the
template's words that has at least t times its words from the template. Only such stretches are aligned, and uniqueness
is taken within them, so a notice that a text repeats is found each time.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flush_rows, rows_of

#: Least coverage of a match, and the length of a stretch in template words.
COVERAGE = 0.8
STRETCH = 1.5

_BSD_FIRST = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:"
)
_BSD = (
    f"{_BSD_FIRST} Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission."
)
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'

#: Public notices by which works name their licenses, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "BSD-3-Clause": (f"{_BSD} {_BSD_NAMES} {_AS_IS}", "Released under the BSD 3-Clause License.", "Released under the New BSD License."),
    "BSD-2-Clause": (f"{_BSD} {_AS_IS}", "Released under the BSD 2-Clause License.", "Released under the Simplified BSD License."),
    "BSD": ("Released under the BSD License.", _BSD_FIRST),
    "CC0-1.0": (
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
        "Creative Commons Legal Code CC0 1.0 Universal",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to "
        "the creation of, or owns Covered Software.",
    ),
} | {
    f"CC-{kind.upper()}-{version}": (
        f"Licensed under CC {kind.upper()} {version}.",
        f"This work is licensed under a Creative Commons {title} {version} {port} License.",
        f"Creative Commons {title} {version} {port} Public License",
    )
    for version, port in (("4.0", "International"), ("3.0", "Unported"))
    for kind, title in (
        ("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"),
        ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))
}
#: Words by which a variant of a notice differs from the plain one. A match can't leave one of them unaligned.
VARIANT_WORDS = frozenset(
    "lesser affero nc sa nd non noncommercial sharealike noderivatives noderivs derivatives neither endorse".split()
)
#: Names and versions. A match must align those that its template has.
NAME_WORDS = VARIANT_WORDS | frozenset(
    "apache mit bsd gnu general cc cc0 by creative commons attribution mozilla public unencumbered international unported universal new simplified clause "
    "1 2 3 4 0 redistributions".split()
)
#: Names that tell a family only: any other match of the same words is preferred.
FAMILIES = frozenset({"BSD"})

_WORDS = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def increasing(values: list[int]) -> list[int]:
    """The positions of a longest increasing subsequence of distinct values, by patience piles."""
    tops: list[int] = []
    top_at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(top_at[k - 1] if k else -1)
        tops[k : k + 1] = [v]
        top_at[k : k + 1] = [i]
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of ``a`` and ``b``, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        unique = [(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in at]
        chain = [unique[k] for k in increasing([j for _, j in unique])]
        if not chain:
            continue
        out += chain
        i0, j0 = a0, b0
        for i, j in [*chain, (a1, b1)]:
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


def best_run(at: list[int], size: int, first: int | None = None, last: int = 0) -> tuple[int, int, float]:
    """(first, last, coverage) of the run of matches of highest coverage, then most matches, then the first.

    ``at``: the matched positions in the text, rising; ``size``: the template's words. With ``first`` and ``last``, only
    runs that hold the matches from first to last count.
    """
    pos = np.asarray(at, dtype=np.int64)
    best, share = (0, 0), 0.0
    for p in range(len(pos) if first is None else first + 1):
        if (len(pos) - p) / size < share:  # no later run has enough matches
            break
        count = np.arange(1, len(pos) - p + 1)
        shares = count / np.maximum(size, pos[p:] - pos[p] + 1)
        shares[: max(0, last - p)] = 0
        q = len(shares) - 1 - int(shares[::-1].argmax())
        if shares[q] > share or (shares[q] == share and q > best[1] - best[0]):
            best, share = (p, p + q), float(shares[q])
    return *best, share


class Scanner:
    """Finds the templates in texts."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, coverage: float = COVERAGE):
        self.coverage = coverage
        self.vocabulary: dict[str, int] = {}
        self.templates = []
        for name, texts in sorted(templates.items()):
            for text in texts:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
                self.templates.append((name, ids))
        size = len(self.vocabulary)
        names, variants = ({self.vocabulary[w] for w in ws if w in self.vocabulary} for ws in (NAME_WORDS, VARIANT_WORDS))
        self.names = [names.intersection(ids) for _, ids in self.templates]
        self.variants = [variants.difference(ids) for _, ids in self.templates]
        self.multiplicity = [np.bincount(ids, minlength=size) for _, ids in self.templates]

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(license, first word, word after the last, coverage) of every match, leftmost first; matches don't overlap."""
        found = words(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in found), dtype=np.int64, count=len(found))
        hits = np.flatnonzero(ids >= 0)
        if not len(hits):
            return []
        count = np.bincount(ids[hits], minlength=len(self.vocabulary))
        out = []
        for (name, template), times, named, variants in zip(self.templates, self.multiplicity, self.names, self.variants, strict=True):
            least = self.coverage * len(template)
            if np.minimum(count, times).sum() < least or not all(count[w] for w in named):
                continue
            stretch = int(STRETCH * len(template)) + 1
            at = hits[times[ids[hits]] > 0]
            dense = np.searchsorted(at, at + stretch) - np.arange(len(at)) >= least
            done = -1
            for start in at[dense].tolist():
                if start <= done:
                    continue
                window = ids[start : start + stretch]
                if np.minimum(np.bincount(window[window >= 0], minlength=len(times)), times).sum() < least:
                    continue
                found_here = self.matched(template, named, ids, start, stretch)
                if found_here is None:
                    continue
                first, last, share = found_here
                if share >= self.coverage and not any(w in variants for w in ids[first : last + 1].tolist()):
                    out.append((name, first, last + 1, share))
                    done = last
        # like notices match the same words: the better match of overlapping ones stays
        out.sort(key=lambda m: (m[0] in FAMILIES, -m[3], m[1] - m[2], m[0], m[1]))
        kept: list[tuple[str, int, int, float]] = []
        for m in out:
            k = bisect_left(kept, m[1], key=lambda x: x[1])
            if (k == len(kept) or kept[k][1] >= m[2]) and (k == 0 or kept[k - 1][2] <= m[1]):
                kept.insert(k, m)
        return kept

    def matched(self, template: list[int], named: set[int], ids: np.ndarray, start: int, stretch: int) -> tuple[int, int, float] | None:
        """(first, last, coverage) of the best run in the stretch at ``start``, or in those that begin where a run's template would.

        A stray word before a notice lets the stretch end inside it, or takes the place of one of its first words; from
        where its template would begin, counted back from the run's first word or its last, the stretch holds it all.
        """
        best, todo, tried = None, [start], set()
        while todo:
            start = todo.pop()
            tried.add(start)
            found = align(template, ids[start : start + stretch].tolist())
            run = self.agreeing(template, found, named) if found else None
            if run is None or (best is not None and run[2] <= best[2]):
                continue
            (i0, j0), (i1, j1) = found[run[0]], found[run[1]]
            best = start + j0, start + j1, run[2]
            if run[2] == 1:
                break
            todo += [x for x in {max(0, start + j0 - i0), max(0, start + j1 - i1)} if x not in tried]
        return best

    @staticmethod
    def agreeing(template: list[int], matched: list[tuple[int, int]], named: set[int]) -> tuple[int, int, float] | None:
        """The best run of matches among those that align all words of ``named``; None where there is none."""
        at = [j for _, j in matched]
        p, q, share = best_run(at, len(template))
        if named <= {template[i] for i, _ in matched[p : q + 1]}:
            return p, q, share
        places: dict[int, int] = {}
        for k, (i, _) in enumerate(matched):
            if template[i] in named:
                places.setdefault(template[i], k)
        if len(places) < len(named):
            return None
        return best_run(at, len(template), min(places.values()), max(places.values()))


def license_scan(docs: DataFrame, coverage: float = COVERAGE, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """doc_id, n_matches, licenses (sorted, joined by commas), best_license, coverage, first_word, last_word of every row.

    ``best_license`` is the match of highest coverage, then most words, then first name and place; ``last_word`` is
    exclusive. A row without a match (null and empty texts too) has zero matches, an empty list and nulls. Texts of any
    length are scanned whole. One pass without a shuffle; repeated rows and null ids are kept, an empty table gives no
    row, and columns other than doc_id and text aren't read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_matches", pa.int64()), ("licenses", pa.string()), ("best_license", pa.string()),
                        ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)

        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc_id, text in rows_of(b, "doc_id", "text"):
                    got = scanner.scan(text)
                    if not got:
                        yield doc_id, 0, "", None, None, None, None
                        continue
                    name, first, last, share = min(got, key=lambda m: (-m[3], m[1] - m[2], m[0], m[1]))
                    yield doc_id, len(got), ",".join(sorted({m[0] for m in got})), name, share, first, last

        yield from flush_rows(schema, rows())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, n_matches long, licenses string, best_license string, coverage double, first_word long, last_word long")
