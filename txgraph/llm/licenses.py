"""License scans (2): patience alignment of texts with license templates.

Words that occur once in the text and once in the template are anchors; the longest increasing
subsequence of their places is kept, and the gaps between kept anchors are aligned in the same way
(words that repeat in the whole become unique in a gap). A gap without anchors is split at its
longest common run of words. Coverage is the share of the template's words that are aligned.

Only words that the template has can be aligned, so the others are left out first, however many they are. What is left is
aligned step by step, each over the words the steps before it left free: verbatim runs of the whole
template, then overlapping stretches of 3, 12 and 48 template lengths until they show no more, and only where the words
present could reach the needed coverage (an exact upper bound with their counts, computed for all documents).
Known are short notices (``TEMPLATES``) and whole license texts (the files of ``license_texts``, named "... text").

Defined results: null or empty text has no words and no match; a very long text is aligned whole, stretch by stretch; a template
shorter than ``SHORT`` words must be covered whole within three template lengths of text (scattered common words
name no license), others by ``coverage`` with any number of foreign words between, the aligned ones within 48
template lengths of words that the template has; matches of one template share no aligned words, of
those that overlap in one step the one covering most stays, then the first; of matches of different templates that align the same words, the
one aligned best in both directions stays (aligned words times their shares of template and span,
then the first template), another one only if at most half of its words are aligned by it, or if it is
found again over the words that are left; repeated rows give repeated results; a null id is kept; extra
columns are ignored; no rows, no result rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.llm import textkernel as K
from txgraph.llm.common import id_type, ids_and_texts, map_texts

COVERAGE = 0.8
SHORT = 20
WIDTHS = (3, 12, 48)  # template lengths of a stretch, step by step
MEMO_BYTES = 8 << 20  # alignments of equal stretches are kept up to this size
TEXTS = Path(__file__).parent / "license_texts"

# Wording of public license notices.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
           "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
           "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
           "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
           "substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
           "the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                    "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
                    "the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                  "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
                  "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                  "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
                  "limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
               "this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
           "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
           "version.",
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
           "License as published by the Free Software Foundation; version 2 of the License.",
    "LGPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Library General "
           "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
           "later version.",
    "LGPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Library General "
           "Public License as published by the Free Software Foundation; version 2 of the License.",
    "LGPL-2.1-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
           "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
           "any later version.",
    "LGPL-2.1-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
           "Public License as published by the Free Software Foundation; version 2.1 of the License.",
    "LGPL-3.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
           "Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any "
           "later version.",
    "LGPL-3.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
           "Public License as published by the Free Software Foundation; version 3 of the License.",
    "AGPL-3.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General "
           "Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any "
           "later version.",
    "AGPL-3.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General "
           "Public License as published by the Free Software Foundation; version 3 of the License.",
    "GPL-3.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
           "License as published by the Free Software Foundation; version 3 of the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
           "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
           "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
           "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
           "promote products derived from this software without specific prior written permission.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
           "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
           "commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
           "this software to the public domain worldwide. This software is distributed without any warranty. You should have "
           "received a copy of the CC0 Public Domain Dedication along with this software.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
           "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for"
           " any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
           "restrictions:",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
           "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
           "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
           "Software is furnished to do so, all subject to the following:",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which"
           " is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0 line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0 line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0 line": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}


def known_templates() -> dict[str, str]:
    """The notices and the whole texts by name; read on the driver, sent to the tasks with the function."""
    return TEMPLATES | {f"{p.stem} text": p.read_text(encoding="utf-8") for p in sorted(TEXTS.glob("*.txt"))}


def _increasing(places: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience piles)."""
    tops: list[int] = []
    pile: list[int] = []
    back: list[int] = []
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        if k == len(tops):
            tops.append(p)
            pile.append(i)
        else:
            tops[k], pile[k] = p, i
        back.append(pile[k - 1] if k else -1)
    out, i = [], pile[-1] if pile else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _longest_run(a: list, b: list) -> tuple[int, int, int]:
    best, before = (0, 0, 0), {}
    where: dict = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    for i, w in enumerate(a):
        now = {}
        for j in where.get(w, ()):
            n = now[j] = before.get(j - 1, 0) + 1
            if n > best[2]:
                best = (i - n + 1, j - n + 1, n)
        before = now
    return best


def patience_align(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        x, y = a[a0:a1], b[b0:b1]
        once_a, once_b = Counter(x), Counter(y)
        place_b = {w: j for j, w in enumerate(y) if once_b[w] == 1}
        common = [(i, place_b[w]) for i, w in enumerate(x) if once_a[w] == 1 and w in place_b]
        if common:
            pairs = [common[k] for k in _increasing([j for _, j in common])]
        else:
            i, j, n = _longest_run(x, y)
            pairs = [(i + k, j + k) for k in range(n)]
        if not pairs:
            continue
        out += [(a0 + i, b0 + j) for i, j in pairs]
        edges = [(-1, -1), *pairs, (len(x), len(y))]
        todo += [(a0 + i + 1, a0 + k, b0 + j + 1, b0 + m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


class Templates:
    """Templates as word hashes, and the counts that bound what a text can cover."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.names = list(templates)
        self.words = [lower_words(*_one(t))[0].tolist() for t in templates.values()]
        self.vocabulary = np.unique(np.array([w for t in self.words for w in t], dtype=np.uint64))
        self.outside = next(x for x in np.arange(len(self.vocabulary) + 1, dtype=np.uint64) if x not in self.vocabulary)
        self.share = np.zeros((len(self.vocabulary), len(self.words)), dtype=np.int64)
        for k, t in enumerate(self.words):
            np.add.at(self.share[:, k], np.searchsorted(self.vocabulary, np.array(t, np.uint64)), 1)
        self.need = [len(t) if len(t) < SHORT else int(np.ceil(coverage * len(t))) for t in self.words]
        self.memo: dict[tuple[int, bytes], list[int]] = {}
        self.memo_bytes = 0

    def could(self, bounds: np.ndarray, doc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Flags (document, template): the template words present suffice for the coverage."""
        n_docs = len(bounds) - 1
        pair, count = np.unique(doc * len(self.vocabulary) + word, return_counts=True)
        have = np.zeros((n_docs, len(self.words)), dtype=np.int64)
        if len(pair):
            of = pair // len(self.vocabulary)
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            for k in range(len(self.words)):
                have[of[first], k] = np.add.reduceat(np.minimum(count, self.share[pair % len(self.vocabulary), k]), first)
        return have >= np.array(self.need)

    def _aligned(self, k: int, words: np.ndarray) -> list[int]:
        """Places of ``words`` that align with template k; equal stretches are aligned once."""
        key = (k, words.tobytes())
        got = self.memo.get(key)
        if got is None:
            got = self.memo[key] = [i for i, _ in patience_align(words.tolist(), self.words[k])]
            self.memo_bytes += len(key[1]) + 64 * len(got)
            if self.memo_bytes > MEMO_BYTES:
                self.memo, self.memo_bytes = {}, 0
        return got

    def _verbatim(self, words: np.ndarray, k: int) -> list[int]:
        """First places of the whole template in ``words``, not overlapping."""
        t = self.words[k]
        at = np.flatnonzero(words[: max(len(words) - len(t) + 1, 0)] == np.uint64(t[0]))
        for d, w in enumerate(t):
            if not len(at):
                break
            at = at[words[at + d] == np.uint64(w)]
        out: list[int] = []
        for a in at.tolist():
            if not out or a >= out[-1] + len(t):
                out.append(a)
        return out

    def _in_stretches(self, words: np.ndarray, at: np.ndarray, k: int, width: int) -> list[tuple[int, ...]]:
        """Places of the aligned words of each match in stretches of ``width`` template lengths, not overlapping
        (``at``: the words' places in the vocabulary, -1 for words that the template has not)."""
        n, need, share = len(self.words[k]), self.need[k], self.share[:, k]

        def bound(a: int, b: int) -> int:
            word, count = np.unique(at[a:b][at[a:b] >= 0], return_counts=True)
            return int(np.minimum(count, share[word]).sum())

        found = set()
        step = n * width // 3
        if bound(0, len(at)) < need:
            return []
        for s in np.unique(np.flatnonzero(at >= 0) // step).tolist():
            a, b = s * step, s * step + n * width  # holds any match of two thirds of the width that starts in the step
            if bound(a, b) < need:
                continue
            best = [a + i for i in self._aligned(k, words[a:b])]
            if len(best) < need:
                continue
            p, q = best[0], best[-1] + 1
            # words of neighbouring copies may be aligned: of a wide span, the part that aligns best alone stays
            for x in range(max(a, p - n // 4), q, max(n // 4, 1)) if q - p > n else ():
                near = [x + i for i in self._aligned(k, words[x : x + n + n // 4])]
                if len(near) >= need and len(near) ** 2 * (best[-1] + 1 - best[0]) > len(best) ** 2 * (near[-1] + 1 - near[0]):
                    best = near
            found.add(tuple(best))
        starts: list[int] = []
        kept: list[tuple[int, ...]] = []
        for m in sorted(found, key=lambda m: (-len(m), m[0], m[-1])):
            i = bisect_left(starts, m[-1] + 1)
            if not i or kept[i - 1][-1] < m[0]:
                starts.insert(i, m[0])
                kept.insert(i, m)
        return kept

    def find(self, h: np.ndarray, k: int) -> list[tuple[int, int, int, tuple[int, ...]]]:
        """(aligned words, first word, end word, places of the aligned words) of the matches of template k."""
        n = len(self.words[k])
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        at = np.where((self.vocabulary[at] == h) & (self.share[at, k] > 0), at, -1)
        place = np.arange(len(h)) if n < SHORT else np.flatnonzero(at >= 0)  # short ones are measured in all words
        out = []

        def take(matches: list) -> np.ndarray:
            free = np.ones(len(place), dtype=bool)
            for m in matches:
                free[m[0] : m[-1] + 1] = False
                places = tuple(place[list(m)].tolist())
                out.append((len(m), places[0], places[-1] + 1, places))
            return place[free]

        place = take([range(a, a + n) for a in self._verbatim(h[place], k)])
        for width in WIDTHS[:1] if n < SHORT else WIDTHS:
            while matches := self._in_stretches(h[place], at[place], k, width):  # again, as a stretch shows one match
                place = take(matches)
        return sorted(out, key=lambda m: m[1])

    def best(self, h: np.ndarray, ks: list[int]) -> list[tuple[int, int, int, int]]:
        """(template, aligned words, first word, end word) of the matches that stay of all the templates'."""
        taken: set[int] = set()
        out = []
        while ks:
            found = [(k, *m) for k in ks for m in self.find(h, k)]
            found.sort(key=lambda m: (-m[1] * m[1] / len(self.words[m[0]]) * m[1] / (m[3] - m[2]), m[0], m[2]))
            ks, before = [], len(taken)
            for k, n, a, b, places in found:
                if 2 * sum(p in taken for p in places) <= n:
                    taken.update(places)
                    out.append((k, n, a, b))
                elif k not in ks:
                    ks.append(k)  # again, over the words that are left
            if len(taken) == before:
                break
            h = h.copy()
            h[list(taken)] = self.outside
        return sorted(out, key=lambda m: (m[2], m[0]))


def _one(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return data, np.array([0, len(data)])


def lower_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = K.LOWER[data]
    starts, ends, bounds = K.words(low, offs, K.ALNUM_WORD)
    return K.hash_spans(low, starts, ends), bounds


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, matches (license, covered words, coverage, first word, words)."""
    src = ids_and_texts(docs, id_col, text_col)
    given = templates or known_templates()
    inner = pa.list_(pa.struct([("license", pa.string()), ("covered", pa.int64()), ("coverage", pa.float64()), ("start", pa.int64()), ("words", pa.int64())]))

    def make():
        known = Templates(given, coverage)

        def f(rows, data, offs):
            h, bounds = lower_words(data, offs)
            n = len(rows)
            doc = np.repeat(np.arange(n), np.diff(bounds))
            at = np.minimum(np.searchsorted(known.vocabulary, h), len(known.vocabulary) - 1)
            hit = known.vocabulary[at] == h
            matches: list[list] = [[] for _ in range(n)]
            could = known.could(bounds, doc[hit], at[hit])
            for d in np.flatnonzero(could.any(axis=1)).tolist():
                for k, got, a, b in known.best(h[bounds[d] : bounds[d + 1]], np.flatnonzero(could[d]).tolist()):
                    matches[d].append({"license": known.names[k], "covered": got, "coverage": got / len(known.words[k]), "start": a, "words": b - a})
            return [rows.column(0), np.diff(bounds), pa.array(matches, inner)]

        return f

    return map_texts(src, f"doc_id {id_type(src)}, n_words long, matches array<struct<license:string,covered:long,coverage:double,start:long,words:long>>", make)


def license_summary(matches: DataFrame) -> DataFrame:
    """doc_id, n_words, n_matches, licenses (distinct names in order, comma-joined), coverage (the best)."""
    return matches.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"),
                          F.concat_ws(",", F.array_sort(F.array_distinct(F.expr("transform(matches, m -> m.license)")))).alias("licenses"),
                          F.coalesce(F.array_max(F.expr("transform(matches, m -> m.coverage)")), F.lit(0.0)).alias("coverage"))
