"""License scans: MinHash bands over overlapping text windows, then exact containment.

Words are runs of letters and digits, in lower case; a shingle is five of them.  Templates are grouped so that the longest
of a group has at most 1.5 times the shingles of the shortest.  For each group a text is read in windows of four steps,
a step being half the longest (one shingle at least), so any passage of a template's length lies whole in some window.
Windows are signed by the minima of ``bands`` x ``rows`` hash functions over their shingles, and equal bands, nothing
else, retrieve templates.  The functions are one to one, so a window can have a template's minimum only if it holds the
one shingle that gives it; these, at most one for each band and template, are looked up first, and windows without any are
not signed, as no band of theirs could be equal (a test signs all).  A
template with m shingles that a window of at most 3 m + 3 holds to at least ``least`` (0.8) has a Jaccard similarity of at
least 0.8 / 3.2 = 0.25 with it, for one shingle 1 / 4; with rows = 1 and 64 bands they share a band with a probability of
at least 1 - 0.75^64 > 0.99999998.  Retrieved pairs are verified: the share of the template's distinct shingles that the
window holds, counted exactly.  Of windows of one template that overlap, the fullest counts, then the shortest, then the first.

The templates, a bounded list given by the caller, go to the workers with the code.  Texts of over ``PIECE`` characters
are read in pieces that overlap by the longest window, so memory is bounded.  Null and empty texts have no licenses; a
template of fewer than five words is one shingle; repeated rows are scanned each for itself; an empty table gives no rows;
other columns, whatever their names, stay out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import common

#: Short notices as licensors word them, and the opening of common licence texts.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved. No part of this publication may be reproduced without permission.",
}

#: Whole licence texts as licensors publish them, without the lines for year and holder.
WHOLE = {
    "mit-whole": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "bsd-2-whole": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "isc-whole": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "unlicense-whole": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "zlib-whole": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

#: Notices of fewer than five words, each one shingle of its own length; op9 scans for these too.
SHORT = {"reserved-short": "All rights reserved."}

_WORD = re.compile(r"[^\W_]+")
PIECE = 1_000_000


def words(text: str) -> list[str]:
    return list(map(str.lower, _WORD.findall(text)))


class Shingles:
    """64-bit hashes of shingles, from hashes of words, which are remembered."""

    def __init__(self, most: int = 500_000):
        self.known: dict[str, int] = {}
        self.most = most

    def of(self, text: str) -> np.ndarray:
        """The hash of each word."""
        known, every = self.known, _WORD.findall(text)
        if len(known) > self.most:
            known.clear()
        out = [known.get(w) for w in every]
        for k, w in enumerate(every):
            if out[k] is None:
                out[k] = known[w] = xxhash.xxh64_intdigest(w.lower())
        return np.array(out, np.uint64)

    @staticmethod
    def joined(hashes: np.ndarray, width: int) -> np.ndarray:
        """The hash of each run of so many words."""
        n = len(hashes) - width + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        x = hashes[:n].copy()
        for k in range(1, width):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k]
        x ^= x >> np.uint64(32)
        return x * np.uint64(0xD6E8FEB86659FD93)


class Scanner:
    def __init__(self, templates: dict[str, str], width: int = 5, bands: int = 64, rows: int = 1, least: float = 0.8, seed: int = 11):
        self.bands, self.rows, self.least, self.shingles = bands, rows, least, Shingles()
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 61, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 61, bands * rows, dtype=np.uint64)
        #: Of each template, its distinct shingles; groups: (longest, width, names, signatures, shingles that give these).
        self.own: dict[str, np.ndarray] = {}
        sizes: dict[int, list[tuple[int, str]]] = {}
        for name, text in templates.items():
            hashes = self.shingles.of(text)
            if not len(hashes):
                continue
            size = min(width, len(hashes))
            self.own[name] = np.unique(Shingles.joined(hashes, size))
            sizes.setdefault(size, []).append((len(hashes) - size + 1, name))
        self.groups: list[tuple[int, int, list[str], np.ndarray, np.ndarray]] = []
        for size, left in sorted(sizes.items()):
            left.sort()
            while left:
                longest = max(n for n, _ in left if n <= 1.5 * left[0][0])
                group, left = [t for n, t in left if n <= longest], [(n, t) for n, t in left if n > longest]
                # A hash function has its minimum at one shingle of a template; only a window that holds it can have the same.
                keys = [self.own[t][self._signed(self.own[t]).argmin(axis=1)] for t in group]
                self.groups.append((longest, size, group, np.stack([self.bands_of(self.own[t]) for t in group]), np.unique(np.concatenate(keys))))
        self.overlap = max((4 * self._step(g[0]) + g[1] for g in self.groups), default=0)

    @staticmethod
    def _step(longest: int) -> int:
        return max(1, (longest + 1) // 2)

    def _signed(self, shingles: np.ndarray) -> np.ndarray:
        """Every hash function of every shingle."""
        x = shingles[None, :] * self.a[:, None] + self.b[:, None]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, start, end, containment) of the best window of each stretch where a template is held."""
        if len(text) <= 2 * PIECE:
            return self._best(self._piece(text, 0))
        found, low = [], 0
        while low < len(text):
            high = low + PIECE
            while high < len(text) and _WORD.match(text[high - 1]) and _WORD.match(text[high]):
                high += 1
            found += self._piece(text[low:high], low)
            if high >= len(text):
                break
            starts = [m.start() for m in _WORD.finditer(text, low, high)][-self.overlap :]
            low = max(low + 1, starts[0] if starts and starts[0] > low else high)
        return self._best(found)

    def _piece(self, text: str, before: int) -> list[tuple[str, int, int, float]]:
        hashes = self.shingles.of(text)
        held, spans = [], None
        for size in sorted({g[1] for g in self.groups}):
            every = Shingles.joined(hashes, size)
            for name, low, high in self._retrieved(every, [g for g in self.groups if g[1] == size]):
                own = self.own[name]
                window = every[low:high]
                at = np.minimum(np.searchsorted(own, window), len(own) - 1)
                inside = np.flatnonzero(own[at] == window)
                share = len(np.unique(window[inside])) / len(own)
                if share >= self.least:
                    spans = [m.span() for m in _WORD.finditer(text)] if spans is None else spans
                    held.append((name, before + spans[low + inside[0]][0], before + spans[low + inside[-1] + size - 1][1], share))
        return held

    def windows(self, n: int, longest: int) -> Iterator[tuple[int, int]]:
        """All windows over n shingles."""
        step = self._step(longest)
        return ((w * step, min(n, (w + 4) * step)) for w in range(-(-n // step)))

    def bands_of(self, shingles: np.ndarray) -> np.ndarray:
        return self._signed(shingles).min(axis=1)

    def _retrieved(self, every: np.ndarray, groups: list) -> Iterator[tuple[str, int, int]]:
        """(template, first shingle, end) of windows that share a band with a template.  Windows are signed where that can be."""
        n = len(every)
        for longest, _, names, signatures, keys in groups:
            step = self._step(longest)
            at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, every), len(keys) - 1)] == every) if n else ()
            if not len(at):
                continue
            starts = np.unique(at[:, None] // step - np.arange(4)[None, :])
            for w in starts[starts >= 0].tolist():
                low, high = w * step, min(n, (w + 4) * step)
                same = (signatures == self.bands_of(every[low:high])[None, :]).reshape(len(names), self.bands, self.rows).all(axis=2).any(axis=1)
                for t in np.flatnonzero(same).tolist():
                    yield names[t], low, high

    @staticmethod
    def _best(found: list) -> list:
        out: list[tuple[str, int, int, float]] = []
        for t, s, e, share in sorted(set(found), key=lambda x: (x[0], x[1], -x[3], x[2])):
            if out and out[-1][0] == t and s < out[-1][2]:
                last = out[-1]
                if share > last[3] or share == last[3] and e - s < last[2] - last[1]:
                    out[-1] = (t, s, e, share)
            else:
                out.append((t, s, e, share))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """(doc_id, license, start, end, containment): where texts hold templates; code points, end exclusive."""
    templates = templates or TEMPLATES | WHOLE | SHORT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least=least)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
        for batch in batches:
            for part in common.parts(batch, "text"):
                rows = [(d, *f) for d, t in zip(part.column(0).to_pylist(), part.column(1), strict=True) for f in scanner.scan(t.as_py())]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "license", "start", "end", "containment"])

    return common.small_batches(common.documents(docs)).mapInArrow(run, "doc_id long, license string, start long, end long, containment double")
