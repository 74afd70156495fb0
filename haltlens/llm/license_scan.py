"""License scans by conditional compression.

Candidate blocks (stretches of words around license wording) are compressed alone and with each template as a raw zstandard
dictionary. What a template saves, in bytes and as a share of the block's own compressed size, ranks the templates; all that
save anything and share words enough are then confirmed by their exact wording differences: the words of the template that the block lacks and the other
way round, from a longest common subsequence over the range of the block that fits best. A finding is accepted if a range of the block holds at least ``coverage`` of the
template's words in order and few others.

Defined results: null or empty text has no blocks; a text may hold several licenses, each its own row, in order of their place; equal
savings rank by template name; repeated rows give repeated findings; whole texts are scanned, a very long run of lines in
windows that overlap by the longest template, so that no notice is cut. A null doc_id is kept; an empty table has no findings; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import only, sliced

# Published notices of common licenses, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
}

_SIGN = re.compile(r"(?i)licen[sc]e|copyright|\(c\) ?[0-9]{4}|all rights reserved|warrant|redistribut|permission (?:is|to)|public domain|creative commons|\bCC[ -](?:BY|0)|free software|spdx|without restriction")
_WORDS = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")
#: Words about a sign that are looked at for short notices and for long ones, and those of a window of a long stretch.
SHORT, LONG, WINDOW = 30, 250, 600
#: Words of the longest short notice.
SHORT_WORDS = 20


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text)]


@dataclass(frozen=True)
class Template:
    license: str
    form: int
    words: tuple[str, ...]
    count: Counter
    packer: zstandard.ZstdCompressor


@lru_cache(maxsize=1)
def templates() -> tuple[Template, ...]:
    out = []
    for name, forms in TEMPLATES.items():
        for i, text in enumerate(forms):
            w = _words(text)
            raw = zstandard.ZstdCompressionDict(" ".join(w).encode() * (1 + 16 // len(" ".join(w))), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            out.append(Template(name, i, tuple(w), Counter(w), zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_checksum=False)))
    return tuple(out)


@lru_cache(maxsize=1)
def _alone() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)


def stretches(signs: list[int], around: int, n: int) -> list[tuple[int, int]]:
    """Candidate blocks, as ranges of words: ``around`` words to both sides of each sign, merged where they meet."""
    out: list[list[int]] = []
    for i in signs:
        a, b = max(0, i - around), min(n, i + around + 1)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def differences(template: tuple[str, ...], words: list[str], coverage: float = 0.9) -> tuple[int, int, int, int] | None:
    """Of the range of ``words`` that fits best: template words found in order there (a longest common subsequence), its first and last place, words in it that the
    template lacks. A range fits if it holds ``coverage`` of the template and at most a fifth of its length (two words at least) besides; the best has the greatest share
    found less share added, then the most found, then the earliest start. All ranges are compared: from each start that may fit, rows of the table of common subsequences
    are kept as bits of one number. None if no range fits."""
    n = len(template)
    most, need = max(2, n // 5), coverage * n
    reach, n_words = n + most, len(words)
    at = {}
    for i, w in enumerate(template):
        at[w] = at.get(w, 0) | 1 << i
    count = Counter(template)
    full, best = (1 << n) - 1, None
    # words of the template, each as often as there, among the next ``reach``: no range from a start finds more
    seen: Counter = Counter()
    there = end = 0
    for a in range(n_words):
        while end < min(n_words, a + reach):
            w = words[end]
            if w in count:
                there += seen[w] < count[w]
                seen[w] += 1
            end += 1
        if words[a] in at and there >= need:
            row, hit = full, 0
            for b in range(a, end):
                m = at.get(words[b])
                if m is None:
                    continue
                u = row & m
                row = ((row + u) | (row - u)) & full
                now = n - row.bit_count()
                if now > hit:
                    hit = now
                    added = b + 1 - a - hit
                    if hit >= need and added <= most:
                        score = (hit / n - added / (b + 1 - a), hit)
                        if best is None or score > best[0]:
                            best = (score, hit, a, b + 1, added)
        w = words[a]
        if w in count:
            seen[w] -= 1
            there -= seen[w] < count[w]
    return None if best is None else best[1:]


def scan(text: str, *, coverage: float = 0.9) -> list[tuple]:
    """(start, license, form, saved bytes, saved share, missing words, added words) of each accepted finding, by place."""
    spans = [(m.start(), m.group().lower()) for m in _WORDS.finditer(text)]
    at = [p for p, _ in spans]
    signs = sorted({max(0, bisect_right(at, m.start()) - 1) for m in _SIGN.finditer(text)})
    taken = [False] * len(spans)
    found = []
    # long notices first, so that their parts are not read as short ones
    for around, kind in ((LONG, [t for t in templates() if len(t.words) > SHORT_WORDS]), (SHORT, [t for t in templates() if len(t.words) <= SHORT_WORDS])):
        for a, b in stretches(signs, around, len(spans)):
            for p in range(a, b, WINDOW // 2):
                found += _in_window(spans, taken, range(p, min(b, p + WINDOW)), kind, coverage)
                if p + WINDOW >= b:
                    break
    return sorted(found)


def _in_window(spans, taken, window, kind, coverage) -> list[tuple]:
    found = []
    while True:
        left = [i for i in window if not taken[i]]
        now = [spans[i][1] for i in left]
        data = " ".join(now).encode()
        own = len(_alone().compress(data))
        ranked = sorted(((own - len(t.packer.compress(data)), t) for t in kind), key=lambda x: (-x[0], x[1].license, x[1].form))
        there = Counter(now)
        best = None
        for saved, t in ranked:
            if saved <= 0:
                break
            if sum(min(n, there[w]) for w, n in t.count.items()) < coverage * len(t.words):
                continue  # no alignment finds more
            fits = differences(t.words, now, coverage)
            if fits is not None:
                hit, first, last, added = fits
                score = (hit / len(t.words) - added / (last - first), hit)
                if best is None or score > best[0]:
                    best = (score, saved, t, hit, first, last, added)
        if best is None:
            return found
        _, saved, t, hit, first, last, added = best
        found.append((spans[left[first]][0], t.license, t.form, saved, round(saved / own, 4), len(t.words) - hit, added))
        for i in left[first:last]:
            taken[i] = True


SCHEMA = "doc_id long, start long, license string, form int, saved_bytes long, saved_share double, missing_words long, added_words long"


def scan_documents(docs: DataFrame, **params) -> DataFrame:
    """One row for each finding in ``docs`` (doc_id, text)."""

    def run(batches):
        for b in sliced(batches):
            rows = [(d, *f) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")) if t.is_valid and (s := t.as_py()) and _SIGN.search(s) for f in scan(s, **params)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in SCHEMA.split(", ")])
    return only(docs, doc_id="doc_id", text="text").mapInArrow(run, SCHEMA)
