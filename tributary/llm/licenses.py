"""License scans: winnowed fingerprints find candidates, banded alignment measures them.

Templates are few, so their inverted index (word -> template and position) is bounded by the
template set and goes along with the tasks.  A template's fingerprints are winnowed: of every
window of its words the rarest one (among all templates, then by hash) is kept.  The window is the
widest that keeps more words than a match may lack, so every match holds a fingerprint, whatever is
inserted, left out or changed.  A document is tokenised once and its words looked up; each hit gives
a diagonal.  The region is aligned with the whole template in a band around that diagonal; a
report gives the matched coverage of the template and the span in the document.

Some words tell one licence from another, such as a name or a version.  A match must hold those of
its template, and none that makes it another licence.  A short notice that is negated ("not released
under") is none.  Long licences are known by their opening, which every copy of the text holds.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import small_batches

# Wording of common licences, their usual headers and notices.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU_HEADER = "{work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
_GNU_NAMES = {"GPL": "General Public License", "LGPL": "Lesser General Public License", "AGPL": "Affero General Public License"}
_CC_KINDS = ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
_CC_NAMES = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "Unlicense", "MPL-2.0", "EPL-2.0", "EUPL-1.2", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later")
_SPDX_OLD = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
_FSF_TERMS = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_CC_VERSIONS = {"3.0": "Unported", "4.0": "International"}

TEMPLATES: dict[str, str] = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-notice": "Released under the MIT License.",
    "MIT": _MIT_GRANT,
    "BSD-2-Clause": f"{_BSD_TERMS} {_BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{_BSD_TERMS} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "EUPL-1.2-notice": "Licensed under the EUPL, Version 1.2.",
    "CC0-1.0-notice": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    **{f"{short}-{version}-notice": f"This work is licensed under the GNU {name}, version {version.removesuffix('.0')}." for short, version, name in [(s, v, n) for s, n in _GNU_NAMES.items() for v in (("2.1", "3.0") if s == "LGPL" else ("3.0",) if s == "AGPL" else ("2.0", "3.0"))]},
    **{f"{short}-{version}-header": _GNU_HEADER.format(work="This library" if short == "LGPL" else "This program", name=name, version=version.removesuffix(".0")) for short, version, name in [(s, v, n) for s, n in _GNU_NAMES.items() for v in (("2.1", "3.0") if s == "LGPL" else ("3.0",) if s == "AGPL" else ("2.0", "3.0"))]},
    **{f"CC-{kind}-{v}-notice": f"Licensed under CC {kind} {v}." for kind in _CC_KINDS for v in _CC_VERSIONS},
    **{f"CC-{kind}-{v}-name": f"This work is licensed under a Creative Commons {_CC_NAMES[kind]} {v} {scope} License." for kind in _CC_KINDS for v, scope in _CC_VERSIONS.items()},
    **{f"{name}-tag": f"SPDX-License-Identifier: {name}" for name in (*_SPDX, *_SPDX_OLD)},
    "BSD-notice": "Released under the BSD License.",
    # how whole licence texts begin
    "Apache-2.0-text": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
    "GPL-2.0-text": f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_FSF_TERMS} Preamble The licenses for most software are designed to take away your freedom to share and change it.",
    "GPL-3.0-text": f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_FSF_TERMS} Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "LGPL-3.0-text": f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_FSF_TERMS} This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "AGPL-3.0-text": f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_FSF_TERMS} Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "MPL-2.0-text": "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    "EPL-2.0-text": "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
}

# Words that tell one licence from another; a match needs those of its template.
DECIDING = frozenset("apache mit bsd mozilla eclipse boost eupl gnu cc creative neither lesser affero by by-sa by-nd by-nc by-nc-sa by-nc-nd attribution attribution-sharealike attribution-noderivatives attribution-noncommercial attribution-noncommercial-sharealike attribution-noncommercial-noderivatives 1.0 1.2 2 2.0 2.1 3 3.0 4.0".encode().split())
# Words that make what holds them another licence than a template without them.
OTHERWISE = frozenset("lesser affero neither".encode().split())
# Words that turn a short notice into its opposite.
NEGATING = frozenset("not never without isn".encode().split())
_NO_LONGER = (b"no", b"longer")


@dataclass(frozen=True)
class LicenseParams:
    """Reports from ``coverage`` up, of words at most ``band`` off the diagonal of a fingerprint.

    A template of up to ``short`` words must show all its deciding words, a longer one those of a name
    or of a GNU header.
    """

    band: int = 8
    coverage: float = 0.7
    short: int = 16


def winnowed(keys: list, window: int) -> list[int]:
    """Places of the least key of every window, the last of equal ones."""
    if window >= len(keys):
        window = max(len(keys), 1)
    return sorted({min(range(at, at + window), key=lambda i: (keys[i], -i)) for at in range(len(keys) - window + 1)} if keys else set())


def fingerprints(words: list[bytes], least: int, often: dict[bytes, int]) -> list[int]:
    """Winnowed places of a template, with the widest window that keeps more than a match may lack."""
    keys = [(often[w], xxhash.xxh3_64_intdigest(w)) for w in words]
    for window in range(len(words), 0, -1):
        found = winnowed(keys, window)
        if len(found) > len(words) - least:
            return found
    return list(range(len(words)))


_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+(?:[.\-][a-z0-9\x80-\xff]+)*")


def tokens(text: bytes | None) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Lower-case tokens of a text and their byte spans."""
    found = list(_TOKEN.finditer((text or b"").lower()))
    return [m[0] for m in found], [m.span() for m in found]


def aligned(template: list[bytes], part: list[bytes], diagonal: int, band: int) -> tuple[int, int, int]:
    """Longest common subsequence in a band: matched tokens, first and last matched position of ``part``.

    Template position i may meet part position j only if |j - i - diagonal| <= band.  Of equal ones
    the one with the shortest span is taken, and of these the first.
    """
    width = 2 * band + 1
    blank = (0, -1)
    previous = [blank] * (width + 1)
    best = (0, 0, -1)
    for i, token in enumerate(template):
        row = [blank] * (width + 1)
        left = blank
        for d in range(width):
            j = i + diagonal + d - band
            cell = max(left, previous[d + 1])  # skip in part, skip in template; the later start of equal ones
            if 0 <= j < len(part) and part[j] == token:
                n, lo = previous[d]
                met = (n + 1, lo if n else j)
                cell = max(cell, met)
                best = max(best, (met[0], met[1] - j, -j))
            row[d] = left = cell
        previous = row
    n, span, last = best
    return (n, span - last, -last) if n else (0, -1, -1)


def through(template: list[bytes], words: list[bytes], i: int, j: int, free: tuple[int, int], band: int) -> tuple[int, int, int]:
    """``aligned`` in words[free[0]:free[1]] around the diagonal j - i, with template position i met by word j."""
    lo, hi = max(j - i - band, free[0]), min(j - i + len(template) + band, free[1])
    # what precedes is aligned from its end, so that the spans close to word j come first
    before, _, back = aligned(template[:i][::-1], words[lo:j][::-1], 0, band)
    after, _, ahead = aligned(template[i + 1 :], words[j + 1 : hi], 0, band)
    return before + 1 + after, j - 1 - back if before else j, j + 1 + ahead if after else j


class Scanner:
    """Inverted index of the templates, and the scan of one text."""

    def __init__(self, templates: dict[str, str], params: LicenseParams):
        self.params = params
        self.names = sorted(templates)
        self.texts = [tokens(templates[n].encode())[0] for n in self.names]
        self.least = [next(m for m in range(len(x) + 1) if m and m >= params.coverage * len(x)) if x else 1 for x in self.texts]
        often = Counter(w for x in self.texts for w in x)
        self.index: dict[bytes, list[tuple[int, int]]] = {}
        self.deciding: list[set[bytes]] = []
        for t, words in enumerate(self.texts):
            for i in fingerprints(words, self.least[t], often):
                self.index.setdefault(words[i], []).append((t, i))
            told = DECIDING.intersection(words)
            self.deciding.append(told if len(words) <= params.short or b"gnu" in told or b"mozilla" in told or b"eclipse" in told else told & OTHERWISE)

    def possible(self, t: int, part: list[bytes]) -> bool:
        """Whether ``part`` has words for enough positions of the template, in whatever order."""
        return sum(map(set(part).__contains__, self.texts[t])) >= self.least[t]

    def decided(self, t: int, part: list[bytes]) -> bool:
        """Whether ``part`` has the deciding words of the template, and none of another licence."""
        have = set(part)
        return self.deciding[t] <= have and not (have & OTHERWISE) - self.deciding[t]

    def denied(self, t: int, words: list[bytes], first: int, last: int) -> bool:
        """Whether a short notice at words[first:last + 1] is negated inside or by the two words before it."""
        if len(self.texts[t]) > self.params.short or not self.deciding[t]:
            return False
        near = words[max(first - 2, 0) : last + 1]
        return not NEGATING.isdisjoint(near) or _NO_LONGER in zip(near, near[1:])

    def scan(self, text: bytes | None) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched tokens, first byte, byte after the last) of every match, by place."""
        words, spans = tokens(text)
        candidates: dict[int, list[tuple[int, int]]] = {}
        for place in [j for j, w in enumerate(words) if w in self.index]:
            for t, i in self.index[words[place]]:
                candidates.setdefault(t, []).append((i, place))
        out, band, have = [], self.params.band, set(words)
        for t, pairs in candidates.items():
            if not self.deciding[t] <= have:
                continue
            template, size = self.texts[t], len(self.texts[t])
            support: dict[int, int] = {}
            for d in {j - i for i, j in pairs}:
                if self.possible(t, words[max(d - band, 0) : max(d + size + band, 0)]):
                    support[d] = sum(map(eq, template[max(-d, 0) :], words[max(d, 0) : max(d + size, 0)]))
            taken: list[tuple[int, int]] = []  # accepted spans, in order
            for i, j in sorted((x for x in pairs if x[1] - x[0] in support), key=lambda x: (-support[x[1] - x[0]], x[1] - x[0], x[1])):  # noqa: B023
                k = bisect(taken, (j, len(words)))
                if k and j <= taken[k - 1][1]:  # the word is part of a match of this template
                    continue
                free = taken[k - 1][1] + 1 if k else 0, taken[k][0] if k < len(taken) else len(words)
                if not self.possible(t, words[max(j - i - band, free[0]) : min(j - i + size + band, free[1])]):
                    continue
                matched, first, last = through(template, words, i, j, free, band)
                if matched >= self.least[t] and self.decided(t, words[first : last + 1]):
                    taken.insert(k, (first, last))
                    if self.denied(t, words, first, last):
                        continue
                    out.append((self.names[t], matched / size, matched, spans[first][0], spans[last][1]))
        return sorted(out, key=lambda m: (m[3], m[0]))


def scan_licenses(documents: DataFrame, templates: dict[str, str] | None = None, params: LicenseParams = LicenseParams()) -> DataFrame:
    """doc_id, license, coverage, matched, span_start, span_end (bytes of the UTF-8 text): one row per match.

    Whole texts are scanned, however long; a text may match several templates and one template in several
    places.  Of equally good alignments the one with the shortest span counts, and of these the first.
    Null and empty texts match nothing.  Null ids and repeated rows keep their matches.  Extra columns
    are ignored; an empty table gives no row.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, params)
        for batch in batches:
            rows = [(key, *m) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True) for m in scanner.scan(text)]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)], ["doc_id", "license", "coverage", "matched", "span_start", "span_end"])

    return small_batches(documents).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, license string, coverage double, matched int, span_start long, span_end long")
