"""Operator 9: licence statements by Dice similarity of word bigrams.

Texts and templates are normalised: lower case, words of letters and digits (version numbers keep
their point). Each template is held against all passages of its own number of words that begin with one of its
bigrams, anywhere in a text, across lines and paragraphs. The Dice coefficient of two sets of word
bigrams is 2 |A & B| / (|A| + |B|). It reaches t only if A shares at least t / (2 - t) x |B| bigrams
with the template, so a size bound prunes templates of which a text, and then a window, holds fewer; templates that share no
bigram are never met (an index leads from bigrams to templates).

Of passages at ``LEAST`` or above that overlap the best stays (at equal values the longer, then the first licence
by name). Result per document: the best passage's licence, its Dice value, and the licences of all
passages. Null or empty text, or one without two words: no licence. Ties go to the first licence by
name. Statements that repeat are found each time and named once. A text may have any length: time grows with its
words and with the passages found. An empty table gives an empty result. Other columns are dropped;
repeated rows stay.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusmill.llm.batches import append
from corpusmill.session import spread

LEAST = 0.7
WORDS = re.compile(r"[a-z]+(?:'[a-z]+)?|[0-9]+(?:\.[0-9]+)*")

# Statements of public licences, as published by their stewards.
AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
UNLICENSE_REST = """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
APACHE_HEAD = """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."""
GPL_HEAD = """GNU {} PUBLIC LICENSE Version {} Copyright (C) {} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."""
MPL_HEAD = """Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."""
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain."""
STATEMENTS: tuple[tuple[str, str], ...] = (
    ("MIT", MIT_GRANT), ("MIT", MIT_WARRANTY), ("MIT", f"{MIT_GRANT} {MIT_WARRANTY}"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("BSD-2-Clause", BSD_HEAD), ("BSD-2-Clause", f"{BSD_HEAD} {AS_IS}"), ("BSD-2-Clause", "Released under the BSD 2-Clause License."), ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", f"{BSD_HEAD} {BSD_NAMES}"), ("BSD-3-Clause", f"{BSD_HEAD} {BSD_NAMES} {AS_IS}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", ISC), ("ISC", f"{ISC} {ISC_WARRANTY}"), ("ISC", "Released under the ISC License."), ("Zlib", ZLIB),
    ("Apache-2.0", APACHE_NOTICE), ("Apache-2.0", APACHE_HEAD), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", GPL_NOTICE.format(2)), ("GPL-3.0", GPL_NOTICE.format(3)),
    ("GPL-2.0", GPL_HEAD.format("GENERAL", "2, June 1991", "1989, 1991")), ("GPL-3.0", GPL_HEAD.format("GENERAL", "3, 29 June 2007", "2007")),
    ("LGPL-3.0", GPL_HEAD.format("LESSER GENERAL", "3, 29 June 2007", "2007")), ("AGPL-3.0", GPL_HEAD.format("AFFERO GENERAL", "3, 19 November 2007", "2007")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", MPL_NOTICE), ("MPL-2.0", MPL_HEAD), ("Unlicense", UNLICENSE), ("Unlicense", f"{UNLICENSE} {UNLICENSE_REST}"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
#: The statements, and each licence's identifier line.
TEMPLATES = STATEMENTS + tuple((name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in STATEMENTS}))

#: (Dice, first word, word behind the last, licence) of a passage.
Passage = tuple[float, int, int, str]


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def apart(found: list[Passage]) -> list[Passage]:
    """The passages that no better one overlaps, best first."""
    kept: list[Passage] = []
    for passage in sorted(found, key=lambda p: (-p[0], p[1] - p[2], p[3], p[1])):
        if all(passage[1] >= end or passage[2] <= start for _, start, end, _ in kept):
            kept.append(passage)
    return kept


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST):
        self.least = least
        self.names = [name for name, _ in templates]
        words = [WORDS.findall(text.lower()) for _, text in templates]
        self.lengths, self.sets = [len(w) for w in words], [bigrams(w) for w in words]
        #: shared bigrams without which a passage can't reach ``least``
        self.needed = [max(1, math.ceil(least / (2 - least) * len(s) - 1e-9)) for s in self.sets]
        self.index: dict[tuple[str, str], list[int]] = {}
        for i, known in enumerate(self.sets):
            for pair in known:
                self.index.setdefault(pair, []).append(i)
        self.firsts = frozenset(a for a, _ in self.index)

    def passages(self, words: list[str]) -> list[Passage]:
        """All passages at ``least`` or above."""
        firsts, index, hits = self.firsts, self.index, {}
        for i in [i for i, w in enumerate(words[:-1]) if w in firsts]:
            for template in index.get((words[i], words[i + 1]), ()):
                hits.setdefault(template, []).append(i)
        found = []
        for template, at in hits.items():
            if len(at) >= self.needed[template]:
                found += self._windows(words, template, at)
        return found

    def _windows(self, words: list[str], template: int, at: list[int]) -> list[Passage]:
        """The template's passages. ``at``: where its bigrams begin, in order."""
        size, known, needed = self.lengths[template], self.sets[template], self.needed[template]
        counts: dict[tuple[str, str], int] = {}
        found, ahead = [], 0
        for start in at:
            while ahead < len(at) and at[ahead] + 1 < start + size:
                pair = (words[at[ahead]], words[at[ahead] + 1])
                counts[pair] = counts.get(pair, 0) + 1
                ahead += 1
            if len(counts) >= needed:
                end = min(len(words), start + size)
                value = dice(bigrams(words[start:end]), known)
                if value >= self.least:
                    found.append((value, start, end, self.names[template]))
            pair = (words[start], words[start + 1])
            counts[pair] -= 1
            if not counts[pair]:
                del counts[pair]
        return found

    def text(self, text: str | None) -> tuple[str | None, float | None, list[str]]:
        found = apart(self.passages(WORDS.findall(text.lower()))) if text else []
        if not found:
            return None, None, []
        best, name = min((-value, name) for value, _, _, name in found)
        return name, round(-best, 6), sorted({name for _, _, _, name in found})


def license_scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST
) -> DataFrame:
    """key, license (best or null), dice, licenses (all found, sorted) of each document."""
    fields = [("license", T.StringType()), ("dice", T.DoubleType()), ("licenses", T.ArrayType(T.StringType()))]

    def setup():
        scanner = Scanner(templates, least)
        return lambda texts: tuple(map(list, zip(*map(scanner.text, texts), strict=True))) if texts else ([], [], [])

    return append(spread(docs.select(key, text)), [text], fields, setup).drop(text)
