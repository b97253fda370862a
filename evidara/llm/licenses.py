"""License scans by conditional compression.

A block of a text is a candidate where a cue word stands: a line, and each run of lines
from cue to cue with the lines of its paragraph, both whole and by sentences, whatever
their length. Blocks are taken in windows that overlap by half, so that each notice or text lies whole
in one. A window is compressed alone and with each dictionary of templates (a raw zstandard
dictionary for the notices of each name, and for each whole text); templates whose dictionary reduces the
size by a share of what it does to themselves are ranked by the reduction. In that order, notices are aligned
word by word with the stretch around their name, and whole texts wherever a piece of them stands that few
changes must leave as it is. A template is confirmed if the wording differs in nothing that names
the license, and for whole texts in few words; the differences are part of the result. All that is
confirmed stands; where places of several licenses overlap, the fewest differences decide. Notices of
three words or fewer are too short to be compressed; nothing of them may differ, so they are looked up.

Templates are short notices, made by rule from names and phrasings, and whole texts and
headers. Each id of an SPDX expression is a finding; a notice after `not` or `never`, or with
one of them among its differences, is none. Spans are code points of the text, end exclusive. Defined cases: null and empty
texts have no findings; each finding of a repeated row is repeated; a line that confirms
several licenses has a row for each; a span goes from the first to the last word that
belongs to the template, with the marks that adjoin them; null ids and other columns are not looked at.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Licenses by SPDX id with their names, phrasings of notices, and whole texts.
NAMES = [
    ("MIT", "the MIT License"), ("ISC", "the ISC License"), ("Zlib", "the zlib License"), ("Unlicense", "the Unlicense"),
    ("BSD-2-Clause", "the BSD 2-Clause License"), ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("Apache-2.0", "the Apache License, Version 2.0"), ("MPL-2.0", "the Mozilla Public License, version 2.0"),
    ("GPL-2.0", "the GNU General Public License, version 2"), ("GPL-3.0", "the GNU General Public License, version 3"),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"), ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"), ("EPL-2.0", "the Eclipse Public License, version 2.0"),
    ("CC0-1.0", "CC0 1.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
]
#: Other ways to write the names of NAMES; every license also goes by its SPDX id.
SHORT = {
    "MIT": ["MIT", "MIT License"], "ISC": ["ISC", "ISC License"], "Zlib": ["zlib"], "BSD-2-Clause": ["BSD 2-Clause", "the Simplified BSD License"], "BSD-3-Clause": ["BSD 3-Clause", "the New BSD License"],
    "Apache-2.0": ["Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0"], "MPL-2.0": ["MPL 2.0", "Mozilla Public License 2.0"],
    "GPL-2.0": ["GPLv2", "GPL v2", "the GNU GPL v2", "the GNU GPLv2"], "GPL-3.0": ["GPLv3", "GPL v3", "the GNU GPL v3", "the GNU GPLv3"], "LGPL-2.1": ["LGPLv2.1", "LGPL v2.1"], "LGPL-3.0": ["LGPLv3", "LGPL v3"],
    "AGPL-3.0": ["AGPLv3", "AGPL v3"], "EPL-2.0": ["EPL 2.0", "Eclipse Public License 2.0"], "Unlicense": ["Unlicense"],
}
#: Names that say what they are without a word beside them.
TELLING = ("GPLv2", "GPLv3", "LGPLv2.1", "LGPLv3", "AGPLv3")
#: Licenses whose SPDX id may end in one of ENDINGS.
GNU, ENDINGS = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"), ("", "-only", "-or-later")
PHRASES = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "Distributed under the terms of {}."]
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation{stop} either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for more details."
TEXTS |= {
    "BSD-2-Clause": _BSD + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD + _BSD_NAMES + _BSD_WARRANTY,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0": _GNU.format(what="program", mark=";", name="", stop=";", version="2"),
    "LGPL-2.1": _GNU.format(what="library", mark=";", name="Lesser ", stop=";", version="2.1"),
    "LGPL-3.0": _GNU.format(what="library", mark=":", name="Lesser ", stop=",", version="3"),
    "AGPL-3.0": _GNU.format(what="program", mark=":", name="Affero ", stop=",", version="3"),
}
RESERVED = "All rights reserved."
CUES = ("licens", "licenc", "copyright", "rights reserved", "permission", "redistribut", "warrant", "public domain", "free software", "creative commons", "spdx", "cc by", "cc0", "unlicense", "gplv", "gpl v", "made available", "released under", "terms of")

_CUE = re.compile("|".join(map(re.escape, CUES)))
_WORD = re.compile(r"[a-z0-9]+(?:[.\-+/][a-z0-9]+)*")
_SENTENCE = re.compile(r"[^.!?]*(?:[.!?](?!\s|$)[^.!?]*)*[.!?]*\s*")
#: Words that take a notice back, when among the differences or right before it; what may stand between the ids of an SPDX expression.
_NOT, _JOINTS = {"not", "never", "nor", "cannot", "neither"}, {"or", "and", "with"}
_SPDX = "spdx-license-identifier"
#: Share of words that may differ in whole texts; share of what a dictionary saves of its own templates that it must save of a window.
MAX_DIFFER, MIN_SAVED = 0.1, 0.2
#: Words of a notice in which nothing may differ, words around a notice that it is aligned with, and words of an SPDX expression before an id.
SHORT_WORDS, STRETCH, EXPRESSION = 3, 8, 64
#: Lines from one cue to the next of a run, and at most taken around it.
RUN_GAP = 5


@dataclass(frozen=True)
class Template:
    license: str
    text: str
    name: tuple[str, ...]  # words that must stand as they are; none for whole texts

    @property
    def words(self) -> list[str]:
        return _WORD.findall(self.text.lower())


def templates() -> list[Template]:
    out = [Template("Proprietary", RESERVED, tuple(_WORD.findall(RESERVED.lower())))]
    named = lambda spdx, text, name: Template(spdx, text, tuple(w for w in _WORD.findall(name.lower()) if w != "the"))
    for spdx, full in NAMES:
        names = list(dict.fromkeys([full, spdx, *SHORT.get(spdx, ())]))
        for name in names:
            out += [named(spdx, p.format(name), name) for p in PHRASES]
            out += [named(spdx, p.format(name.removeprefix("the ")), name) for p in ("License: {}.", "{} licensed.")]
            if "license" not in name.lower():
                out.append(named(spdx, f"the {name.removeprefix('the ')} license", name))
        out += [named(spdx, name, name) for name in names if name in TELLING]
        out += [named(spdx, f"SPDX-License-Identifier: {spdx}{e}", spdx + e) for e in (ENDINGS if spdx in GNU else ENDINGS[:1])]
    seen: set = set()
    out = [t for t in out if not ((t.license, tuple(t.words)) in seen or seen.add((t.license, tuple(t.words))))]
    return out + [Template(spdx, text, ()) for spdx, text in TEXTS.items()]


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans of candidate blocks, without white space around them."""
    low = lowered(text)
    if not _CUE.search(low):
        return []
    found: list[tuple[int, int]] = []
    spans, cued, at = [], [], 0
    for line in low.split("\n"):
        end = at + len(line)
        if _CUE.search(line):
            cued.append(len(spans))
            found.append((at, end))
        spans.append((at, end))
        at = end + 1
    runs: list[list[int]] = []
    for k in cued:
        if runs and k - runs[-1][1] <= RUN_GAP:
            runs[-1][1] = k
        else:
            runs.append([k, k])
    filled = [bool(low[x:y].strip()) for x, y in spans]
    for first, last in runs:  # and the lines around it, as far as the paragraph goes
        near = next((k for k in range(first - 1, first - RUN_GAP, -1) if k < 0 or not filled[k]), first - RUN_GAP) + 1
        far = next((k for k in range(last + 1, last + RUN_GAP + 1) if k >= len(spans) or not filled[k]), last + RUN_GAP + 1) - 1
        found.append((spans[near][0], spans[far][1]))
    for a, b in found[:]:
        found += [m.span() for m in _SENTENCE.finditer(low, a, b) if m.end() > m.start() and _CUE.search(low, *m.span())]
    out = set()
    for a, b in found:
        part = text[a:b]
        a, b = a + len(part) - len(part.lstrip()), a + len(part.rstrip())
        if a < b:
            out.add((a, b))
    return sorted(out)


def differences(block: list[str], template: list[str]) -> tuple[list[str], int, int]:
    """Word edits that make the template out of the best part of the block, and that part's place."""
    ops = difflib.SequenceMatcher(None, block, template, autojunk=False).get_opcodes()
    while ops and ops[0][0] == "delete":
        ops = ops[1:]
    while ops and ops[-1][0] == "delete":
        ops = ops[:-1]
    if not ops:
        return [f"-{w}" for w in template], 0, 0
    out = [x for tag, a, b, c, d in ops if tag != "equal" for x in [*(f"+{w}" for w in block[a:b]), *(f"-{w}" for w in template[c:d])]]
    return out, ops[0][1], ops[-1][2]


def lowered(text: str) -> str:
    """In lower case, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def placed(text: str) -> tuple[list[tuple[int, int]], list[str]]:
    """Spans of the words of a text, and the words."""
    low = lowered(text)
    at = [m.span() for m in _WORD.finditer(low)]
    return at, [low[a:b] for a, b in at]


def around(text: str, start: int, end: int) -> tuple[int, int]:
    """The span with the marks that adjoin it."""
    while start and not (text[start - 1].isspace() or text[start - 1].isalnum()):
        start -= 1
    while end < len(text) and not (text[end].isspace() or text[end].isalnum()):
        end += 1
    return start, end


class Whole:
    """Finds a whole text with few changed words, in time linear in the block.

    Of one piece more than there may be changes, one stands unchanged, and tells where
    the text can be.
    """

    def __init__(self, words: list[str]):
        self.words, self.most = words, int(MAX_DIFFER * len(words))
        cuts = [len(words) * k // (self.most + 1) for k in range(self.most + 2)]
        self.pieces: dict[str, list[tuple[int, tuple[str, ...]]]] = {}
        for c, d in zip(cuts, cuts[1:]):
            self.pieces.setdefault(words[c], []).append((c, tuple(words[c:d])))

    def places(self, block: list[str]) -> list[tuple[list[str], int, int]]:
        """(differences, first word, word after the last) of each place of the text in the block."""
        starts = sorted({k - c for k, w in enumerate(block) for c, piece in self.pieces.get(w, ()) if tuple(block[k : k + len(piece)]) == piece})
        groups: list[list[int]] = []
        for at in starts:
            if groups and at - groups[-1][0] <= self.most:
                groups[-1][1] = at
            else:
                groups.append([at, at])
        out = []
        for first, last in groups:
            best = None
            for more in (0, self.most):
                a = max(0, first - more)
                got = differences(block[a : max(a, last + len(self.words) + more)], self.words)
                if best is None or len(got[0]) < len(best[0]):
                    best = (got[0], got[1] + a, got[2] + a)
            if len(best[0]) <= self.most:
                out.append(best)
        return out


def sized(text: str) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Cover:
    """Places that are taken, as sorted intervals that do not touch."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def meets(self, a: int, b: int) -> bool:
        k = bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < b

    def add(self, a: int, b: int) -> None:
        i, j = bisect_left(self.ends, a), bisect_right(self.starts, b)
        if i < j:
            a, b = min(a, self.starts[i]), max(b, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [a], [b]


class Scanner:
    def __init__(self, known: list[Template] | None = None, level: int = 3):
        self.known = templates() if known is None else known
        self.level = level
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.words = [t.words for t in self.known]
        self.given = [self.with_dictionary(t.text) for t in self.known]
        self.whole = {i: Whole(self.words[i]) for i, t in enumerate(self.known) if not t.name}
        by_name: dict[tuple[str, ...], list[int]] = {}
        self.short: dict[tuple[str, ...], list[int]] = {}
        for i, t in enumerate(self.known):
            if t.name and len(self.words[i]) > SHORT_WORDS:
                by_name.setdefault(t.name, []).append(i)
            elif t.name:  # of an SPDX expression each id is looked up
                self.short.setdefault(tuple(self.words[i][self.words[i][0] == _SPDX :]), []).append(i)
        #: (templates, compressor with all of them as dictionary, least reduction) of each name, and of each whole text.
        self.notices_of = [(g, *self.dictionary(g)) for g in by_name.values()]
        self.texts_of = [([i], *self.dictionary([i])) for i in self.whole]
        self.joints = _JOINTS | {w for t in self.known if len(t.name) == 1 for w in t.name}
        longest = lambda which: max((len(self.words[i]) for i in which), default=0)
        self.notice_window = 2 * (2 * longest(i for g in by_name.values() for i in g) + STRETCH)
        self.text_window = 4 * longest(self.whole)
        self.seen: dict[str, list] = {}

    def with_dictionary(self, text: str) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=self.level, dict_data=sized(text), write_content_size=False)

    def dictionary(self, group: list[int]) -> tuple[zstandard.ZstdCompressor, float]:
        """Their texts as one dictionary, and the least reduction of a window that may hold one of them."""
        made = self.with_dictionary(" ".join(self.known[i].text for i in group))
        own = [self.reduction(self.known[i].text.encode(), made) for i in group]
        return made, MIN_SAVED * min(own)

    def reduction(self, raw: bytes, given: zstandard.ZstdCompressor, alone: int | None = None) -> int:
        return (len(self.plain.compress(raw)) if alone is None else alone) - len(given.compress(raw))

    def chosen(self, window: str, groups: list) -> list[list[int]]:
        """Templates of the groups whose dictionary reduces the window enough, those of the greatest reduction first."""
        raw = window.encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        saved = [(self.reduction(raw, made, alone), least, k) for k, (_, made, least) in enumerate(groups)]
        return [groups[k][0] for r, least, k in sorted(saved, key=lambda s: (-s[0], s[2])) if r >= least]

    def saved(self, block: str, which: Iterable[int]) -> list[tuple[float, int]]:
        """(share saved, template) of each of these templates."""
        raw = block.encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        return [((alone - len(self.given[i].compress(raw))) / alone, i) for i in which]

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """(share saved, template) of those that save enough, most first."""
        return sorted((s for s in self.saved(block, range(len(self.known))) if s[0] >= MIN_SAVED), key=lambda s: (-s[0], s[1]))

    @staticmethod
    def windows(first: int, last: int, size: int) -> Iterator[tuple[int, int]]:
        """Windows of so many words, each beginning in the middle of the one before."""
        step = max(1, size // 2)
        for at in range(first, max(first + 1, last - step), step):
            yield at, min(last, at + size)

    def notices(self, block: str, at: list[tuple[int, int]], words: list[str], first: int, last: int) -> list[tuple]:
        """As judge, with places in words: among words first to last, and among what confirmed ones leave."""
        if first >= last:
            return []
        found = []
        for k in range(first, last):
            for n in range(1, min(SHORT_WORDS, last - k) + 1):
                for i in self.short.get(tuple(words[k : k + n]), ()):
                    before = EXPRESSION if self.words[i][0] == _SPDX else STRETCH
                    found += self.confirmed(block, at, words, i, max(first, k - before), min(last, k + n + STRETCH))
        for lo, hi in self.windows(first, last, self.notice_window):
            stand: dict[str, list[int]] = {}
            for k in range(lo, hi):
                stand.setdefault(words[k], []).append(k)
            for group in self.chosen(block[at[lo][0] : at[hi - 1][1]], self.notices_of):
                name = self.known[group[0]].name
                places = [k for k in stand.get(name[0], ()) if tuple(words[k : k + len(name)]) == name]
                for i in group if places else ():
                    n, off = len(self.words[i]), next(k for k in range(len(self.words[i])) if tuple(self.words[i][k : k + len(name)]) == name)
                    stretches = sorted({(max(first, k - off - n - STRETCH), min(last, k - off + 2 * n + STRETCH)) for k in places})
                    for a, b in stretches:
                        found += self.confirmed(block, at, words, i, a, b)
        denied = Cover()
        for f in found:
            if not f[0]:
                denied.add(f[1], f[2])
        out = self.settled([f for f in found if f[0] and not denied.meets(f[1], f[2])])
        if not out:
            return []
        free, more = first, []
        for a, b in sorted(f[1:3] for f in out):
            more += self.notices(block, at, words, free, a)
            free = max(free, b)
        return out + more + self.notices(block, at, words, free, last)

    def confirmed(self, block: str, at: list[tuple[int, int]], words: list[str], i: int, first: int, last: int) -> list[tuple]:
        """The place of a notice among words first to last, if its wording stands; without a license if it is denied."""
        t, n, part = self.known[i], len(self.known[i].name), words[first:last]
        differ, a, b = differences(part, self.words[i])
        before = words[max(0, first + a - 2) : first + a]
        # as in: not licensed under, isn't released under
        denied = bool({d[1:] for d in differ if d[0] == "+"} & _NOT or _NOT & set(before) or before[-1:] == ["t"] or before == ["no", "longer"])
        if self.words[i][0] == _SPDX and a < b and part[a] == _SPDX and all(d[0] == "+" and d[1:] in self.joints for d in differ):
            a, differ = b - 1 if differ else a, []  # a further id of an expression
        # the wording before the name may differ a little, what follows may not go on with the name
        most = 0 if len(self.words[i]) <= SHORT_WORDS else max(2, len(self.words[i]) // 2)
        if len(differ) > most or not any(tuple(part[k : k + n]) == t.name for k in range(a, b - n + 1)):
            return []
        return [("" if denied else t.license, a + first, b + first, self.saved(block[at[a + first][0] : at[b + first - 1][1]], [i])[0][0], differ)]

    @staticmethod
    def settled(found: list[tuple]) -> list[tuple]:
        """Of places that overlap, those of fewest differences; each license once."""
        out: list[tuple] = []
        fewer, of_license = Cover(), {}
        order = sorted(found, key=lambda f: (len(f[4]), f[1] - f[2], -f[3]))
        for _, same in groupby(order, key=lambda f: len(f[4])):
            kept = []
            for f in same:
                own = of_license.setdefault(f[0], Cover())
                if not own.meets(f[1], f[2]) and not fewer.meets(f[1], f[2]):
                    own.add(f[1], f[2])
                    kept.append(f)
            for f in kept:
                fewer.add(f[1], f[2])
            out += kept
        return out

    def judge(self, block: str) -> list[tuple[str, int, int, float, list[str]]]:
        """(license, start, end, share saved, differences) of the notices that are confirmed in the block."""
        if block in self.seen:
            return self.seen[block]
        at, words = placed(block)
        out = [(lic, *around(block, at[a][0], at[b - 1][1]), saved, differ) for lic, a, b, saved, differ in self.notices(block, at, words, 0, len(words))]
        if len(self.seen) > 20_000:
            self.seen.clear()
        self.seen[block] = out
        return out

    def texts(self, text: str) -> list[tuple[str, int, int, float, list[str]]]:
        """As judge, of the whole texts that stand anywhere in the text."""
        at, words = placed(text)
        found = []
        for i, lo, hi in self.text_places(text, at, words):
            for differ, a, b in self.whole[i].places(words[lo:hi]):
                a, b = a + lo, b + lo
                start, end = around(text, at[a][0], at[b - 1][1])
                found.append((self.known[i].license, start, end, self.saved(text[start:end], [i])[0][0], differ))
        return self.settled(found)

    def text_places(self, text: str, at: list[tuple[int, int]], words: list[str]) -> list[tuple[int, int, int]]:
        """(template, first word, word after the last) of the windows that whole texts are chosen for, joined where they touch."""
        ranges: dict[int, list[list[int]]] = {}
        for lo, hi in self.windows(0, len(words), self.text_window):
            for (i,) in self.chosen(text[at[lo][0] : at[hi - 1][1]], self.texts_of) if hi > lo else ():
                mine = ranges.setdefault(i, [])
                if mine and lo <= mine[-1][1]:
                    mine[-1][1] = hi
                else:
                    mine.append([lo, hi])
        return [(i, lo, hi) for i, mine in ranges.items() for lo, hi in mine]

    def scan(self, text: str | None) -> list[tuple[str, int, int, float, list[str]]]:
        """(license, start, end, share saved, differences); of places within one another, the best wording."""
        parts = blocks(text) if text else []
        found = [(lic, a + x, a + y, saved, differ) for a, b in parts for lic, x, y, saved, differ in self.judge(text[a:b])]
        if parts:
            found += self.texts(text)
        out: list[tuple] = []
        taken: dict[str, Cover] = {}
        for f in sorted(found, key=lambda f: (len(f[4]), f[1] - f[2], f[1], f[0], -f[3])):
            mine = taken.setdefault(f[0], Cover())
            if not mine.meets(f[1], f[2]):
                mine.add(f[1], f[2])
                out.append(f)
        return sorted(out, key=lambda f: (f[1], f[2], f[0]))


def find_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, license, start, end, saved, differences) of each finding in docs (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("saved", pa.float64()), ("differences", pa.list_(pa.string()))])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in slices(batches):
            rows = [(i, *f) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for f in scanner.scan(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, license string, start int, end int, saved double, differences array<string>")
