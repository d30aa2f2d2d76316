"""License scans by conditional compression.

Blocks (sentences around a cue; for whole license texts all that stands round the cues of a
document) are compressed with each license template as a zstandard raw
dictionary.  Templates are ranked by how many bytes that saves; each is held
against every stretch of the block and confirmed by its word differences.  The name of the license within a
template, numbers and words that turn a sense round must be the same: what differs there is an unknown variant
of the template, not that license; so is what a word such as "not" goes before.  Of confirmed stretches that overlap
the best one stays, all others are returned.  A license that "and", "or" or a comma joins to a confirmed one is found by its name alone.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import with_results

#: Wordings by which licenses are stated (fixed values; further ones are a parameter).  What stands in
#: braces names the license and must be there word by word.  A name that ends in -text is a wording of the license before it.
TEMPLATES = {
    "MIT": "Released under the {MIT License}.",
    "Apache-2.0": "Licensed under the {Apache License, Version 2.0}.",
    "Apache-2.0-text": "Licensed under the {Apache License, Version 2.0} (the \"License\"); you may not use this file except in compliance with the License.",
    "GPL-3.0": "This work is licensed under the {GNU General Public License, version 3}.",
    "GPL-2.0": "This work is licensed under the {GNU General Public License, version 2}.",
    "LGPL-3.0": "This work is licensed under the {GNU Lesser General Public License, version 3}.",
    "LGPL-2.1": "This work is licensed under the {GNU Lesser General Public License, version 2.1}.",
    "AGPL-3.0": "This work is licensed under the {GNU Affero General Public License, version 3}.",
    "BSD": "{Redistribution and use in source and binary forms}, with or without modification, are permitted provided that the following conditions are met.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}.",
    "EPL-2.0": "This program is made available under the terms of the {Eclipse Public License 2.0}.",
    "CC-BY-4.0": "Licensed under {CC BY 4.0}.",
    "CC-BY-SA-4.0": "Licensed under {CC BY-SA 4.0}.",
    "CC-BY-NC-4.0": "Licensed under {CC BY-NC 4.0}.",
    "CC-BY-ND-4.0": "Licensed under {CC BY-ND 4.0}.",
    "CC-BY-NC-SA-4.0": "Licensed under {CC BY-NC-SA 4.0}.",
    "CC-BY-NC-ND-4.0": "Licensed under {CC BY-NC-ND 4.0}.",
    "CC0-1.0": "Licensed under {CC0 1.0 Universal}, dedicated to the public domain.",
    "proprietary": "{All rights reserved}.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-grant-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "GPL-3.0-or-later-text": """This program is free software: you can redistribute it and/or modify it under the terms of the {GNU General Public License} as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
}
#: What BSD-3-Clause has beyond BSD-2-Clause.
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
TEMPLATES["BSD-3-Clause-text"] = TEMPLATES["BSD-2-Clause-text"].replace("THIS SOFTWARE IS", _THIRD + "THIS SOFTWARE IS", 1)
#: Short names by which licenses are known (fixed values), stated behind one of LEADS and a colon or word.
NAMES = {
    "MIT": ("MIT", "Expat"), "Apache-2.0": ("Apache-2.0", "Apache 2.0", "Apache 2"), "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GPLv2", "GPL v2", "GPL 2.0", "GNU GPLv2", "GNU GPL v2"),
    "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPLv3", "GPL v3", "GPL 3.0", "GNU GPLv3", "GNU GPL v3"), "GPL-2.0-or-later": ("GPL-2.0-or-later",), "GPL-3.0-or-later": ("GPL-3.0-or-later",),
    "LGPL-2.1": ("LGPL-2.1", "LGPL-2.1-only", "LGPLv2.1", "LGPL v2.1"), "LGPL-3.0": ("LGPL-3.0", "LGPL-3.0-only", "LGPLv3", "LGPL v3"), "LGPL-2.1-or-later": ("LGPL-2.1-or-later",), "LGPL-3.0-or-later": ("LGPL-3.0-or-later",),
    "AGPL-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPLv3", "AGPL v3"), "AGPL-3.0-or-later": ("AGPL-3.0-or-later",), "BSD-2-Clause": ("BSD-2-Clause", "BSD 2-Clause"), "BSD-3-Clause": ("BSD-3-Clause", "BSD 3-Clause"),
    "MPL-2.0": ("MPL-2.0", "MPL 2.0"), "EPL-2.0": ("EPL-2.0", "EPL 2.0"), "ISC": ("ISC",), "Zlib": ("Zlib",), "Unlicense": ("Unlicense",), "CC0-1.0": ("CC0-1.0", "CC0 1.0"),
    "CC-BY-4.0": ("CC-BY-4.0", "CC BY 4.0"), "CC-BY-SA-4.0": ("CC-BY-SA-4.0", "CC BY-SA 4.0"), "CC-BY-NC-4.0": ("CC-BY-NC-4.0",), "CC-BY-ND-4.0": ("CC-BY-ND-4.0",), "CC-BY-NC-SA-4.0": ("CC-BY-NC-SA-4.0",), "CC-BY-NC-ND-4.0": ("CC-BY-NC-ND-4.0",),
}
LEADS = {"spdx-license-identifier": (), "license": (":",), "licence": (":",), "licensed": ("under",), "licenced": ("under",), "released": ("under",), "distributed": ("under",), "available": ("under",)}
#: Words before a stretch that turn its sense round (fixed values), and how many words before it are looked at.
TURNS = frozenset("not no never neither nor cannot isn wasn aren weren".split())
BEFORE = 3
#: Words that may stand between a license and one that is joined to it (fixed values).
JOINS = frozenset("and or".split())
BETWEEN = frozenset("and or either both also the a under by of terms alternatively at your option license licence".split())
_JOINT = re.compile(r"[,/&+|]")
#: Words that tell licenses apart or turn a sense round, wherever they stand (fixed values); words with a digit are such, too.
KEYS = frozenset("affero lesser library mozilla eclipse apache mit bsd isc zlib gnu gpl lgpl agpl sa nc nd sharealike noncommercial noderivatives noderivs attribution proprietary not no neither nor only except".split())
#: Spellings that count as the same where words must be the same (fixed values).
SAME = {"licence": "license", "licenced": "licensed", "ver": "version", "v": "version"}
UNKNOWN = "unknown variant"
#: Templates of more words are held against all that stands round the cues of a document, not against single sentences.
LONG = 30
CUE = r"licen[cs]e|\b[al]?gpl|rights[\W_]+reserved|public[\W_]+domain|copyright|\bcc[\W_]{0,9}(?:by|0)|redistribution|permission[\W_]+is[\W_]+hereby"
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_CUE = re.compile(CUE, re.I)
_SIGNS = r"[ \t]*(?:[#*;%!>|'\"]+|//+!?|/\*+!?|--+)?[ \t]*"
#: Ends of sentences: a stop before white space, or a line without words; a single line end is white space.
_END = re.compile(r"[.!?][\"')\]]*(?=\s)|\n" + _SIGNS + r"\r?(?=\n)")
_TAIL = re.compile(r"[^\w\s]*")
_SHORT = re.compile(r"\b(?:v|no)\Z", re.I)
_LINE = re.compile(r"\n" + _SIGNS)


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def key(word: str) -> bool:
    """Whether a license is another one with another word here."""
    return any(c.isdigit() for c in word) or any(w in KEYS for w in re.split("[.-]", word))


def gate(template: str, differences: float) -> list[str]:
    """Words of which every stretch that may be confirmed has one: one more than may be lost, the longest."""
    own = words(template)
    counts, lost, found = Counter(own), int(differences * len(own)), []
    for w in sorted(counts, key=lambda w: (-len(w), w)):
        found.append(w)
        lost -= counts[w]
        if lost < 0:
            break
    return found


def plain(text: str) -> str:
    """Lower case, white space (and comment signs at line starts) as one space: what is compressed, as words are compared without case, too."""
    return " ".join(_LINE.sub(" ", text.lower()).split())


def _stop(text: str, lo: int, hi: int) -> re.Match | None:
    """The first end of a sentence; a version number such as "v. 2.0" has none."""
    stop = _END.search(text, lo, hi)
    while stop and _SHORT.search(text, max(0, stop.start() - 3), stop.start()):
        stop = _END.search(text, stop.end(), hi)
    return stop


def candidate_blocks(text: str, reach: int = 600, cues: re.Pattern = _CUE) -> list[tuple[int, int]]:
    """Stretches of sentences around cues, (start, end); sentences end at a stop before white space or at a blank line.

    A block is the sentence of one or more cues, or (where that is longer) `reach` characters on
    either side of them; cues whose surroundings meet within a sentence share a block.
    """
    found: list[tuple[int, int]] = []
    at = 0
    while cue := cues.search(text, at):
        lo = max(at, cue.start() - reach)
        before = [m.end() for m in _END.finditer(text, lo, cue.start()) if not _SHORT.search(text, max(0, m.start() - 3), m.start())]
        start = before[-1] if before else lo
        while True:
            most = min(len(text), cue.end() + 2 * reach + 2)
            stop = _stop(text, cue.end(), most)
            further = cues.search(text, cue.end(), stop.start() if stop else most)
            if not further:
                break
            cue = further
        end = min(stop.end() if stop else len(text), cue.end() + reach)
        at = max(end, cue.end())
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        found.append((start, end))
    return found


def aligned(other: list[str], own: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Opcodes with the fewest words lost and added (difflib's may have more)."""
    rows = [[0] * (len(own) + 1)]
    for x in reversed(other):
        row, below = [0] * (len(own) + 1), rows[-1]
        for j in range(len(own) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == own[j] else max(below[j], row[j + 1])
        rows.append(row)
    rows.reverse()
    out: list[tuple[str, int, int, int, int]] = []
    i = j = a = c = 0
    while i < len(other) or j < len(own):
        if i < len(other) and j < len(own) and other[i] == own[j]:
            if (a, c) != (i, j):
                out.append(("replace", a, i, c, j))
            out.append(("equal", i, i + 1, j, j + 1))
            i, j = i + 1, j + 1
            a, c = i, j
        elif i < len(other) and (j == len(own) or rows[i + 1][j] >= rows[i][j + 1]):
            i += 1
        else:
            j += 1
    return out if (a, c) == (i, j) else [*out, ("replace", a, i, c, j)]


class Scanner:
    """differences: words that may be lost, added or exchanged, as a share of the template's words.

    A template without any of the cues is looked for round words of its own, so many of the longest that no
    stretch with few enough differences lacks them all.
    winners: with a number, only so many templates of a block (by bytes saved) are confirmed; by default all.
    """

    def __init__(self, templates: dict[str, str] | None = None, differences: float = 0.2, winners: int | None = None) -> None:
        marked = dict(sorted((TEMPLATES if templates is None else templates).items()))
        self.templates = {k: t.replace("{", "").replace("}", "") for k, t in marked.items()}
        self.differences, self.winners = differences, winners
        self.words = {k: words(t) for k, t in self.templates.items()}
        self.counts = {k: Counter(w) for k, w in self.words.items()}
        self.joined: dict[tuple[str, ...], str] = {}
        for k, t in reversed(marked.items()):
            for m in re.finditer(r"\{[^}]*\}", t) if t.count("{") == 1 else ():
                self.joined[tuple(SAME.get(w, w) for w in words(m[0]))] = k
        self.later: dict[str, str] = {}
        self.brief: dict[tuple[str, ...], str] = {}
        for license, names in NAMES.items() if templates is None else ():
            k = f"{license}#{names[0]}"
            self.brief |= {tuple(words(name)): k for name in names}
            self.later[license] = k
            marked[k] = "Licensed under the {" + names[0] + "} license."
        for name, k in self.brief.items():
            self.joined.setdefault(name, k)
        self.longest = max(map(len, self.joined), default=0)
        self.named = {k: [(len(words(t[: m.start()])), len(words(t[: m.end()]))) for m in re.finditer(r"\{[^}]*\}", t)] for k, t in marked.items()}
        self.words |= {k: words(marked[k]) for k in self.brief.values()}
        self.long = [k for k in self.templates if len(self.words[k]) > LONG]
        self.short = [k for k in self.templates if len(self.words[k]) <= LONG]
        own = {w for t in self.templates.values() if not _CUE.search(t) for w in gate(t, differences)}
        self.pattern = "|".join([CUE, *(r"\b" + re.escape(w) + r"\b" for w in sorted(own))])
        self.cues = re.compile(self.pattern, re.I) if own else _CUE
        reach = lambda some: max([600, *(2 * len(self.templates[k]) for k in some)])
        self.reach, self.wide = reach(self.short), reach(self.long)
        self.plain = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
        self.given = {k: zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(plain(t).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, t in {k: t.replace("{", "").replace("}", "") for k, t in marked.items()}.items()}

    def rank(self, block: str, names: list[str] | None = None) -> list[tuple[int, str]]:
        """(bytes saved, template), most first; ties by name."""
        raw = plain(block).encode()
        alone = len(self.plain.compress(raw))
        return sorted(((alone - len(self.given[k].compress(raw)), k) for k in (self.templates if names is None else names)), key=lambda x: (-x[0], x[1]))

    def saved(self, stretch: str, template: str) -> int:
        raw = plain(stretch).encode()
        return len(self.plain.compress(raw)) - len(self.given[template].compress(raw))

    def differ(self, own: list[str], template: str) -> list[str]:
        """Words to lose (-) or add (+) that turn the template into a stretch of words."""
        return self.compare(own, template)[0]

    def compare(self, own: list[str], template: str, fewest: bool = False) -> tuple[list[str], bool]:
        """The word differences (by difflib, or the fewest), and whether one of them makes it another license: in the name that the template marks, or by a key word."""
        other = self.words[template]
        out: list[str] = []
        another = False
        for tag, a, b, c, d in aligned(other, own) if fewest else difflib.SequenceMatcher(None, other, own, autojunk=False).get_opcodes():
            if tag == "equal":
                continue
            out += ["-" + w for w in other[a:b]] + ["+" + w for w in own[c:d]]
            if [SAME.get(w, w) for w in other[a:b]] != [SAME.get(w, w) for w in own[c:d]]:
                inside = any((lo < b and a < hi) if a < b else lo < a < hi for lo, hi in self.named[template])
                another |= inside or any(key(w) for w in other[a:b] + own[c:d])
        return out, another

    def confirmed(self, own: list[str], ids: np.ndarray, known: dict[str, int], counts: Counter, template: str) -> Iterator[tuple[int, int, list[str], bool]]:
        """Stretches (first word, end) of a block's words that differ little enough from the template, their differences, and whether these make another license.

        A stretch that may lose and add `most` words is at most twice as many edits away, so all ends of
        stretches within that distance are judged: first with the start that gives the fewest edits, then, where that one
        loses or adds too much, with the start that loses and adds least; own words that are too few in common can't be.
        """
        other = self.words[template]
        most = self.differences * len(other)
        if not other or sum(min(n, counts[w]) for w, n in self.counts[template].items()) < len(other) - most:
            return
        n = len(own)
        place = np.arange(n + 1)
        edits, start = np.zeros(n + 1, dtype=np.int64), place.copy()
        for w in other:
            kept = np.concatenate([[n + 1], edits[:-1] + (ids != known.get(w, -1))])
            lost = edits + 1
            best = np.minimum(kept, lost)
            begin = np.where(kept <= lost, np.concatenate([[0], start[:-1]]), start)
            # words added behind: the least of best[i] + (j - i), the nearest i first
            level = best - place
            least = np.minimum.accumulate(level)
            nearest = np.maximum.accumulate(np.where(level == least, place, 0))
            edits, start = least + place, begin[nearest]
        few = lambda differences: max(sum(w[0] == s for w in differences) for s in "+-") <= most
        for end in np.flatnonzero(edits <= 2 * most):
            lo, hi = int(start[end]), int(end)
            differences, another = self.compare(own[lo:hi], template)
            if lo == hi or not few(differences):
                lo = self.best_start(ids, known, hi, template, most)
                if lo is None:
                    continue
                differences, another = self.compare(own[lo:hi], template)
                if not few(differences):
                    differences, another = self.compare(own[lo:hi], template, fewest=True)
            yield lo, hi, differences, another

    def best_start(self, ids: np.ndarray, known: dict[str, int], hi: int, template: str, most: float) -> int | None:
        """The start of the stretch up to hi that has the fewest words lost or added, whichever is more; none where these are more than `most`."""
        other = self.words[template]
        own = ids[max(0, hi - len(other) - int(most)) : hi][::-1]  # from the end back
        n = len(own)
        place = np.arange(n + 1)
        edits = place.copy()  # from own[:j] to no words of the template
        for w in reversed(other):
            differ = np.where(own == known.get(w, -1), 0, 2)  # an exchange is a word lost and one added
            best = edits + 1
            best[1:] = np.minimum(best[1:], edits[:-1] + differ)
            edits = np.minimum.accumulate(best - place) + place
        worst = (edits + np.abs(len(other) - place)) // 2
        j = int(worst[1:].argmin()) + 1 if n else 0
        return hi - j if n and worst[j] <= most else None

    def blocks(self, text: str) -> Iterator[tuple[int, int, list[str]]]:
        """(start, end, templates): sentences for the short templates, and for the long ones all that stands round the cues."""
        for start, end in candidate_blocks(text, self.reach, self.cues):
            yield start, end, self.short
        if self.long and (first := self.cues.search(text)):
            last = first
            for last in self.cues.finditer(text, first.end()):
                pass
            yield max(0, first.start() - self.wide), min(len(text), last.end() + self.wide), self.long

    @staticmethod
    def turned(block: str, spans: list[tuple[int, int]], own: list[str], lo: int) -> list[str]:
        """What stands shortly before a stretch, in its sentence, and turns its sense round."""
        for i in range(lo - 1, max(-1, lo - 1 - BEFORE), -1):
            if _END.search(block, spans[i][1], spans[i + 1][0]):
                break
            if own[i] in TURNS and own[i + 1] != "only":
                return ["+" + own[i]]
        return []

    def beside(self, block: str, spans: list[tuple[int, int]], own: list[str], hi: int) -> tuple[int, int, str] | None:
        """The name (first word, end, template) that is joined to what ends before the word hi."""
        at = hi
        while at < len(own) and at - hi < 6 and own[at] in BETWEEN:
            at += 1
        for lo in range(at, hi - 1, -1):  # "the" and the like may belong to the name
            if lo < len(own) and (JOINS & set(own[hi:lo]) or _JOINT.search(block, spans[hi - 1][1], spans[lo][0])) and not _END.search(block, spans[hi - 1][1], spans[lo][0]):
                for n in range(min(self.longest, len(own) - lo), 0, -1):
                    name = self.joined.get(tuple(SAME.get(w, w) for w in own[lo : lo + n]))
                    if name:
                        return lo, lo + n, name
        return None

    def stated(self, block: str, spans: list[tuple[int, int]], own: list[str]) -> Iterator[tuple[int, int, str]]:
        """(first word, end, template) of every short name behind one of LEADS."""
        for i in range(len(own) if self.brief else 0):
            behind = LEADS.get(own[i])
            if behind is None or i + 1 >= len(own):
                continue
            at = i + 1
            if behind == ("under",):
                if own[at] != "under":
                    continue
                at += 1
            elif ":" not in block[spans[i][1] : spans[at][0]]:
                continue
            while at < len(own) and at - i < 7 and own[at] in ("the", "a", "terms", "of", "either"):
                at += 1
            for n in range(min(self.longest, len(own) - at), 0, -1):
                name = self.brief.get(tuple(own[at : at + n]))
                if name and not _END.search(block, spans[i][1], spans[at][0]):
                    if block.startswith("+", spans[at + n - 1][1]):
                        name = self.later.get(license_of(name) + "-or-later", name)
                    yield i, at + n + (own[at + n : at + n + 1] in (["license"], ["licence"])), name
                    break

    def scan(self, text: str) -> list[dict]:
        stretches: list[tuple] = []
        places: dict[tuple[int, int], tuple] = {}
        for start, end, names in self.blocks(text):
            block = text[start:end]
            spans = [m.span() for m in _WORD.finditer(block)]
            own = [block[a:b].lower() for a, b in spans]
            counts = Counter(own)
            known = {w: i for i, w in enumerate(counts)}
            ids = np.array([known[w] for w in own], dtype=np.int64)
            saves: dict[tuple, int] = {}
            maybe = [k for k in names if sum(min(n, counts[w]) for w, n in self.counts[k].items()) >= (1 - self.differences) * len(self.words[k])]
            for lo, hi, name in self.stated(block, spans, own) if names is self.short else ():
                a, b = start + spans[lo][0], start + spans[hi - 1][1]
                turned = self.turned(block, spans, own, lo)
                places[a, b] = (start, block, spans, own, hi, turned)
                stretches.append((2 if turned else 1, lo - hi, len(turned), -self.saved(text[a:b], name), name, a, b, turned))
            for _, name in self.rank(block, maybe)[: self.winners] if maybe else []:
                for lo, hi, differences, another in self.confirmed(own, ids, known, counts, name):
                    a, b = spans[lo][0], _TAIL.match(block, spans[hi - 1][1]).end()
                    turned = self.turned(block, spans, own, lo)
                    places[start + a, start + b] = (start, block, spans, own, hi, turned)
                    differences, another = [*turned, *differences], another or bool(turned)
                    if (a, b, name) not in saves:
                        saves[a, b, name] = self.saved(block[a:b], name)
                    # words explained, less the differences: a whole text goes before a sentence of it
                    worth = hi - lo - sum(w[0] == "+" for w in differences) - len(differences)
                    stretches.append((2 if another else 0, -worth, len(differences), -saves[a, b, name], name, start + a, start + b, differences))
        found = []
        taken: list[tuple[int, int]] = []  # the chosen stretches, in order
        for another, _, _, saved, name, a, b, differences in sorted(stretches):
            i = bisect(taken, (a, b))
            if (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b):
                continue
            taken.insert(i, (a, b))
            found.append({"license": UNKNOWN if another == 2 else name, "nearest": name, "start": a, "end": b, "saved": -saved, "differences": differences})
        for x in found:  # grows by what is joined to what it holds
            if x["license"] == UNKNOWN and not places[x["start"], x["end"]][-1]:
                continue
            start, block, spans, own, hi, turned = places[x["start"], x["end"]]
            if beside := self.beside(block, spans, own, hi):
                lo, hi, name = beside
                a, b = start + spans[lo][0], start + spans[hi - 1][1]
                i = bisect(taken, (a, b))
                if (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b):
                    continue
                taken.insert(i, (a, b))
                places[a, b] = (start, block, spans, own, hi, turned)
                found.append({"license": UNKNOWN if turned else name, "nearest": name, "start": a, "end": b, "saved": self.saved(text[a:b], name), "differences": [*turned, *self.differ(own[lo:hi], name)]})
        return sorted(found, key=lambda x: x["start"])


_FOUND = pa.list_(pa.struct([("license", pa.string()), ("nearest", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.int64()), ("differences", pa.list_(pa.string()))]))


def license_of(template: str) -> str:
    """The license that a template of this name states."""
    return template.partition("#")[0].removesuffix("-text").removesuffix("-grant")


def _run(templates: dict[str, str] | None, differences: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, differences)
        for batch in batches:
            texts = batch.column("text")
            maybe = pc.fill_null(pc.match_substring_regex(texts, scanner.pattern, ignore_case=True), False).to_pylist()
            out = [scanner.scan(texts[i].as_py()) if maybe[i] else [] for i in range(batch.num_rows)]
            names = [sorted({license_of(x["license"]) for x in found}) for found in out]
            for x in (x for found in out for x in found):
                x["license"] = x["license"].partition("#")[0]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names, pa.list_(pa.string())), pa.array(out, _FOUND)], names=["row", "licenses", "found"])

    return run


def scan_licenses(documents: DataFrame, templates: dict[str, str] | None = None, differences: float = 0.2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, licenses (sorted names) and found (license, nearest template, start, end in characters, bytes saved, word differences) of every row.

    Null and empty texts, and texts without a cue, have none.  A wording that is near a template but names
    something else is an "unknown variant".  Of stretches that overlap a license goes before an unknown variant, then
    the one with more words of its template (less the differences), more bytes saved, then the lesser name wins.  Rows repeat as they come; other columns are dropped.
    """
    more = "licenses array<string>, found array<struct<license: string, nearest: string, start: bigint, end: bigint, saved: bigint, differences: array<string>>>"
    return with_results(documents, keep, {"text": F.col("text").cast("string")}, _run(templates, differences), more)
