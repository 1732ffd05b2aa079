"""License scans by patience alignment.

A text and a template are sequences of words. Words that occur once in both anchor the alignment:
the longest chain of anchors in the same order in both is kept, and the gaps between its members are
aligned in the same way, where other words have become unique. Coverage is the share of the
template's words that are aligned with equal words of the text.

A text is only aligned with templates of which it holds enough distinct words to reach the coverage,
and then from every place on where those words stand close enough together, so the texts of a clean
corpus are passed over by set intersection. A match of a notice or a whole text may be stretched by
other words to ``REACH`` times the template's length, a statement to ``STRETCH`` times.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm._shared import small_batches

COVERAGE = 0.8
STRETCH = 1.5  # windows that begin at every place are this many templates long
REACH = 4.0  # the longest match, in templates: part of what a match is
SHORT = 20  # templates of fewer words must align whole

# Public license texts, notices and statements.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program.""",
    "GPL-2.0-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program; if not, write to
the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "LGPL-2.1-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public
License for more details. You should have received a copy of the GNU Lesser General Public License along with this
library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301
USA.""",
    "LGPL-3.0-notice": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License
for more details. You should have received a copy of the GNU Lesser General Public License along with this library.""",
    "AGPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License
for more details. You should have received a copy of the GNU Affero General Public License along with this program.""",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software. 3. This notice may not be removed or altered from any source distribution.""",
    "MIT-statement": "Released under the MIT License.",
    "MIT-statement-2": "Licensed under the MIT License.",
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-statement": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-statement": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1-statement": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0-statement": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-statement": "Released under the BSD License.",
    "CC-BY-4.0-statement": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-statement": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0-statement": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-statement": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-statement": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-statement": "Released under CC0 1.0.",
}

# Where a statement names its license: from this word of the template on no other word may stand in between.
NAMED_FROM = {
    "MIT-statement": b"mit", "MIT-statement-2": b"mit", "Apache-2.0-statement": b"apache", "GPL-3.0-statement": b"gnu", "GPL-2.0-statement": b"gnu",
    "LGPL-3.0-statement": b"gnu", "LGPL-2.1-statement": b"gnu", "AGPL-3.0-statement": b"gnu", "BSD-statement": b"bsd", "CC-BY-4.0-statement": b"cc",
    "CC-BY-SA-4.0-statement": b"cc", "CC-BY-NC-4.0-statement": b"cc", "CC-BY-ND-4.0-statement": b"cc", "CC-BY-NC-SA-4.0-statement": b"cc",
    "CC-BY-NC-ND-4.0-statement": b"cc", "CC0-statement": b"cc0",
}

# Words without which a notice is another license's.
NAMING = {"Apache-2.0-notice": (b"apache",), "MPL-2.0-notice": (b"mozilla",), "GPL-3.0-notice": (b"3",), "GPL-2.0-notice": (b"2",), "LGPL-2.1-notice": (b"lesser", b"2", b"1"), "LGPL-3.0-notice": (b"lesser", b"3"), "AGPL-3.0-notice": (b"affero", b"3")}

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words(raw: bytes) -> list[bytes]:
    """Runs of letters, digits and bytes outside ASCII, A-Z lowered."""
    return raw.translate(_PLAIN).split()


def _longest_rising(values: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence, by piles and back pointers."""
    tops: list[int] = []
    places: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before[i] = places[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(v)
            places.append(i)
        else:
            tops[pile], places[pile] = v, i
    out, at = [], places[-1] if places else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Pairs of places with equal words, rising in both, by patience alignment."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found.append((j, m))
        if i >= j or k >= m:
            continue
        once = {w for w, n in Counter(a[i:j]).items() if n == 1} & {w for w, n in Counter(b[k:m]).items() if n == 1}
        if not once:
            continue
        at = {w: x for x, w in enumerate(a[i:j], i) if w in once}
        anchors = [(at[w], y) for y, w in enumerate(b[k:m], k) if w in once]
        chain = [anchors[x] for x in _longest_rising([x for x, _ in anchors])]
        for (x, y), (p, q) in zip([(i - 1, k - 1), *chain], [*chain, (j, m)], strict=True):
            todo.append((x + 1, p, y + 1, q))
        found += chain
    return sorted(found)


@dataclass(frozen=True)
class Match:
    name: str
    coverage: float
    start: int  # first and past the last word of the text that is aligned
    end: int


class Matcher:
    """Templates in the form that scanning takes."""

    def __init__(self, templates: dict[str, str] | None = None, coverage: float = COVERAGE, stretch: float = STRETCH):
        self.coverage, self.stretch = coverage, stretch
        self.templates = {name: words(t.encode()) for name, t in (TEMPLATES if templates is None else templates).items()}
        self.kinds = {name: frozenset(t) for name, t in self.templates.items()}
        self.least = {name: max(coverage, 1.0) if len(t) < SHORT else coverage for name, t in self.templates.items()}
        self.named = {name: t.index(NAMED_FROM[name]) for name, t in self.templates.items() if NAMED_FROM.get(name) in t}
        self.naming = {name: frozenset(NAMING.get(name, ())) & kinds for name, kinds in self.kinds.items()}
        self.all = frozenset().union(*self.kinds.values())

    def scan(self, text: list[bytes]) -> list[Match]:
        """All matches that reach the coverage, by start; where matches overlap the one of the narrower windows
        stays, then the one whose aligned words exceed its missing ones by most, then the one of greater coverage, then the earlier in the templates' order."""
        held = self.all & set(text)
        found: list[tuple[int, int, float, int, Match]] = []
        for order, (name, own) in enumerate(self.templates.items()):
            least, named = self.least[name], self.named.get(name)
            spare = len(own) - least * len(own)
            if not own or len(self.kinds[name] - held) > spare:
                continue
            done = 0
            for scale, low, high in self._windows(text, own, spare, len(own) >= SHORT):
                if low < done:
                    continue
                pairs = align(text[low:high], own)
                share = len(pairs) / len(own)
                if share >= least and (named is None or pairs[-1][0] - pairs[named][0] == len(own) - 1 - named) and self.naming[name] <= {own[y] for _, y in pairs}:
                    match = Match(name, share, low + pairs[0][0], low + pairs[-1][0] + 1)
                    if match.end - match.start <= (REACH if len(own) >= SHORT else self.stretch) * len(own) + 1:
                        found.append((scale, len(own) - 2 * len(pairs), -share, order, match))
                    if share == 1.0 and match.end - match.start == len(own):
                        done = match.end  # nothing that starts before its end can be better
        kept: list[Match] = []
        for *_, match in sorted(found, key=lambda x: (*x[:4], x[4].end - x[4].start, x[4].start)):
            if all(match.end <= k.start or match.start >= k.end for k in kept):
                kept.append(match)
        return sorted(kept, key=lambda k: k.start)

    def _windows(self, text: list[bytes], own: list[bytes], spare: float, wide: bool) -> Iterator[tuple[int, int, int]]:
        """Windows, with the rank of their width, of the text from every place of a template's word on, and if ``wide`` wider ones, which
        overlap so far that every match of up to ``REACH`` templates lies within one; but none that
        holds too few of the template's words, counted with repeats, to reach the coverage."""
        wanted = Counter(own)
        at = [i for i, w in enumerate(text) if w in wanted]
        need = len(own) - int(spare)
        scales = [(self.stretch, 0.0)] + [(2 * x, x - 0.5) for x in (2.0, REACH)] * wide
        for scale, (length, stride) in enumerate(scales):
            width = int(length * len(own)) + 1
            held: Counter[bytes] = Counter()
            j = useful = 0
            free = -1
            for low in at:
                while j < len(at) and at[j] < low + width:
                    w = text[at[j]]
                    held[w] += 1
                    useful += held[w] <= wanted[w]
                    j += 1
                if useful >= need and low >= free:
                    yield scale, low, min(len(text), low + width)
                    free = low + int(stride * len(own))
                w = text[low]
                useful -= held[w] <= wanted[w]
                held[w] -= 1


def templates_in(spark: SparkSession, folder: str) -> dict[str, str]:
    """The texts of a folder's files by file name, as templates to scan for: full licenses, for example. They
    are read by Spark and held by the driver and each worker, so a folder holds templates, not documents."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    return {r["name"]: r["value"] for r in files.orderBy("name").collect()}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id_col, n_licenses, license, coverage, matches``.

    ``license`` and ``coverage`` are of the match with most aligned words (null and 0 if none);
    ``matches`` lists all as ``name:start:end`` in bytes of the text, by start. Texts of any length are
    scanned whole. Null texts count as
    empty. Repeated rows and null ids are rows like any other; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, coverage)
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                raw = raw or b""
                found = matcher.scan(words(raw))
                spans = [m.span() for m in _WORD.finditer(raw)] if found else []
                best = min(found, key=lambda m: (-(m.coverage * len(matcher.templates[m.name])), m.start), default=None)
                rows.append((len(found), best and best.name, best.coverage if best else 0.0, ",".join(f"{m.name}:{spans[m.start][0]}:{spans[m.end - 1][1]}" for m in found)))
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "n_licenses", "license", "coverage", "matches"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, f"id {kind}, n_licenses long, license string, coverage double, matches string").withColumnRenamed("id", id_col)
