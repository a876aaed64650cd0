"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A unit is a run of whole lines. Texts and templates are normalised (ASCII letters in lower case, everything but letters
and digits is space) and compared as sets of word bigrams: 2 |A & B| / (|A| + |B|). With a threshold t, only templates
of t / (2 - t) to (2 - t) / t times a unit's size can reach it; the others are pruned unseen. At t the two sets share at
least t / (2 - t) of the template, so a unit must have one of any selection of more than the rest of its bigrams: the
anchors, the longest of them. Texts without an anchor are done after one pass over their bigrams.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator
from math import ceil, floor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

# Wording of public licences and of the notices by which works refer to them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_1 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_4 = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_GPL_2 = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC),
    ("BSD-2-Clause", f"{_BSD_1}\n{_BSD_2}\n{_BSD_4}"),
    ("BSD-3-Clause", f"{_BSD_1}\n{_BSD_2}\n{_BSD_3}\n{_BSD_4}"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", _GPL),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", _GPL.replace("General", "Lesser General")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", _GPL.replace("General", "Affero General")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", _MPL),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    *[(f"CC-{kind}-4.0", f"Licensed under CC {kind} 4.0.") for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")],
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-2.0", _GPL_2),
    ("LGPL-2.1", _GPL_2.replace("General", "Lesser General").replace("program", "library").replace("version 2 ", "version 2.1 ")),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0."),
    *[(own, f"SPDX-License-Identifier: {own}") for own in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "Unlicense", "Zlib", "CC0-1.0", "BSL-1.0", "EPL-2.0")],
    *[(own, f"SPDX-License-Identifier: {own}{end}") for own in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for end in ("", "-only", "-or-later")],
]


def normalised(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:], strict=False))


class Scanner:
    """The templates, their sizes, and the inverted index of their anchors."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must be above 0 and at most 1")
        self.threshold, self.templates = threshold, [(name, bigrams(normalised(text))) for name, text in templates]
        self.anchors: set[tuple[bytes, bytes]] = set()
        share = threshold / (2 - threshold)
        for _, own in self.templates:
            # a unit at the threshold shares ceil(share n) of the n bigrams at least, hence one of any n - that + 1
            needed = max(1, ceil(share * len(own) - 1e-9))
            self.anchors |= set(sorted(own, key=lambda b: (-len(b[0]) - len(b[1]), b))[: len(own) - needed + 1])
        sizes = [len(own) for _, own in self.templates] or [0]
        self.smallest, self.largest = ceil(share * min(sizes) - 1e-9), floor(max(sizes) / share + 1e-9)
        self.compared: dict[tuple[frozenset, int], list[tuple]] = {}
        self.every = set().union(*(own for _, own in self.templates)) if self.templates else set()

    def fits(self, n: int, size: int) -> bool:
        """Whether sets of n and `size` bigrams can reach the threshold: at most the smaller one is shared."""
        return 2 * min(n, size) >= self.threshold * (n + size) - 1e-9

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, dice, first line, last line), lines counted from 1: for each licence found, the run of lines with
        the highest coefficient; of equal ones the first, of these the shortest."""
        best: dict[str, tuple] = {}
        for name, *key in self.runs(text):
            best[name] = min(best.get(name, (0,)), tuple(key[:3]))
        return [(name, round(-k[0], 6), k[1], k[2]) for name, k in sorted(best.items())]

    def strongest(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, dice, first line, last line) of runs that share no line: the highest coefficient goes first, of equal
        ones the longer run of bigrams that its template shares, the first, the shortest, the licence's name."""
        taken: set[int] = set()
        found = []
        for value, shared, first, last, name in sorted((v, -n, a, b, name) for name, v, a, b, n in self.runs(text)):
            lines = range(first, last + 1)
            if taken.isdisjoint(lines):
                taken.update(lines)
                found.append((name, round(-value, 6), first, last))
        return sorted(found, key=lambda x: x[2])

    def runs(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(licence, -dice, first line, last line, shared bigrams) of runs of lines at the threshold: for each first line
        those that have more bigrams than any shorter one. The others' coefficients are those of shorter runs.

        From the last line up, the bigrams below a line are kept in the order in which they come next, so a first line
        costs as many steps as the largest template allows bigrams, however often lines repeat."""
        if not text:
            return []
        words = normalised(text)
        if self.anchors.isdisjoint(zip(words, words[1:], strict=False)):
            return []
        lines = [(i, own) for i, line in enumerate(text.split("\n"), 1) if (own := normalised(line))]
        found: list[tuple] = []
        below: OrderedDict[tuple[bytes, bytes], int] = OrderedDict()
        for k in range(len(lines) - 1, -1, -1):
            first, line = lines[k]
            own = bigrams(line)
            following = iter(below.items())
            step = next(following, None)
            last, new, hit = first, own, False
            while len(own) <= self.largest:
                hit = hit or not self.every.isdisjoint(new)
                if hit and len(own) >= self.smallest:
                    self.compare(own, first, last, found)
                new = []
                while step and not (new and step[1] != last):  # the bigrams of the next line that has new ones
                    if step[0] not in own:
                        last = step[1]
                        new.append(step[0])
                        if len(own) + len(new) > self.largest:
                            break
                    step = next(following, None)
                if not new:
                    break
                own.update(new)
            for b in bigrams([lines[k - 1][1][-1], *line]) if k else ():
                below[b] = first
                below.move_to_end(b, last=False)
        return found

    def compare(self, own: set, first: int, last: int, found: list[tuple]) -> None:
        shared, n = frozenset(own & self.every), len(own)
        if (shared, n) not in self.compared:
            if len(self.compared) > 4096:
                self.compared.clear()
            values = []
            for name, template in self.templates:
                if self.fits(n, len(template)) and 2 * len(shared) >= self.threshold * (n + len(template)) - 1e-9:
                    m = len(shared & template)
                    value = 2 * m / (n + len(template))
                    if value >= self.threshold - 1e-12:
                        values.append((name, -value, m))
            self.compared[shared, n] = values
        found += [(name, value, first, last, m) for name, value, m in self.compared[shared, n]]


def scan_licenses(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, license, dice, first_line, last_line): a row for each run of lines that holds a licence.

    Runs that share lines compete: the one with the highest coefficient counts, so a notice goes by the version that it
    names. The same licence in two places has two rows. Null and empty texts hold none. Rows are scanned each on its own, null
    and repeated ids included, in time that grows with the number of lines. Of equal
    coefficients the first run of lines counts, of those the shortest. Other columns aren't read. Nothing is shuffled.
    """
    import pyarrow as pa

    scanner = df.sparkSession.sparkContext.broadcast(Scanner(templates, threshold))  # its size is the templates'
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
    names = ["doc_id", "license", "dice", "first_line", "last_line"]

    def run(batches: Iterable) -> Iterator:
        own = scanner.value
        for batch in batches:
            found = [(i.as_py(), *x) for i, text in zip(batch.column(0), batch.column(1), strict=True) for x in own.strongest(text.as_py())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, license string, dice double, first_line long, last_line long")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
