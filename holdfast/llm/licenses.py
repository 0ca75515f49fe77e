"""Licence scans: Dice coefficient over word bigrams, pruned by size.

Templates are normalised (lower-cased words and numbers, copyright lines left
out) into sets of word bigrams. Two sets of a and b bigrams have a Dice
coefficient of at most 2 min(a, b) / (a + b), so only windows of a template's size
times t / (2 - t) to (2 - t) / t can match it, and they share at least the lower
of these numbers with it. An index by bigram names the templates of which a text
has so many; for these, windows slide over the text's words, whatever its lines
are, from one shared bigram to another. A window is no longer in words than its
template's bound.

Of all windows that reach the coefficient, the one whose shared bigrams exceed
what the coefficient asks for by most is reported, and the words before and after it
are searched in the same way, so findings don't overlap. Offsets are code points,
from the first word to the punctuation behind the last.

The work is a narrow pass over whole texts; the templates are code, not data.

Rows: each finding is a row. A NULL or empty text has none; repeated rows repeat
theirs; a NULL key stays. Windows that match equally well: the longer one, then the
first, then the first licence by name. A template of one word is found as a line of it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from holdfast.llm.common import quoted, slices

LEAST = 0.8
BATCH_BYTES = 2_000_000
STARTS = 64  # windows that are compared at once
WORD = re.compile(r"[a-z0-9]+")
PLACED = re.compile(r"[A-Za-z0-9]+")
AFTER = re.compile(r"[^\w\s]*")
# Lines that name an owner, not those of a wrapped licence text that begin with "copyright notice" or an item (c).
COPYRIGHT = re.compile(
    r"^[^\w\n]*(?:copyright(?!\W*$|\W+(?:notices?|holders?|owners?|and|or|laws?|licen[cs]es?|interests?|statements?)\b)"
    r"|\(c\)\W*(?:copyright|\d{4})|©).*$", re.I | re.M)

# Public licence texts and the notices that stand for them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
        IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
        USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
        ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
        USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
        OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "BSD-2-Clause": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
        CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
    ),
    "BSD-3-Clause": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
        CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License
        for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see
        <https://www.gnu.org/licenses/>.""",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License
        for more details.
        You should have received a copy of the GNU General Public License along with this program; if not, write to
        the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or
        (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License
        for more details.
        You should have received a copy of the GNU General Public License along with this program; if not, write to
        the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or
        (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License
        for more details.
        You should have received a copy of the GNU General Public License along with this program; if not, see
        <https://www.gnu.org/licenses/>.""",
    ),
    "LGPL-2.1": (
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
        (at your option) any later version.
        This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License
        for more details.
        You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to
        the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
        (at your option) any later version.
        This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License
        for more details.
        You should have received a copy of the GNU Lesser General Public License along with this library; if not, see
        <https://www.gnu.org/licenses/>.""",
    ),
    "LGPL-3.0": (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License
        for more details.
        You should have received a copy of the GNU Lesser General Public License along with this program. If not, see
        <https://www.gnu.org/licenses/>.""",
        """This library is free software: you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.
        This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License
        for more details.
        You should have received a copy of the GNU Lesser General Public License along with this library. If not, see
        <https://www.gnu.org/licenses/>.""",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License
        for more details.
        You should have received a copy of the GNU Lesser General Public License along with this program; if not, write to
        the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
        """This library is free software: you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.
        This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License
        for more details.
        You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to
        the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    ),
    "AGPL-3.0": (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License
        for more details.
        You should have received a copy of the GNU Affero General Public License along with this program. If not, see
        <https://www.gnu.org/licenses/>.""",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License
        for more details.
        You should have received a copy of the GNU Affero General Public License along with this program; if not, write to
        the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    ),
    "MPL-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    "EPL-1.0": (
        """All rights reserved. This program and the accompanying materials are made available under the terms of the
        Eclipse Public License v1.0 which accompanies this distribution, and is available at
        http://www.eclipse.org/legal/epl-v10.html""",
    ),
    "EPL-2.0": (
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License
        2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License
        v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.
        SPDX-License-Identifier: EPL-2.0""",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work.",
    ),
    "Unlicense": (
        """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
        code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
        copyright interest in the software to the public domain. We make this dedication for the benefit of the public
        at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
        TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE.
        For more information, please refer to <https://unlicense.org>""",
    ),
}


def bigrams(text: str) -> set[tuple[str, str]]:
    """Pairs of neighbouring words of the normalised text; of one word, the word and nothing."""
    words = WORD.findall(COPYRIGHT.sub(" ", text).lower())
    return set(zip(words, words[1:])) if len(words) != 1 else {(words[0], "")}


class Matcher:
    def __init__(self, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST):
        self.least = least
        forms = sorted(((len(b), name, b, len(WORD.findall(t.lower()))) for name, texts in templates.items()
                        for t in texts for b in [bigrams(t)]), key=lambda f: f[:2])
        self.sizes, self.names = [f[0] for f in forms], [f[1] for f in forms]
        self.index: dict[tuple[str, str], list[int]] = {}
        for i, (_, _, pairs, _) in enumerate(forms):
            for pair in pairs:
                self.index.setdefault(pair, []).append(i)
        self.pairs = [f[2] for f in forms]
        self.longest = [int(self._bounds(f[3])[1] + 1e-9) for f in forms]
        self.one_word = any(second == "" for _, second in self.index)

    def _bounds(self, size: int) -> tuple[float, float]:
        return size * self.least / (2 - self.least), size * (2 - self.least) / self.least

    def best(self, pairs: set[tuple[str, str]]) -> tuple[str, float] | None:
        """The licence with the highest coefficient, if that reaches the least."""
        low, high = self._bounds(len(pairs))
        first, last = bisect_left(self.sizes, low - 1e-9), bisect_right(self.sizes, high + 1e-9)
        if first == last:
            return None
        shared: Counter[int] = Counter()
        for pair in pairs & self.index.keys():
            shared.update(i for i in self.index[pair] if first <= i < last)
        found = [(-2 * n / (len(pairs) + self.sizes[i]), self.names[i]) for i, n in shared.items()]
        if not found or -min(found)[0] < self.least - 1e-12:
            return None
        dice, name = min(found)
        return name, -dice

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, licence, coefficient) of the text's parts that match, in order."""
        found = self._lines_of_one_word(text) if self.one_word else []
        plain = COPYRIGHT.sub(lambda m: " " * len(m[0]), text)
        words = WORD.findall(plain.lower())
        shared: Counter[int] = Counter()
        for pair in set(zip(words, words[1:])) & self.index.keys():
            shared.update(self.index[pair])
        able = [i for i, n in sorted(shared.items()) if n >= self._bounds(self.sizes[i])[0] - 1e-9]
        if able:
            spans = [m.span() for m in PLACED.finditer(plain)]
            words = [plain[a:b].lower() for a, b in spans]
            for first, last, i, dice in self._windows(words, able):
                end = AFTER.match(text, spans[last + 1][1]).end()
                found.append((spans[first][0], end, self.names[i], dice))
        return sorted(found)

    def _lines_of_one_word(self, text: str) -> list[tuple[int, int, str, float]]:
        found, at = [], 0
        for line in text.split("\n"):
            pairs = bigrams(line)
            match = self.best(pairs) if any(second == "" for _, second in pairs) else None
            if match:
                found.append((at, at + len(line), *match))
            at += len(line) + 1
        return found

    def _windows(self, words: list[str], able: list[int]) -> list[tuple[int, int, int, float]]:
        """(first bigram, last bigram, template, coefficient) of the best windows that don't overlap."""
        pairs = list(zip(words, words[1:]))
        before, last = np.empty(len(pairs), np.int64), {}
        for at, pair in enumerate(pairs):
            before[at] = last.get(pair, -1)
            last[pair] = at
        hits = {i: np.fromiter((pair in self.pairs[i] for pair in pairs), bool, len(pairs)) for i in able}
        heap = []
        for i, hit in hits.items():
            places = np.flatnonzero(hit)
            need = int(np.ceil(self._bounds(self.sizes[i])[0] - 1e-9))
            within = np.searchsorted(places, places + self.longest[i]) - np.arange(len(places))
            heap += self._from_starts(before, hit, places[within >= need], len(pairs), i)
        heapify(heap)
        # Bigrams that share a word with a window taken, as ranges in order.
        kept, gone = [], []
        while heap:
            _, length, first, _, i, dice = heappop(heap)
            at = bisect_right(gone, (first, len(pairs) + 1))
            if at and gone[at - 1][1] > first:
                continue
            high = gone[at][0] if at < len(gone) else len(pairs)
            end = first - length
            if end > high:
                # Less room gives a start no better window, so it waits for its turn again.
                for window in self._from_starts(before, hits[i], np.array([first]), high, i):
                    heappush(heap, window)
                continue
            kept.append((first, end - 1, i, dice))
            gone.insert(at, (first - 1, end + 1))
        return kept

    def _from_starts(self, before: np.ndarray, hit: np.ndarray, starts: np.ndarray, high: int, i: int) -> list[tuple]:
        """(-surplus, -length, first, name, template, coefficient) of each start's best
        window that ends before ``high``, where that reaches the least."""
        size, found = self.sizes[i], []
        steps = np.arange(self.longest[i])
        for at in range(0, len(starts), STARTS):
            first = starts[at:at + STARTS, None]
            where = np.minimum(first + steps, high - 1)
            # In a window from ``first``, a bigram counts where it stands first.
            fresh = (before[where] < first) & (first + steps < high)
            m = np.cumsum(fresh, 1, dtype=np.int32)
            n = np.cumsum(fresh & hit[where], 1, dtype=np.int32)
            # Rounded, so that equal surpluses are equal; only ends on a shared bigram count.
            surplus = np.where(hit[where] & (first + steps < high), np.round(2 * n - self.least * (m + size), 9), -np.inf)
            end = surplus.shape[1] - 1 - surplus[:, ::-1].argmax(1)
            top = surplus[np.arange(len(end)), end]
            for row in np.flatnonzero(top >= -1e-9).tolist():
                e = int(end[row])
                dice = float(2 * n[row, e] / (m[row, e] + size))
                found.append((-float(top[row]), -e - 1, int(first[row, 0]), self.names[i], i, dice))
        return found


def scan_licenses(docs: DataFrame, key: str, text: str, templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
                  least: float = LEAST) -> DataFrame:
    """(key, start, end, licence, dice) of every finding."""
    slim = docs.select(quoted(key).alias("key"), quoted(text).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("span_start", T.LongType()),
        T.StructField("span_end", T.LongType()), T.StructField("license", T.StringType()),
        T.StructField("dice", T.DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, least)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64())
        for batch in slices(batches, "text", BATCH_BYTES):
            rows = [(i, *f) for i, t in enumerate(batch.column(1).to_pylist()) if t for f in matcher.scan(t)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), *[pa.array([r[c + 1] for r in rows], k) for c, k in enumerate(kinds)]],
                names=[f.name for f in schema.fields],
            )

    return slim.mapInArrow(run, schema)
