"""Whole licence texts and notices, as other projects have them, each by its own name."""

import itertools
import textwrap

import numpy as np
import pytest

from holdfast.llm.licenses import TEMPLATES, Matcher, bigrams

BSD_START = """Copyright (c) 2016, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.

"""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without
specific prior written permission.

"""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
GPL_2 = """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License along
    with this program; if not, write to the Free Software Foundation, Inc.,
    51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.
"""
LGPL_21 = """    This library is free software; you can redistribute it and/or
    modify it under the terms of the GNU Lesser General Public
    License as published by the Free Software Foundation; either
    version 2.1 of the License, or (at your option) any later version.

    This library is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
    Lesser General Public License for more details.

    You should have received a copy of the GNU Lesser General Public
    License along with this library; if not, write to the Free Software
    Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA
"""
AFFERO = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as published
    by the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU Affero General Public License for more details.

    You should have received a copy of the GNU Affero General Public License
    along with this program.  If not, see <http://www.gnu.org/licenses/>.
"""
ECLIPSE = """ * This program and the accompanying materials are made available under the
 * terms of the Eclipse Public License 2.0 which is available at
 * http://www.eclipse.org/legal/epl-2.0.
"""
TEXTS = {
    "BSD-2-Clause": BSD_START + BSD_END, "BSD-3-Clause": BSD_START + BSD_THIRD + BSD_END, "GPL-2.0": GPL_2,
    "GPL-3.0": AFFERO.replace("Affero ", ""),
    "LGPL-2.1": LGPL_21, "LGPL-3.0": AFFERO.replace("Affero", "Lesser"), "AGPL-3.0": AFFERO, "EPL-2.0": ECLIPSE,
}


def joined(text):
    """One paragraph a line."""
    return "\n".join(" ".join(p.replace("\n *", " ").split()) for p in text.split("\n\n"))


def test_the_version_decides_between_notices_of_one_wording():
    assert {f[2] for f in Matcher().scan(GPL_2.replace("version 2", "version 3"))} == {"GPL-3.0"}


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_whole_texts_give_their_own_name(name):
    for text in (TEXTS[name], joined(TEXTS[name])):
        found = Matcher().scan(text)
        assert {f[2] for f in found} == {name}
        # What is found reaches to the text's end.
        assert max(f[1] for f in found) >= len(text.rstrip()) - 40


def wrapped(text, width):
    return textwrap.fill(" ".join(text.split()), width)


WHOLE = {name: max(texts, key=len) for name, texts in TEMPLATES.items() if len(max(texts, key=len)) > 300}


@pytest.mark.parametrize("width", [40, 78, 10**6])
def test_licences_that_follow_each_other_are_found(width):
    matcher = Matcher()
    for a, b in itertools.permutations(["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "Unlicense"], 2):
        first, second = wrapped(WHOLE[a], width), wrapped(WHOLE[b], width)
        for between in ("\n\nCopyright (c) 2020 Nobody\n\n", "\n", " "):
            found = matcher.scan(first + between + second)
            assert [f[2] for f in found] == [a, b], (a, b, between)
            assert found[0][:2] == (0, len(first)) and found[1][:2] == (len(first + between), len(first + between + second))


def test_notices_inside_longer_lines():
    prose = "These are words of a file that lists what it is made of and by whom, "
    text = prose + "Licensed under the MIT License. " + prose + " ".join(WHOLE["ISC"].split()) + " " + prose
    found = Matcher().scan(text)
    assert [(text[s:e][:13], n) for s, e, n, _ in found] == [("Licensed unde", "MIT"), ("Permission to", "ISC")]
    assert all(d == 1 for *_, d in found)


def test_windows_equal_brute_force():
    """The first finding's surplus is the best of all windows of all templates."""
    rng = np.random.default_rng(7)
    words = "alpha beta gamma delta".split()
    templates = {"A": ("alpha beta gamma delta alpha gamma",), "B": ("delta delta beta alpha beta",)}
    matcher = Matcher(templates)
    forms = [(n, bigrams(t[0]), len(t[0].split())) for n, t in templates.items()]
    for _ in range(300):
        text = list(rng.choice(words, 14))
        all_ = [(round(2 * len(p & b) - 0.8 * (len(p) + len(b)), 9), e - s)
                for _, b, size in forms for s in range(14) for e in range(s + 2, min(14, s + 1 + int(size * 1.5)) + 1)
                for p in [bigrams(" ".join(text[s:e]))]]
        best = max(all_)
        found = matcher.scan(" ".join(text))
        assert bool(found) == (best[0] >= 0)
        if found:
            got = []
            for s, e, name, dice in found:
                part = bigrams(" ".join(text)[s:e])
                b = next(f[1] for f in forms if f[0] == name)
                assert dice == pytest.approx(2 * len(part & b) / (len(part) + len(b))) and dice >= 0.8
                got.append(round(2 * len(part & b) - 0.8 * (len(part) + len(b)), 9))
            assert max(got) == best[0]
            assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def greedy(matcher, words, low, high, forms):
    """The best window of the words from low to high, then of those before and after it."""
    best = None
    for name, b, longest in forms:
        for s in range(low, high):
            for e in range(s + 2, min(high, s + 1 + longest) + 1):
                part = list(zip(words[s:e], words[s + 1:e]))
                if part[0] in b and part[-1] in b:
                    surplus = round(2 * len(set(part) & b) - matcher.least * (len(set(part)) + len(b)), 9)
                    key = (-surplus, s - e, s, name, e)
                    best = min(best, key) if best else key
    if not best or best[0] > 1e-9:
        return []
    _, _, s, name, e = best
    return greedy(matcher, words, low, s, forms) + [(s, e, name)] + greedy(matcher, words, e, high, forms)


def test_all_windows_equal_brute_force():
    rng = np.random.default_rng(11)
    matcher = Matcher({"A": ("alpha beta gamma delta alpha gamma",), "B": ("delta delta beta alpha beta",)})
    forms = [(matcher.names[i], set(matcher.pairs[i]), matcher.longest[i]) for i in range(2)]
    several = 0
    for _ in range(150):
        words = rng.choice("alpha beta gamma delta".split(), 80).tolist()
        text = " ".join(words)
        found = [(text[:s].count(" "), text[:e].count(" ") + 1, name) for s, e, name, _ in matcher.scan(text)]
        assert found == greedy(matcher, words, 0, 80, forms)
        several += len(found) > 1
    assert several > 20


def test_many_licences_in_one_text():
    """Each start's window is worked out once, so twice the copies are about twice the work."""
    matcher, calls = Matcher(), []
    plain = Matcher._from_starts

    def counted(self, before, hit, starts, high, i):
        calls.append(len(starts))
        return plain(self, before, hit, starts, high, i)

    Matcher._from_starts = counted
    try:
        work = []
        for copies in (20, 160):
            calls.clear()
            found = matcher.scan((WHOLE["MIT"] + "\n") * copies)
            assert [f[2] for f in found] == ["MIT"] * copies
            work.append(sum(calls))
    finally:
        Matcher._from_starts = plain
    assert work[1] <= 8.5 * work[0]
