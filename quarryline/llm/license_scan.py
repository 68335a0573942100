"""License scan by template markup.

A template is license wording with markup: ``<<beginOptional>> ... <<endOptional>>`` around words
that may be missing; ``<<var;name=holder;words=0-12>>`` where any words may stand, so many of them;
``<<var;name=act;match=licensed|released>>`` where one of the words named stands. It is compiled to
an automaton over words, and a text matches where all mandatory words stand in order with nothing
else between them; one word changed, and it doesn't. Short phrases are looked for as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrase to label.
PHRASES: dict[str, str] = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# The wording of public licenses and of usual statements.
_MERCHANTABILITY = "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. """
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY <<var;name=holder;words=1-24>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name=liable;words=1-24>> BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ACT = "<<var;name=act;match=licensed|released|distributed|published|available|provided|shared>>"


def _gnu(what: str, license_: str, version: str) -> str:
    """The notice by which a program or library is put under a GNU license."""
    return f"""This {what} is free software<<beginOptional>>;<<endOptional>> you can redistribute it and/or modify it under the terms of the {license_} as published by the
Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful,
{_MERCHANTABILITY} See the {license_} for more details. <<beginOptional>>You should have received a copy of the {license_} along with this {what}<<beginOptional>>; if not,
write to the Free Software Foundation<<var;name=address;words=0-16>><<endOptional>><<beginOptional>>. If not, see https://www.gnu.org/licenses/<<endOptional>><<endOptional>>"""


#: Label to templates.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit-text": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        <<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction, including without limitation the rights to use,
        copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name=holder;words=1-24>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE.""",
    ),
    "isc-text": (
        """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
        <<var;name=holder;words=1-24>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL <<var;name=liable;words=1-24>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
        RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
        WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "bsd-2-clause": (_BSD_HEAD + _BSD_TAIL,),
    "bsd-3-clause": (
        _BSD_HEAD
        + """<<beginOptional>>3.<<endOptional>> Neither the name of <<var;name=organisation;words=1-24>> nor the names of <<beginOptional>>its<<endOptional>> contributors
        may be used to endorse or promote products derived from this software without specific prior written permission. """
        + _BSD_TAIL,
    ),
    "apache-2.0": (
        """Licensed under the Apache License, Version 2.0<<beginOptional>> (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at <<beginOptional>>http<<endOptional>><<beginOptional>>s<<endOptional>>://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
        License<<endOptional>>""",
    ),
    "mpl-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
        obtain one at <<var;name=scheme;match=http|https>>://mozilla.org/MPL/2.0/""",
    ),
    "gpl-3.0": (
        f"""<<beginOptional>>This <<var;name=what;words=1-3>> is<<endOptional>> {_ACT} under the <<beginOptional>>terms of the<<endOptional>> GNU General Public
        License<<beginOptional>>,<<endOptional>> version 3""",
        _gnu("program", "GNU General Public License", "3"),
    ),
    "gpl-2.0": (
        f"""<<beginOptional>>This <<var;name=what;words=1-3>> is<<endOptional>> {_ACT} under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, version 2""",
        _gnu("program", "GNU General Public License", "2"),
    ),
    "lgpl-2.1": (_gnu("library", "GNU Lesser General Public License", "2.1"),),
    "lgpl-3.0": (_gnu("library", "GNU Lesser General Public License", "3"),),
    "cc-by-nc-4.0": (
        f"""{_ACT} under <<beginOptional>>the<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-NC 4.0""",
        """Creative Commons Attribution-NonCommercial 4.0 International""",
    ),
    "cc-by-4.0": (
        f"""{_ACT} under <<beginOptional>>the<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY 4.0""",
        """Creative Commons Attribution 4.0 International""",
    ),
    "mit-statement": (f"""{_ACT} under the <<beginOptional>>terms of the<<endOptional>> MIT License""",),
}

_MARK = re.compile(r"<<\s*(beginOptional|endOptional|var)\b(.*?)>>", re.S)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(data: bytes) -> list[bytes]:
    return _WORD.findall(data.translate(_LOWER))


@dataclass
class Automaton:
    """States by number; ``steps`` from a state by a word, or by None for any word; ``free`` needs no word. The last state made is the end."""

    label: str
    steps: list[dict[bytes | None, set[int]]] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)
    #: Words that every match holds.
    mandatory: list[bytes] = field(default_factory=list)

    def state(self) -> int:
        self.steps.append({})
        self.free.append(set())
        return len(self.steps) - 1

    def step(self, start: int, word: bytes | None) -> int:
        end = self.state()
        self.steps[start].setdefault(word, set()).add(end)
        return end

    def skip(self, start: int, end: int) -> None:
        self.free[start].add(end)

    def closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            new = self.free[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    def match(self, words: Sequence[bytes], at: int) -> int:
        """Where the longest match from word ``at`` ends; -1 if there is none."""
        found, end = -1, len(self.steps) - 1
        now = self.closed({0})
        for k in range(at, len(words)):
            then: set[int] = set()
            for s in now:
                then |= self.steps[s].get(words[k], set()) | self.steps[s].get(None, set())
            if not then:
                break
            now = self.closed(then)
            if end in now:
                found = k + 1
        return found

    def matches(self, words: Sequence[bytes]) -> list[tuple[int, int]]:
        """Leftmost longest matches that don't overlap: first word, number of words."""
        first = {w for s in self.closed({0}) for w in self.steps[s]}
        out, at = [], 0
        while at < len(words):
            end = self.match(words, at) if None in first or words[at] in first else -1
            if end > at:
                out.append((at, end - at))
                at = end
            else:
                at += 1
        return out


def compiled(label: str, template: str) -> Automaton:
    """The automaton of a template; its markup must be nested rightly."""
    made = Automaton(label)
    now, opened, at = made.state(), [], 0
    for m in [*_MARK.finditer(template), None]:
        for w in words_of(template[at : m.start() if m else len(template)].encode()):
            now = made.step(now, w)
            if not opened:
                made.mandatory.append(w)
        if m is None:
            break
        at = m.end()
        if m[1] == "beginOptional":
            opened.append(now)
        elif m[1] == "endOptional":
            end = made.state()
            made.skip(now, end)
            made.skip(opened.pop(), end)
            now = end
        elif (named := re.search(r"match\s*=\s*([^;>]+)", m[2])) is not None:
            start, now = now, made.state()
            for w in named[1].split("|"):
                made.skip(made.step(start, words_of(w.encode())[0]), now)
        else:
            asked = re.search(r"words\s*=\s*(\d+)-(\d+)", m[2])
            least, most = map(int, asked.groups()) if asked else (0, 20)
            skipped = []
            for k in range(most):
                if k >= least:
                    skipped.append(now)
                now = made.step(now, None)
            if skipped:
                end = made.state()
                for s in [*skipped, now]:
                    made.skip(s, end)
                now = end
    if opened:
        raise ValueError(f"{label}: an optional region isn't ended")
    made.skip(now, made.state())
    made.mandatory = sorted(set(made.mandatory), key=lambda w: (-len(w), w))
    return made


def find_licenses(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, ``n_words``, and ``places``: label, first word, number of words, and whether a template (or else a phrase) stands there.

    A-Z count as a-z; words are runs of letters, digits and characters beyond ASCII. Phrases are
    found in all places, template matches are leftmost, longest and without overlap for each
    template. A null text counts as empty: no words, no places. Each row is scanned by itself, so
    null ids and repeated rows are no matter; other columns aren't read. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("template", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [compiled(label, t) for label, all_ in templates.items() for t in all_]
        wanted = [(label, words, re.compile(rb"(?<![0-9a-z\x80-\xff])(?=" + rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+".join(map(re.escape, words)) + rb"(?![0-9a-z\x80-\xff]))")) for p, label in phrases.items() if (words := words_of(p.encode()))]
        for batch in batches:
            counts, places = [], []
            for text in batch.column(1):
                data = (text.as_py() or "").encode()
                inside = _IN_WORD[np.frombuffer(data, dtype=np.uint8)]
                starts = inside.copy()
                starts[1:] &= ~inside[:-1]
                counts.append(int(np.count_nonzero(starts)))
                low = data.translate(_LOWER)
                found = []
                for label, words, pattern in wanted:
                    if all(w in low for w in words):
                        at = np.flatnonzero(starts)
                        found += [(label, int(np.searchsorted(at, m.start())), len(words), False) for m in pattern.finditer(low)]
                likely = [a for a in automata if all(w in low for w in a.mandatory)]
                if likely:
                    words = _WORD.findall(low)
                    found += [(a.label, k, n, True) for a in likely for k, n in a.matches(words)]
                places.append([{"label": f[0], "first": f[1], "n": f[2], "template": f[3]} for f in sorted(found, key=lambda f: (f[1], f[0]))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, type=pa.int64()), pa.array(places, type=shape)], [id_col, "n_words", "places"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, places array<struct<label:string,first:long,n:long,template:boolean>>")


def labels_of(places, templates: bool):
    """The distinct labels, sorted and joined by commas; with ``templates`` those of templates too."""
    some = places if templates else F.filter(places, lambda x: ~x["template"])
    return F.array_join(F.sort_array(F.array_distinct(F.transform(some, lambda x: x["label"]))), ",")


def confidence(places, n_words):
    """From 0 to 1: 0 if nothing is found, 0.5 if only phrases are, and from 0.75 to 1 if a template matches, by the share of the document's words in the longest match."""
    longest = F.array_max(F.transform(F.filter(places, lambda x: x["template"]), lambda x: x["n"]))
    return F.when(longest.isNotNull(), 0.75 + 0.25 * F.least(F.lit(1.0), longest / n_words)).when(F.size(places) > 0, 0.5).otherwise(0.0)
