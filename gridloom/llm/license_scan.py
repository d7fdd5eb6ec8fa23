"""Licence scan: matching statistics of a generalised suffix automaton, chained into template spans.

The automaton holds the word sequences of all templates. A file's words are streamed through it; at each
word it knows the longest run ending there that stands in some template. Maximal runs of `LEAST` words or
more are chained, template by template, where both their places in the file and in the template advance; of a run that a
template repeats, every place may go on a chain. A chain that covers half of its template is a span; of all templates' chains that overlap in the
file the one that covers most words stays. The automaton depends on the templates alone, so each task builds it once and every file is a row of its own: no shuffle.

Defined results: a null text is empty. Rows are judged one by one, repeated rows alike. An empty table gives an empty one. Of chains that cover equally
much that of the shorter template stays, then the first in the file. Very long texts are taken whole, with memory in proportion to their words. Columns but doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases with their labels, and templates: short licences whole, of long ones the notice that their authors ask for (fixed values).
#: Others are passed to scan().
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject
to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder
nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented
as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright
law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""",
    "apache-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in
the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this
program. If not, see http://www.gnu.org/licenses/.""",
    "lgpl-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "mpl-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "cc-by-notice": """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit
http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.""",
}
COMMON = frozenset(
    b"the of and to in a is that for it was on are as with be by this at from or an have not you any all but will can see if one no".split(),
)

#: Words of a run that counts, words that a chain may skip, and the share of a template that a span needs.
LEAST, SKIP, COVER = 5, 12, 0.5
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | bytes | None) -> list[bytes]:
    """The words of a text with A-Z in lower case, as UTF-8."""
    raw = b"" if text is None else text.encode() if isinstance(text, str) else text
    return WORDS.findall(raw.lower())  # bytes.lower() changes A-Z alone


@dataclass
class Automaton:
    """Suffix automaton of several word sequences; ends: for each state of LEAST words or more all places where it ends, by template."""

    next: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    ends: list[dict[int, list[int]]] = field(default_factory=lambda: [{}])

    def _state(self, size: int, link: int, after: dict[bytes, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(after)
        self.ends.append({})
        return len(self.size) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """A copy of q for the words of length size[p] + 1."""
        copy = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def extend(self, last: int, word: bytes) -> int:
        """The state of last's words and word; made unless another template has made it."""
        if (q := self.next[last].get(word)) is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, word)
        new, p = self._state(self.size[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, word)
        return new


def build(templates: dict[str, str] = TEMPLATES) -> tuple[Automaton, list[str], list[int], frozenset[bytes]]:
    """The automaton, template names and lengths, and words of which every run of LEAST template words has one."""
    sam, names, lengths, anchors = Automaton(), list(templates), [], set()
    for words in (seqs := [words_of(t) for t in templates.values()]):
        state = 0
        for w in words:
            state = sam.extend(state, w)
        lengths.append(len(words))
    for k, words in enumerate(seqs):
        state = 0
        for i, w in enumerate(words):
            state = s = sam.next[state][w]
            while s > 0 and sam.size[s] >= LEAST:  # a suffix ends wherever its extension ends
                sam.ends[s].setdefault(k, []).append(i)
                s = sam.link[s]
        for i in range(max(1, len(words) - LEAST + 1)):
            run = words[i : i + LEAST]
            own = [w for w in run if w not in COMMON]
            anchors.update(own or run)
    return sam, names, lengths, frozenset(anchors)


def runs(sam: Automaton, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """Maximal matches of LEAST words or more as (end in the file, length, state)."""
    state = length = 0
    for i, w in enumerate(words):
        if w in sam.next[state]:
            state, length = sam.next[state][w], length + 1
            continue
        if length >= LEAST:
            yield i, length, state
        while state > 0 and w not in sam.next[state]:
            state = sam.link[state]
            length = sam.size[state]
        if w in sam.next[state]:
            state, length = sam.next[state][w], length + 1
        else:
            state = length = 0
    if length >= LEAST:
        yield len(words), length, state


def chained(sam: Automaton, lengths: list[int], words: list[bytes]) -> list[tuple[int, int, int, int]]:
    """Spans as (start, end, template, words covered), by start."""
    enough: list[tuple[int, int, int, int]] = []
    # by template the chains (start, end, covered, last place in the template) since the last gap of more than SKIP words
    held: dict[int, list[tuple[int, int, int, int]]] = {}
    open_: dict[int, list[tuple[int, int, int, int]]] = {}

    def close(k: int) -> None:
        enough.extend((start, end, k, covered) for start, end, covered, _ in held.pop(k, ()) if covered >= COVER * lengths[k])

    for end, length, state in runs(sam, words):
        start = end - length
        # state may stand for longer words; its ends hold for every suffix of them
        for k, places in sam.ends[state].items():
            near = [c for c in open_.get(k, ()) if start - c[1] <= SKIP]
            if not near:
                close(k)
            made = []
            for at in places:
                best = (start, end, length, at)
                for c in near:
                    new = end - max(start, c[1])
                    if at - c[3] >= new and c[2] + new > best[2]:
                        best = (c[0], end, c[2] + new, at)
                made.append(best)
            open_[k] = near + made
            held.setdefault(k, []).extend(made)
    for k in list(held):
        close(k)
    # all templates' chains at once: of two that overlap, the one that covers more words stays, then more of its template
    taken: list[tuple[int, int, int, int]] = []
    for start, end, k, covered in sorted(enough, key=lambda c: (-c[3], lengths[c[2]], c[0], c[1], c[2])):
        if all(end <= a or b <= start for a, b, *_ in taken):
            taken.append((start, end, k, covered))
    return sorted(taken)


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Starts of the base phrases with their labels."""
    out = []
    for phrase, label in PHRASES:
        p = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(p[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(p)] == p:
                out.append((at, label))
    return sorted(out)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,covered:long>>"


def scanner(templates: dict[str, str] = TEMPLATES):
    """A function over Arrow batches of (..., text) that replaces text by the fields of SCHEMA."""

    def scan(batches):
        import pyarrow as pa

        sam, names, lengths, anchors = build(templates)
        heads = {p.split()[0].encode() for p, _ in PHRASES}
        look = anchors | heads
        for batch in batches:
            rows = []
            for raw in batch.column("text").cast(pa.binary()):
                words = words_of(raw.as_py())
                base, spans = [], []
                if not look.isdisjoint(words):
                    base, spans = base_places(words), chained(sam, lengths, words)
                labels = {label for _, label in base}
                covered = max((c / lengths[k] for _, _, k, c in spans), default=0.0)
                rows.append({
                    "n_words": len(words),
                    "n_base": len(base),
                    "first_word": base[0][0] if base else None,
                    "last_word": base[-1][0] if base else None,
                    "base_labels": ",".join(sorted(labels)),
                    "labels": ",".join(sorted(labels | {names[k] for _, _, k, _ in spans})),
                    "score": min(1.0, max(covered, 0.5 if base else 0.0)),
                    "spans": [{"label": names[k], "start": s, "end": e, "covered": c} for s, e, k, c in spans],
                })
            kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64())]))
            types = [
                ("n_words", pa.int64()),
                ("n_base", pa.int64()),
                ("first_word", pa.int64()),
                ("last_word", pa.int64()),
                ("base_labels", pa.string()),
                ("labels", pa.string()),
                ("score", pa.float64()),
                ("spans", kind),
            ]
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
            made = [pa.array([r[n] for r in rows], t) for n, t in types]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + made, names=[n for n, _ in kept] + [n for n, _ in types])

    return scan


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, ...) of docs with the fields of SCHEMA; spans are in words, the end exclusive."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(scanner(templates), f"doc_id {kind}, {SCHEMA}")


def op6(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("spans")
