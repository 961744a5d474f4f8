"""License scans: matching statistics against a generalised suffix automaton of licence tokens.

The automaton holds all templates and base phrases as token sequences (a parameter, small).  Each
text streams through it, giving at every word the longest suffix that occurs in a template; base
phrases are read off the suffix links, long matches are chained per template into covered spans.
A chain needs the identifying words of its licence in one piece and no word of another kind of
licence among its own; where chains of different licences overlap, the fullest cover wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Phrases whose every place counts, with their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Notices and whole texts of well-known licences, as their authors state them.
_WARRANTY_BSD = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_TERMS_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."

TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd", f"{_TERMS_BSD} {_WARRANTY_BSD}"),
    ("bsd", f"{_TERMS_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_WARRANTY_BSD}"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Identifying words of a label: a chain must match them in one piece, where its template has them.
KEYS = {
    "apache-2": "apache license version 2",
    "gpl-3": "version 3",
    "gpl-2": "version 2",
    "lgpl": "gnu lesser general public license",
    "mpl-2": "mozilla public license",
    "cc-by": "creative commons attribution",
    "cc-by-nc": "attribution noncommercial",
    "cc-by-nd": "attribution noderivatives",
    "cc-by-sa": "attribution sharealike",
    "cc-by-nc-sa": "attribution noncommercial sharealike",
    "cc-by-nc-nd": "attribution noncommercial noderivatives",
}
#: By the first part of a label: words of other kinds of licence, of which none may stand unmatched in a chain.
RIVALS = {
    "gpl": "lesser library affero",
    "lgpl": "library affero",
    "cc": "noncommercial commercial nc noderivatives noderivs derivatives nd sharealike alike sa",
}

#: Words that a match must have to enter a chain.
MIN_MATCH = 3
#: Share of a template's words that a chain must cover to label the text.
MIN_COVER = 0.7
#: Words of text that may stand between two matches of a chain.
MAX_GAP = 8
BLOCK_BYTES = 8 << 20


class SuffixAutomaton:
    """Generalised suffix automaton of several token sequences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]  # sequence to all places where a state ends in it

    def _new(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """The part of q's strings that are p's longest string and the token, as a state of its own."""
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.ends[clone] = {k: list(v) for k, v in self.ends[q].items()}
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            q = self.next[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        here = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = here
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[here] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return here

    def add(self, tokens: list[int], number: int) -> None:
        """Adds sequence ``number``."""
        last = 0
        for token in tokens:
            last = self._extend(last, token)
        state = 0
        for i, token in enumerate(tokens):
            state = up = self.next[state][token]
            while up > 0:
                self.ends[up].setdefault(number, []).append(i)
                up = self.link[up]

    def walk(self, tokens: Iterable[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: after each token the state and length of the longest match that ends there."""
        follow, link, length = self.next, self.link, self.length
        state = n = 0
        for token in tokens:
            while state and token not in follow[state]:
                state = link[state]
                n = length[state]
            if token in follow[state]:
                state = follow[state][token]
                n += 1
            else:
                n = 0
            yield state, n


@dataclass
class Found:
    n_words: int = 0
    n_base: int = 0
    first: int | None = None
    last: int | None = None
    base: tuple = ()
    spans: tuple = ()


class Scanner:
    """Automaton, vocabulary and chain rules for a set of phrases and templates."""

    def __init__(
        self,
        templates=TEMPLATES,
        phrases=BASE_PHRASES,
        min_match=MIN_MATCH,
        min_cover=MIN_COVER,
        max_gap=MAX_GAP,
        keys=KEYS,
        rivals=RIVALS,
    ):
        self.vocabulary: dict[bytes, int] = {}
        self.templates = [(label, self._ids(text)) for label, text in templates]
        self.phrases = [(self._ids(text), label) for text, label in phrases]
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap
        self.keys = [self._place(ids, self._ids(keys.get(label, ""))) for label, ids in self.templates]
        kinds = {part: set(self._ids(words)) for part, words in rivals.items()}
        self.rivals = [kinds.get(label.split("-")[0], set()) for label, _ in self.templates]
        self.automaton = a = SuffixAutomaton()
        for i, (_, ids) in enumerate(self.templates):
            a.add(ids, i)
        for i, (ids, _) in enumerate(self.phrases):
            a.add(ids, len(self.templates) + i)
        self.shortest = min([min_match, *(len(p) for p, _ in self.phrases)])
        homes: dict[int, list[int]] = {}
        for i, (ids, _) in enumerate(self.phrases):
            state = 0
            for token in ids:
                state = a.next[state][token]
            homes.setdefault(state, []).append(i)
        #: Phrases that are suffixes of a state's strings: its own and those of its suffix links.
        self.suffixes: list[list[int]] = [[] for _ in a.next]
        for state in sorted(range(1, len(a.next)), key=a.length.__getitem__):
            self.suffixes[state] = self.suffixes[a.link[state]] + homes.get(state, [])

    def _ids(self, text: str) -> list[int]:
        words = common.alnum_words(text.encode())
        return [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]

    @staticmethod
    def _place(ids: list[int], key: list[int]) -> tuple[int, int]:
        """Where the key stands in a template; an empty place when it does not."""
        at = next((i for i in range(len(ids) - len(key) + 1) if ids[i : i + len(key)] == key), None)
        return (0, 0) if at is None else (at, at + len(key))

    def _chain(self, matches: list[tuple[int, int, int]], words: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, cover) of chains that cover enough of a template.

        A match stands at each of its places in a template.  A chain is a row of matches of which each
        begins and ends after the one before it in text and template, with ``max_gap`` words of text
        between them at most; its cover counts the template's words that it holds.  A match at a place
        continues the chain that gives it the most cover (the latest start, then, of equal ones).
        """
        placed: dict[int, list[tuple[int, int, int, int]]] = {}
        for at, n, state in matches:
            for t, ends in self.automaton.ends[state].items():
                if t < len(self.templates):
                    placed.setdefault(t, []).extend((at, at + n, end - n + 1, end + 1) for end in ends)
        good = []
        for t, own in placed.items():
            covered, before, start = [], [], []
            low = 0
            continued = set()
            for j, (at, stop, here, end) in enumerate(own):
                while own[low][1] + self.max_gap < at:
                    low += 1
                best, from_ = (end - here, at), -1
                for i in range(low, j):
                    at_i, stop_i, here_i, end_i = own[i]
                    if at_i < at and stop_i < stop and here_i < here and end_i < end:
                        gained = (covered[i] + end - max(here, end_i), start[i])
                        if gained > best:
                            best, from_ = gained, i
                covered.append(best[0])
                start.append(best[1])
                before.append(from_)
                continued.add(from_)
            for i in range(len(own)):
                # The longest part, from its beginning, of a chain that nothing continues.
                while i >= 0 and i not in continued and covered[i] >= self.min_cover * len(self.templates[t][1]):
                    pieces, k = [], i
                    while k >= 0:
                        pieces.append(own[k])
                        k = before[k]
                    if self._holds(t, pieces[::-1], words):
                        good.append((covered[i] / len(self.templates[t][1]), covered[i], self.templates[t][0], start[i], own[i][1]))
                        break
                    continued.discard(i := before[i])
        return self._winners(good)

    def _holds(self, t: int, pieces: list[tuple[int, int, int, int]], words: np.ndarray) -> bool:
        """Whether a chain has its licence's identifying words in one piece and no rival's word between."""
        first, last = self.keys[t]
        if last and not any(p[2] <= first and last <= p[3] for p in pieces):
            return False
        gaps = ((a[1], b[0]) for a, b in zip(pieces, pieces[1:], strict=False))
        return not self.rivals[t] or not any(int(words[at]) in self.rivals[t] for a, b in gaps for at in range(a, b))

    @staticmethod
    def _winners(good: list[tuple[float, int, str, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains that no fuller (then longer) chain of another label overlaps; equals stay."""
        kept: list[tuple[float, int, str, int, int]] = []
        reach = 0
        groups: list[list[tuple[float, int, str, int, int]]] = []
        for chain in sorted(set(good), key=lambda x: x[3]):
            if not groups or chain[3] >= reach:
                groups.append([])
            groups[-1].append(chain)
            reach = max(reach, chain[4]) if len(groups[-1]) > 1 else chain[4]
        for group in groups:
            own: list[tuple[float, int, str, int, int]] = []
            for chain in sorted(group, reverse=True):
                if not any(w[:2] > chain[:2] and w[2] != chain[2] and w[3] < chain[4] and chain[3] < w[4] for w in own):
                    own.append(chain)
            kept += own
        return sorted({(c[2], c[3], c[4], c[0]) for c in kept}, key=lambda x: (x[1], x[2], x[0]))

    def scan(self, texts: list[bytes]) -> list[Found]:
        get = self.vocabulary.get
        parts, found = [], []
        for text in texts:
            numbers = common.word_numbers(text, get)
            found.append(Found(len(numbers)))
            parts += [numbers, np.zeros(1, np.int32)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        starts = np.concatenate([[0], np.cumsum([f.n_words + 1 for f in found])])
        known = np.concatenate([[0], (ids > 0).view(np.int8), [0]])
        edges = np.flatnonzero(np.diff(known))
        begins, ends = edges[::2], edges[1::2]
        long = ends - begins >= self.shortest
        begins, ends = begins[long], ends[long]
        docs = np.searchsorted(starts, begins, "right") - 1
        matches: dict[int, list[tuple[int, int, int]]] = {}
        places: dict[int, list[tuple[int, int]]] = {}
        for doc, begin, end in zip(docs.tolist(), begins.tolist(), ends.tolist(), strict=True):
            shift = begin - int(starts[doc])
            state = n = i = 0
            for i, (new, m) in enumerate(self.automaton.walk(ids[begin:end].tolist())):
                if m <= n and n >= self.min_match:
                    matches.setdefault(doc, []).append((shift + i - n, n, state))
                state, n = new, m
                for p in self.suffixes[state]:
                    if n >= (k := len(self.phrases[p][0])):
                        places.setdefault(doc, []).append((shift + i - k + 1, p))
            if n >= self.min_match:
                matches.setdefault(doc, []).append((shift + i + 1 - n, n, state))
        for doc, own in places.items():
            f = found[doc]
            f.n_base, f.first, f.last = len(own), min(own)[0], max(own)[0]
            f.base = tuple(sorted({self.phrases[p][1] for _, p in own}))
        for doc, own in matches.items():
            found[doc].spans = tuple(self._chain(own, ids[starts[doc] : starts[doc + 1]]))
        return found


_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,start:int,stop:int,cover:double>>"
)
_SPAN = pa.list_(
    pa.struct([("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("cover", pa.float64())])
)


def scan_licenses(
    docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per document: base places and labels, labels with those of chains, score, spans.

    Other columns of ``docs`` may have any names.  An empty table gives no rows.  ``score`` is 1 where a base phrase stands, else the largest cover of a chain, else 0.  Null or
    empty text has no words, no labels and score 0.  Repeated rows each get their row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.texts_of(batch.column("text"))
            for a, b in common.blocks(texts, BLOCK_BYTES):
                found = shared.value.scan(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array([f.n_words for f in found], pa.int64()),
                        pa.array([f.n_base for f in found], pa.int64()),
                        pa.array([f.first for f in found], pa.int64()),
                        pa.array([f.last for f in found], pa.int64()),
                        pa.array([",".join(f.base) for f in found], pa.string()),
                        pa.array([",".join(sorted({*f.base, *(s[0] for s in f.spans)})) for f in found], pa.string()),
                        pa.array([1.0 if f.base else max((min(1.0, s[3]) for s in f.spans), default=0.0) for f in found]),
                        pa.array(
                            [[dict(zip(("label", "start", "stop", "cover"), s, strict=True)) for s in f.spans] for f in found],
                            _SPAN,
                        ),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return common.map_batches(common.id_and_text(docs, id_col, text_col), work, _SCHEMA)
