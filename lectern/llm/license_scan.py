"""License scans by matching statistics over a generalised suffix automaton of license templates.

All templates and phrases make one automaton of their words. Each text streams through it once: at every word it knows the
longest stretch ending there that stands in some template, and where. Stretches that end (no template goes on as the text does, or
fewer do) are matches; matches of one template that follow each other in text and template, few words apart, are chained; a
chain that covers enough of its template is a span and gives its label. Of spans that overlap, the one covering more words stays.
Phrases are found on the way: a phrase ends at a word if its state is the present one or above it by suffix links.

Two neighbouring words that stand beside each other in no template end every stretch, so only what lies between such
places is walked; a table of pairs of template words tells them for all texts of a batch at once. The templates are a parameter
and small; documents are independent, and nothing is shuffled.

Defined cases: words are what is left between ASCII characters that are no letters or digits, A-Z in lower case; a null text is empty; without
words or matches there is no label and score 0; of chains that tie, the first in the order of templates, then of the text; repeated rows and null
doc_ids each get their row; texts may be of any length; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import sliced
from .suffix_automaton import automaton

#: Fixed by the contract of op12: phrase, label.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: label, text. Notices as their licenses ask for them, texts of the short licenses, and lines that name one. Fixed values.
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
        of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS
        PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
        of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of
        the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
        this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License
        at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software
        Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either
        in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
]

#: Words of a match, words between chained matches, and the share of a template that makes a span.
MATCH, GAP, SHARE = 3, 12, 0.8
TOGETHER, PIECE = 4 << 20, 1 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


class Match(NamedTuple):
    """Words [start, end) of a text are words [at, at + end - start) of a template."""

    template: int
    start: int
    end: int
    at: int


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and _FOLD[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_FOLD).split()
        at = end


class Templates:
    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], match: int = MATCH, gap: int = GAP, share: float = SHARE):
        self.labels, self.phrase_labels = [label for label, _ in templates], [label for _, label in phrases]
        self.match, self.gap, self.share = match, gap, share
        spelt = [[w for some in words_of(text.encode()) for w in some] for text in [*(t for _, t in templates), *(p for p, _ in phrases)]]
        self.number: dict[bytes, int] = {}
        flat, owner, place = [], [], []
        for k, words in enumerate(spelt):
            for i, w in enumerate(words):
                flat.append(self.number.setdefault(w, len(self.number)))
                owner.append(k)
                place.append(i)
            flat.append(-1 - k)  # a separator of its own, which no word equals
            owner.append(-1)
            place.append(-1)
        self.sizes = [len(words) for words in spelt]
        n = len(self.number)
        self.pairs = np.zeros((n + 1, n + 1), bool)  # the last row and column are of words in no template
        for a, b in zip(flat, flat[1:]):
            if a >= 0 and b >= 0:
                self.pairs[a, b] = True
        self.length, self.link, prefix, self.following = automaton(flat)
        ends: list[set[tuple[int, int]]] = [set() for _ in self.length]
        for i, state in enumerate(prefix):
            if 0 <= owner[i] < len(templates):
                ends[state].add((owner[i], place[i] + 1))
        order = sorted(range(1, len(self.length)), key=lambda s: -self.length[s])
        for state in order:
            if self.link[state] > 0:
                ends[self.link[state]] |= ends[state]
        self.ends = [sorted(e) for e in ends]
        self.phrases: list[tuple[tuple[int, int], ...]] = [()] * len(self.length)  # of each state: (words, phrase) that end where it does
        own: dict[int, list[tuple[int, int]]] = {}
        for k, words in enumerate(spelt[len(templates) :]):
            state = 0
            for w in words:
                state = self.following[state][self.number[w]]
            if words:
                own.setdefault(state, []).append((len(words), k))
        for state in reversed(order):
            self.phrases[state] = (self.phrases[self.link[state]] if self.link[state] > 0 else ()) + tuple(own.get(state, ()))

    def walk(self, numbers: list[int], start: int, matches: list[Match], places: list[tuple[int, int]]) -> None:
        """Adds the matches and places of phrases of one stretch of template words, which begins at word `start`."""
        state = size = 0
        following, link, length, ends, phrases = self.following, self.link, self.length, self.ends, self.phrases

        def close(at: int, which: list[tuple[int, int]]) -> None:
            matches.extend(Match(k, at - size, at, e - size) for k, e in which)

        for i, c in enumerate(numbers, start):
            if c not in following[state]:
                if size >= self.match:
                    close(i, ends[state])
                while state and c not in following[state]:
                    state = link[state]
                    size = length[state]
            elif size >= self.match and len(ends[following[state][c]]) < len(ends[state]):
                on = set(ends[following[state][c]])
                close(i, [(k, e) for k, e in ends[state] if (k, e + 1) not in on])
            if c in following[state]:
                state = following[state][c]
                size += 1
            for n, k in phrases[state]:
                if n <= size:
                    places.append((i - n + 1, k))
        if size >= self.match:
            close(start + len(numbers), ends[state])

    def chains(self, matches: list[Match]) -> list[tuple[int, int, int, int]]:
        """(covered words, template, start, end) of the chains of each template, no match in two of them."""
        out = []
        for k in sorted({m.template for m in matches}):
            own = sorted({m for m in matches if m.template == k}, key=lambda m: (m.end, m.start, m.at))
            best, before, first = [], [], []
            for j, m in enumerate(own):
                gain, came = m.end - m.start, -1
                for i in range(j - 1, -1, -1):
                    p = own[i]
                    if p.end < m.start - self.gap:
                        break
                    p_at = p.at + p.end - p.start
                    if p.start < m.start and p.at < m.at and p.end < m.end and p_at < m.at + m.end - m.start:
                        more = best[i] + m.end - m.start - max(0, p.end - m.start, p_at - m.at)
                        if more > gain:
                            gain, came = more, i
                best.append(gain)
                before.append(came)
                first.append(m.start if came < 0 else first[came])
            used = [False] * len(own)
            for j in sorted(range(len(own)), key=lambda j: (-best[j], j)):
                path, i = [], j
                while i >= 0 and not used[i]:
                    path.append(i)
                    i = before[i]
                if i < 0:
                    for i in path:
                        used[i] = True
                    out.append((best[j], k, first[j], own[j].end))
        return out

    def spans(self, matches: list[Match]) -> tuple[list[tuple[int, int, str, float]], float]:
        """(start, end, label, share) of the spans in order, and the largest share of any chain."""
        chains = self.chains(matches)
        kept: list[tuple[int, int, str, float]] = []
        for covered, k, a, b in sorted((c for c in chains if c[0] >= self.share * self.sizes[c[1]]), key=lambda c: (-c[0], c[1], c[2])):
            if all(b <= s or e <= a for s, e, _, _ in kept):
                kept.append((a, b, self.labels[k], covered / self.sizes[k]))
        return sorted(kept), max((c[0] / self.sizes[c[1]] for c in chains), default=0.0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, match: int = MATCH, gap: int = GAP, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, n_base (places of phrases), first_word, last_word (of places), base_labels, labels, score, spans (start, end, label, share) for each row of docs.

    score: the largest share of a template that a chain covers, 1 where a phrase stands.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start: bigint, end: bigint, label: string, share: double>>"
    struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))

    def solve(known: Templates, ids: pa.Array, texts: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(texts)
        begins = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        joined = known.pairs[flat[:-1], flat[1:]] if len(flat) else np.zeros(0, bool)
        inner = begins[1:-1]
        joined[inner[(inner > 0) & (inner < len(flat))] - 1] = False  # from one text to the next
        edge = np.diff(np.concatenate(([0], joined.view(np.int8), [0])))
        matches: dict[int, list[Match]] = {}
        places: dict[int, list[tuple[int, int]]] = {}
        alone = {w for w in range(len(known.number)) if known.phrases[known.following[0][w]]} if known.following[0] else set()
        stretches = [(a, b + 1) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
        if alone:  # phrases of one word stand in stretches of one word too
            single = np.ones(len(flat), bool)
            for a, b in stretches:
                single[a:b] = False
            stretches += [(i, i + 1) for i in np.flatnonzero(single & np.isin(flat, list(alone))).tolist()]
        for a, b in stretches:
            k = int(np.searchsorted(begins, a, "right")) - 1
            known.walk(flat[a:b].tolist(), int(a - begins[k]), matches.setdefault(k, []), places.setdefault(k, []))
        rows = []
        for k, t in enumerate(texts):
            spans, score = known.spans(matches[k]) if matches.get(k) else ([], 0.0)
            at = places.get(k, ())
            base = {known.phrase_labels[p] for _, p in at}
            rows.append((len(t), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[2] for s in spans})), 1.0 if at else score, [dict(zip(("start", "end", "label", "share"), s)) for s in spans]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), struct]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        return pa.RecordBatch.from_arrays([ids, *[pa.array([r[i] for r in rows], kinds[i]) for i in range(8)]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, phrases, match, gap, share)
        number, other = known.number.get, repeat(len(known.number))
        for batch in sliced(batches):
            first, size, texts = 0, 0, []
            for k, value in enumerate(batch.column(1)):
                buffer = value.as_buffer()
                text = buffer.to_pybytes() if buffer is not None else b""
                if texts and size + len(text) > TOGETHER:
                    yield solve(known, batch.column(0).slice(first, k - first), texts)
                    first, size, texts = k, 0, []
                parts = [np.fromiter(map(number, words, other), np.int32, len(words)) for words in words_of(text)]
                texts.append(np.concatenate(parts) if parts else np.empty(0, np.int32))
                size += len(text)
            if texts:
                yield solve(known, batch.column(0).slice(first), texts)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
