"""License scans by a generalised suffix automaton of licence tokens.

The automaton holds all token sequences of all templates. A document's tokens
are streamed through it once: at each token it knows the longest suffix read so
far that some template contains (the matching statistic). Matches of at least
`min_match` tokens are chained per template, in the order of both texts and
with gaps of at most `max_gap` tokens, into spans; a template whose chained
tokens cover at least `min_cover` of it gives its label.

Base phrases are found wherever their words stand consecutively; their
labels always stay.

Tokens are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased. Defined
cases: null and empty texts have no words, no labels and score 0; rows that
repeat a document repeat its result; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_text, python_path, release, slices

#: The phrases and labels of the base result.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Public notices, conditions and disclaimers of common licences: label and the words by which it is known. Callers may give others.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "licensed under the Apache License 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("isc", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced"),
]

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


@dataclass
class _State:
    length: int
    link: int
    next: dict[int, int] = field(default_factory=dict)
    ends: dict[int, int] = field(default_factory=dict)  # template -> where this state's strings first end in it


class SuffixAutomaton:
    """All substrings of several token sequences; tokens are positive integers."""

    def __init__(self, templates: list[list[int]]) -> None:
        self.states = [_State(0, -1)]
        self.sizes = [len(t) for t in templates]
        for number, template in enumerate(templates):
            last = 0
            for token in template:
                last = self._extend(last, token)
            at = 0
            for end, token in enumerate(template, 1):
                at = self.states[at].next[token]
                up = at
                while up > 0 and number not in self.states[up].ends:
                    self.states[up].ends[number] = end
                    up = self.states[up].link

    def _clone(self, p: int, q: int, token: int) -> int:
        s = self.states
        s.append(_State(s[p].length + 1, s[q].link, dict(s[q].next), dict(s[q].ends)))
        new = len(s) - 1
        while p >= 0 and s[p].next.get(token) == q:
            s[p].next[token] = new
            p = s[p].link
        s[q].link = new
        return new

    def _extend(self, last: int, token: int) -> int:
        s = self.states
        if (q := s[last].next.get(token)) is not None:
            return q if s[q].length == s[last].length + 1 else self._clone(last, q, token)
        s.append(_State(s[last].length + 1, 0))
        new, p = len(s) - 1, last
        while p >= 0 and token not in s[p].next:
            s[p].next[token] = new
            p = s[p].link
        if p >= 0:
            q = s[p].next[token]
            s[new].link = q if s[q].length == s[p].length + 1 else self._clone(p, q, token)
        return new

    def matches(self, tokens: list[int], begin: int, least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) where a match of at least that length can't be prolonged; begin is the place of the first token."""
        s, at, length = self.states, 0, 0
        for place, token in enumerate(tokens, begin):
            if token not in s[at].next:
                if length >= least:
                    yield place, length, at
                while at and token not in s[at].next:
                    at = s[at].link
                    length = s[at].length
            if (q := s[at].next.get(token)) is not None:
                at, length = q, length + 1
        if length >= least:
            yield begin + len(tokens), length, at


@dataclass(frozen=True)
class Rules:
    min_match: int = 3
    max_gap: int = 12
    min_cover: float = 0.6


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], rules: Rules) -> None:
        self.labels, self.rules = [label for label, _ in templates], rules
        texts = [words_of(text.encode()) for _, text in templates]
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases.items()]
        known = {w for t in [*texts, *(p for p, _ in self.phrases)] for w in t}
        self.number = {w: i for i, w in enumerate(sorted(known), 1)}
        self.automaton = SuffixAutomaton([[self.number[w] for w in t] for t in texts])
        self.by_first: dict[int, list[tuple[list[int], str]]] = {}
        for p, label in self.phrases:
            ids = [self.number[w] for w in p]
            self.by_first.setdefault(ids[0], []).append((ids, label))

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, labels, score, spans of (label, first word, past the last word, covered share)."""
        number = self.number
        ids = [number.get(w, 0) for w in words_of(text)]
        base, found = [], []
        place, n = 0, len(ids)
        while place < n:
            if not ids[place]:
                place += 1
                continue
            end = place
            while end < n and ids[end]:
                end += 1
            if end - place >= 2:
                run = ids[place:end]
                for k, token in enumerate(run):
                    for phrase, label in self.by_first.get(token, ()):
                        if run[k : k + len(phrase)] == phrase:
                            base.append((place + k, label))
                if end - place >= self.rules.min_match:
                    found += self.automaton.matches(run, place, self.rules.min_match)
            place = end
        spans = self._chain(found) if found else []
        base_labels = sorted({label for _, label in base})
        labels = sorted({*base_labels, *(s[0] for s in spans)})
        score = 1.0 if base else max((s[3] for s in spans), default=0.0)
        starts = [p for p, _ in base]
        return n, len(base), min(starts, default=None), max(starts, default=None), base_labels, labels, min(1.0, score), spans

    def _chain(self, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """All covered template spans, in the order of the text, as found is."""
        open_: dict[int, list[int]] = {}  # template -> first word, past the last, past the last in the template, covered
        spans: list[tuple[str, int, int, float]] = []

        def close(template: int) -> None:
            first, end, _, covered = open_.pop(template)
            share = covered / self.automaton.sizes[template]
            if share >= self.rules.min_cover:
                spans.append((self.labels[template], first, end, min(1.0, share)))

        for end, length, state in found:
            for template, at in self.automaton.states[state].ends.items():
                begin = end - length
                if (chain := open_.get(template)) is not None:
                    fresh = min(length, at - chain[2], end - chain[1])
                    if fresh > 0 and begin - chain[1] <= self.rules.max_gap:
                        chain[1:] = [end, at, chain[3] + fresh]
                        continue
                    if fresh <= 0 and begin < chain[1]:
                        continue
                    close(template)
                open_[template] = [begin, end, at, length]
        for template in list(open_):
            close(template)
        return sorted(spans, key=lambda s: (s[1], s[2], s[0]))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, rules: Rules = Rules()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of each row of docs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scanner = Scanner(templates, phrases, rules)
        span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64())])
        for batch in slices(batches):
            rows = [scanner.scan(text) for _, text in id_text(batch)]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            columns += [pa.array([",".join(r[k]) for r in rows], pa.string()) for k in (4, 5)]
            spans = pa.array([[dict(zip(("label", "first_word", "end_word", "cover"), s)) for s in r[7]] for r in rows], pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([r[6] for r in rows], pa.float64()), spans], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    python_path(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(
        scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, end_word: long, cover: double>>"
    )
