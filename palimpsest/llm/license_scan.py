"""License scans with a generalised suffix automaton.

The automaton holds every run of words of the license templates and of the short
phrases that name a license. Texts stream through it word by word; the state
gives the longest run that ends at each word and stands in a template, the
matching statistics. A word that no template has sends it back to the start, so
only stretches of template words are walked.

A phrase is found wherever its words end, by the suffix links. Matches of at
least LEAST words that can't be extended are anchors; anchors that lie in the
same order in text and template are chained, within twice the template's length,
and a template whose words a chain covers to THRESHOLD gives its label, with a span
for each such chain. Templates
and automaton are parameters of fixed size; texts are read whole where they lie,
with no exchange.

Defined cases: null and empty texts have no words, no labels (empty strings) and
score 0; repeated rows are scanned each.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .kernels import ALNUM, group_runs, hash_words, text_slices, words_of

LEAST, THRESHOLD = 4, 0.75
#: Phrases that name a license by themselves.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices by which texts carry a license, and texts of short licenses: fixed wording.
TEMPLATES = (
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "mit",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "bsd",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "isc",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache-2",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "gpl-3",
    ),
    ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unlicense"),
    ("Released under the MIT License.", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache-2"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gpl-3"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2"),
    ("All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means", "all-rights-reserved"),
)


class SuffixAutomaton:
    """States of all runs of some sequences; each knows its longest run, its suffix link and where it ends."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]

    def _state(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _extend(self, last: int, c) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c, q: int) -> int:
        """The state of the runs of q that are no longer than p's and c."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, words: list, name) -> None:
        last = 0
        for i, c in enumerate(words):
            last = self._extend(last, c)
            self.ends[last].add((name, i + 1))

    def finish(self) -> None:
        """Every state gets the ends of the states that link to it."""
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]
        self.ends[0] = set()

    def statistics(self, words: list):
        """(state, length) of the longest run that ends at each word."""
        s = n = 0
        for c in words:
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            yield s, n


def _hashes(text: str) -> list[int]:
    for _, _, buf, off in text_slices(pa.array([text], pa.string())):
        buf, s, e, _ = words_of(buf, off, ALNUM, lower=True)
        return hash_words(buf, s, e).tolist()
    return []


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES, least: int = LEAST, threshold: float = THRESHOLD):
        self.phrases, self.labels, self.least, self.threshold = phrases, [x for _, x in templates], least, threshold
        self.automaton, self.sizes = SuffixAutomaton(), []
        for i, (text, _) in enumerate(templates):
            words = _hashes(text)
            self.automaton.add(words, i)
            self.sizes.append(len(words))
        named = [(_hashes(text), label) for text, label in phrases]
        for words, _ in named:
            self.automaton.add(words, -1)
        self.automaton.finish()
        self.shortest = min([least, *self.sizes, *(len(w) for w, _ in named)])
        #: Phrases that end with a state's runs, with their lengths.
        self.found: list[list[tuple[int, str]]] = [[] for _ in self.automaton.next]
        home = {}
        for words, label in named:
            *_, (s, _) = self.automaton.statistics(words)
            home.setdefault(s, []).append((len(words), label))
        for s in range(len(self.found)):
            t = s
            while t > 0:
                self.found[s] += home.get(t, [])
                t = self.automaton.link[t]
        self.vocabulary = np.array(sorted({c for nxt in self.automaton.next for c in nxt}), np.uint64)

    def chains(self, anchors: list[tuple[int, int, int]], size: int) -> list[tuple[float, int, int]]:
        """(share covered, first word, last word) of chains of (first word, words, end in the template), best first.

        A chain lies in the same order in a text and a template of `size` words,
        each anchor within twice that size of the next. After the best chain, the
        anchors that lie clear of it are chained again, as long as a chain covers
        the threshold; the first one is given in any case.
        """
        left, out = sorted(set(anchors)), []
        while left:
            starts, best, before = [a for a, _, _ in left], [n for _, n, _ in left], [-1] * len(left)
            for j, (a, n, end) in enumerate(left):
                for i in range(bisect_left(starts, a - 2 * size), j):
                    b, m, e = left[i]
                    new = min(n, end - e, a + n - b - m)  # words of j past the end of i, in both
                    if new > 0 and b < a and e < end and best[i] + new > best[j]:
                        best[j], before[j] = best[i] + new, i
            j = max(range(len(left)), key=lambda j: (best[j], -j))
            share, last = min(1.0, best[j] / size), left[j][0] + left[j][1] - 1
            while before[j] >= 0:
                j = before[j]
            if out and share < self.threshold:
                break
            out.append((share, left[j][0], last))
            left = [x for x in left if x[0] + x[1] - 1 < out[-1][1] or x[0] > last]
            if share < self.threshold:
                break
        return out

    def scan(self, words: np.ndarray, runs: list[tuple[int, int]]) -> tuple[list[tuple[int, str]], dict[int, list]]:
        """(phrases' first words and labels, templates' anchors) of a text, from its stretches of template words."""
        phrases, anchors = [], {}
        for a, b in runs:
            was = (0, 0)
            for i, (s, n) in enumerate([*self.automaton.statistics(words[a:b].tolist()), (0, 0)]):
                for size, label in self.found[s]:
                    if n >= size:
                        phrases.append((a + i - size + 1, label))
                if was[1] >= self.least and n != was[1] + 1:
                    for t, end in self.automaton.ends[was[0]]:
                        if t >= 0:
                            anchors.setdefault(t, []).append((a + i - was[1], was[1], end))
                was = s, n
        return phrases, anchors

    def texts(self, texts: pa.Array):
        """A row of results for each text: n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
        out = []
        for _, _, buf, off in text_slices(texts):
            buf, s, e, first = words_of(buf, off, ALNUM, lower=True)
            words = hash_words(buf, s, e)
            at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
            runs: dict[int, list] = {}
            for d, a, b in group_runs(self.vocabulary[at] == words, first, self.shortest):
                runs.setdefault(d, []).append((a, b))
            for d, n in enumerate(np.diff(first).tolist()):
                if d not in runs:
                    out.append((n, 0, None, None, "", "", 0.0, []))
                    continue
                phrases, anchors = self.scan(words[first[d] : first[d + 1]], runs[d])
                base, spans, score = {x for _, x in phrases}, [], float(bool(phrases))
                for t, found in sorted(anchors.items()):
                    for share, a, b in self.chains(found, self.sizes[t]):
                        score = max(score, share)
                        if share >= self.threshold:
                            spans.append((self.labels[t], a, b, share))
                where = [p for p, _ in phrases]
                out.append((n, len(phrases), min(where, default=None), max(where, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x for x, *_ in spans})), score, spans))
        return out


RESULT = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType())]
SPANS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("coverage", T.DoubleType())]))


def with_licenses(docs: DataFrame, scanner: Scanner | None = None, text_col: str = "text") -> DataFrame:
    """docs with what Scanner.texts() finds; columns of docs so named are replaced."""
    fields = [*RESULT, ("spans", SPANS)]
    out = docs.select(*[c for c in docs.columns if c not in {n for n, _ in fields}])
    shared = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())  # as large as the templates
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))]

    def run(batches):
        for batch in batches:
            rows = shared.value.texts(batch.column(batch.schema.get_field_index(text_col)))
            cols = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in kinds]
            cols[-1] = [[dict(zip(("label", "first_word", "last_word", "coverage"), x, strict=True)) for x in spans] for spans in cols[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*batch.schema.names, *[n for n, _ in fields]])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, *[T.StructField(n, t) for n, t in fields]]))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return with_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *[F.col(n) for n, _ in RESULT])
