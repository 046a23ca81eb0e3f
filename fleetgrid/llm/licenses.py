"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds every run of words of the templates. Streaming a text through it gives matching statistics: at
each word, the longest run that ends there and occurs in a template. Long matches are chained, in the order of the
template, into spans that cover it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

#: Words of a text with A-Z lower-cased, as UTF-8: ASCII letters and digits, and everything beyond ASCII.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases that are labelled wherever they stand.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Wording of common public licence notices, as words.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

# Whole texts of short public licences, from the grant on, as words.
WHOLE = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties "
        "of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever "
        "resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software",
        "isc",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source "
        "code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright "
        "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the "
        "copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a "
        "particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential "
        "damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of "
        "liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
        "possibility of such damage",
        "bsd-2-clause",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following "
        "restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an "
        "acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be "
        "misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
        "zlib",
    ),
)
#: Shortest match that is chained, longest gap inside a chain (words of the text), least cover of a template for its label.
MIN_MATCH, MAX_GAP, MIN_COVER = 3, 16, 0.75


class Span(NamedTuple):
    label: str
    first_word: int
    last_word: int
    cover: float


class Automaton:
    """Generalised suffix automaton over sequences of words, with every place at which a state's words end."""

    def __init__(self, base: tuple[tuple[str, str], ...], templates: tuple[tuple[str, str], ...]):
        self.base = [(tuple(p.encode().split()), label) for p, label in base]
        # a shorter run of known words holds neither a phrase nor a match that is chained
        self.shortest = min([MIN_MATCH, *(len(p) for p, _ in self.base)])
        self.templates = [(tuple(t.encode().split()), label) for t, label in templates]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        self.word: dict[bytes, int] = {}
        for n, (words, _) in enumerate([*self.templates, *self.base]):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, self.word.setdefault(w, len(self.word) + 1))
                if n < len(self.templates):
                    self.ends[last].add((n, at + 1))
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[max(self.link[s], 0)] |= self.ends[s]
        home = []
        for words, _ in self.base:
            s = 0
            for w in words:
                s = self.next[s][self.word[w]]
            home.append(s)
        #: base phrases that end wherever the state is reached with a match at least as long as they are
        self.phrases: list[list[int]] = []
        for s in range(len(self.next)):
            up, t = set(), s
            while t > 0:
                up.add(t)
                t = self.link[t]
            self.phrases.append([i for i, h in enumerate(home) if h in up])

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None and self.length[q] == self.length[last] + 1:
            return q
        if q is not None:
            return self._clone(last, c, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(-1)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[new] = self.link[q]
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word (0: a word of no template)."""
        s = n = 0
        for c in ids:
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            yield s, n

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[Span]]:
        """Places of base phrases (first word, phrase), and spans of chained matches with a cover above zero."""
        get = self.word.get
        ids = [get(w, 0) for w in words]
        known = np.flatnonzero(ids)
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []  # first word, words, state
        for run in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1) if len(known) else []:
            if len(run) < self.shortest:
                continue
            start, before = int(run[0]), (0, 0)
            for at, (s, n) in enumerate(self.statistics([*ids[start : start + len(run)], 0]), start):
                for p in self.phrases[s] if at < start + len(run) else []:
                    if n >= len(self.base[p][0]):
                        places.append((at + 1 - len(self.base[p][0]), p))
                if n <= before[1] and before[1] >= MIN_MATCH:
                    matches.append((at - before[1], before[1], before[0]))
                before = (s, n)
        return places, self._chains(matches)

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[Span]:
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for first, n, s in matches:
            for t, end in self.ends[s]:
                by_template.setdefault(t, []).append((first, end - n, n))
        spans = []
        for t, found in by_template.items():
            words, label = self.templates[t]
            found.sort()
            best: list[tuple[int, int]] = []  # words covered, first word of the chain
            near = 0
            for i, (first, at, n) in enumerate(found):
                while found[near][0] + len(words) + MAX_GAP < first:
                    near += 1
                own = (n, first)
                for j in range(near, i):
                    f, a, m = found[j]
                    if a + m <= at and f + m <= first <= f + m + MAX_GAP and best[j][0] + n > own[0]:
                        own = (best[j][0] + n, best[j][1])
                best.append(own)
            spans += [Span(label, start, first + n - 1, covered / len(words)) for (first, _, n), (covered, start) in zip(found, best, strict=True)]
        return spans


@functools.lru_cache(maxsize=2)
def automaton(base: tuple, templates: tuple) -> Automaton:
    return Automaton(base, templates)


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("cover", pa.float64())])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple = BASE, templates: tuple = TEMPLATES + WHOLE) -> DataFrame:
    """``doc_id, n_words, places`` (first word and label of each base phrase) and ``spans`` (label, first and last word,
    cover) of every whole text; spans cover MIN_COVER of a template at least. ``cover`` is the best cover at all.

    Words count from 0. Null and empty texts have no words and no finds. Rows stay as they are, repeated ones too;
    other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(base, templates)
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(1)).to_pylist(), 4_000_000):
                counts, places, spans, cover = [], [], [], []
                for text in batch.column(1).slice(a, b - a).to_pylist():
                    words = WORDS.findall(text.encode().lower())
                    found, chained = machine.scan(words)
                    counts.append(len(words))
                    places.append([{"first_word": at, "label": base[p][1]} for at, p in found])
                    spans.append([s._asdict() for s in chained if s.cover >= MIN_COVER])
                    cover.append(max([0.0, *(s.cover for s in chained)]))
                place = pa.list_(pa.struct([("first_word", pa.int64()), ("label", pa.string())]))
                columns = [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(places, place), pa.array(spans, pa.list_(_SPAN)), pa.array(cover, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "places", "spans", "cover"])

    schema = "doc_id long, n_words long, places array<struct<first_word: long, label: string>>, spans array<struct<label: string, first_word: long, last_word: long, cover: double>>, cover double"
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("_text")).mapInArrow(run, schema)


def report(df: DataFrame) -> DataFrame:
    """What was found in each document, as labels and a score: 1 for a base phrase, else the best cover."""
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    labels = F.col("places.label")
    return scan(df).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first_word").alias("first_word"),
        F.array_max("places.first_word").alias("last_word"),
        joined(labels).alias("base_labels"),
        joined(F.concat(labels, F.col("spans.label"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.col("cover")).alias("score"),
    )
