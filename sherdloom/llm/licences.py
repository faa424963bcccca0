"""Licence scans with a generalised suffix automaton of licence words.

All templates (short notices and passages of licence texts) are put into one suffix
automaton.  A text streams through it word by word, which gives its matching statistics:
the longest run of words that ends here and occurs in some template.  Runs of ``LONG``
words, and whole templates that are shorter, are matches; every template place is met, not the
longest alone.  Matches of one template that follow each other in the text and in the template
are chained, and a chain that covers enough of its template is a span.  Of spans that lie over
each other the one with more covered words stays.

The base phrases are templates too, and their places come from the same walk.

Defined results: null and empty texts have no words and no spans; repeated rows are scanned
each for itself; a null doc id stays null; of spans with equally many covered words
the first by start, then by label stays; a chain looks back ``GAP`` words at most, so the
work of a text grows with its length; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import col

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = 5  # words of a match, or the whole of a shorter template
GAP = 40  # words that may lie between two matches of a chain, in text and template
SHARE = 0.5  # of a template's words that a span covers
OVERLAP = 0.5  # of a span's words that a better span may cover

# The base phrases and their labels.
PHRASES = {
    "gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license",
}
# Public licence notices and passages, by label.
TEMPLATES = {
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "licensed under the GNU Lesser General Public License",
    ],
    "agpl": ["licensed under the GNU Affero General Public License, version 3"],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Released under the MIT License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
        "licensed under the BSD license",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0."],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0.",
    ],
    "public-domain": ["This is free and unencumbered software released into the public domain", "dedicated to the public domain under CC0"],
    "all-rights-reserved": ["All rights reserved."],
}


def words(text: str | None) -> list[str]:
    """Words of a text, A-Z in lower case."""
    return WORD.findall((text or "").encode().lower().decode())


class Automaton:
    """The suffix automaton of several word sequences, and where in them each state ends."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.sequences = sequences
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.places: list[list[tuple[int, int]]] = [[]]  # (sequence, end) of each state
        for k, sequence in enumerate(sequences):
            state = 0
            for end, word in enumerate(sequence, 1):
                state = self._extend(state, word)
                self.places[state].append((k, end))
        for state in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            if self.link[state] > 0:
                self.places[self.link[state]] += self.places[state]

    def _state(self, size: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.size.append(size)
        self.places.append([])
        return len(self.size) - 1

    def _split(self, state: int, word: int, held: int) -> int:
        """A copy of ``held`` for the strings that are one word longer than ``state``'s."""
        if self.size[held] == self.size[state] + 1:
            return held
        copy = self._state(self.size[state] + 1)
        self.next[copy], self.link[copy] = dict(self.next[held]), self.link[held]
        self.link[held] = copy
        while state >= 0 and self.next[state].get(word) == held:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        held = self.next[last].get(word)
        if held is not None:  # another sequence has been here
            return self._split(last, word, held)
        new = self._state(self.size[last] + 1)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        self.link[new] = 0 if last < 0 else self._split(last, word, self.next[last][word])
        return new


class Scanner:
    """Spans and base places of one text after another."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]], long: int) -> None:
        self.phrases = len(phrases)
        self.labels = [*phrases, *[label for label, texts in templates.items() for _ in texts]]
        split = [words(t) for t in [*phrases.values(), *[t for texts in templates.values() for t in texts]]]
        self.ids: dict[str, int] = {}
        self.sequences = [[self.ids.setdefault(w, len(self.ids)) for w in s] for s in split]
        self.long = long
        a = self.automaton = Automaton(self.sequences)
        # What ends at a state, its shorter suffixes included: places (sequence, end, words
        # at most) of long matches, and whole sequences that are shorter than that, or base phrases.
        self.ends: list[list[tuple[int, int, int]]] = [[] for _ in a.size]
        self.whole: list[list[int]] = [[] for _ in a.size]
        for state in sorted(range(1, len(a.size)), key=a.size.__getitem__):
            at = {(k, end): m for k, end, m in self.ends[a.link[state]]}
            if a.size[state] >= long:
                at |= {place: a.size[state] for place in a.places[state]}
            self.ends[state] = [(k, end, m) for (k, end), m in at.items()]
            here = {k for k, end in a.places[state] if end == a.size[state] == len(self.sequences[k])}
            self.whole[state] = sorted({*self.whole[a.link[state]], *(k for k in here if k < self.phrases or len(self.sequences[k]) < long)})

    def matches(self, text: list[str]) -> tuple[list[tuple[int, int]], dict[int, list[tuple[int, int, int, int]]]]:
        """(phrase, start) of base places; by sequence, matches (start, end, sequence start, sequence end)."""
        a, known, long = self.automaton, self.ids.get, self.long
        following, link, size = a.next, a.link, a.size
        base: list[tuple[int, int]] = []
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        state = length = before = 0
        for at in [k for k, w in enumerate(text) if w in self.ids]:
            if at != before:
                state = length = 0
            before = at + 1
            word = self.ids[text[at]]
            while state and word not in following[state]:
                state = link[state]
                length = size[state]
            state = following[state][word]  # every known word leaves the first state
            length += 1
            for k in self.whole[state]:
                n = len(self.sequences[k])
                if n <= length:
                    if k < self.phrases:
                        base.append((k, at + 1 - n))
                    if n < long:
                        found.setdefault(k, []).append((at + 1 - n, at + 1, 0, n))
            if length >= long and self.ends[state]:
                ahead = known(text[at + 1], -1) if at + 1 < len(text) else -1
                for k, end, most in self.ends[state]:
                    sequence = self.sequences[k]
                    if end == len(sequence) or sequence[end] != ahead:  # the match ends here
                        n = min(most, length)
                        found.setdefault(k, []).append((at + 1 - n, at + 1, end - n, end))
        return base, found

    def scan(self, text: list[str]) -> tuple[list, list, float]:
        """Base places, spans (label, template, start, end, covered, share), and the largest share."""
        base, found = self.matches(text)
        spans, score = [], 0.0
        for k, matches in found.items():
            n = len(self.sequences[k])
            for start, end, covered in chains(matches):
                share = covered / n
                score = max(score, share)
                if share >= SHARE:
                    spans.append((self.labels[k], k, start, end, covered, share))
        return (
            sorted((start, self.labels[k], start + len(self.sequences[k])) for k, start in base),
            best_spans([s for s in spans if s[1] >= self.phrases]),
            score,
        )


def chains(matches: list[tuple[int, int, int, int]], gap: int = GAP) -> list[tuple[int, int, int]]:
    """(start, end, covered words) of the best chains; every match is in one chain at most."""
    matches = sorted(matches, key=lambda m: (m[1], m[3], m[0]))
    covered, before = [], []
    for k, (start, end, first, last) in enumerate(matches):
        most, link = end - start, -1
        j = k - 1
        while j >= 0 and matches[j][1] >= start - gap:
            s, e, f, l = matches[j]
            if s < start and f < first and l < last and e < end and first - l <= gap:
                more = covered[j] + min(end - max(start, e), last - max(first, l))
                if more > most:
                    most, link = more, j
            j -= 1
        covered.append(most)
        before.append(link)
    used = [False] * len(matches)
    out = []
    for k in sorted(range(len(matches)), key=lambda k: (-covered[k], k)):
        path, j = [], k
        while j >= 0 and not used[j]:
            path.append(j)
            j = before[j]
        if j < 0:  # what runs into a better chain is a branch of it
            for i in path:
                used[i] = True
            out.append((matches[path[-1]][0], matches[k][1], covered[k]))
        elif path:
            used[k] = True
    return out


def best_spans(spans: list[tuple]) -> list[tuple]:
    """Spans in text order, without those that lie for the most part under a better one."""
    kept: list[tuple] = []
    for span in sorted(spans, key=lambda s: (-s[4], s[2], s[0], s[1])):
        _, _, start, end, *_ = span
        if all(min(end, e) - max(start, s) <= OVERLAP * (end - start) for _, _, s, e, *_ in kept):
            kept.append(span)
    return sorted(kept, key=lambda s: (s[2], s[3], s[0], s[1]))


@lru_cache(maxsize=4)
def _scanner(phrases: tuple, templates: tuple, long: int) -> Scanner:
    """One per worker process and set of templates."""
    return Scanner(dict(phrases), {label: list(texts) for label, texts in templates}, long)


def scan(
    docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, long: int = LONG
) -> DataFrame:
    """(doc_id, n_words, base, spans, score) of every text.

    ``base`` has (label, start, end) of the phrases, ``spans`` (label, template, start, end, covered,
    share) of the chains; starts and ends count words from 0.
    """
    source = docs.select(col(docs, "doc_id").alias("doc_id"), col(docs, "text").cast("string").alias("text"))
    held = (tuple(phrases.items()), tuple((k, tuple(v)) for k, v in templates.items()), long)
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    span = pa.list_(
        pa.struct(
            [("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
             ("covered", pa.int64()), ("share", pa.float64())]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*held)
        for b in batches:
            n, base, spans, scores = [], [], [], []
            for t in b.column(1):
                text = words(t.as_py())
                places, chained, score = scanner.scan(text)
                n.append(len(text))
                base.append([{"label": k, "start": s, "end": e} for s, k, e in places])
                spans.append([dict(zip(("label", "template", "start", "end", "covered", "share"), s)) for s in chained])
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(base, place), pa.array(spans, span), pa.array(scores, pa.float64())],
                names=["doc_id", "n_words", "base", "spans", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        run,
        f"doc_id {kind}, n_words long, base array<struct<label:string,start:bigint,end:bigint>>, "
        "spans array<struct<label:string,template:int,start:bigint,end:bigint,covered:bigint,share:double>>, score double",
    )


def report(docs: DataFrame, **parameters) -> DataFrame:
    found = scan(docs, **parameters)
    base, spans = F.col("base.label"), F.col("spans.label")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, spans)), ",").alias("labels"),
        "score",
    )
