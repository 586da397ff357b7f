"""License scan by matching statistics over a generalised suffix automaton.

The words of all templates go into one suffix automaton.  A text is streamed through it word by word,
which gives at each word the length of the longest run ending there that stands in some template,
and the template places where such runs end.  Long maximal matches are chained, in the order of the
text and of the template, into spans; a template that its spans cover well enough gives its label.
Words in no template reset the automaton, so only runs of known words are streamed.

Beside the templates there are base phrases: every place where their words stand consecutively counts.

Defined cases: a null or empty text has no words, no label and a score of 0; overlapping places of a
phrase all count; every place that covers a template well enough is a span; spans of one template are
apart, of overlapping ones that of greater coverage stays, or the earlier one; repeated rows each get a row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_of

#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public licence notices, by label.  A label may have several.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
     associated documentation files (the "Software"), to deal in the Software without restriction, including without
     limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
     Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"""),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """Unless required by applicable law or agreed to in writing, software distributed under the License is
     distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
     that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
     list of conditions and the following disclaimer"""),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
     General Public License as published by the Free Software Foundation; either version 2 of the License"""),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
     General Public License as published by the Free Software Foundation, either version 3 of the License"""),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication"),
)

#: All bytes that end a word become a space; A-Z are in lower case already.
_GAPS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().lower().translate(_GAPS).split()


@dataclass(frozen=True)
class LicenseRules:
    """min_match: words of a match that counts.  min_cover: the share of a template's words that its
    spans cover.  max_gap: words of text between matches of one span."""

    templates: tuple[tuple[str, str], ...] = TEMPLATES
    phrases: tuple[tuple[str, str], ...] = tuple(PHRASES.items())
    min_match: int = 3
    min_cover: float = 0.8
    max_gap: int = 8


class Automaton:
    """A suffix automaton of several sequences: after each sequence the next one starts at the root."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (sequence, end) of the state's runs
        for k, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.ends[last].add((k, at + 1))
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        """The state of the run of p and the symbol, parted from the longer runs of q."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, self.next[last][symbol], symbol)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][symbol], symbol)
        return new

    def maximal_matches(self, run: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) where the longest match that ends there can't be carried on."""
        state = length = 0
        for at, symbol in enumerate(run):
            if symbol not in self.next[state] and length >= least:
                yield at, length, state
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
        if length >= least:
            yield len(run), length, state


class Scanner:
    def __init__(self, rules: LicenseRules):
        self.rules = rules
        sequences = [words(t) for _, t in rules.templates]
        phrases = [p.encode().split() for p, _ in rules.phrases]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for s in [*sequences, *phrases] for w in s}))}
        self.sequences = [[self.vocabulary[w] for w in s] for s in sequences]
        self.phrases = [[self.vocabulary[w] for w in p] for p in phrases]
        self.automaton = Automaton(self.sequences)

    def spans(self, matches: list[tuple[int, int, int, int]], template: int) -> tuple[float, list[tuple[int, int, float]]]:
        """Of a template's matches (start, end, start there, end there): the best chain's coverage, and all spans (start,
        end, coverage) of chains that cover enough, apart from one another, the best ones first chosen."""
        size = len(self.sequences[template])
        chains: list[tuple[int, int, int, int, int]] = []  # covered, start, end, end in the template, start of the last match
        for s, e, ts, te in sorted(matches):
            covered, start = e - s, s
            for c, cs, ce, cte, cb in reversed(chains):
                if cb < s - size - self.rules.max_gap:  # no earlier match can reach this one
                    break
                cut = max(0, ce - s, cte - ts)  # matches may overlap by a word or two
                if cut < e - s and s - ce <= self.rules.max_gap and te > cte and c + e - s - cut > covered:
                    covered, start = c + e - s - cut, cs
            chains.append((covered, start, e, te, s))
        found: list[tuple[int, int, float]] = []
        for covered, start, end, _, _ in sorted(chains, key=lambda c: (-c[0], c[1], c[2])):
            if covered / size < self.rules.min_cover:
                break
            k = bisect(found, (start, end, 0.0))
            if (not k or found[k - 1][1] <= start) and (k == len(found) or found[k][0] >= end):
                found.insert(k, (start, end, covered / size))
        return max(c[0] for c in chains) / size, found


    def scan(self, text: str) -> dict:
        rules, tokens = self.rules, words(text)
        n = len(tokens)
        ids = np.fromiter(map(self.vocabulary.get, tokens, [-1] * n), np.int32, n)
        first = last = None
        places, labels, base = 0, set(), set()
        for (_, label), phrase in zip(rules.phrases, self.phrases):
            if n >= len(phrase):
                hit = ids[: n - len(phrase) + 1] == phrase[0]
                for k, word in enumerate(phrase[1:], 1):
                    hit &= ids[k : n - len(phrase) + 1 + k] == word
                at = np.flatnonzero(hit)
                if len(at):
                    places += len(at)
                    base.add(label)
                    first = int(at[0]) if first is None else min(first, int(at[0]))
                    last = int(at[-1]) if last is None else max(last, int(at[-1]))
        found: dict[int, list] = {}
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0]))))
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - begin >= rules.min_match:
                for at, length, state in self.automaton.maximal_matches(ids[begin:end].tolist(), rules.min_match):
                    for template, te in self.automaton.ends[state]:
                        found.setdefault(template, []).append((begin + at - length, begin + at, te - length, te))
        score, spans = 1.0 if base else 0.0, []
        for template in sorted(found):
            cover, covered = self.spans(found[template], template)
            score = max(score, cover)
            for start, end, share in covered:
                labels.add(rules.templates[template][0])
                spans.append({"label": rules.templates[template][0], "start": start, "end": end, "cover": share})
        return {
            "n_words": n, "n_base": places, "first_word": first, "last_word": last, "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | labels)), "score": min(score, 1.0), "spans": spans,
        }


_SCANNERS: dict[LicenseRules, Scanner] = {}
FIELDS = pa.schema([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))),
])


def scan(docs: DataFrame, rules: LicenseRules = LicenseRules(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: counts and places of base phrases, labels, score, and the template spans (in words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _SCANNERS.get(rules) or _SCANNERS.setdefault(rules, Scanner(rules))
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[f.name] for r in rows], f.type) for f in FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *FIELDS.names])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label:string,start:bigint,end:bigint,cover:double>>"
    )
    return docs.select(docs[doc_id].alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, schema)
