"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every template's words (phrases are short templates). A text's words are streamed through it and
give matching statistics: at each word, the longest run of words ending there that occurs in some template, and along
the suffix links the runs that each template has there. Words that no template has reset the state, so only runs of
known words are walked. A stretch of equal words of text and template, of `least` words or more and no longer on either
side, is a match; a template's matches are chained by dynamic programming, in text order and template order with gaps of
at most `gap` words (overlaps count once), into the span that covers most of it.

Templates label the text best first (share covered, then words covered): one that has `cover` of its words covered does,
unless half or more of the text's words that it covers are a better one's already. So a notice of one licence isn't also
that of another whose notice reads nearly alike. Phrases label the text by occurring at all.

Per row and without a shuffle; the automaton is a constant of the code, whose size doesn't depend on the data.

Defined cases: a null or empty text has no words and no labels, score 0; phrases of one word count at each place; phrases
without words never occur; repeated rows stay repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from planeworks.llm.text import LOWER_BYTES, WORD, dictionary, id_text, map_slices, words_of

#: Fixed values of the contract: phrase -> label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices as their licences print them: label -> text.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software",
    "apache": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "cc0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
}
LEAST, GAP, COVER = 4, 8, 0.5


def tokens_of(text: str) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().translate(LOWER_BYTES))


class Automaton:
    """Suffix automaton of several token lists. A state has the length of its longest string, its suffix link, its
    transitions, and every (template, end) at which its strings occur."""

    def __init__(self, templates: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, words in enumerate(templates):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].add((k, i + 1))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s]:
                self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of the string of length[p] + 1 that p's transition over w leads to."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = self._split(p, w) if p >= 0 else 0
        return new

    def aligned(self, state: int, n: int, least: int) -> dict[tuple[int, int], int]:
        """(template, end) -> length of the run that ends there too, of at least `least` words, where the longest match
        has n words and this state."""
        found: dict[tuple[int, int], int] = {}
        while n >= least and state:
            for place in self.ends[state]:
                found.setdefault(place, n)
            state = self.link[state]
            n = self.length[state]
        return found

    def walk(self, words: list[int]) -> tuple[list[int], list[int]]:
        """Matching statistics: (state, length of the longest match) at the end of each word."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        states, lengths = [], []
        for w in words:
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(w)
            if to is not None:
                state, n = to, n + 1
            states.append(state)
            lengths.append(n)
        return states, lengths


class Scanner:
    """The automaton with what its templates mean. scan() reads one text's words."""

    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, least: int = LEAST, gap: int = GAP, cover: float = COVER) -> None:
        phrases = {p: label for p, label in phrases.items() if tokens_of(p)}
        lists = [tokens_of(x) for x in [*phrases, *templates.values()]]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for x in lists for w in x))}
        self.lists = [[self.ids[w] for w in x] for x in lists]
        self.labels = [*phrases.values(), *templates]
        self.n_phrases, self.least, self.gap, self.cover = len(phrases), least, gap, cover
        a = self.automaton = Automaton(self.lists)
        ends: dict[int, list[int]] = {}  # the state at which a phrase ends
        for k in range(self.n_phrases):
            states, _ = a.walk(self.lists[k])
            ends.setdefault(states[-1], []).append(k)
        self.phrases_at: list[list[int]] = [[] for _ in a.next]
        for s in sorted(range(len(a.next)), key=lambda s: a.length[s]):
            self.phrases_at[s] = (self.phrases_at[a.link[s]] if s else []) + ends.get(s, [])
        self.sizes = [len(x) for x in self.lists]
        self.shortest = min([least, *self.sizes[: self.n_phrases]])

    def scan_run(self, words: list[int], first: int, base: list[tuple[int, int]], matches: list[tuple[int, int, int, int]]) -> None:
        """Adds (start, phrase) to base and (template, first word of the text, of the template, words) of long matches to
        matches; first: the run's place in the text."""
        states, lengths = self.automaton.walk(words)
        now: dict[tuple[int, int], int] = {}
        for i, (s, n) in enumerate(zip(states, lengths, strict=True)):
            for k in self.phrases_at[s]:
                if self.sizes[k] <= n:
                    base.append((first + i + 1 - self.sizes[k], k))
            then = self.automaton.aligned(s, n, self.least) if n >= self.least else {}
            self._ended(now, then, first + i, matches)
            now = then
        self._ended(now, {}, first + len(words), matches)

    def _ended(self, now: dict, then: dict, end: int, matches: list[tuple[int, int, int, int]]) -> None:
        for (k, e), n in now.items():
            if (k, e + 1) not in then and k >= self.n_phrases:
                matches.append((k, end - n, e - n, n))

    def chain(self, matches: list[tuple[int, int, int, int]]) -> dict[int, tuple[int, list[tuple[int, int]]]]:
        """Template -> (its words covered by its best chain, the text's words covered as (start, end))."""
        best: dict[int, tuple[int, list[tuple[int, int]]]] = {}
        by: dict[int, list[tuple[int, int, int]]] = {}
        for k, start, at, n in matches:
            by.setdefault(k, []).append((start, at, n))
        for k, found in by.items():
            found.sort()
            # per match: words covered by the best chain that ends with it, the match before, words that it adds
            chains: list[tuple[int, int, int]] = []
            low = 0
            for j, (start, at, n) in enumerate(found):
                while found[low][0] + self.sizes[k] + self.gap < start:
                    low += 1
                top = (n, -1, n)
                for i in range(low, j):
                    x, y, m = found[i]
                    over = max(0, x + m - start, y + m - at)
                    if over < n and x < start and y < at and start + over - x - m <= self.gap and at + over - y - m <= self.gap and chains[i][0] + n - over > top[0]:
                        top = (chains[i][0] + n - over, i, n - over)
                chains.append(top)
            j = max(range(len(found)), key=lambda j: (chains[j][0], -j))
            total, spans = chains[j][0], []
            while j >= 0:
                end = found[j][0] + found[j][2]
                spans.append((end - chains[j][2], end))
                j = chains[j][1]
            best[k] = (total, spans[::-1])
        return best

    def labels_of(self, chains: dict[int, tuple[int, list[tuple[int, int]]]]) -> set[str]:
        taken: set[int] = set()
        found = set()
        for share, total, k in sorted(((c / self.sizes[k], c, k) for k, (c, _) in chains.items()), key=lambda x: (-x[0], -x[1], x[2])):
            words = {i for a, b in chains[k][1] for i in range(a, b)}
            if share >= self.cover and 2 * len(words & taken) < total:
                found.add(self.labels[k])
                taken |= words
        return found


def _scan_step(make: Callable[[], Scanner]) -> Callable:
    scanner = make()
    ids = scanner.ids

    def step(keys: pa.Array, data: np.ndarray, offsets: np.ndarray) -> dict:
        low = np.frombuffer(data.tobytes().translate(LOWER_BYTES), np.uint8)
        starts, ends, before = words_of(low, offsets, WORD)
        codes, distinct = dictionary(low, starts, ends)
        table = np.array([ids.get(w, -1) for w in distinct.to_pylist()], np.int64)
        word = table[codes] if len(codes) else codes
        rows = len(offsets) - 1
        known = word >= 0
        begin = known.copy()
        begin[1:] &= ~known[:-1]
        cut = before[:-1][before[:-1] < len(word)]
        begin[cut] = known[cut]
        stop = known.copy()
        stop[:-1] &= begin[1:] | ~known[1:]
        run_first, run_end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        long = run_end - run_first >= scanner.shortest
        run_first, run_end = run_first[long], run_end[long]
        row_of = np.searchsorted(before, run_first, side="right") - 1
        n_base, first_word, last_word = [0] * rows, [None] * rows, [None] * rows
        base_labels, labels, score, spans = [""] * rows, [""] * rows, [0.0] * rows, [None] * rows
        at = 0
        row_list, first_list, end_list = row_of.tolist(), run_first.tolist(), run_end.tolist()
        words = word.tolist()
        while at < len(row_list):
            r = row_list[at]
            base: list[tuple[int, int]] = []
            matches: list[tuple[int, int, int, int]] = []
            while at < len(row_list) and row_list[at] == r:
                a = first_list[at]
                scanner.scan_run(words[a : end_list[at]], a - int(before[r]), base, matches)
                at += 1
            chains = scanner.chain(matches) if matches else {}
            own = {scanner.labels[k] for _, k in base}
            if base:
                n_base[r] = len(base)
                first_word[r], last_word[r] = min(base)[0], max(base)[0]
                base_labels[r] = ",".join(sorted(own))
            labels[r] = ",".join(sorted(own | scanner.labels_of(chains)))
            score[r] = 1.0 if base else round(max((c / scanner.sizes[k] for k, (c, _) in chains.items()), default=0.0), 6)
            spans[r] = sorted((scanner.labels[k], a, b - a) for k, (_, own_) in chains.items() for a, b in own_)
        return {
            "doc_id": keys, "n_words": pa.array(np.diff(before)), "n_base": pa.array(n_base, pa.int64()), "first_word": pa.array(first_word, pa.int64()), "last_word": pa.array(last_word, pa.int64()),
            "base_labels": pa.array(base_labels, pa.string()), "labels": pa.array(labels, pa.string()), "score": pa.array(score, pa.float64()),
            "matches": pa.array([[{"label": k, "first_word": a, "words": n} for k, a, n in x] if x else [] for x in spans], pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())]))),
        }

    return step


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, least: int = LEAST, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (of every template's best chain)."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, first_word: long, words: long>>"
    return map_slices(id_text(docs, id_col, text_col), lambda: _scan_step(lambda: Scanner(phrases, templates, least, gap, cover)), schema)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("matches")
