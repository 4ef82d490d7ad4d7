"""License scan with a generalised suffix automaton of license words (operator 4).

Phrases and notice templates form one automaton over words. A text streams through it and yields
matching statistics: at each word the longest stretch ending there that stands in some template.
A phrase is found where it is a suffix of that stretch. Long maximal stretches are chained, per
template, by weight: a chain follows the order of template and text, leaves gaps of at most the
template's length, and covers as many words as it can (ties: the earlier stretch before). A chain that
covers enough of its template adds a label.

Words are lower-cased (A-Z). Null and empty texts have no words, no labels and score 0. Repeated rows
are judged alike, every place of a repeated phrase counts, and texts of any length are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from swathe.llm.common import ASCII_LOWER, mapped, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Phrase, label.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"),
           ("mit license", "mit")]
# Sentences of widely used notices, label.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with "
     "the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee "
     "is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution", "cc-by"),
]
LONG = 4          # words from which a stretch counts
COVERED = 0.6     # share of a template that a span must cover


class LicenseAutomaton:
    """States hold the words that may follow, a link to the next shorter suffix, and a place."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases = [(p.split(), label) for p, label in phrases]
        self.templates = [(t.split(), label) for t, label in templates]
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        ends = []
        for t, (words, _) in enumerate(self.templates + self.phrases):
            last = 0
            for i, word in enumerate(words):
                last = self._extend(last, word)
                ends.append((last, t, i + 1))
        # A state stands for all places where its words end: its own and those of longer suffixes.
        for state, t, i in ends:
            while state > 0:
                if (t, i) in self.ends[state]:
                    break
                self.ends[state].append((t, i))
                state = self.link[state]
        first = len(self.templates)
        whole = {}
        for p, (words, _) in enumerate(self.phrases):
            state = 0
            for word in words:
                state = self.next[state][word]
            whole.setdefault(state, []).append((len(words), first + p))
        self.found = []
        for state in range(len(self.next)):
            hits, s = [], state
            while s > 0:
                hits += whole.get(s, [])
                s = self.link[s]
            self.found.append(hits)
        self.vocabulary = set(self.next[0])

    def _state(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _extend(self, last: int, word: str) -> int:
        if word in self.next[last]:
            known = self.next[last][word]
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, word)
        new, state = self._state(self.length[last] + 1, {}, 0), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            known = self.next[state][word]
            self.link[new] = (known if self.length[known] == self.length[state] + 1
                              else self._split(state, known, word))
        return new

    def _split(self, state: int, known: int, word: str) -> int:
        copy = self._state(self.length[state] + 1, dict(self.next[known]), self.link[known])
        self.link[known] = copy
        while state >= 0 and self.next[state].get(word) == known:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """(phrase, start) places, and maximal long stretches (template, its start, start, words)."""
        places, stretches = [], []
        state = size = 0
        previous = -2
        first = len(self.templates)

        def close(past: int) -> None:
            if size >= LONG:
                stretches.extend((t, i - size, past - size, size) for t, i in self.ends[state] if t < first)
        for at, word in enumerate(words):
            if word not in self.vocabulary:
                continue
            if at != previous + 1:
                close(previous + 1)
                state = size = 0
            previous = at
            if word not in self.next[state]:
                close(at)
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            state = self.next[state].get(word, 0)
            size = size + 1 if state else 0
            for length, phrase in self.found[state]:
                if length <= size:
                    places.append((phrase - first, at - length + 1))
        close(previous + 1)
        return places, stretches

    def chain(self, stretches) -> list[tuple[int, int, int, float]]:
        """(template, first word, past, share covered): best chains in template and text order."""
        spans = []
        for t in sorted({s[0] for s in stretches}):
            own = sorted({s[1:] for s in stretches if s[0] == t}, key=lambda s: (s[1], s[0]))
            size = len(self.templates[t][0])
            weight, before, oldest = [], [], 0
            for j, (i, x, n) in enumerate(own):
                # Stretches are at most as long as the template, so none before ``oldest`` is near enough.
                while own[oldest][1] < x - 2 * size:
                    oldest += 1
                fits = [(weight[k], -k) for k in range(oldest, j)
                        if own[k][0] + own[k][2] <= i and 0 <= x - own[k][1] - own[k][2] <= size]
                most, k = max(fits, default=(0, 1))
                weight.append(most + n)
                before.append(-k)
            used = [False] * len(own)
            # Heaviest chains first; a chain ends where it meets one that was taken.
            for last in sorted(range(len(own)), key=lambda j: (-weight[j], j)):
                j, covered, first = last, 0, None
                while j >= 0 and not used[j]:
                    used[j] = True
                    covered, first, j = covered + own[j][2], own[j][1], before[j]
                if first is not None:
                    spans.append((t, first, own[last][1] + own[last][2], covered / size))
        return sorted(spans)

    def labels(self, text: str) -> tuple:
        words = WORD.findall(text.translate(ASCII_LOWER))
        places, stretches = self.scan(words)
        spans = self.chain(stretches)
        base = sorted({self.phrases[p][1] for p, _ in places})
        more = {self.templates[t][1] for t, _, _, share in spans if share >= COVERED}
        starts = [s for _, s in places]
        score = 1.0 if places else min(1.0, max((s[3] for s in spans), default=0.0))
        return (len(words), len(places), min(starts, default=None), max(starts, default=None),
                ",".join(base), ",".join(sorted(more.union(base))), score,
                [{"label": self.templates[t][1], "first": a, "past": b, "share": c} for t, a, b, c in spans])


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per text with words, places, labels, score and covered template ``spans``."""
    def start():
        automaton = LicenseAutomaton(phrases, templates)
        return lambda values: list(zip(*map(automaton.labels, values), strict=True))
    return mapped(
        texts(docs), ["doc_id"], start,
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label:string,first:long,past:long,share:double>>")
