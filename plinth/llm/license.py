"""Licence scans: a generalised suffix automaton of licence words.

Each document is streamed through the automaton word by word, which gives the
matching statistics: at every place, the longest run of words ending there that
occurs in some template.  Runs of at least ``MIN_MATCH`` words that can't be
extended are seeds; seeds of one template that follow each other in both the
document and the template are chained into a covered span.  A chain that covers
enough of its template adds the template's label.

The base phrases are templates too: a phrase ends at a place if the state there
has the phrase as a suffix within its matched length.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from plinth.llm import common

#: Fixed values of the result's contract.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Wordings of public licences and notices, with the labels that they add.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Words of a seed; words between two seeds of a chain; share of a template, or words of it, that a chain must cover.
MIN_MATCH, MAX_GAP, MIN_COVER, MIN_WORDS = 4, 12, 0.75, 16


class Automaton:
    """Suffix automaton of several word lists."""

    def __init__(self, texts: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for words in texts:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: For each state, the ends of its words in each template that has them, ascending.
        self.ends: list[dict[int, list[int]]] = [{} for _ in self.link]
        for t, words in enumerate(texts):
            v = 0
            for j, w in enumerate(words):
                v = u = self.next[v][w]
                while u > 0:
                    self.ends[u].setdefault(t, []).append(j)
                    u = self.link[u]

    def _add(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.link) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """The state of ``p``'s longest words followed by ``w``, cut from ``q`` if ``q`` has longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        c = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w)
        made, p = self._add(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = made
            p = self.link[p]
        if p >= 0:
            self.link[made] = self._split(p, self.next[p][w], w)
        return made

    def walk(self, words: list[bytes]) -> int:
        v = 0
        for w in words:
            v = self.next[v][w]
        return v


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, templates: list[tuple[str, str]] = TEMPLATES):
        phrases = [common.words_of(p.encode()) for p in base]
        self.base_labels = list(base.values())
        self.labels = self.base_labels + [label for label, _ in templates]
        texts = phrases + [common.words_of(t.encode()) for _, t in templates]
        self.sizes = [len(t) for t in texts]
        self.n_base = len(phrases)
        self.words = {w for t in texts for w in t}
        self.sam = sam = Automaton(texts)
        own: dict[int, list[tuple[int, int]]] = {}
        for k, p in enumerate(phrases):
            own.setdefault(sam.walk(p), []).append((k, len(p)))
        #: For each state, the phrases (number, words) that end wherever the state is reached.
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in sam.link]
        for v in range(1, len(sam.link)):
            u = v
            while u > 0:
                self.phrases[v] += own.get(u, [])
                u = sam.link[u]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Base places (start, phrase), and covered spans (start, end, template, share covered)."""
        sam, known = self.sam, self.words
        edges, link, length, phrases = sam.next, sam.link, sam.length, self.phrases
        places: list[tuple[int, int]] = []
        seeds: list[tuple[int, int, int]] = []  # state, matched words, end in the document
        v = n = 0
        for i, w in enumerate(words):
            if w not in known:
                if n >= MIN_MATCH:
                    seeds.append((v, n, i))
                v = n = 0
                continue
            before, was = v, n
            while v and w not in edges[v]:
                v = link[v]
                n = length[v]
            v = edges[v].get(w, 0)
            n = n + 1 if v else 0
            if n <= was and was >= MIN_MATCH:
                seeds.append((before, was, i))
            for k, m in phrases[v]:
                if m <= n:
                    places.append((i - m + 1, k))
        if n >= MIN_MATCH:
            seeds.append((v, n, len(words)))
        return places, self.chains(seeds) if seeds else []

    def chains(self, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        open_: dict[int, list[int]] = {}  # template: start, end in the document, end in the template, words covered
        done: list[tuple[int, int, int, float]] = []

        def close(t: int) -> None:
            a, b, _, got = open_.pop(t)
            share = min(1.0, got / self.sizes[t])
            if share >= MIN_COVER or got >= MIN_WORDS:
                done.append((a, b, t, share))

        for v, n, end in seeds:
            a = end - n
            for t, ends in self.sam.ends[v].items():
                if t in open_:
                    # The seed's first place in the template that goes on from where the chain has come to.
                    s = open_[t]
                    for tb in (last + 1 for last in ends):
                        over = max(0, s[2] - tb + n, s[1] - a)
                        if tb > s[2] and over < n and a - s[1] <= MAX_GAP and tb - n - s[2] <= MAX_GAP:
                            s[1], s[2], s[3] = end, tb, s[3] + n - over
                            break
                    else:
                        close(t)
                if t not in open_:
                    open_[t] = [a, end, ends[0] + 1, n]
        for t in list(open_):
            close(t)
        return sorted(done)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row for each row of ``docs``: base places, labels and covered template spans (word ranges).

    Null and empty texts have no words, no labels and score 0.  The score is the
    largest share of a template that is covered; a base phrase is covered whole.
    Repeated rows are each scanned; other columns of ``docs`` are not read.
    """
    schema = T.StructType(
        [common.id_field(docs, id_col)]
        + [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
        + [T.StructField(n, T.StringType()) for n in ("base_labels", "labels")]
        + [T.StructField("score", T.DoubleType()), T.StructField("spans", T.StringType())]
    )

    def run(batch: pa.RecordBatch, s: Scanner) -> dict:
        rows = []
        for text in common.utf8(batch.column("text")):
            words = common.words_of(text)
            places, spans = s.scan(words)
            starts = [a for a, _ in places]
            own = sorted({s.base_labels[k] for _, k in places})
            every = sorted({*own, *(s.labels[t] for _, _, t, _ in spans)})
            score = max([1.0] * bool(places) + [x[3] for x in spans], default=0.0)
            rows.append((
                len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(every), score,
                ",".join(f"{s.labels[t]}:{a}:{b}" for a, b, t, _ in spans),
            ))
        names = [f.name for f in schema.fields[1:]]
        return {"doc_id": batch.column("doc_id"), **{n: [r[i] for r in rows] for i, n in enumerate(names)}}

    return common.map_arrow(common.id_text(docs, id_col, text_col), run, schema, setup=lambda: Scanner(base, templates))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"))
