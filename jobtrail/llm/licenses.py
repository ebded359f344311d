"""License scan with a positional index of rare words.

A file's words are looked up in a small index that holds, for each licence template, its words of highest inverse
document frequency and where they stand in the template. Occurrences vote for the place where the template would
begin; each place at which most of the rare words agree is verified: its mandatory key phrases must stand near it.
Document frequencies are counted over the whole corpus, for the words of the templates only.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import slices, texts_of

# Public licence notices, in the words of the scan, and the phrases that must be found.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license version 2 0",)),
    "apache-2.0-notice": (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("except in compliance with the license",),
    ),
    "mit": ("released under the mit license", ("mit license",)),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "with or without fee"),
    ),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    "gpl-2.0": (
        "under the terms of the gnu general public license as published by the free software foundation either version 2",
        ("gnu general public license", "version 2"),
    ),
    "lgpl": ("licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    "agpl": ("licensed under the gnu affero general public license", ("gnu affero general public license",)),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "epl-2.0": ("made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    "cc-by-4.0": ("licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    "cc-by-sa-4.0": (
        "licensed under a creative commons attribution sharealike 4 0 international license",
        ("creative commons attribution sharealike",),
    ),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    "cc0-1.0": ("to the extent possible under law the author has waived all copyright cc0 1 0 universal", ("cc0 1 0",)),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software",),
    ),
}
# Phrases that give a label wherever they stand.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Rare words per template, the share of them that must agree, and by how many words a place may be off.
RARE = 4
AGREE = 0.75
SLACK = 2
# Share of a template's words that must stand where the template has them, give or take the slack.
COVERED = 0.6

_DELIMITERS = bytes(c for c in range(128) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or 0x41 <= c <= 0x5A))
_WORDS = bytes.maketrans(bytes(range(0x41, 0x5B)) + _DELIMITERS, bytes(range(0x61, 0x7B)) + b" " * len(_DELIMITERS))


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than ASCII non-alphanumerics, A-Z as a-z."""
    return text.encode().translate(_WORDS).split()


@dataclass(frozen=True)
class Index:
    """rare: word -> [(template, offset)]; words and phrases by template."""

    rare: dict[bytes, list[tuple[str, int]]]
    words: dict[str, list[bytes]]
    needed: dict[str, int]


def build_index(frequencies: dict[bytes, int], documents: int, templates=TEMPLATES) -> Index:
    rare, words, needed = defaultdict(list), {}, {}
    for name, (text, _) in templates.items():
        words[name] = text.encode().split()
        idf = lambda w: math.log((documents + 1) / (frequencies.get(w, 0) + 1))
        chosen = sorted(set(words[name]), key=lambda w: (-idf(w), w))[:RARE]
        needed[name] = math.ceil(AGREE * len(chosen))
        for offset, w in enumerate(words[name]):
            if w in chosen:
                rare[w].append((name, offset))
    return Index(dict(rare), words, needed)


def _places(words: list[bytes], phrase: str) -> list[int]:
    """Starts of the phrase's words standing consecutively."""
    want = phrase.encode().split()
    out, at = [], -1
    while True:
        try:
            at = words.index(want[0], at + 1)
        except ValueError:
            return out
        if words[at : at + len(want)] == want:
            out.append(at)


def _coverage(words: list[bytes], start: int, template: list[bytes]) -> float:
    found = 0
    for i, w in enumerate(template):
        low = max(0, start + i - SLACK)
        found += w in words[low : max(0, start + i + SLACK + 1)]
    return found / len(template)


def scan(words: list[bytes], seen: set[bytes], index: Index, templates=TEMPLATES) -> list[tuple[str, int, float]]:
    """(template, first word, coverage) of each template that is found, at the best place that has its key phrases."""
    hits = seen & index.rare.keys()
    if not hits:
        return []
    votes: dict[str, dict[int, set[bytes]]] = defaultdict(lambda: defaultdict(set))
    for at, w in enumerate(words):
        if w in hits:
            for name, offset in index.rare[w]:
                votes[name][at - offset].add(w)
    out = []
    for name, starts in votes.items():
        best = (0.0, 0)
        for start in starts:
            agreeing = set().union(*(starts.get(s, ()) for s in range(start - SLACK, start + SLACK + 1)))
            if len(agreeing) >= index.needed[name]:
                place = (_coverage(words, start, index.words[name]), -start)
                if place[0] >= COVERED and place > best:  # the phrases are looked for at every place that would be best
                    near = words[max(0, start - 2 * SLACK) : max(0, start + len(index.words[name]) + 2 * SLACK)]
                    if all(_places(near, p) for p in templates[name][1]):
                        best = place
        if best[0]:
            out.append((name, max(0, -best[1]), best[0]))
    return out


def base_places(words: list[bytes], seen: set[bytes]) -> list[tuple[int, int, str]]:
    """(first word, last word, label) of each base phrase."""
    return [
        (at, at + phrase.count(" "), label)
        for phrase, label in BASE
        if seen.issuperset(phrase.encode().split())
        for at in _places(words, phrase)
    ]


def word_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word binary, n bigint): documents that hold each template word, and at null the number of documents.

    A task emits one row per template word, so the shuffle is bounded by tasks times the templates' words.
    """
    vocabulary = {w for text, _ in TEMPLATES.values() for w in text.encode().split()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = dict.fromkeys(vocabulary, 0), 0
        for batch in batches:
            for part in slices(batch, "_text"):
                for t in texts_of(part, "_text"):
                    rows += 1
                    for w in vocabulary.intersection(words_of(t)):
                        counts[w] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *counts], pa.binary()), pa.array([rows, *counts.values()], pa.int64())], names=["word", "n"]
        )

    return docs.select(F.col(text).alias("_text")).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


FOUND = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def find_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key and FOUND for each row: base phrases, and labels with those of the templates.

    first_word and last_word are the smallest and the largest start of a base phrase (words from 0, null without one).
    score is the best coverage of a verified template; a text with base phrases only has 0.5, one with neither 0.
    A null text is an empty one; repeated rows give repeated results; an empty table gives none.
    """
    counts = {r.word and bytes(r.word): r.n for r in word_frequencies(docs, text).collect()}  # one row per template word
    index = build_index(counts, counts.get(None, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                rows = []
                for t in texts_of(part, "_text"):
                    words = words_of(t)
                    seen = set(words)
                    base = base_places(words, seen)
                    found = scan(words, seen, index)
                    labels = {label for *_, label in base}
                    starts = [b[0] for b in base]
                    rows.append((
                        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
                        ",".join(sorted(labels | {_label(name) for name, *_ in found})),
                        max([c for *_, c in found], default=0.5 if base else 0.0),
                    ))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                names = [c.split()[0] for c in FOUND.split(", ")]
                columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[key, *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, {FOUND}")


def _label(template: str) -> str:
    """Several templates may stand for one licence."""
    return template.removesuffix("-text").removesuffix("-notice")
