"""License scans with a positional index of all notice words, entered by each file's rarest ones."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegate.llm.common import as_bytes, lower_words, map_batches

# Label, notice, and the phrases that must be in it. The first three are exact phrases.
PHRASES = (
    ("cc-by", "cc by", ("cc by",)),
    ("gpl", "general public license", ("general public license",)),
    ("reserved", "all rights reserved", ("all rights reserved",)),
)
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
     "and associated documentation files the software to deal in the software without restriction",
     ("permission is hereby granted free of charge", "without restriction")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met",
     ("redistribution and use in source and binary forms", "conditions are met")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license", "3")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license", "2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl-3.0", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution 4 0",)),
    ("cc0-1.0", "released under cc0 1 0 universal", ("cc0 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software", "public domain")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without "
     "fee is hereby granted", ("permission to use copy modify", "is hereby granted")),
)
ADDED = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
         "score double, matches array<struct<label:string,start:long,words:long,score:double>>")


class Template:
    def __init__(self, label: str, notice: str, required: tuple[str, ...], exact: bool):
        self.label, self.exact = label, exact
        self.words = notice.encode().split()
        self.required = [p.encode().split() for p in required]
        self.needed = frozenset(w for p in self.required for w in p)
        self.slack = 0 if exact else 1 + len(self.words) // 8


TEMPLATES = [Template(*p, True) for p in PHRASES] + [Template(*n, False) for n in NOTICES]
VOCABULARY = sorted({w for t in TEMPLATES for w in t.words})
#: Licence words of a file that enter a notice's postings, besides one of each required phrase.
RARE = 3


def document_frequency(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """Documents with each licence word, over all documents, and the number of documents.

    Each task counts into one row per licence word, a list of fixed length.
    """

    def count(batches):
        found, total, vocabulary = Counter(), 0, frozenset(VOCABULARY)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(vocabulary.intersection(lower_words(text)))
            total += batch.num_rows
        rows = [*found.items(), (b"", total)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())],
            names=["word", "n"])

    counted = docs.select(as_bytes()).mapInArrow(count, "word binary, n long")
    sums = {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return sums, sums.pop(b"", 0)


def postings() -> dict[bytes, dict[int, list[int]]]:
    """Word to its positions in each template: all words of all templates."""
    index: dict[bytes, dict[int, list[int]]] = {}
    for t, template in enumerate(TEMPLATES):
        for at, word in enumerate(template.words):
            index.setdefault(word, {}).setdefault(t, []).append(at)
    return index


def inverse_frequency(frequency: dict[bytes, int], documents: int) -> dict[bytes, float]:
    return {w: math.log((1 + documents) / (1 + frequency.get(w, 0))) for w in VOCABULARY}


def entry_words(template: Template, places: dict[bytes, list[int]], idf: dict[bytes, float]) -> list[bytes]:
    """The file's own words that enter a template's postings: its rarest ones, and one of each required phrase.

    A phrase that must be there has all its words in the file, so a notice whose other words are altered
    is still entered. Of an exact phrase the rarest word is enough, because every place has it.
    """
    rank = lambda w: (-idf[w], w)
    if template.exact:
        return [min(template.words, key=rank)]
    own = sorted({w for w in template.words if w in places}, key=rank)[:RARE]
    return list(dict.fromkeys([*own, *(min(p, key=rank) for p in template.required)]))


def has_phrase(words: list[bytes], phrase: list[bytes], start: int, end: int) -> bool:
    n = len(phrase)
    return any(words[i:i + n] == phrase for i in range(max(0, start), min(end, len(words) - n) + 1))


def find_notices(words: list[bytes], index, idf) -> list[tuple[int, int, float]]:
    """(template, first word, score) of every notice in a text.

    Templates of which the text lacks a required word are out. Of the others the text's rarest licence words are
    looked up; each posting proposes a place for the whole notice, and words that agree on a place are
    one proposal. It stands if the required phrases are near their places and enough words of the
    notice are where they should be.
    """
    places: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        if w in index:
            places.setdefault(w, []).append(i)
    proposed: dict[tuple[int, int], None] = {}
    for t, template in enumerate(TEMPLATES):
        if template.needed <= places.keys():
            for w in entry_words(template, places, idf):
                proposed |= dict.fromkeys((t, i - at) for at in index[w][t] for i in places[w])
    found: dict[int, list[tuple[int, float]]] = {}
    for t, start in proposed:
        template = TEMPLATES[t]
        size, slack = len(template.words), template.slack
        if template.exact:
            if start >= 0 and words[start:start + size] == template.words:
                found.setdefault(t, []).append((start, 1.0))
            continue
        if not all(has_phrase(words, p, start - slack, start + size + slack - len(p)) for p in template.required):
            continue
        there = sum(
            w in words[max(0, start + i - slack):max(0, start + i + slack + 1)]
            for i, w in enumerate(template.words))
        if 4 * there >= 3 * size:
            found.setdefault(t, []).append((max(0, start), there / size))
    kept = []
    for t, starts in found.items():
        last = None
        for start, score in sorted(starts, key=lambda s: (s[0], -s[1])):
            if TEMPLATES[t].exact or last is None or start - last > TEMPLATES[t].slack:
                kept.append((t, start, score))
                last = start
    return sorted(kept, key=lambda k: (k[1], k[0]))


def scan_licenses(docs: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and matches.

    All places of the base phrases are counted, wherever they stand; labels has the labels of the
    notices too. The score is the best share of a notice's words found in place, 1 for a phrase and
    0 without a match. Null and empty texts have no words, null places, empty labels and score 0.
    The word frequencies that rank a file's licence words are counted over all documents first; they decide
    where the search starts, not what it finds of the base phrases. Columns of the added names are
    replaced. Repeated rows are scanned each; an empty table stays empty.
    """
    index, idf = postings(), inverse_frequency(*document_frequency(docs))

    def start():
        def work(texts):
            columns = [[] for _ in range(8)]
            for text in texts.to_pylist():
                words = lower_words(text)
                found = find_notices(words, index, idf)
                base = [(t, at) for t, at, _ in found if TEMPLATES[t].exact]
                row = (
                    len(words), len(base), min((at for _, at in base), default=None),
                    max((at for _, at in base), default=None),
                    ",".join(sorted({TEMPLATES[t].label for t, _ in base})),
                    ",".join(sorted({TEMPLATES[t].label for t, _, _ in found})),
                    max((s for *_, s in found), default=0.0),
                    [{"label": TEMPLATES[t].label, "start": at, "words": len(TEMPLATES[t].words), "score": s}
                     for t, at, s in found])
                for column, value in zip(columns, row):
                    column.append(value)
            return columns

        return work

    return map_batches(docs, [as_bytes()], ADDED, start, drop)
