"""License scans: phrases, and an exact containment join of text blocks with license templates.

A block is a line. It meets a template when at least `percent` per cent of the template's distinct words stand in it.
Words of the templates are ordered by their document frequency in the whole corpus (first pass; only the templates'
words are counted, so that what the driver gathers is bounded by the templates). A template's prefix holds its rarest
words, one more than it may lack; a block without any word of a prefix is never looked at again. The others go through
a length filter and a positional filter before the exact comparison. Nothing is shuffled but the counts.

`scan_windows` does the same with blocks over line breaks: windows of words, sized from each template, so that notices
wrapped over several lines are met, and scattered words of a long line are not. Short templates must be met in full, since
a single word often tells their licenses apart.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import text_or_empty

#: Phrases and their labels (fixed values of the contract).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: License notices by label (fixed values: wordings of public licenses, cut to a line).
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "released under the bsd license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "released under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license version 2 0"),
    ("proprietary", "copyright all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
PERCENT = 80

#: Maps bytes that are no part of a word to a space, but for line ends, and A-Z to a-z.
_WORDS = bytes(ord(c.lower()) if (c := chr(b)).isascii() and c.isalnum() else b if b >= 0x80 or b == 0x0A else 0x20 for b in range(256))


def blocks_of(text: bytes) -> list[list[bytes]]:
    """The words of each line."""
    return [line.split() for line in text.translate(_WORDS).split(b"\n")]


def places_of(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand consecutively."""
    found, at = [], 0
    while True:
        try:
            at = words.index(phrase[0], at)
        except ValueError:
            return found
        if words[at : at + len(phrase)] == phrase:
            found.append(at)
        at += 1


class Index:
    """Templates under one global word order, with their prefixes."""

    def __init__(self, templates, frequency: dict[bytes, int], percent: int, whole: int = 0):
        self.sets = [frozenset(t.encode().split()) for _, t in templates]
        self.labels = [label for label, _ in templates]
        vocabulary = sorted({w for s in self.sets for w in s}, key=lambda w: (frequency.get(w, 0), w))
        self.order = {w: i for i, w in enumerate(vocabulary)}
        #: Templates of at most `whole` distinct words must be met in full.
        self.least = [len(s) if len(s) <= whole else -(-percent * len(s) // 100) for s in self.sets]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for t, s in enumerate(self.sets):
            ordered = sorted(s, key=self.order.__getitem__)
            for i, w in enumerate(ordered[: len(s) - self.least[t] + 1]):
                self.prefix.setdefault(w, []).append((t, i))

    def matches(self, block: list[bytes]) -> list[tuple[int, float]]:
        """Templates that the block meets, with the share of their words that it holds."""
        known = sorted((w for w in set(block) if w in self.order), key=self.order.__getitem__)
        seen, out = set(), []
        for j, w in enumerate(known):
            for t, i in self.prefix.get(w, ()):
                if t in seen:
                    continue
                seen.add(t)  # the first shared word: what stands before it in either order is not shared
                least = self.least[t]
                if len(known) < least or min(len(self.sets[t]) - i, len(known) - j) < least:
                    continue
                common = len(self.sets[t].intersection(known))
                if common >= least:
                    out.append((t, common / len(self.sets[t])))
        return out

    def windows(self, words: list[bytes], sizes: list[int]) -> list[tuple[int, int, int, float]]:
        """(template, start, end, largest share) of the places where windows of sizes[template] words, each begun by a word
        of the template, meet it; windows that overlap or touch are one place. A window that meets a template holds a word
        of its prefix, so that only what is near those is looked at."""
        near: dict[int, list[int]] = {}
        for at, w in enumerate(words):
            for t, _ in self.prefix.get(w, ()):
                near.setdefault(t, []).append(at)
        out = []
        for t, hits in near.items():
            of, size, least = self.sets[t], sizes[t], self.least[t]
            starts, last = [], -1
            for hit in hits:
                for at in range(max(last + 1, hit - size + 1), hit + 1):
                    if words[at] in of:
                        starts.append(at)
                last = hit
            for start in starts:
                window = words[start : start + size]
                if bisect_left(hits, start) == bisect_left(hits, start + size):
                    continue
                common = len(of.intersection(window))
                if common < least:
                    continue
                if out and out[-1][0] == t and start <= out[-1][2]:
                    _, first, _, share = out.pop()
                    out.append((t, first, start + len(window), max(share, common / len(of))))
                else:
                    out.append((t, start, start + len(window), common / len(of)))
        return out


def word_frequency(docs: DataFrame, words: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many documents each of the words stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            for t in batch.column(0):
                for w in words.intersection(t.as_buffer().to_pybytes().translate(_WORDS).split()):
                    total[w] = total.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["w", "n"])

    texts = docs.select(text_or_empty(text_col).cast("binary").alias("t"))
    rows = texts.mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()  # words of the templates
    return {r["w"].encode(): r["n"] for r in rows}


SCHEMA = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long"


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base (places of phrases), first_word and last_word of them, base_labels, labels, score, n_blocks.

    labels adds those of the templates that a line meets, n_blocks counts such lines. score is 1 where a phrase stands,
    else the largest share of a met template, else 0. Null and empty texts have no words, labels "" and score 0.
    Repeated rows are scanned each. An empty table gives an empty result; other columns are ignored.
    """
    vocabulary = frozenset(w for _, t in templates for w in t.encode().split())
    index = Index(templates, word_frequency(docs, vocabulary, text_col), percent)
    wanted = [(p.encode().split(), label) for p, label in phrases.items()]
    # A document without any of these words holds neither a phrase nor a block that meets a template.
    telling = frozenset([*(p[0] for p, _ in wanted), *index.prefix])

    def scan(text: bytes) -> tuple:
        words = text.translate(_WORDS).split()
        if telling.isdisjoint(words):
            return len(words), 0, None, None, "", "", 0.0, 0
        places = [(at, label) for p, label in wanted for at in places_of(words, p)]
        base = {label for _, label in places}
        met, blocks, score = set(), 0, 1.0 if places else 0.0
        for block in blocks_of(text):
            found = index.matches(block)
            blocks += bool(found)
            met.update(index.labels[t] for t, _ in found)
            score = max([score, *(share for _, share in found)])
        starts = [at for at, _ in places]
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | met)), score, blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = [scan(t.as_buffer().to_pybytes()) for t in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)


#: A window holds this per cent of a template's words in number; templates up to so many distinct words are met in full.
STRETCH, WHOLE = 120, 10
WINDOWS = "id long, n_words long, labels string, n_places long, score double, places array<struct<label:string,start:long,end:long,share:double>>"


def scan_windows(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT, stretch: int = STRETCH, whole: int = WHOLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, labels (distinct, sorted, comma-joined), n_places, score (largest share, 0 without a place) and
    the places where a template is met: label, first word, word after the last, share.

    Words run on over line breaks. Null and empty texts have no words and no places; repeated rows are scanned each; an
    empty table gives an empty result; other columns are ignored. Texts are read whole; the work is linear in a text but
    for the windows around words of a prefix.
    """
    vocabulary = frozenset(w for _, t in templates for w in t.encode().split())
    index = Index(templates, word_frequency(docs, vocabulary, text_col), percent, whole)
    sizes = [-(-stretch * len(t.split()) // 100) for _, t in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "labels", "n_places", "score", "places"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))]
        for batch in batches:
            rows = []
            for t in batch.column(1):
                words = t.as_buffer().to_pybytes().translate(_WORDS).split()
                found = [] if index.prefix.keys().isdisjoint(words) else sorted(index.windows(words, sizes), key=lambda x: (x[1], x[2], x[0]))
                places = [{"label": index.labels[t], "start": a, "end": b, "share": share} for t, a, b, share in found]
                rows.append((len(words), ",".join(sorted({p["label"] for p in places})), len(places), max((p["share"] for p in places), default=0.0), places))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, WINDOWS).withColumnRenamed("id", id_col)
