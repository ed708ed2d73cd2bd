"""License scans: a positional rare-token index over licence templates.

The index holds, for each template word, its (template, position) postings. A file is
looked up only by its highest-IDF licence words, by the corpus' own frequencies: of each
template so many of the rarest that two of them must be in any place that holds enough
of the template's weight. Each hit gives a relative position (file position less
template position); a template's postings are intersected by it: at least two different
rare words must lie within ``slip`` words of the same relative position. There the
template is aligned, words left out or put in allowed up to ``slip``, and it is accepted if
the aligned words hold enough of its IDF weight and all its mandatory key phrases stand
in the place word by word.

A template whose ``coverage`` is 1.0 needs all its words in a row, so one anchor, its
rarest word, finds every place of it: the base phrases are such templates.

Edge cases: null or empty text has no words and no labels; a null doc_id is kept;
repeated rows are each answered; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@dataclass(frozen=True)
class Template:
    """A licence text, or a phrase of one: label, words, key phrases, share of weight needed."""

    label: str
    text: str
    key_phrases: tuple[str, ...] = ()
    coverage: float = 0.8
    base: bool = False


BASE_TEMPLATES = (
    Template("mit", "mit license", coverage=1.0, base=True),
    Template("apache", "apache license", coverage=1.0, base=True),
    Template("gpl", "general public license", coverage=1.0, base=True),
)

#: The method's own templates, public licence wording.
TEMPLATES = (
    *BASE_TEMPLATES,
    Template("agpl", "gnu affero general public license", ("affero general public license",), 1.0),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-2.0-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("you may not use this file except in compliance with the license",)),
    Template("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so", ("prepare derivative works of the software",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd-conditions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions of source code must retain", "redistributions in binary form must reproduce")),
    Template("bsd-endorsement", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ("dedicated the work to the public domain",)),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which accompanies this distribution", ("eclipse public license",)),
    Template("gpl-2.0-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("free software foundation", "version 2 of the license")),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-3.0-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("free software foundation", "version 3 of the license")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",), 1.0),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("free and unencumbered software",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("to alter it and redistribute it freely",)),
)


def words_of(text: str | None) -> list[str]:
    """The words of a text; A-Z are lower-cased, as bytes, so no other letter changes."""
    return WORD.findall(text.encode().lower().decode()) if text else []


def slip_of(length: int) -> int:
    """Words that may be put in or left out of a place of a template of so many words."""
    return max(1, length // 8)


def align(words: list[str], want: list[str], weight: list[float], start: int) -> tuple[float, int, int]:
    """Largest weight of template words in order near the position, and the first and last word of that place.

    Template word k is looked for within ``slip`` words of ``start + k``.
    """
    slip = slip_of(len(want))
    width = 2 * slip + 1
    none = (0.0, -1, -1)
    above = [none] * (width + 1)
    for k, (w, x) in enumerate(zip(want, weight, strict=True)):
        low = start + k - slip
        row = []
        for c in range(width):
            at = low + c
            best = above[c + 1]  # the same file word, template word left out
            if c and row[c - 1][0] > best[0]:
                best = row[c - 1]
            if 0 <= at < len(words) and words[at] == w:
                before = above[c]
                if before[0] + x > best[0]:
                    best = (before[0] + x, at if before[1] < 0 else before[1], at)
            row.append(best)
        above = [*row, none]
    return max(above, key=lambda r: r[0])


class LicenseIndex:
    """Postings of the templates' highest-IDF words, made from corpus-wide IDF."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[str, float]) -> None:
        self.templates = templates
        self.words = [words_of(t.text) for t in templates]
        self.keys = [[words_of(k) for k in t.key_phrases] for t in templates]
        self.weights = [[max(idf[w], 1e-6) for w in ws] for ws in self.words]
        self.totals = [sum(x) for x in self.weights]
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (t, ws, x) in enumerate(zip(templates, self.words, self.weights, strict=True)):
            rare = sorted(range(len(ws)), key=lambda p, x=x: (-x[p], p))
            n = 1
            if t.coverage < 1:
                # what may be missing can't be all anchors but one
                while n < len(rare) and sum(x[p] for p in rare[1:n]) <= (1 - t.coverage) * self.totals[i] + 1e-9:
                    n += 1
            for p in rare[:n]:
                self.postings[ws[p]].append((i, p))
        self.lookup = frozenset(self.postings)

    def scan(self, words: list[str]) -> list[tuple[int, int, int, float]]:
        """(template, first word, word after the last, share of the template's weight) of each accepted place."""
        if self.lookup.isdisjoint(words):
            return []
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at, w in enumerate(words):
            if w in self.lookup:
                for i, p in self.postings[w]:
                    hits[i].append((at - p, p))
        found = []
        for i, places in sorted(hits.items()):
            want, t = self.words[i], self.templates[i]
            if t.coverage >= 1:
                found += [(i, o, o + len(want), 1.0) for o, _ in sorted(places) if o >= 0 and words[o : o + len(want)] == want]
            else:
                found += self._near(words, i, sorted(places))
        return found

    def _near(self, words: list[str], i: int, places: list[tuple[int, int]]) -> list[tuple[int, int, int, float]]:
        want, weight, total, t = self.words[i], self.weights[i], self.totals[i], self.templates[i]
        slip, least = slip_of(len(want)), t.coverage * self.totals[i] - 1e-9
        found, tried, end = [], None, -1
        for k, (offset, anchor) in enumerate(places):
            if offset == tried or offset < end - slip:
                continue
            # the intersection: another anchor near the same relative position
            near = k + 1
            while near < len(places) and places[near][0] <= offset + slip and places[near][1] == anchor:
                near += 1
            if near == len(places) or places[near][0] > offset + slip:
                continue
            tried = offset
            there = set(words[max(0, offset - slip) : offset + len(want) + slip])
            if sum(x for w, x in zip(want, weight, strict=True) if w in there) < least:
                continue
            got, first, last = align(words, want, weight, offset)
            if got >= least and all(self._holds(words, first, last + 1, key) for key in self.keys[i]):
                found.append((i, first, last + 1, min(1.0, got / total)))
                end = last
        return found

    @staticmethod
    def _holds(words: list[str], low: int, high: int, key: list[str]) -> bool:
        return any(words[a : a + len(key)] == key for a in range(low, high - len(key) + 1))


def licence_idf(docs: DataFrame, templates: tuple[Template, ...]) -> dict[str, float]:
    """IDF of each template word over all documents. Only the templates' words reach the driver."""
    vocabulary = frozenset(w for t in templates for w in words_of(t.text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = dict.fromkeys(vocabulary, 0), 0
        for batch in common.slices(batches):
            for text in batch.column(0).to_pylist():
                n += 1
                for w in vocabulary.intersection(words_of(text)):
                    df[w] += 1
        yield pa.RecordBatch.from_pydict({"word": [*df, ""], "df": pa.array([*df.values(), n], pa.int64())})

    with common.few_rows_a_batch(docs.sparkSession):
        rows = docs.select("text").mapInArrow(count, "word string, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()
    df = {r["word"]: r["df"] for r in rows}
    n = df.get("", 0)
    return {w: math.log(1 + (n - (k := df.get(w, 0)) + 0.5) / (k + 0.5)) for w in vocabulary}


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id") -> DataFrame:
    """One row per document: word and place counts, labels, places and a score from 0 to 1.

    ``matches`` lists every accepted place as label, start word, end word and share;
    ``score`` is the largest share among them, 0 without any.
    """
    index = LicenseIndex(templates, licence_idf(docs, templates))
    match = pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("share", pa.float64()), ("base", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            n_words, matches = [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                n_words.append(len(words))
                matches.append([{"label": index.templates[i].label, "start_word": s, "end_word": e, "share": x, "base": index.templates[i].base} for i, s, e, x in index.scan(words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(matches, match)], names=[id_col, "n_words", "matches"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(scan, f"`{id_col}` {kind}, n_words long, matches array<struct<label:string,start_word:long,end_word:long,share:double,base:boolean>>")
