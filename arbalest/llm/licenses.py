"""License scans with a positional rare-token index.

The index holds the words of licence templates (notices and full texts) as postings (template, position), with inverse document
frequencies counted over the whole table. In each file the ``RARE`` licence words of highest idf are looked up; every place of
such a word and every posting of it vote for an alignment (template, offset), and alignments are kept on which ``VOTES`` of these
words agree. There the template's words are compared at their relative positions: the share of its idf that is found is the
score, and the label is given if that is at least ``SHARE`` and a mandatory key phrase of the template stands whole. So a
licence is found when words of it were changed, whichever they are, as long as a key phrase is left.

The base phrases are looked up by their own rarest word, at every place of it.

Contract of ``scan``:
* words: A-Z lower-cased, maximal runs of anything but ASCII non-alphanumerics; a null text is empty;
* n_base, first_word, last_word, base_labels: places of the base phrases (word indices from 0; null and '' if none);
  labels: these and those of all verified templates; both distinct, sorted and comma-joined;
* score: largest share of a template's idf at a kept alignment, rounded to 6 digits; 1 where a base phrase or a template stands whole,
  0 without an alignment; ties of idf go to the alphabetically first word;
* one result row for each input row; null ids, repeated rows and extra columns do not matter; an empty table gives an
  empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbalest.llm import kernels as K
from arbalest.llm.common import in_small_batches

RARE, VOTES, SHARE = 8, 2, 0.5

#: The base phrases; and templates as (label, mandatory key phrase, words), first notices, then longer texts.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    ("mit", "the mit license", "licensed under the mit license"),
    ("mit", "granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "apache license version 2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license"),
    ("cc-by-nc", "creative commons attribution noncommercial", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification"),
    ("gpl", "gnu general public license", "licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license", "licensed under the gnu lesser general public license version 3"),
    ("mpl", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    (
        "mit", "permission is hereby granted",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
        "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the software",
    ),
    (
        "apache-2", "apache license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on "
        "an as is basis without warranties or conditions of any kind either express or implied",
    ),
    (
        "bsd", "source and binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of "
        "source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above "
        "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    (
        "gpl", "gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
    ),
    (
        "lgpl", "gnu lesser general public license",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version",
    ),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    (
        "isc", "with or without fee",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies",
    ),
    (
        "unlicense", "into the public domain",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    ),
)

BREAKS = np.ones(256, bool)
BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

Phrase = tuple[str, str]
Template = tuple[str, str, str]


def vocabulary(base: tuple[Phrase, ...], templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for text in (*(b[0] for b in base), *(t[2] for t in templates)) for w in text.split()})


def key_places(template: Template) -> list[int]:
    """Where the key phrase stands in the template."""
    key, words = template[1].split(), template[2].split()
    return [i for i in range(len(words) - len(key) + 1) if words[i : i + len(key)] == key]


def _slices(texts: pa.Array, known: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, words of each text, each word's number in ``known`` or -1): words are told apart by their bytes."""
    names = pa.array([w.encode() for w in known], pa.large_binary())
    for row, end, data, places in K.slices(texts):
        data = K.LOWER[data]
        starts, ends, counts = K.words(data, places, BREAKS)
        found = pc.index_in(K.word_array(data, starts, ends).cast(pa.large_binary()), names)
        yield row, end, counts, pc.fill_null(found, -1).to_numpy().astype(np.int64)


def document_frequencies(docs: DataFrame, words: list[str]) -> tuple[dict[str, int], int]:
    """In how many of all rows each word occurs, and the number of rows; one row a word and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(len(words), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, counts, number in _slices(batch["text"], words):
                places = np.flatnonzero(number >= 0)
                owner = np.searchsorted(np.cumsum(counts), places, "right")
                seen += np.bincount(np.unique(owner * len(words) + number[places]) % max(len(words), 1), minlength=len(words))
        yield pa.record_batch([pa.array([*words, ""]), pa.array([*seen.tolist(), rows])], names=["word", "n"])

    got = {r.word: r.n for r in docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    rows = got.pop("", 0)
    return {w: got.get(w, 0) for w in words}, rows


class Index:
    """Licence words in the order of falling idf, with their postings; base phrases; templates."""

    def __init__(self, base: tuple[Phrase, ...], templates: tuple[Template, ...], frequencies: dict[str, int], rows: int):
        self.words = sorted(frequencies, key=lambda w: (frequencies[w], w))
        number = {w: i for i, w in enumerate(self.words)}
        self.idf = np.array([np.log((rows + 1) / (frequencies[w] + 1)) for w in self.words])
        self.base = [(label, np.array([number[w] for w in text.split()])) for text, label in base]
        self.templates = [(t[0], np.array([number[w] for w in t[2].split()]), key_places(t), len(t[1].split())) for t in templates]
        posted = sorted((int(w), t, q) for t, (_, words, _, _) in enumerate(self.templates) for q, w in enumerate(words))
        self.posted = np.array(posted, np.int64).reshape(-1, 3)
        self.n_posted = np.bincount(self.posted[:, 0], minlength=len(self.words))

    def base_places(self, number: np.ndarray, first: np.ndarray, last: np.ndarray, owner: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        """For each base phrase its label and the places where it stands; first, last: of each word's text."""
        for label, words in self.base:
            q = int(words.argmin())  # the rarest
            at = np.flatnonzero(number == words[q]) - q
            at = at[(at >= first[at + q]) & (at + len(words) <= last[at + q])]
            for i, w in enumerate(words):
                at = at[number[at + i] == w]
            yield label, at

    def alignments(self, number: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, template, offset) on which enough of a text's rarest licence words agree; offsets count over all words."""
        at = np.flatnonzero(number >= 0)
        code = owner[at] * len(self.words) + number[at]
        pair, back = np.unique(code, return_inverse=True)  # sorted by text, then by idf
        text = pair // len(self.words)
        at = at[(np.arange(len(pair)) - np.searchsorted(text, text) < RARE)[back]]
        word, n = number[at], self.n_posted[number[at]]
        lo = np.cumsum(self.n_posted) - self.n_posted
        take = np.repeat(lo[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
        template, offset = self.posted[take, 1], np.repeat(at, n) - self.posted[take, 2]
        reach = max((len(t[1]) for t in self.templates), default=0)  # offsets from -reach, packed with text and template into one number
        places = len(number) + reach
        packed = (np.repeat(owner[at], n) * len(self.templates) + template) * places + offset + reach
        votes = np.unique(packed * len(self.words) + np.repeat(word, n)) // max(len(self.words), 1)  # a word votes once
        found, count = np.unique(votes, return_counts=True)
        found = found[count >= VOTES]
        rest = found // max(places, 1)
        return rest // max(len(self.templates), 1), rest % max(len(self.templates), 1), found % max(places, 1) - reach

    def verified(self, number: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """For each template: label; of its alignments the text, the share of idf, and whether the label is given."""
        text, template, offset = self.alignments(number, np.repeat(np.arange(len(counts)), counts))
        for t, (label, words, keys, length) in enumerate(self.templates):
            mine = template == t
            owner, start = text[mine], offset[mine]
            if not len(owner):
                continue
            first, last = ends[owner] - counts[owner], ends[owner]
            same = np.zeros((len(words), len(owner)), bool)
            for q, w in enumerate(words):
                at = start + q
                same[q] = (at >= first) & (at < last)
                same[q] &= number[np.clip(at, 0, len(number) - 1)] == w
            total = self.idf[words].sum()
            share = np.round(self.idf[words] @ same / total, 6) if total > 0 else np.zeros(len(owner))
            share = np.where(same.all(axis=0), 1.0, share)
            key = np.any([same[k : k + length].all(axis=0) for k in keys], axis=0)
            yield label, owner, share, key & (share >= SHARE)


def _scan(index: Index):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, counts, number in _slices(batch["text"], index.words):
                n = end - row
                n_base, score = np.zeros(n, np.int64), np.zeros(n)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                labels: dict[int, set[str]] = {}
                base_labels: dict[int, set[str]] = {}
                ends = np.cumsum(counts)
                owner = np.repeat(np.arange(n), counts)
                for label, at in index.base_places(number, (ends - counts)[owner], ends[owner], owner) if len(number) else ():
                    text = owner[at]
                    start = at - (ends - counts)[text]
                    n_base += np.bincount(text, minlength=n)
                    np.minimum.at(first, text, start)
                    np.maximum.at(last, text, start)
                    score[text] = 1
                    for i in np.unique(text).tolist():
                        base_labels.setdefault(i, set()).add(label)
                        labels.setdefault(i, set()).add(label)
                for label, text, share, given in index.verified(number, ends, counts):
                    np.maximum.at(score, text, share)
                    for i in np.unique(text[given]).tolist():
                        labels.setdefault(i, set()).add(label)
                names = lambda sets: pa.array([",".join(sorted(sets[i])) if i in sets else "" for i in range(n)])
                none = n_base == 0
                yield pa.record_batch(
                    [batch["doc_id"].slice(row, n), pa.array(counts), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), names(base_labels), names(labels), pa.array(score)],
                    schema=schema,
                )

    return run


def scan(docs: DataFrame, base: tuple[Phrase, ...] = BASE, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    index = Index(base, templates, *document_frequencies(rows, vocabulary(base, templates)))
    return rows.mapInArrow(_scan(index), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
