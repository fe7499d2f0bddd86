"""Licence scans with a positional index of rare words.

Licence words are weighed by how few documents hold them. The index holds the positions of every word of every
template. Of each short stretch of a file the rarest licence words are looked up; their occurrences vote for a
template and a shift (position in the file less position in the template), and where enough of the template's weight
agrees, its key phrases must stand nearby and enough of its words in their places.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that name a licence, and paragraphs of published licences with their key phrases.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", ["except in compliance with the license"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["under the terms of the gnu general public license"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["gnu affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", ["this permission notice shall be included in all copies"]),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", ["unless required by applicable law or agreed to in writing"]),
    ("gpl-2.0", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ["gnu general public license", "either version 2 of the license"]),
    ("gpl-3.0", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu general public license", "either version 3 of the license"]),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", ["redistributions in binary form must reproduce"]),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["to endorse or promote products derived from this software"]),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", ["this permission notice appear in all copies"]),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["any person or organization obtaining a copy"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ["without any express or implied warranty in no event will the authors"]),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["eclipse public license 2 0"]),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("cc-by", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ["cc by nd"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
]

BLOCK, STEP = 24, 12  # words of a file among which the rarest are looked up, and from one such stretch to the next
RAREST = 8  # different words that are looked up in each
LEAST_VOTED = 0.2  # share of a template's weight that the looked-up words must vote for
DRIFT = 2  # words that may be added or lost between places that belong together
LEAST_COVERED = 0.6
BASE_SCORE = 0.5
_SEPARATORS = bytes(32 if b < 0x80 and not (48 <= b <= 57 or 97 <= b <= 122) else b for b in range(256))


def license_words(text: str | None) -> list[bytes]:
    """Runs of digits, a-z and non-ASCII characters, A-Z in lower case."""
    return text.encode().lower().translate(_SEPARATORS).split() if text else []


# Every base phrase ends in the word "license".
_BASE = [(tuple(license_words(p)), label) for p, label in BASE.items()]
_PARSED = [(label, license_words(text), [license_words(p) for p in phrases]) for label, text, phrases in TEMPLATES]
_KEY_WORDS = [frozenset(w for p in phrases for w in p) for _, _, phrases in _PARSED]
_VOCABULARY = frozenset(w for _, words, _ in _PARSED for w in words)


def _document_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[bytes] = Counter()
    rows = 0
    for batch in batches:
        for text in batch["text"]:
            counts.update(_VOCABULARY.intersection(license_words(text)))
        rows += len(batch)
    found = [(w.decode(), n) for w, n in counts.items()] + [("", rows)]
    yield pd.DataFrame(found, columns=["word", "n"])


def weights(docs: DataFrame) -> dict[bytes, float]:
    """The inverse document frequency of every template word, over all documents; the driver sees one row a word."""
    counts = docs.select("text").mapInPandas(_document_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r.word.encode(): r.n for r in counts.collect()}
    return {w: math.log((found.get(b"", 0) + 1) / (found.get(w, 0) + 1)) for w in _VOCABULARY}


def positional_index() -> dict[bytes, list[tuple[int, int]]]:
    """word -> (template, position), in this order, of all words of all templates."""
    index: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for nth, (_, words, _) in enumerate(_PARSED):
        for at, word in enumerate(words):
            index[word].append((nth, at))
    return dict(index)


def looked_up(words: list[bytes], idf: dict[bytes, float]) -> set[int]:
    """Where the file's rarest licence words stand: of each stretch of BLOCK words, all places of the RAREST words."""
    places = [i for i, w in enumerate(words) if w in idf]
    chosen: set[int] = set()
    first = last = 0
    for start in range(0, max(len(words) - BLOCK, 0) + STEP, STEP):
        while first < len(places) and places[first] < start:
            first += 1
        while last < len(places) and places[last] < start + BLOCK:
            last += 1
        here = places[first:last]
        different = {words[i] for i in here}
        if len(different) > RAREST:
            different = set(sorted(different, key=lambda w: (-idf[w], w))[:RAREST])
        chosen.update(i for i in here if words[i] in different)
    return chosen


def _stands(words: list[bytes], phrase: list[bytes], start: int, end: int) -> bool:
    n = len(phrase)
    return any(words[i : i + n] == phrase for i in range(max(0, start), min(end, len(words) - n + 1)))


def covered(words: list[bytes], nth: int, shift: int, idf: dict[bytes, float]) -> float:
    """The share of a template's weight that stands at the shift, within DRIFT; 0 without all key phrases."""
    _, template, phrases = _PARSED[nth]
    start, end = shift - DRIFT, shift + len(template) + DRIFT
    if not all(_stands(words, p, start, end) for p in phrases):
        return 0.0
    weight = [idf[w] + 0.1 for w in template]
    hit = sum(x for i, (w, x) in enumerate(zip(template, weight, strict=True)) if w in words[max(0, shift + i - DRIFT) : max(0, shift + i + DRIFT + 1)])
    return hit / sum(weight)


def scan(words: list[bytes], index: dict[bytes, list[tuple[int, int]]], idf: dict[bytes, float]) -> tuple[list[tuple[int, str]], dict[str, float]]:
    """The places of base phrases with their labels, and the labels that templates give with their best shares."""
    base = []
    for last in (i for i, w in enumerate(words) if w == b"license"):
        for phrase, label in _BASE:
            first = last - len(phrase) + 1
            if first >= 0 and tuple(words[first : last + 1]) == phrase:
                base.append((first, label))
    present = _VOCABULARY.intersection(words)
    possible = {nth for nth, keys in enumerate(_KEY_WORDS) if keys <= present}  # all others lack a key phrase
    if not possible:
        return base, {}
    votes: dict[tuple[int, int], float] = defaultdict(float)
    for at in looked_up(words, idf):
        weight = idf[words[at]] + 0.1
        for nth, place in index[words[at]]:
            if nth in possible:
                votes[nth, at - place] += weight
    needed = {nth: LEAST_VOTED * sum(idf[w] + 0.1 for w in _PARSED[nth][1]) for nth in possible}
    labels: dict[str, float] = {}
    for nth, shift in list(votes):
        near = sum(votes.get((nth, shift + d), 0.0) for d in range(-DRIFT, DRIFT + 1))
        if near >= needed[nth] and (share := covered(words, nth, shift, idf)) >= LEAST_COVERED:
            labels[_PARSED[nth][0]] = max(share, labels.get(_PARSED[nth][0], 0.0))
    return base, labels


def _scanned(index: dict[bytes, list[tuple[int, int]]], idf: dict[bytes, float]):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["text"]:
                words = license_words(text)
                base, labels = scan(words, index, idf)
                places, named = [i for i, _ in base], {label for _, label in base}
                score = max(labels.values(), default=0.0)
                found.append((
                    len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(named)),
                    ",".join(sorted(named | set(labels))), max(score, BASE_SCORE if base else 0.0),
                ))
            columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            table = pd.DataFrame(found, columns=columns).astype({"first_word": "Int64", "last_word": "Int64"})
            table.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield table

    return rows


def licensed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs(doc_id, text, ...)``.

    ``n_base`` counts all places where a base phrase's words stand one after the other; ``first_word`` and
    ``last_word`` are the first and last of these (words from 0), null without one. ``labels`` adds those of the
    templates. ``score`` is the best share of a found template's word weights, BASE_SCORE at least with a base
    phrase, 0 without labels. Null texts are empty. Repeated rows are scanned each; further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # pandas has no long beside nulls
    idf = weights(docs)
    schema = "doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    scanned = docs.mapInPandas(_scanned(positional_index(), idf), schema)
    return scanned.withColumn("doc_id", F.col("doc_id").cast("long"))
