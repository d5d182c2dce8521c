"""Licence texts by an exact set-similarity join of text blocks with templates, and phrases by consecutive words.

A block is any run of SPREAD times as many words as the template has, wherever lines end: a notice may be wrapped and hold words
of its own (a comment's marks, names), but words scattered over a longer text are none. Templates are one-line notices, the permission
sentences and the whole notices that files carry. A template matches a block when at least THRESHOLD of the template's distinct words are in the block. Words are
ordered by their frequency over all documents (one counting pass, in which only words of templates are gathered); a template is
indexed under its rarest words only (prefix filter: one of them must be in any block that reaches the threshold), a text with too few
distinct words is passed over (length filter), and the words left on both sides after a hit bound the overlap (positional
filter). These filters are applied to a document's words as a whole, as what no document holds no block of it does; for the
templates that pass, all blocks are counted in full, by the places of the template's words, so that the join is exact. Documents are
never compared with each other: the templates are a fixed list, which goes to each task; both passes are map-only but for one row
per template word and task.

Null or empty text: n_words 0, no places, labels ''. Null ids stay null, repeated rows give repeated rows, other columns are
ignored. Ties in frequency: by word.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_row, table

#: Phrases of consecutive words and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices as their licences word them.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("mit", "Released under the MIT License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution License"),
]
THRESHOLD = 0.9
#: Words of a block for each word of a template.
SPREAD = 2
#: Bytes: A-Z to lower case, what isn't in a word to a space.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD).split()


def places(line: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """Starts, in words, of all places of phrases, with labels."""
    found = []
    for phrase, label in phrases:
        at = -1
        while True:
            try:
                at = line.index(phrase[0], at + 1)
            except ValueError:
                break
            if line[at : at + len(phrase)] == phrase:
                found.append((at, label))
    return found


class Index:
    """The templates' prefix index under an order of words (rank: the rarest has the smallest)."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float):
        split = [(label, w) for label, t in templates if (w := words(t))]
        self.sets = [(label, frozenset(w)) for label, w in split]
        self.size = [SPREAD * len(w) for _, w in split]
        self.rank = {w: i for i, w in enumerate(sorted(set().union(*(s for _, s in self.sets)), key=lambda w: (counts.get(w, 0), w)))}
        self.need = [math.ceil(threshold * len(s) - 1e-9) for _, s in self.sets]
        self.prefix: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, s) in enumerate(self.sets):
            for k, w in enumerate(sorted(s, key=self.rank.__getitem__)[: len(s) - self.need[i] + 1]):
                self.prefix[w].append((i, k))
        self.keys = frozenset(self.prefix)

    def candidates(self, distinct: set[bytes]) -> list[int]:
        """The templates that reach the threshold in all words of a text together."""
        found, seen = [], set()
        known = sorted((w for w in distinct if w in self.rank), key=self.rank.__getitem__)
        for j, w in enumerate(known):
            for i, k in self.prefix.get(w, ()):
                if i in seen:
                    continue
                s = self.sets[i][1]
                # Up to a template's first hit nothing has matched, and what follows on either side bounds the overlap.
                if len(distinct) >= self.need[i] and 1 + min(len(s) - k - 1, len(known) - j - 1) >= self.need[i]:
                    seen.add(i)
                    if len(s & distinct) >= self.need[i]:
                        found.append(i)
        return found

    def overlap(self, i: int, line: list[bytes]) -> int:
        """The most distinct words of a template in any block of a text, given by its words."""
        s, size = self.sets[i][1], self.size[i]
        held: dict[bytes, int] = {}  # the last place of each word in the run, oldest first
        most = 0
        for at, w in enumerate(line):
            if w in s:
                held.pop(w, None)
                held[w] = at
                while held[first := next(iter(held))] <= at - size:
                    del held[first]
                most = max(most, len(held))
        return most

    def matches(self, line: list[bytes], distinct: set[bytes]) -> list[tuple[str, float]]:
        """Labels and containments of the templates that reach the threshold in a block of a text (its words, in order and distinct)."""
        return [(self.sets[i][0], n / len(self.sets[i][1])) for i in self.candidates(distinct) if (n := self.overlap(i, line)) >= self.need[i]]


def frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How many documents hold each word of a vocabulary; as many rows come to the driver as it has words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for b in batches:
            for t in b["text"].tolist():
                if isinstance(t, str) and t:
                    n.update(vocabulary.intersection(words(t)))
        yield pd.DataFrame({"word": list(n.keys()), "n": list(n.values())})

    return {bytes(r.word): r.n for r in docs.select("text").mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs (doc_id, text): counts and ends of the phrases' places, labels of phrases and of matched templates.

    score: 1 where a phrase stands, else the largest containment of a matched template, else 0.
    """
    index = Index(templates, frequencies(docs, frozenset().union(*(words(t) for _, t in templates))), threshold)
    sought = [(words(p), label) for p, label in phrases.items()]

    firsts, rest = frozenset(p[0] for p, _ in sought), [frozenset(p) for p, _ in sought]

    def rows(texts: list[str | None]) -> list[tuple]:
        out = []
        for t in texts:
            line = words(t)
            distinct = set(line)
            found = places(line, sought) if not firsts.isdisjoint(distinct) and any(r <= distinct for r in rest) else []
            score, labels = float(bool(found)), {x for _, x in found}
            base = ",".join(sorted(labels))
            if not index.keys.isdisjoint(distinct):
                for label, share in index.matches(line, distinct):
                    labels.add(label)
                    score = max(score, share)
            starts = [s for s, _ in found]
            out.append((len(line), len(found), min(starts, default=None), max(starts, default=None), base, ",".join(sorted(labels)), score))
        return out

    return per_row(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"], "text", rows, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
