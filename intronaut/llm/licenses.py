"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Every line of a text is a possible licence header, and the whole text of a file
named like a licence file is one as well. Lines and templates are sparse vectors of
log-scaled term frequency times inverse document frequency; document frequencies of the
templates' words are counted over all files, words in no template count as the
rarest. A line can reach the threshold only if it has one of a template's heavy words
(those without which the rest of the template has too little mass), which spares
nearly all lines the exact computation.

Notices also stand within a line or go over several, and headers and full licence texts
have many: so for each template, standard headers and full texts with them, a window of as
many words slides over the whole text, whatever its lines and comment marks. A window
reaches the threshold only if the squared weights of the template's words in it add up to the
threshold's square; the others, nearly all, cost a running sum.

A file without a licence of its own takes the one of the nearest directory above it
that holds a licence file with one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intronaut.llm.words import NOT_ALNUM, split_words
from intronaut.scratch import materialize

# Notices by which works are commonly put under public licences.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
#: Notices that several licences begin with: any other template that is reached goes before them.
SHARED_NOTICES = ("Redistribution and use in source and binary forms, with or without modification, are permitted",)
# The standard header of the GNU licences, with the kind and version of each.
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_REST = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."
_GNU_NAMES = [("AGPL-3.0", "Affero ", "3"), ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3")]
# Standard headers, titles and telling passages, found by windows only.
HEADERS: list[tuple[str, str]] = [
    *((name, _GNU.format(kind, version)) for name, kind, version in _GNU_NAMES),
    *((name, (_GNU + _GNU_REST).format(kind, version)) for name, kind, version in _GNU_NAMES),
    *((name, f"GNU {kind}General Public License Version {version}") for name, kind, version in _GNU_NAMES),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("AGPL-3.0", "if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("ISC", "Licensed under the ISC License"),
    ("MIT", "The MIT License (MIT)"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
#: Base names, in lower case and without extension, of files that hold the licence of their directory.
LICENCE_FILES = ("license", "licence", "copying", "unlicense", "notice")
#: A licence file with so many of these beginnings of words is a licence, known or not.
LICENCE_WORDS, LICENCE_WORDS_LEAST = r"\b(licen[sc]e|permi(?:ssion|tted)|warrant|liab|copyright|redistribut|disclaim)", 3
THRESHOLD = 0.8


def full_texts() -> list[tuple[str, str]]:
    """Whole licences beside this file; read on the driver only."""
    return [(f.name.removesuffix(".txt"), f.read_text()) for f in sorted(Path(__file__).with_name("licence_texts").glob("*.txt"))]


def _vectors(column: list[str]) -> list[Counter]:
    out = []
    for words in split_words(pa.array(column, pa.string()), lower=True, separators=NOT_ALNUM, whole=True):
        out += [Counter(words.codes[a:b].tolist()) for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
    return out


class Scanner:
    """Templates with weights for ``n`` files of which ``df[word]`` have a word of the templates; ``texts`` are met by windows only."""

    def __init__(self, templates: list[tuple[str, str]], n: int, df: dict[int, int], threshold: float, texts: list[tuple[str, str]] | None = None):
        self.n, self.df, self.threshold = n, df, threshold
        self.names = [name for name, _ in templates]
        self.shared_names = {name for name, text in templates if text in SHARED_NOTICES}
        self.templates = [self.unit(v) for v in _vectors([text for _, text in templates])]
        heavy: set[int] = set()
        for t in self.templates:
            rest = 1.0
            for word, weight in sorted(t.items(), key=lambda x: (-x[1], x[0])):
                if rest < threshold**2 - 1e-9:
                    break
                heavy.add(word)
                rest -= weight * weight
        self.heavy = np.array(sorted(heavy), np.uint64)
        counts = _vectors([text for _, text in [*templates, *(texts or [])]])
        self.sliding = [(name, v.total(), self.unit(v)) for (name, _), v in zip([*templates, *(texts or [])], counts, strict=True)]
        self.shared = [text in SHARED_NOTICES for _, text in [*templates, *(texts or [])]]
        self.vocabulary = np.array(sorted({w for v in counts for w in v}), np.uint64)
        # squared weights by place in the vocabulary, 0 for any other word
        self.masses = [np.array([*(t.get(w, 0.0) ** 2 for w in self.vocabulary.tolist()), 0.0]) for _, _, t in self.sliding]

    def idf(self, word: int) -> float:
        return math.log((1 + self.n) / (1 + self.df.get(word, 0))) + 1

    def unit(self, counts: Counter) -> dict[int, float]:
        v = {w: (1 + math.log(c)) * self.idf(w) for w, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    def best(self, counts: Counter) -> tuple[float, str]:
        """Largest cosine and its licence; ties go to the first name."""
        v = self.unit(counts)
        return max(((sum(x * v.get(w, 0.0) for w, x in t.items()), name) for t, name in zip(self.templates, self.names, strict=True)), key=lambda x: (round(x[0], 12), [-ord(c) for c in x[1]]))

    def scan(self, column: pa.Array, whole: np.ndarray) -> tuple[list[str | None], list[float | None]]:
        """Licence and cosine of each text by its lines, and by all of it where ``whole``."""
        names: list[str | None] = [None] * len(column)
        cosines: list[float | None] = [None] * len(column)
        for words in split_words(column, lower=True, separators=NOT_ALNUM, whole=True):
            row = np.repeat(np.arange(len(words.counts)), words.counts)
            line = np.cumsum(words.data == 10)[words.starts] if len(words.starts) else np.zeros(0, np.int64)
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (line[1:] != line[:-1])])) if len(row) else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(self.heavy, words.codes), len(self.heavy) - 1)
            hits = np.flatnonzero(self.heavy[at] == words.codes) if len(self.heavy) else np.zeros(0, np.int64)
            ends = np.append(new[1:], len(row))
            spans = [(new[k], ends[k]) for k in np.unique(np.searchsorted(new, hits, "right") - 1)]
            spans += [(words.offsets[r], words.offsets[r + 1]) for r in np.unique(row[hits]) if whole[words.first + r]]
            for a, b in spans:
                cosine, name = self.best(Counter(words.codes[a:b].tolist()))
                i = words.first + int(row[a])
                if cosine >= self.threshold and (cosines[i] is None or (-cosine, name) < (-cosines[i], names[i])):
                    names[i], cosines[i] = name, cosine
        return names, cosines

    def slide(self, codes: list[int], m: int, template: dict[int, float]) -> float:
        """Largest cosine of the windows of ``m`` words of ``codes``; of all of them if there are fewer."""
        counts: Counter = Counter()
        idf = {w: self.idf(w) for w in set(codes)}
        dot = square = best = 0.0
        for i, word in enumerate(codes):
            for w, change in ((word, 1), (codes[i - m], -1)) if i >= m else ((word, 1),):
                c = counts[w]
                old, new = (((1 + math.log(k)) * idf[w] if k else 0.0) for k in (c, c + change))
                counts[w] = c + change
                dot += template.get(w, 0.0) * (new - old)
                square += new * new - old * old
            if i >= min(m, len(codes)) - 1:
                best = max(best, dot / math.sqrt(square))
        return best

    def scan_windows(self, column: pa.Array) -> tuple[list[str | None], list[float | None]]:
        """Licence and cosine of each text by windows of each template's length; ties go to the longest template, then the first name.

        Notices that several licences share count only where nothing else does.
        """
        lengths, weak = [0] * len(column), [True] * len(column)
        names: list[str | None] = [None] * len(column)
        cosines: list[float | None] = [None] * len(column)
        for words in split_words(column, lower=True, separators=NOT_ALNUM, whole=True):
            n = len(words.codes)
            if not n or not len(self.vocabulary):
                continue
            at = np.minimum(np.searchsorted(self.vocabulary, words.codes), len(self.vocabulary) - 1)
            at = np.where(self.vocabulary[at] == words.codes, at, len(self.vocabulary))
            row = np.repeat(np.arange(len(words.counts)), words.counts)
            start = np.arange(n)
            first, last = words.offsets[:-1][row], words.offsets[1:][row]
            for (name, m, template), mass, shared in zip(self.sliding, self.masses, self.shared, strict=True):
                total = np.concatenate([[0.0], np.cumsum(mass[at])])
                end = np.minimum(start + m, last)
                able = np.flatnonzero((total[end] - total[start] >= self.threshold**2 - 1e-9) & ((start + m <= last) | (start == first)))
                if not len(able):
                    continue
                opens = np.flatnonzero(np.concatenate([[True], (np.diff(able) != 1) | (row[able[1:]] != row[able[:-1]])]))
                for a, b in zip(able[opens], able[np.append(opens[1:], len(able)) - 1], strict=True):
                    cosine = self.slide(words.codes[a : end[b]].tolist(), m, template)
                    i = words.first + int(row[a])
                    cosine = round(min(1.0, cosine), 9)
                    if cosine >= self.threshold and (cosines[i] is None or (shared, -cosine, -m, name) < (weak[i], -cosines[i], -lengths[i], names[i])):
                        names[i], cosines[i], lengths[i], weak[i] = name, cosine, m, shared
        return names, cosines


def _counter(vocabulary: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, total = 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            files += len(batch)
            for words in split_words(batch.column("text"), lower=True, separators=NOT_ALNUM, whole=True):
                row = np.repeat(np.arange(len(words.counts)), words.counts)
                at = np.minimum(np.searchsorted(vocabulary, words.codes), len(vocabulary) - 1)
                hit = vocabulary[at] == words.codes
                seen = np.unique(row[hit] * len(vocabulary) + at[hit])
                total += np.bincount(seen % len(vocabulary), minlength=len(vocabulary))
        yield pa.record_batch([pa.array([-1, *range(len(vocabulary))], pa.int32()), pa.array([files, *total.tolist()], pa.int64())], ["word", "files"])

    return count


def scan_licenses(files: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Licence of each file, its own or inherited.

    ``files`` has file_id, path and text; other columns are not read. Returns one row per input row: file_id,
    path, license, cosine, origin (``own``, ``inherited``, ``unrecognised``, ``none``) and inherited_from (directory).
    A licence file in whose text no template is found but several words of licences is ``unrecognised``: it inherits nothing, and
    what is below it inherits nothing from further up.
    Null and empty texts have no licence of their own; a null path is in no directory. Of several
    licence files of a directory the one with the larger cosine counts, then the first name. Repeated
    rows get the same answer each.
    """
    texts = [*HEADERS, *full_texts()] if templates is None else []
    templates = TEMPLATES if templates is None else templates
    files = files.select(F.col("file_id").cast("long").alias("file_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    vocabulary = np.array(sorted({w for v in _vectors([t for _, t in [*templates, *texts]]) for w in v}), np.uint64)
    # as many numbers as the templates have words, whatever the input
    counts = {r["word"]: r["files"] for r in files.select("text").mapInArrow(_counter(vocabulary), "word int, files long").groupBy("word").agg(F.sum("files").alias("files")).collect()}
    scanner = Scanner(templates, counts.get(-1, 0), {int(w): counts.get(i, 0) for i, w in enumerate(vocabulary)}, threshold, texts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, cosines = scanner.scan(batch.column("text"), batch.column("licence_file").to_numpy(zero_copy_only=False))
            for i, (name, cosine) in enumerate(zip(*scanner.scan_windows(batch.column("text")), strict=True)):
                # a line is a window too, but for lines and whole files that are shorter or longer than their template
                if cosine is not None and (cosines[i] is None or cosine >= round(cosines[i], 9) or names[i] in scanner.shared_names):
                    names[i], cosines[i] = name, cosine
            yield pa.record_batch([batch.column(c) for c in ("file_id", "path", "licence_file", "unknown")] + [pa.array(names, pa.string()), pa.array(cosines, pa.float64())], ["file_id", "path", "licence_file", "unknown", "license", "cosine"])

    base = F.lower(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
    marked = files.select("file_id", "path", "text", F.coalesce(base.isin(*LICENCE_FILES), F.lit(False)).alias("licence_file"))
    worded = F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(LICENCE_WORDS), F.lit(1)))) >= LICENCE_WORDS_LEAST
    marked = marked.withColumn("unknown", F.when(F.col("licence_file"), F.coalesce(worded, F.lit(False))).otherwise(False))
    scanned = materialize(marked.mapInArrow(scan, "file_id long, path string, licence_file boolean, unknown boolean, license string, cosine double"), "licences")
    own = scanned.withColumn("unknown", F.col("unknown") & F.col("license").isNull())
    steps = F.split("path", "/")
    parent = F.array_join(F.slice(steps, 1, F.size(steps) - 1), "/")
    holders = own.where("licence_file and (license is not null or unknown)").select(parent.alias("directory"), "license", "cosine")
    holders = holders.groupBy("directory").agg(F.min(F.struct(F.col("license").isNull().alias("without"), (-F.col("cosine")).alias("c"), "license")).alias("h")).select("directory", F.col("h.license").alias("license"), (-F.col("h.c")).alias("cosine"))
    # nearest directory above: by distinct directories, so a crowded one costs one row
    homes = own.where("license is null and path is not null and not unknown").select(parent.alias("home")).distinct()
    up = F.split("home", "/")
    above = homes.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(up)))).withColumn("directory", F.array_join(F.slice(up, F.lit(1), F.col("depth")), "/"))
    nearest = above.join(holders, "directory").groupBy("home").agg(F.max(F.struct("depth", "directory", "license", "cosine")).alias("n")).select("home", "n.directory", F.col("n.license").alias("given"), F.col("n.cosine").alias("given_cosine"))
    # written, so that Spark can split a directory with many files; files that need no directory go round the join
    nearest = materialize(nearest.where("given is not null"), "nearest")
    asks = F.col("license").isNull() & F.col("path").isNotNull() & ~F.col("unknown")
    found = own.where(asks).withColumn("home", parent).join(nearest, "home", "left")
    given = found.select("file_id", "path", F.col("given").alias("license"), F.col("given_cosine").alias("cosine"), F.when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"), F.col("directory").alias("inherited_from"))
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("unknown"), "unrecognised").otherwise("none")
    return given.union(own.where(~asks).select("file_id", "path", "license", "cosine", origin.alias("origin"), F.lit(None).cast("string").alias("inherited_from")))


def demonstration_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree, for want of paths: 16 to a directory, 32 of these to the next, below their source."""
    top, middle = F.floor(F.col("doc_id") / 512), F.floor(F.col("doc_id") / 16)
    place = F.when(F.col("doc_id") % 512 == 0, F.concat(F.lit("d"), top, F.lit("/LICENSE"))).when(F.col("doc_id") % 16 == 0, F.concat(F.lit("d"), top, F.lit("/e"), middle, F.lit("/LICENSE"))).otherwise(F.concat(F.lit("d"), top, F.lit("/e"), middle, F.lit("/f"), F.col("doc_id"), F.lit(".txt")))
    return docs.select(F.col("doc_id").alias("file_id"), F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), place).alias("path"), "text")
