"""Licences of files: TF-IDF cosine to templates, then inheritance from directories.

Every text is read whole. Its stretches that are dense in template words are
compared with each template as sparse TF-IDF vectors; document frequencies are
counted over all files. A file without a licence of its own takes that of the licence
file in its nearest ancestor directory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventsieve.llm.text import bounded, hashed, slices
from eventsieve.plans.tables import materialize

SIMILARITY = 0.7
#: This many words at most lie between two words that hold a stretch together.
GAP = 4
#: Template words of everyday texts: alone they begin no stretch, unless a template has no other words. Fixed, so that it doesn't matter how many files carry a notice.
EVERYDAY = frozenset(
    "a above all an and any anyone are as at be by can charge code com deal do either express fee file files following for"
    " form forms free general http if in including into is it kind language later law library list may met must not of on one"
    " option or org other person persons program public purpose required see sell shall so source specific subject that"
    " the this to under unless use was whom with without work writing www you your 0 1 2 3 4 v".split()
)
LICENCE_FILE = r"(?i)^(licen[cs]es?|copying|copyright|unlicense|notice)([.\-_].*)?$"

# Notices and opening passages of public licences.
FSF_OPENING = (
    "Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document,"
    " but changing it is not allowed."
)
BSD_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
    " the following conditions are met: Redistributions of source code must retain the above copyright notice,"
    " this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the"
    " above copyright notice, this list of conditions and the following disclaimer in the documentation and/or"
    " other materials provided with the distribution."
)
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed"
        " on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License"
        " for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
        " the Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation; either version 2 of the License, or (at your"
        " option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser"
        " General Public License as published by the Free Software Foundation; either version 2.1 of the License, or"
        " (at your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser"
        " General Public License as published by the Free Software Foundation, either version 3 of the License, or"
        " (at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero"
        " General Public License as published by the Free Software Foundation, either version 3 of the License, or"
        " (at your option) any later version.",
    ),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 {FSF_OPENING}"),
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 {FSF_OPENING}"),
    ("LGPL-2.1", f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 {FSF_OPENING}"),
    ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 {FSF_OPENING}"),
    ("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 {FSF_OPENING}"),
    ("BSD-2-Clause", BSD_CLAUSES),
    (
        "BSD-3-Clause",
        f"{BSD_CLAUSES} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or"
        " promote products derived from this software without specific prior written permission.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,"
        " publish, use, compile, sell, or distribute this software.",
    ),
    ("Proprietary", "All rights reserved."),
)
#: The notices, and the tag by which a file names each of their licences.
TEMPLATES = (
    *NOTICES,
    *((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(name for name, _ in NOTICES) if name != "Proprietary"),
)


class Templates:
    """Template words by hash, counts of each in each template, which are telling, and which pairs follow each other."""

    def __init__(self, templates=TEMPLATES):
        self.names = [name for name, _ in templates]
        hashes, ends = hashed([text.encode() for _, text in templates])
        self.words, where = np.unique(hashes, return_inverse=True)
        of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        self.counts = np.zeros((len(templates), len(self.words)))
        where = where.reshape(-1)
        np.add.at(self.counts, (of, where), 1)
        self.telling = ~np.isin(self.words, hashed([" ".join(EVERYDAY).encode()])[0])
        # a template of everyday words only is told by each of them
        dull = (self.counts[:, self.telling].sum(axis=1) == 0) if len(self.words) else np.zeros(len(templates), dtype=bool)
        self.telling |= (self.counts[dull] > 0).any(axis=0)
        self.pairs = np.unique((where[:-1] * len(self.words) + where[1:])[of[:-1] == of[1:]])


def _places(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The number of the template word with each hash, or -1."""
    place = np.searchsorted(words, hashes)
    place[place == len(words)] = 0
    return np.where(words[place] == hashes, place, -1)


def _frequencies(source: DataFrame, templates: Templates) -> tuple[np.ndarray, int]:
    """In how many files each template word stands, and the number of files."""
    words = templates.words

    def count(batches):
        sums, files = np.zeros(len(words), dtype=np.int64), 0
        for batch in batches:
            for _, texts in slices(batch):
                hashes, ends = hashed(texts)
                of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                place = _places(words, hashes)
                pairs = np.unique((of * len(words) + place)[place >= 0])
                sums += np.bincount(pairs % len(words), minlength=len(words))
                files += len(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, len(words))), pa.array(np.concatenate([[files], sums]))], ["word", "files"]
        )

    rows = (
        source.select("text").mapInArrow(count, "word long, files long").groupBy("word").agg(F.sum("files").alias("n"))
    )
    found = {r["word"]: r["n"] for r in rows.collect()}
    return np.array([found.get(i, 0) for i in range(len(words))]), found.get(-1, 0)


class Matcher:
    """Best template of each text of a run."""

    def __init__(self, known: Templates, files, total):
        self.words, self.names, self.telling, self.pairs = known.words, known.names, known.telling, known.pairs
        self.idf = np.log((total + 1) / (files + 1)) + 1
        weighted = known.counts * self.idf
        self.templates = weighted / np.linalg.norm(weighted, axis=1, keepdims=True)

    def __call__(self, texts: list, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """(template or -1, cosine) of each text."""
        lines, line_of = [], []
        for i, text in enumerate(texts):
            own = (text or b"").splitlines()
            lines += own
            line_of += [i] * len(own)
        hashes, ends = hashed(lines)
        line = np.repeat(np.arange(len(lines)), np.diff(ends, prepend=0))
        of = np.array(line_of, dtype=np.int64)[line] if len(line) else line
        place = _places(self.words, hashes)
        best, score = np.full(len(texts), -1, dtype=np.int64), np.zeros(len(texts))
        # a notice may be one line among others, or run over lines: look at both
        for parts in (line, of):
            seeds = self._seeds(place, parts)
            if not len(seeds):
                break
            cut = (np.diff(seeds) > GAP + 1) | (parts[seeds[1:]] != parts[seeds[:-1]])
            first = seeds[np.concatenate([[True], cut])]
            last = seeds[np.concatenate([cut, [True]])]
            for number, cosine, run in self._compared(place, first, last, similarity):
                text = of[first[run]]
                order = np.lexsort((-number, cosine))
                text, number, cosine = text[order], number[order], cosine[order]
                # ascending by cosine: the last write of a text is its best
                better = cosine > score[text]
                best[text[better]], score[text[better]] = number[better], cosine[better]
        return best, score

    def _seeds(self, place, parts):
        """Where telling words stand, and the words beside them that follow each other as in a template."""
        told = (place >= 0) & self.telling[place]
        if not told.any():
            return np.empty(0, dtype=np.int64)
        follow = (place[:-1] >= 0) & (place[1:] >= 0) & (parts[:-1] == parts[1:])
        at = np.flatnonzero(follow)
        follow[at] = np.isin(place[at] * len(self.words) + place[at + 1], self.pairs)
        run = np.cumsum(np.concatenate([[0], ~follow]))
        return np.flatnonzero(np.bincount(run, weights=told)[run] > 0)

    def _compared(self, place, first, last, similarity, chunk: int = 2048):
        """(template, cosine, stretch) of the stretches first..last that reach similarity.

        A word of no template weighs as much as the stretch's rarest template word, however many files carry the notice.
        """
        inside = np.concatenate([[0], np.cumsum(place < 0)])
        for at in range(0, len(first), chunk):
            a, b = first[at : at + chunk], last[at : at + chunk] + 1
            others = inside[b] - inside[a]
            size = b - a
            run = np.repeat(np.arange(len(a)), size)
            where = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
            word = place[where]
            counts = np.zeros((len(a), len(self.idf)))
            np.add.at(counts, (run[word >= 0], word[word >= 0]), 1)
            vectors = counts * self.idf
            rarest = ((counts > 0) * self.idf).max(axis=1)
            length = np.sqrt((vectors**2).sum(axis=1) + others * rarest**2)
            cosine = (vectors @ self.templates.T) / length[:, None]
            number = np.argmax(cosine, axis=1)
            found = np.minimum(cosine[np.arange(len(a)), number], 1.0)
            good = np.flatnonzero(found >= similarity)
            yield number[good], found[good], good + at


def detected(
    files: DataFrame, id_col: str, path_col: str, text_col: str, similarity: float = SIMILARITY, templates=TEMPLATES
) -> DataFrame:
    """(id, path, licence, similarity) of every row; licence is null where no template reaches similarity."""
    source = bounded(files).select(
        files[id_col].alias("id"), files[path_col].alias("path"), files[text_col].cast("binary").alias("text")
    )
    known = Templates(templates)
    parts = (known, *_frequencies(source, known))

    def run(batches):
        match = Matcher(*parts)
        for batch in batches:
            names, scores = [], []
            for _, texts in slices(batch):
                best, score = match(texts, similarity)
                names += [match.names[b] if b >= 0 else None for b in best]
                scores += [float(s) if b >= 0 else None for b, s in zip(best, score)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("path"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["id", "path", "licence", "similarity"],
            )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, path string, licence string, similarity double")


def _folders(path):
    """The names of a path's directories, without empty ones and dots."""
    names = F.filter(F.split(path, "/"), lambda n: ~n.isin("", "."))
    return F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0)))


def licensed(
    files: DataFrame,
    id_col: str = "doc_id",
    path_col: str = "path",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    templates=TEMPLATES,
) -> DataFrame:
    """(id, path, licence, similarity, origin, licence_path) of every row of files.

    origin is "own" where the file's text states a licence; "inherited" where it doesn't
    but a licence file (by its name) in the same or the nearest ancestor directory does, whose path is
    licence_path; else null, as is licence. Of several licence files in a directory
    the most similar counts, then the one with the shortest path. A null path inherits nothing;
    null and empty texts state nothing. Rows come out as often as they go in; an empty
    table gives an empty result; further columns are ignored.

    Ancestors are listed once for each directory, not for each file, so a
    directory that holds a third of all files is one row of the path join.
    """
    own = detected(files, id_col, path_col, text_col, similarity, templates)
    own = own.withColumn("folder", F.when(F.col("path").isNotNull(), F.concat_ws("/", _folders(F.col("path")))))
    # read three times below: the texts are scanned once
    own = materialize(own, "detected")
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.struct("similarity", F.struct(-F.length("path"), "path"))
    given = (
        own.where(F.col("licence").isNotNull() & name.rlike(LICENCE_FILE))
        .groupBy("folder")
        .agg(F.max_by(F.struct("licence", "similarity", "path"), rank).alias("given"))
        .withColumnRenamed("folder", "ancestor")
    )
    names = F.split("folder", "/")
    folders = own.select("folder").where("folder is not null").distinct()
    up = folders.select(
        "folder",
        F.explode(F.sequence(F.lit(0), F.when(F.col("folder") == "", 0).otherwise(F.size(names)))).alias("depth"),
    ).withColumn("ancestor", F.concat_ws("/", F.slice(names, F.lit(1), F.col("depth"))))
    # written, so that the join below stands alone and a folder that holds very many files can be split
    nearest = materialize(up.join(given, "ancestor").groupBy("folder").agg(F.max_by("given", "depth").alias("given")), "nearest")
    mine = F.col("licence").isNotNull()
    return own.join(nearest, "folder", "left").select(
        F.col("id").alias(id_col),
        F.col("path").alias(path_col),
        F.coalesce("licence", "given.licence").alias("licence"),
        F.when(mine, F.col("similarity")).otherwise(F.col("given.similarity")).alias("similarity"),
        F.when(mine, "own").when(F.col("given").isNotNull(), "inherited").alias("origin"),
        F.when(~mine, F.col("given.path")).alias("licence_path"),
    )
