"""License scan by patience alignment of whole texts with license templates.

A text is read in windows of twice a template's length (one length apart), so that a notice anywhere, or several times,
lies whole in a window.  In a window, common words at both ends are matched, words that are unique to both the window
and the template are anchors, the longest increasing run of anchors is kept, and the gaps between them are aligned the
same way.  Coverage is the matched part of the template's words.  Windows that hold too few of the template's words
for the asked coverage are skipped beforehand: an upper bound, so nothing is lost.  The scan is row by row, without a
shuffle, with templates as constants.

Nulls and odd input: a null or empty text has no license; repeated rows are scanned each; templates without words are
refused; an empty table gives an empty result; other columns pass.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import python_tasks
from inkveil.llm.decontam import read_batch, words_of

#: Notices in their usual wording.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
}
COVERAGE = 0.8
FOUND = "n_words long, licenses array<struct<license:string,coverage:double,begin:long,end:long>>"


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of ``pairs`` (sorted by the first) that increases in the second."""
    tails, ends, back = [], [], []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(b)
            ends.append(i)
        else:
            tails[k], ends[k] = b, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Matched (text place, template place) pairs, increasing in both."""
    out, gaps = [], [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        where = {w: j for j, w in enumerate(template[c:d], c) if theirs[w] == 1 and ours.get(w) == 1}
        anchors = increasing([(i, where[w]) for i, w in enumerate(text[a:b], a) if w in where])
        out += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]) if anchors else ():
            gaps.append((i + 1, k, j + 1, m))
    return sorted(out)


def scan_words(ids: np.ndarray, template: np.ndarray, member: np.ndarray, coverage: float) -> tuple[float, int, int] | None:
    """Best coverage of a template in the words of a text, and the words it spans; the first of equals."""
    size, need = len(template), coverage * len(template) - 1e-9
    inside = np.concatenate(([0], np.cumsum(member[ids])))
    starts = np.arange(0, max(1, len(ids) - size), size)
    stops = np.minimum(starts + 2 * size, len(ids))
    best, wanted = None, template.tolist()
    for at in np.flatnonzero(inside[stops] - inside[starts] >= need).tolist():
        a, b = int(starts[at]), int(stops[at])
        matched = align(ids[a:b].tolist(), wanted)
        if len(matched) >= need and (best is None or len(matched) / size > best[0]):
            best = (len(matched) / size, a + matched[0][0], a + matched[-1][0] + 1)
    return best


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with ``_found``: n_words and licenses (license, coverage, begin and end word), by license."""
    python_tasks(docs.sparkSession)
    texts = TEMPLATES if templates is None else templates
    vocabulary: dict[bytes, int] = {}
    coded = {}
    for name, text in sorted(texts.items()):
        coded[name] = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], np.int64)
        if not len(coded[name]):
            raise ValueError(f"template {name} has no words")
    members = {name: np.isin(np.arange(len(vocabulary) + 1), ids).astype(np.int64) for name, ids in coded.items()}

    @F.pandas_udf(FOUND)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in parts:
            ids, begins, ends = read_batch(batch, vocabulary)
            rows = []
            for a, b in zip(begins.tolist(), ends.tolist()):
                hits = []
                known = ids[a:b]
                for name, template in coded.items() if known.any() else ():
                    if hit := scan_words(known, template, members[name], coverage):
                        hits.append({"license": name, "coverage": hit[0], "begin": hit[1], "end": hit[2]})
                rows.append(hits)
            yield pd.DataFrame({"n_words": ends - begins, "licenses": rows})

    return docs.drop("_found").withColumn("_found", found("text"))
