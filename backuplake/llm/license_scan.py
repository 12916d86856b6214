"""License scans: which known notices stand in a text.

A template is a set of five-word shingles. For each size class of templates, overlapping windows of
a text are taken: `window_size(t)` shingles, a power of two of at least twice the template's count,
each half a window apart, so that any run as long as the template lies whole in one window. MinHash
bands of one register retrieve the templates a window may hold; `bands_for` gives so many that a
window with the wanted containment misses all of them less than once in a million. Retrieved
templates are verified by the exact share of their shingles that the window holds. A window without
any template shingle has no register in common with a template and is passed over.

Words are lower-cased runs of letters, digits and underscores. Texts that are null or shorter than
five words hold nothing (nor do templates). Notices that differ in a word or two (GPL-2.0 and GPL-3.0)
share most shingles, so a text of one passes for the other: a template's match in a window counts only
if one of the template's shingles there lies in no stronger match of a rival. A rival has shingles in
common with the template, and neither holds all of the other's; stronger is a greater exact containment,
in any window. Ties, templates inside one another and notices that stand beside each other are all reported.
One row per document and template found, for its best window that counts, the first of equals; repeated
rows and null ids give rows of their own. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backuplake.llm.words import STEP, mixed, shingles, words

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-6

#: Common license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the'
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable"
        ' law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES'
        " OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and"
        " limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        ' files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,'
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice"
        " shall be included in all copies or substantial portions of the Software."
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
        " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}


def window_size(shingle_count: int) -> int:
    return 1 << max(1, math.ceil(math.log2(2 * shingle_count)))


def bands_for(containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """Registers after which a window of the wanted containment has met its template.

    With c of t template shingles in a window of w < 4 t, the similarity is at least
    c t / (w + (1 - c) t) > c / (5 - c).
    """
    return math.ceil(math.log(miss) / math.log(1 - containment / (5 - containment)))


class Scanner:
    """Templates as shingle sets and as registers, per window size."""

    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT):
        hashed = words()
        self.containment, self.names = containment, sorted(templates)
        own = {n: hashed(templates[n]) for n in self.names}
        sets = [np.unique(shingles(own[n], SHINGLE)) if len(own[n]) >= SHINGLE else np.zeros(0, np.uint64) for n in self.names]
        self.every = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        #: Template shingles as places in `every`.
        self.sets = [np.searchsorted(self.every, s) for s in sets]
        owners: dict[int, list[int]] = defaultdict(list)
        for t, own in enumerate(self.sets):
            for shingle in own.tolist():
                owners[shingle].append(t)
        near = {(t, u) for who in owners.values() for t in who for u in who if t != u}
        inside = {(t, u) for t, u in near if np.isin(self.sets[t], self.sets[u]).all()}
        #: Templates that share shingles, neither inside the other.
        self.rivals: dict[int, list[int]] = defaultdict(list)
        for t, u in sorted(near - inside - {(u, t) for t, u in inside}):
            self.rivals[t].append(u)
        self.seeds = mixed(np.arange(1, bands_for(containment) + 1, dtype=np.uint64) * STEP)
        self.registers: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        for t, s in enumerate(sets):
            if len(s):
                for f, value in enumerate(mixed(s[None, :] ^ self.seeds[:, None]).min(axis=1).tolist()):
                    self.registers[window_size(len(s))][f, value].append(t)

    def scan(self, text: str | None) -> list[tuple[str, float, int]]:
        """(template, containment, first word of the window) of each template found."""
        own = words()(text or "")
        if len(own) < SHINGLE or not len(self.every):
            return []
        runs = shingles(own, SHINGLE)
        place = np.minimum(np.searchsorted(self.every, runs), len(self.every) - 1)
        known = np.flatnonzero(self.every[place] == runs)
        if not len(known):
            return []
        #: Per template: containment, first word, and the places in `known` of its shingles in that window.
        matches: dict[int, list[tuple[float, int, np.ndarray]]] = defaultdict(list)
        for size, registers in self.registers.items():
            half = size // 2
            for w in sorted({k for p in (known // half).tolist() for k in (p - 1, p) if k >= 0}):
                window = runs[w * half : w * half + size]
                least = mixed(window[None, :] ^ self.seeds[:, None]).min(axis=1).tolist()
                candidates = {t for f, value in enumerate(least) for t in registers.get((f, value), ())}
                if not candidates:
                    continue
                first, end = np.searchsorted(known, [w * half, w * half + size])
                inside = place[known[first:end]]
                held = np.unique(inside)
                for t in candidates:
                    share = len(np.intersect1d(held, self.sets[t], assume_unique=True)) / len(self.sets[t])
                    if share >= self.containment:
                        matches[t].append((share, w * half, first + np.flatnonzero(np.isin(inside, self.sets[t]))))
        best: dict[int, tuple[float, int]] = {}
        for t, found in matches.items():
            #: The greatest containment of a rival over each place.
            rival = np.zeros(len(known))
            for u in self.rivals.get(t, ()):
                for share, _, at in matches.get(u, ()):
                    rival[at] = np.maximum(rival[at], share)
            for share, first_word, at in found:
                if share > best.get(t, (0.0, 0))[0] and rival[at].min() <= share:
                    best[t] = (share, first_word)
        return [(self.names[t], share, at) for t, (share, at) in sorted(best.items())]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment, first_word of every notice found."""
    from backuplake.llm.bpe import _arrow

    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", _arrow(kind)), ("license", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, containment)
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for name, share, at in scanner.scan(text):
                    for column, value in zip(rows, (doc_id, name, share, at)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    ddl = f"doc_id {kind.simpleString()}, license string, containment double, first_word long"
    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def oracle() -> str:
    """The same scan in SQL: shares of template shingles in each window, rivals told apart, the best per document."""
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(TEMPLATES.items()))
    word = r"'[\p{L}\p{N}_]+'"
    runs = "array_to_string(ws[i : i + 4], ' ')"
    return f"""
WITH t AS (SELECT name, regexp_extract_all(lower(body), {word}) AS ws FROM (VALUES {rows}) v(name, body)),
     ts AS (SELECT DISTINCT name, {runs} AS s FROM (SELECT name, ws, unnest(range(1, len(ws) - 3)) AS i FROM t)),
     tn AS (SELECT name, count(*) AS n, CAST(greatest(2, pow(2, ceil(log2(2 * count(*))))) AS BIGINT) AS w FROM ts GROUP BY name),
     d AS (SELECT doc_id, regexp_extract_all(lower(text), {word}) AS ws FROM documents WHERE text IS NOT NULL),
     ds AS (SELECT doc_id, i - 1 AS p, {runs} AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
     h AS (SELECT doc_id, name, s, n, w, p FROM ds JOIN ts USING (s) JOIN tn USING (name)),
     k AS (SELECT doc_id, name, s, n, w, p, unnest([p // (w // 2) - 1, p // (w // 2)]) AS win FROM h),
     c AS (SELECT doc_id, name, win, win * (w // 2) AS first_word, CAST(count(DISTINCT s) AS DOUBLE) / any_value(n) AS containment
           FROM k WHERE win >= 0 GROUP BY doc_id, name, win, w HAVING containment >= 0.8::DOUBLE),
     m AS (SELECT c.*, p FROM c JOIN k USING (doc_id, name, win)),
     o AS (SELECT a.name, b.name AS rival FROM ts a JOIN ts b ON a.s = b.s AND a.name <> b.name JOIN tn x ON x.name = a.name JOIN tn y ON y.name = b.name
           GROUP BY a.name, b.name, x.n, y.n HAVING count(*) < x.n AND count(*) < y.n),
     r AS (SELECT doc_id, o.name, p, max(containment) AS stronger FROM m JOIN o ON m.name = o.rival GROUP BY ALL),
     f AS (SELECT m.doc_id, m.name, any_value(containment) AS containment, any_value(first_word) AS first_word
           FROM m LEFT JOIN r ON r.doc_id = m.doc_id AND r.name = m.name AND r.p = m.p
           GROUP BY m.doc_id, m.name, win HAVING bool_or(coalesce(stronger, 0) <= containment))
SELECT doc_id, name AS license, max(containment) AS containment, CAST(arg_min(first_word, (-containment, first_word)) AS BIGINT) AS first_word
FROM f GROUP BY doc_id, name
"""
