"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlens.llm.common import folded_words, raw
from ledgerlens.llm.license_texts import LINES, TEXTS

SHINGLE, CONTAINMENT = 5, 0.8
#: Least probability that a window around a license shares a band with its template.
RETRIEVAL = 0.999
ROWS = 1
#: Words of a stretch in which matches are compared with each other.
PLACE = 64
#: Shingles whose minimum is shared by all longer windows.
BLOCK = 4

#: Public license notices and texts.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def common() -> dict[str, str]:
    """TEMPLATES, and all further texts and lines of at least SHINGLE words whose words no other one has."""
    out, seen = dict(TEMPLATES), {tuple(folded_words(x.encode())) for x in TEMPLATES.values()}
    for name, text in {**TEXTS, **LINES}.items():
        words = tuple(folded_words(text.encode()))
        if len(words) >= SHINGLE and words not in seen:
            seen.add(words)
            out[name] = text
    return out


def bands_needed(jaccard: float, rows: int = ROWS, retrieval: float = RETRIEVAL) -> int:
    """Bands of ``rows`` minima so that a window of at least this similarity is retrieved with that probability."""
    hit = jaccard**rows
    return 1 if hit >= 1 else math.ceil(math.log(1 - retrieval) / math.log(1 - hit))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row; of all values if there are fewer."""
    width, span = min(width, len(values)), 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def _hashes(words: list[bytes]) -> np.ndarray:
    """A hash of each shingle; equal ones of different shingles are told apart when a match is verified."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    out = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _band(minima: list[np.ndarray]) -> np.ndarray:
    out = minima[0]
    for row in minima[1:]:
        out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
    return out


class _Class:
    """Templates of one number of shingles, all and different ones: how windows are cut, and their bands."""

    def __init__(self, n: int, different: int, rows: int):
        need = max(1, math.ceil(CONTAINMENT * different - 1e-9))
        self.step = max(BLOCK, n // 4 // BLOCK * BLOCK) if need < n else 1
        #: A match may be spread over so many shingles.
        self.spread = -(-(n + self.step - 1) // self.step) * self.step + different
        # Windows begin every ``step`` shingles and hold ``parts`` steps, and one ends with the text: some window holds any
        # ``spread`` shingles in a row.
        self.parts = -(-(self.spread + self.step - 1) // self.step)
        self.width = self.parts * self.step
        self.bands = bands_needed(need / (self.width + different - need), rows)
        self.names: list[str] = []
        self.tables: list[tuple[np.ndarray, dict[int, list[str]]]] = []


class Scanner:
    """All templates, by number of shingles. The hash functions are shared, so a text is hashed once for each."""

    def __init__(self, templates: dict[str, str], rows: int = ROWS):
        self.rows, self.shingles, self.classes, hashed = rows, {}, {}, {}
        for name in sorted(templates):
            words = folded_words(templates[name].encode())
            if len(words) < SHINGLE:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            self.shingles[name] = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
            hashed[name] = _hashes(words)
            n = len(words) - SHINGLE + 1
            different = len(self.shingles[name])
            self.classes.setdefault((n, different), _Class(n, different, rows)).names.append(name)
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed.values()]))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.known >> np.uint64(44)] = True
        self.reach = max((x.width for x in self.classes.values()), default=0)
        self.bands = max((x.bands for x in self.classes.values()), default=0)
        self.factors = np.random.default_rng(5).integers(1, 1 << 63, self.bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for kind in self.classes.values():
            every, begins = np.concatenate([hashed[x] for x in kind.names]), np.cumsum([0, *[len(hashed[x]) for x in kind.names[:-1]]])
            for band in range(kind.bands):
                keys = _band([np.minimum.reduceat(every * f, begins) for f in self._factors(band)])
                names: dict[int, list[str]] = {}
                for key, name in zip(keys.tolist(), kind.names):
                    names.setdefault(key, []).append(name)
                kind.tables.append((np.unique(keys), names))

    def _factors(self, band: int) -> np.ndarray:
        return self.factors[band * self.rows : (band + 1) * self.rows]

    def _parts(self, shingles: np.ndarray):
        """(begin, end) of the parts of a text that can share a band: those within reach of a shingle of some template.

        Windows without such a shingle have another minimum than any template, so no match is lost.
        """
        at = np.flatnonzero(self.maybe[shingles >> np.uint64(44)])
        if len(at):
            at = at[self.known[np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)] == shingles[at]]
        if not len(at):
            return
        breaks = np.flatnonzero(np.diff(at) > 2 * self.reach)
        for first, last in zip(at[np.append(0, breaks + 1)].tolist(), at[np.append(breaks, len(at) - 1)].tolist()):
            yield max(0, first - self.reach), min(len(shingles), last + self.reach + 1)

    def _candidates(self, shingles: np.ndarray):
        """(class, first shingle of a window, template) wherever a window and a template share a band."""
        edges = np.arange(0, len(shingles), BLOCK)
        for band in range(self.bands):
            mixed = [shingles * f for f in self._factors(band)]
            low = [np.minimum.reduceat(x, edges) for x in mixed]
            for kind in self.classes.values():
                if band >= kind.bands:
                    continue
                if kind.step == 1:
                    minima = [_sliding_min(x, kind.width) for x in mixed]
                    starts = np.arange(len(minima[0]))
                else:
                    minima = [_sliding_min(x, kind.width // BLOCK) for x in low]
                    starts = np.arange(0, len(minima[0]), kind.step // BLOCK)
                    if starts[-1] != len(minima[0]) - 1:
                        starts = np.append(starts, len(minima[0]) - 1)  # the window that ends with the text
                    minima = [x[starts] for x in minima]
                    starts = starts * BLOCK
                found = _band(minima)
                keys, names = kind.tables[band]
                hit = keys[np.minimum(np.searchsorted(keys, found), len(keys) - 1)] == found
                for w in np.flatnonzero(hit).tolist():
                    for name in names[int(found[w])]:
                        yield kind, int(starts[w]), name

    def __call__(self, data: bytes | None) -> list[tuple[str, int, int, float]]:
        """(license, first word, last word, containment) of each occurrence, by place."""
        words = folded_words(data)
        if len(words) < SHINGLE:
            return []
        near: dict[str, set] = defaultdict(set)
        kinds = {}
        shingles = _hashes(words)
        for begin, end in self._parts(shingles):
            for kind, start, name in self._candidates(shingles[begin:end]):
                near[name].add(begin + start)
                kinds[name] = kind
        found = [x for name, starts in near.items() for x in self._verify(words, name, sorted(starts), kinds[name])]
        found = [(name.partition("#")[0], *place) for name, *place in self._best(found)]
        return sorted(dict.fromkeys(found), key=lambda x: (x[1], x[0]))

    def _best(self, found):
        """Of matches on the same words (half of the shorter one or more) the one with most shingles, so that a license is not
        taken for its relatives; templates outside of the further texts and lines do not displace each other. Only matches
        that share a stretch of PLACE words are compared."""
        kept, placed = [], defaultdict(list)
        for x in sorted(found, key=lambda x: (-round(x[3] * len(self.shingles[x[0]])), -x[3], x[0], x[1])):
            more = x[0] in TEXTS or x[0] in LINES
            places = range(x[1] // PLACE, x[2] // PLACE + 1)
            if not any(
                (more or y[0] in TEXTS or y[0] in LINES) and 2 * (min(x[2], y[2]) - max(x[1], y[1]) + 1) >= min(x[2] - x[1], y[2] - y[1]) + 1
                for place in places for y in placed[place]
            ):
                kept.append(x)
                for place in places:
                    placed[place].append(x)
        return kept

    def _verify(self, words, name, starts, kind):
        """Stretches of neighbouring windows are compared exactly; a stretch holds as many matches as fit apart."""
        own, width = self.shingles[name], kind.width
        stretches: list[list[int]] = []
        for s in starts:
            begin, end = max(0, s - width), s + 2 * width
            if stretches and begin <= stretches[-1][1]:
                stretches[-1][1] = end
            else:
                stretches.append([begin, end])
        for begin, end in stretches:
            at = [i for i in range(begin, min(end, len(words) - SHINGLE + 1)) if tuple(words[i : i + SHINGLE]) in own]
            i = 0
            while i < len(at):
                # From here, up to a window and a template's length on, the different shingles met first.
                seen, last, j = set(), i, i
                while j < len(at) and at[j] - at[i] < kind.spread and len(seen) < len(own):
                    gram = tuple(words[at[j] : at[j] + SHINGLE])
                    if gram not in seen:
                        seen.add(gram)
                        last = j
                    j += 1
                if len(seen) >= CONTAINMENT * len(own) - 1e-9:
                    yield name, at[i], at[last] + SHINGLE - 1, len(seen) / len(own)
                    i = last + 1
                else:
                    i += 1


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, rows: int = ROWS) -> DataFrame:
    """One row for each license found: the other columns of ``docs``, ``license``, ``first_word``, ``last_word``, ``containment``.

    Columns of ``docs`` that bear one of these four names give way.

    Words are folded as in the decontamination; a match holds at least 0.8 of the template's different five-word shingles within
    a window and the template's length. Null, empty and short texts match nothing. Repeated rows and overlapping templates each
    give rows; of ``common()``, which holds without ``templates``, the further texts and lines give a row only where no other
    match has more shingles of the same words, and then take the place of what has fewer. The templates are a fixed set of
    some hundred kilobytes at most, checked to have five words at least.
    """
    held = docs.sparkSession.sparkContext.broadcast(Scanner(templates or common(), rows))
    docs = docs.select(text_col, *[c for c in docs.columns if c != text_col and c.lower() not in ("license", "first_word", "last_word", "containment")])
    kept = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField("license", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("containment", T.DoubleType())])

    def scan(batches):
        scanner = held.value
        for batch in batches:
            found = [scanner(x) for x in raw(batch.column(text_col))]
            at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            flat = [y for x in found for y in x]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(f.name).take(at) for f in kept] + [pa.array([x[i] for x in flat], k) for i, k in enumerate(kinds)], names=schema.names)

    return docs.mapInArrow(scan, schema)
