"""License scans (operator 5): MinHash bands over overlapping text windows.

Templates are cut into segments and documents into overlapping windows of the same two sizes (SHORT and LONG
words; every window starts a quarter of its size after the one before).  Both are sets of SHINGLE-word
shingles.  Their MinHash signatures of BANDS x ROWS values are compared by band: a window whose band
equals one of a segment retrieves its template.  A segment that stands in a text has a window with a
Jaccard similarity of 0.6 or more; with 20 bands of 2 rows it collides with probability
1 - (1 - 0.36) ** 20 > 0.9998.  A retrieved template is verified exactly: the share of all its shingles that
the words around the windows hold must reach CONTAINED, and its MANDATORY phrases (version and variant, which the
share cannot tell from those of a neighbour) must stand there word for word.  Of templates of
about one length (none twice as long as the other) whose windows overlap, the best one counts: the highest share, then
the longest template; a statement within a notice, or a notice within a whole license, counts beside it.

The templates (a bounded list, size checked) are sent to the executors; documents are not shuffled.

Edge cases: null and empty texts and texts without a match give no row; templates of fewer than SHINGLE words are
one shingle; repeated rows are reported per row; words are runs of letters and digits, lower case; other
columns are ignored.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, mix, shingles, text_of, word_hashes

SHINGLE = 2
SHORT, LONG = 8, 32
BANDS, ROWS = 20, 2
CONTAINED = 0.8
#: shingles whose BANDS x ROWS hashes are in memory at once
BLOCK = 2048
MAX_TEMPLATE_BYTES = 16 << 20

# fixed values: statements and notices as they are published
TEMPLATES = {
    "Apache-2.0 statement": "Licensed under the Apache License, Version 2.0.",
    "MIT statement": "Released under the MIT License.",
    "GPL-3.0 statement": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                         "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                         "either express or implied.",
    "MIT notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in "
                  "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
                  "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "BSD notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                  "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                      "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "GPL-2.0 statement": "This work is licensed under the GNU General Public License, version 2.",
    "AGPL-3.0 statement": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-3.0 statement": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "CC-BY-SA-4.0 statement": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-SA-4.0 statement": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0 statement": "Licensed under CC BY-NC-ND 4.0.",
    "GPL-2.0 notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                      "Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "AGPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
                       "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT license": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to "
                   "deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
                   "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
                   "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
                   "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
                   "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
                   "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
                  "copyright notice and this permission notice appear in all copies.",
}

# fixed values: what a template's place must hold word for word
MANDATORY = {
    "Apache-2.0 statement": ["apache license version 2 0"], "Apache-2.0 notice": ["apache license version 2 0"], "MIT statement": ["mit license"],
    "GPL-3.0 statement": ["gnu general public license version 3"], "GPL-2.0 statement": ["gnu general public license version 2"],
    "AGPL-3.0 statement": ["gnu affero general public license version 3"], "LGPL-3.0 statement": ["gnu lesser general public license version 3"],
    "GPL notice": ["gnu general public license", "either version 3"], "GPL-2.0 notice": ["gnu general public license", "either version 2"],
    "AGPL-3.0 notice": ["gnu affero general public license", "either version 3"], "MPL-2.0 notice": ["mozilla public license v 2 0"],
    "CC-BY-NC-4.0 statement": ["cc by nc 4 0"], "CC-BY-NC-SA-4.0 statement": ["cc by nc sa 4 0"], "CC-BY-NC-ND-4.0 statement": ["cc by nc nd 4 0"],
    "CC-BY-4.0 statement": ["creative commons attribution 4 0"], "CC-BY-SA-4.0 statement": ["creative commons attribution sharealike 4 0"],
}

_other = re.compile(r"[\W_]+")
_rng = np.random.default_rng(5)
_MASK = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: str) -> bytes:
    """Words parted by single blanks."""
    return _other.sub(" ", text.lower()).strip().encode()


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours, row by row."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:, :-have], x[:, have:])
        have *= 2
    return np.minimum(x[:, :x.shape[1] - (width - have)], x[:, width - have:]) if have < width else x


def band_keys(grams: np.ndarray, size: int, stride: int):
    """Windows of `size` words (one if there are fewer; the last one always counts), BLOCK shingles at a time: their starts,
    and a row of keys for each band."""
    width = min(max(1, size - SHINGLE + 1), len(grams))
    starts = np.unique(np.append(np.arange(0, len(grams) - width + 1, stride), len(grams) - width))
    step = max(1, BLOCK // stride)
    for some in (starts[i:i + step] for i in range(0, len(starts), step)):
        hashed = (grams[None, some[0]:some[-1] + width] ^ _MASK[:, None]) * _FACTOR[:, None]
        least = _least(hashed, width)[:, some - some[0]].reshape(BANDS, ROWS, len(some))
        key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(some), axis=1)
        for row in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ least[:, row])
        yield some, key


def holds(text: np.ndarray, phrase: np.ndarray) -> bool:
    """Whether the words stand in the text one after another."""
    n = len(text) - len(phrase) + 1
    at = np.ones(max(0, n), bool)
    for i, w in enumerate(phrase):
        at &= text[i:i + len(at)] == w
    return bool(at.any())


class Templates:
    def __init__(self, templates: dict[str, str], mandatory: dict[str, list[str]]):
        self.names = sorted(templates)
        self.phrases = [list(word_hashes([words(x) for x in mandatory.get(n, [])])) for n in self.names]
        hashed = list(word_hashes([words(templates[n]) for n in self.names]))
        self.sizes = [len(w) for w in hashed]
        self.grams = [np.unique(shingles(w, SHINGLE)) for w in hashed]
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in (SHORT, LONG):
            keys, owner = [], []
            for t, w in enumerate(hashed):
                if not len(w) or (SHORT if len(w) < LONG else LONG) != size:
                    continue
                for at in range(0, max(1, len(w) - size + 1), max(1, size // 2)):
                    for _, key in band_keys(shingles(w[at:at + size], SHINGLE), size, 1):
                        keys.append(key.ravel())
                        owner.append(np.full(key.size, t))
            order = np.argsort(np.concatenate(keys)) if keys else np.zeros(0, int)
            self.keys[size] = (np.concatenate(keys)[order], np.concatenate(owner)[order]) if keys else (np.zeros(0, np.uint64), np.zeros(0, int))

    def scan(self, doc: np.ndarray) -> list[tuple[str, float, int, int, int]]:
        """(license, containment, windows, first word, end word) of the templates that the words hold."""
        grams = shingles(doc, SHINGLE)
        seen: dict[int, list[tuple[int, int]]] = {}
        for size, (keys, owner) in self.keys.items():
            if not len(keys) or not len(grams):
                continue
            for starts, key in band_keys(grams, size, size // 4):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                for band, w in np.argwhere(keys[at] == key).tolist():
                    i = int(at[band, w])
                    while i < len(keys) and keys[i] == key[band, w]:
                        seen.setdefault(int(owner[i]), []).append((int(starts[w]), int(starts[w]) + size))
                        i += 1
        # every place where a template is held, best ones first
        found = []
        for t, hits in sorted(seen.items()):
            hits = sorted(set(hits))
            # windows that lie within the template's length of each other are one place
            places = []
            for a, e in hits:
                if places and a <= places[-1][1] + self.sizes[t]:
                    places[-1][1] = max(e, places[-1][1])
                else:
                    places.append([a, e])
            for place in places:
                a, e = max(0, place[0] - self.sizes[t]), min(len(doc), place[1] + self.sizes[t])
                held = np.isin(grams[a:max(a + 1, e - SHINGLE + 1)], self.grams[t])
                share = len(np.unique(grams[a:max(a + 1, e - SHINGLE + 1)][held])) / len(self.grams[t])
                if share >= CONTAINED and all(holds(doc[a:e], x) for x in self.phrases[t]):
                    where = np.flatnonzero(held) + a
                    found.append((-share, -self.sizes[t], int(where[0]), t, min(int(where[-1]) + SHINGLE, len(doc)), len(hits), *place))
        taken, best = [], {}
        for share, _, first, t, end, n, a, e in sorted(found):
            if not any(a < g and f < e and 2 * min(self.sizes[t], self.sizes[o]) >= max(self.sizes[t], self.sizes[o]) for f, g, o in taken if o != t):
                taken.append((a, e, t))
                best.setdefault(t, (self.names[t], -share, n, first, end))
        return [best[t] for t in sorted(best)]


@functools.lru_cache(maxsize=2)
def _compiled(items: tuple, mandatory: tuple) -> Templates:
    return Templates(dict(items), dict(mandatory))


FOUND = "license string, containment double, n_windows int, first_word int, end_word int"


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                  mandatory: dict[str, list[str]] = MANDATORY) -> DataFrame:
    """One row per row of docs and template that it holds: the columns `keep`, then FOUND (the template's best place).  mandatory:
    phrases that a template's place must hold; templates without any need their share alone."""
    if sum(len(t.encode()) for t in templates.values()) > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates of over {MAX_TEMPLATE_BYTES} bytes")
    items, hits = tuple(sorted(templates.items())), fresh(docs, "_found")
    phrases = tuple(sorted((n, tuple(x)) for n, x in mandatory.items()))
    names = [c.split()[0] for c in FOUND.split(", ")]
    kind = pa.list_(pa.struct(list(zip(names, [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]))))

    @F.arrow_udf(f"array<struct<{FOUND.replace(', ', ',').replace(' ', ':')}>>")
    def scan(texts: pa.Array) -> pa.Array:
        own = _compiled(items, phrases)
        return pa.array([[dict(zip(names, x)) for x in own.scan(w)] for w in word_hashes([words(t) for t in texts.to_pylist()])], kind)

    return docs.select(*keep, F.explode(scan(text_of(text))).alias(hits)).select(*keep, f"{hits}.*")
