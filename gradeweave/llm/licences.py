"""License scans: winnowed fingerprints pick candidates, banded alignment measures them."""

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded, hashes, mixed, words_of

GRAM = 3
#: One fingerprint at least in so many grams: any GRAM + WINDOW - 1 common words are found.
#: Templates of fewer words are looked up by all grams of a text; of fewer than GRAM, they are never found.
WINDOW = 2
COVERAGE = 0.7
GAP, MISS = -0.5, -0.5
OUTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’«»¿¡…–—"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = (
    "doc_id bigint, license string, start int, end int, matched int, template_words int, coverage double"
)

# The templates.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "mit": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation"
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "All rights reserved.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-3-clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
        "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program. If not, see https://www.gnu.org/licenses/."
    ),
    "gpl-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, "
        "Fifth Floor, Boston, MA 02110-1301 USA."
    ),
    "lgpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the "
        "GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/."
    ),
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the "
        "GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "cc-by-sa-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    ),
    "cc-by-nc-sa-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}


def plain_words(text: str):
    """(words without case and outer marks, their spans in code points)."""
    words, spans = [], []
    for m in WORD.finditer(text):
        left = m[0].lstrip(OUTER)
        bare = left.rstrip(OUTER)
        if bare:
            start = m.end() - len(left)
            words.append(bare.lower())
            spans.append((start, start + len(bare)))
    return words, spans


def grams(values: np.ndarray) -> np.ndarray:
    n = max(0, len(values) - GRAM + 1)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(GRAM):
            total = total * MULTIPLIER + values[i : i + n]
    return mixed(total)


def winnowed(values: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: the last smallest gram of every window of WINDOW grams."""
    if len(values) <= WINDOW:
        return np.flatnonzero(values == values.min())[-1:] if len(values) else np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(values, WINDOW)
    last = WINDOW - 1 - windows[:, ::-1].argmin(axis=1)
    return np.unique(np.arange(len(windows)) + last)


def word_hashes(words) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))


class Index:
    """The templates' words and, by fingerprint, where they have it. As large as the templates."""

    def __init__(self, templates):
        self.words = {name: plain_words(text)[0] for name, text in templates.items()}
        self.places, self.short = {}, {}
        for name, words in self.words.items():
            values = grams(word_hashes(words))
            if len(words) < GRAM + WINDOW - 1:
                for place, value in enumerate(values.tolist()):
                    self.short.setdefault(value, []).append((name, place))
                continue
            for place in winnowed(values).tolist():
                self.places.setdefault(int(values[place]), []).append((name, place))
        self.short_fingerprints = np.array(sorted(self.short), np.uint64)
        self.fingerprints = np.array(sorted({*self.places, *self.short}), np.uint64)


def aligned(template, words, start, band):
    """Best local alignment of the template with words from `start`, within `band` of the diagonal.

    Returns (score, matched words, first word, last word + 1).
    """
    best = (0, 0, start, start)
    above = {}
    for i, word in enumerate(template):
        row = {}
        for j in range(max(0, start + i - band), min(len(words), start + i + band + 1)):
            same = words[j] == word
            score, matched, first = above.get(j - 1, (0, 0, j))
            if score <= 0:
                score, matched, first = 0, 0, j
            ways = [(score + (1 if same else MISS), matched + same, first)]
            for score, matched, first in (above.get(j, (0, 0, j)), row.get(j - 1, (0, 0, j))):
                ways.append((score + GAP, matched, first))
            row[j] = max(ways, key=lambda w: w[:2])
            if row[j][0] > best[0] or (row[j][0] == best[0] and row[j][1] > best[1]):
                best = (row[j][0], row[j][1], row[j][2], j + 1)
        above = row
    return best


def found_in(text: str, index: Index, coverage: float):
    """(license, start, end, matched, template words) of the templates in a text.

    Templates share phrases: of places that overlap, the one with the most matched words counts.
    """
    words, spans = plain_words(text)
    values = grams(word_hashes(words))
    starts = {}
    for place in winnowed(values).tolist():
        for name, at in index.places.get(int(values[place]), ()):
            band = max(2, len(index.words[name]) // 8)
            starts.setdefault((name, (place - at) // band), place - at)
    found = []
    for place in np.flatnonzero(np.isin(values, index.short_fingerprints)).tolist():
        for name, at in index.short[int(values[place])]:
            template, first = index.words[name], place - at
            if words[first : first + len(template)] == template:
                found.append((name, first, first + len(template), len(template), len(template)))
    for (name, _), start in starts.items():
        template = index.words[name]
        band = max(2, len(template) // 8)
        score, matched, first, last = aligned(template, words, start, 2 * band)
        if matched >= coverage * len(template):
            found.append((name, first, last, matched, len(template)))
    kept = []  # places that do not overlap, in order
    for name, first, last, matched, size in sorted(found, key=lambda f: (-f[3], f[4], f[1], f[0])):
        at = bisect_left(kept, (first,))
        if (at == 0 or kept[at - 1][1] <= first) and (at == len(kept) or kept[at][0] >= last):
            kept.insert(at, (first, last, name, matched, size))
    return [(n, spans[a][0], spans[b - 1][1], m, size) for a, b, n, m, size in kept]


def scan_batches(shared, coverage):
    def run(batches):
        index = shared.value
        for batch in batches:
            texts = batch.column("text")
            words, counts = words_of(texts, lower=False)
            codes, distinct = coded(words)
            bare = pc.utf8_lower(pc.utf8_trim(distinct, characters=OUTER))
            keep = pc.not_equal(bare, "").to_numpy(zero_copy_only=False)[codes]
            owner = np.repeat(np.arange(len(counts)), counts)[keep]
            values = grams(hashes(bare)[codes[keep]])
            # Whatever is winnowed from a text with a template's words, or is a short template's
            # gram, is one of the fingerprints: texts without any are done with.
            at = np.searchsorted(index.fingerprints, values)
            hit = index.fingerprints[np.minimum(at, len(index.fingerprints) - 1)] == values
            rows = []
            for o in np.unique(owner[: len(values)][hit]).tolist():
                doc_id = batch.column("doc_id")[o].as_py()
                for name, start, end, matched, size in found_in(texts[o].as_py(), index, coverage):
                    rows.append((doc_id, name, start, end, matched, size, matched / size))
            if rows:
                names = [part.split()[0] for part in SCHEMA.split(", ")]
                kinds = [pa.int64(), pa.string(), *[pa.int32()] * 4, pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def find_licenses(docs: DataFrame, templates=None, coverage: float = COVERAGE) -> DataFrame:
    """A row per document and place of a license: doc_id, license, span, matched words, coverage.

    Spans are code points of the text, end exclusive. Null and empty texts give no row;
    repeated rows give theirs each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(scan_batches(shared, coverage), SCHEMA)
