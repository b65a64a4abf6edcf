"""License scans: normalised text against license templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versewise.llm.scratch import bound_batches
from versewise.llm.texthash import blocks, gram_hashes, word_hashes

# License identifiers, the names they go by in notices, the forms of notices, and some full texts.
NAMES = {
    "MIT": ["MIT License", "MIT Licence"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero v1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "Unlicense": ["The Unlicense"],
}
FORMS = ["Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "This software is distributed under the terms of the {}.", "This project is available under the {}."]
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: The notice of the GNU licenses, and what it says of each.
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this program. If not, see https://www.gnu.org/licenses/."
GNU_NAMES = {"GPL-2.0": ("GNU General Public License", 2), "GPL-3.0": ("GNU General Public License", 3), "LGPL-3.0": ("GNU Lesser General Public License", 3), "AGPL-3.0": ("GNU Affero General Public License", 3)}
#: The clauses of the BSD licenses.
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: ",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. ",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
#: Production threshold of the Dice coefficient.
MIN_DICE = 0.85
MATCH = "struct<license:string,dice:double,unit:string,line:int>"


def default_templates() -> dict[str, list[str]]:
    """License identifier -> template texts: every notice form with every name, and the full texts."""
    out = {k: [form.format(name) for name in names for form in FORMS] for k, names in NAMES.items()}
    texts = TEXTS | {k: GNU.format(name=name, version=version) for k, (name, version) in GNU_NAMES.items()}
    texts |= {"BSD-3-Clause": "".join(BSD), "BSD-2-Clause": "".join(BSD[:3] + BSD[4:])}
    for k, text in texts.items():
        out.setdefault(k, []).append(text)
    return out


#: Known bigrams of one run are at most so far apart; a stretch of runs holds so large a share of them, and begins at most
#: so many runs before one that could match by itself.
REACH, DENSITY, BACK = 6, 0.6, 3


def stretches(known: np.ndarray, texts: np.ndarray, least: int, most: int) -> list[tuple[int, int]]:
    """Ranges of places in which known bigrams stand densely, the longest first: runs of them, and neighbouring runs.

    ``known`` are the places of known bigrams, in order, and ``texts`` the texts that they are in. One run at least holds
    ``least`` of them; ranges of more than ``most`` places are left out.
    """
    breaks = np.flatnonzero((np.diff(known) > REACH) | np.diff(texts).astype(bool)) + 1
    firsts, lasts = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(known)]))
    found = set()
    for i in np.flatnonzero(lasts - firsts >= least):
        for low in range(i, max(-1, i - BACK - 1), -1):
            for high in range(i, len(firsts)):
                a, b = int(known[firsts[low]]), int(known[lasts[high] - 1]) + 1
                if texts[firsts[low]] != texts[firsts[high]] or b - a > most or lasts[high] - firsts[low] < DENSITY * (b - a):
                    break
                found.add((a, b))
    return sorted(found, key=lambda x: (x[0] - x[1], x))


@dataclass(frozen=True)
class TemplateIndex:
    """Bigram sets of all templates by size, so that a unit meets only templates that its size allows."""

    licenses: list[str]
    grams: list[np.ndarray]
    sizes: np.ndarray  # ascending
    vocabulary: np.ndarray

    @classmethod
    def build(cls, templates: Mapping[str, list[str]]) -> TemplateIndex:
        rows = {}
        for name in sorted(templates):
            for text in templates[name]:
                words, _ = word_hashes(pa.array([text]))
                grams = np.unique(gram_hashes(words, 2))
                if len(grams):
                    rows.setdefault(grams.tobytes(), (len(grams), name, grams))
        found = sorted(rows.values(), key=lambda r: (r[0], r[1], r[2].tobytes()))
        return cls([r[1] for r in found], [r[2] for r in found], np.array([r[0] for r in found]), np.unique(np.concatenate([r[2] for r in found])))

    def best(self, grams: np.ndarray, threshold: float) -> list[tuple[str, float]]:
        """(license, dice) of the licenses whose best template reaches the threshold, best first.

        Dice 2|A & B| / (|A| + |B|) of at least t needs sizes within a factor of t / (2 - t) of each other.
        """
        bound = threshold / (2 - threshold)
        lo = np.searchsorted(self.sizes, np.ceil(len(grams) * bound - 1e-9))
        hi = np.searchsorted(self.sizes, np.floor(len(grams) / bound + 1e-9), side="right")
        best: dict[str, float] = {}
        for k in range(lo, hi):
            dice = 2 * len(np.intersect1d(grams, self.grams[k], assume_unique=True)) / (len(grams) + len(self.grams[k]))
            if dice >= threshold - 1e-12:
                best[self.licenses[k]] = max(dice, best.get(self.licenses[k], 0.0))
        return sorted(best.items(), key=lambda x: (-x[1], x[0]))


def scan_licenses(docs: DataFrame, templates: Mapping[str, list[str]] | None = None, threshold: float = MIN_DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, matches)``: a row per document; matches are (license, dice, unit, line), in order.

    Four kinds of units are compared: the whole text, its paragraphs (runs of lines with words), its lines, and
    stretches in which bigrams of templates stand densely, wherever they begin and whatever paragraphs they cross; a
    unit equal in words to a larger one is reported for the larger, and a stretch only where no other unit that it
    overlaps has matched the license. Text is normalised to lower-cased words of
    letters and digits; ``line`` is the number (from 0) of the unit's first line. A unit is compared only with
    templates that its number of distinct bigrams allows, and only if enough of its bigrams occur in any template.
    A unit of one word has that word as its only bigram. Null, empty and wordless texts match nothing.
    """
    index = TemplateIndex.build(templates or default_templates())
    least = int(np.ceil(index.sizes[0] * threshold / (2 - threshold) - 1e-9))
    most = int(index.sizes[-1] * (2 - threshold) / threshold / DENSITY)
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, matches array<{MATCH}>"
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("unit", pa.string()), ("line", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column(1)):
                words, at, lines, gap, line0 = word_hashes(texts, with_lines=True)
                out: list[list[dict]] = [[] for _ in range(len(texts))]
                if len(words):
                    pairs = gram_hashes(words, 2) if len(words) > 1 else words[:0]
                    place = np.minimum(np.searchsorted(index.vocabulary, pairs), len(index.vocabulary) - 1)
                    known = np.concatenate(([0], (index.vocabulary[place] == pairs).cumsum()))
                    known = np.append(known, known[-1])  # texts without words may begin at the end
                    news = np.flatnonzero(np.diff(lines, prepend=-1))
                    edges = {"text": at, "paragraph": np.append(np.flatnonzero(gap), len(words)), "line": np.append(news, len(words))}
                    seen: set[tuple[int, int]] = set()
                    taken: dict[tuple[int, str], list[tuple[int, int]]] = {}
                    for unit, bounds in edges.items():
                        starts, ends = bounds[:-1], bounds[1:]
                        hits = known[np.maximum(ends - 1, starts)] - known[starts]
                        for k in np.flatnonzero((hits >= least) | ((ends - starts == 1) & (least <= 1))):
                            a, b = int(starts[k]), int(ends[k])
                            if (a, b) in seen:
                                continue
                            seen.add((a, b))
                            doc = int(np.searchsorted(at, a, side="right")) - 1
                            for name, dice in index.best(np.unique(gram_hashes(words[a:b], 2)), threshold):
                                out[doc].append({"license": name, "dice": dice, "unit": unit, "line": int(lines[a] - line0[doc])})
                                taken.setdefault((doc, name), []).append((a, b))
                    hit = np.flatnonzero(np.diff(known[: len(pairs) + 1]))
                    owner = np.searchsorted(at, hit, side="right")
                    same = owner == np.searchsorted(at, hit + 1, side="right")  # no bigram of two texts
                    for a, b in stretches(hit[same], owner[same], least, most) if same.any() else ():
                        if (a, b + 1) in seen:
                            continue
                        doc = int(np.searchsorted(at, a, side="right")) - 1
                        for name, dice in index.best(np.unique(gram_hashes(words[a : b + 1], 2)), threshold):
                            held = taken.setdefault((doc, name), [])
                            if not any(x < b + 1 and a < y for x, y in held):
                                out[doc].append({"license": name, "dice": dice, "unit": "stretch", "line": int(lines[a] - line0[doc])})
                                held.append((a, b + 1))
                for x in out:
                    x.sort(key=lambda m: (-m["dice"], m["license"], m["line"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(out, kind)], ["doc_id", "matches"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
