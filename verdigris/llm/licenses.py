"""Operator 6: license scans by MinHash bands over overlapping text windows, verified by exact shingle containment.

For templates of s distinct shingles (five words each; a shorter template or text is a single shingle of all its words) a text's shingles are
taken in windows of 2·s that start every s, so each stretch of s shingles lies whole in a window.  A window that holds a
share c of a template's shingles has a Jaccard similarity of c / (3 − c) with it at least; the number of bands (of one
MinHash value each) is the least for which such a window goes without any collision with a probability below `miss`.
Colliding pairs of window and template are verified: the share of the template's distinct shingles that the window has
must be `containment` or more.  Verified windows of a template that touch are one occurrence.

Templates are a stated, bounded query set (`most_templates`); documents are never shuffled: the scan is a map.

Defined cases: null and wordless texts and templates match nothing; texts of any length are taken whole; ids may be of any
type; equal templates under two names both match; repeated
documents each have their rows; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import WORDS, as_bytes, rolling, slices
from verdigris.llm.decontaminate import words_of

# The usual statements and headers of public licenses, and whole short licenses, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT-text", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("MIT-whole", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC-whole", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-3-Clause-whole", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Zlib-whole", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0-whole", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Unlicense-whole", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
]
SHINGLE = 5


def shingle_run(words: list[bytes]) -> np.ndarray:
    """The hashes of a text's shingles in order."""
    h = WORDS.of(words)
    return rolling(h, min(SHINGLE, len(h))) if len(h) else np.empty(0, np.uint64)


def bands_for(similarity: float, miss: float) -> int:
    """MinHash values of which none agrees, at that Jaccard similarity, with a probability below miss."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - similarity)))


class Bank:
    """Templates by their number of shingles, with the MinHash values of each band."""

    def __init__(self, templates: list[tuple[str, str]], containment: float, miss: float):
        self.containment = containment
        self.bands = bands_for(containment / (3 - containment), miss)
        seeds = [xxhash.xxh3_64_intdigest(b"band%d" % i) for i in range(2 * self.bands)]
        self.xor = np.array(seeds[: self.bands], np.uint64)
        self.odd = np.array(seeds[self.bands :], np.uint64) | np.uint64(1)
        self.names, self.sets = [], []
        self.classes: dict[int, list[int]] = defaultdict(list)
        for name, text in templates:
            got = np.unique(shingle_run(words_of((text or "").encode())))
            if len(got):
                self.classes[len(got)].append(len(self.names))
                self.names.append(name)
                self.sets.append(got)
        self.tables = {}
        for size, members in self.classes.items():
            values = np.stack([[((self.sets[m] ^ x) * o).min() for m in members] for x, o in zip(self.xor, self.odd, strict=True)])
            gate = np.zeros((self.bands, 1 << 16), bool)
            for band in range(self.bands):
                gate[band, values[band] >> np.uint64(48)] = True
            self.tables[size] = (members, values, gate)

    def scan(self, runs: list[np.ndarray]) -> dict[tuple[int, int], list[tuple[int, int, float]]]:
        """(text, template) → (first shingle, last shingle, containment) of each occurrence; runs: the texts' shingles."""
        length = np.array([len(r) for r in runs], np.int64)
        begin = np.cumsum(length) - length
        every = np.concatenate(runs)
        windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in self.tables:
            blocks = -(-length // size)
            text = np.repeat(np.arange(len(runs)), blocks)
            place = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            windows[size] = text, place, begin[text] + place * size
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        for band in range(self.bands if len(every) else 0):
            h = (every ^ self.xor[band]) * self.odd[band]
            for size, (members, values, gate) in self.tables.items():
                text, place, starts = windows[size]
                least = h if size == 1 else np.minimum.reduceat(h, starts)
                least = np.append(np.where(text[1:] == text[:-1], np.minimum(least[:-1], least[1:]), least[:-1]), least[-1])
                for w in np.flatnonzero(gate[band, least >> np.uint64(48)]).tolist():
                    for m, v in zip(members, values[band], strict=True):
                        if least[w] == v:
                            found[int(text[w]), m].add(int(place[w]))
        out = {}
        for (t, m), places in found.items():
            run, size, own, hits = runs[t], len(self.sets[m]), self.sets[m], []
            for w in sorted(places):
                part = run[w * size : (w + 2) * size]
                share = len(np.intersect1d(part, own)) / size
                if share >= self.containment:
                    at = np.flatnonzero(np.isin(part, own)) + w * size
                    a, b = int(at[0]), int(at[-1])
                    if hits and a <= hits[-1][1] + 1:
                        hits[-1] = (hits[-1][0], max(b, hits[-1][1]), max(share, hits[-1][2]))
                    else:
                        hits.append((a, b, share))
            if hits:
                out[t, m] = hits
        return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, *, containment: float = 0.8, miss: float = 1e-4, most_templates: int = 10_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document and template that occurs in it: license, occurrences, the best containment, and the words from the first occurrence's start to its end."""
    templates = TEMPLATES if templates is None else templates
    if len(templates) > most_templates:
        raise ValueError(f"more than {most_templates} templates")
    held = docs.sparkSession.sparkContext.broadcast(templates)
    names = ["doc_id", "template", "license", "occurrences", "containment", "first_word", "last_word"]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank = Bank(held.value, containment, miss)
        for b in slices(batches):
            texts = [words_of(x) for x in as_bytes(b.column(1))]
            rows, source = [], []
            for (i, m), hits in sorted(bank.scan([shingle_run(x) for x in texts]).items()):
                source.append(i)
                rows.append((m, bank.names[m], len(hits), max(h[2] for h in hits), hits[0][0], min(hits[0][1] + SHINGLE, len(texts[i])) - 1))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(source)), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, template int, license string, occurrences long, containment double, first_word long, last_word long")
