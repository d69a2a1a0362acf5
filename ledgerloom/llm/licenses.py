"""License scans: winnowed template fingerprints in an inverted index, then banded alignment.

Word n-grams of a text and of the templates are winnowed alike: of each few consecutive n-grams the one with
the smallest hash is kept, so any shared run of words of some length shares a fingerprint. An index from
fingerprint to template and place proposes where a template may stand; a banded alignment of its words
against the text there counts the matched words and finds the span. The templates have a fixed size, so the
index is broadcast, and documents are only scanned.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALPHANUMERIC, Words, chain, slices
from .shared import texts

GRAM, WINNOW, BAND = 3, 2, 6
#: The least share of a template's words that must be matched in order.
COVERAGE = 0.8

#: Notices and whole texts (without the copyright line) of well-known licenses, as their publishers word them.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense-whole": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}


def winnow(hashes: np.ndarray, n: int = WINNOW) -> np.ndarray:
    """Places of the smallest hash of each n consecutive ones (the first of equals); all if there are fewer."""
    if len(hashes) <= n:
        return np.arange(len(hashes))
    windows = np.lib.stride_tricks.sliding_window_view(hashes, n)
    return np.unique(windows.argmin(1) + np.arange(len(windows)))


class Index:
    """Fingerprints of templates with (template, place); a template shorter than an n-gram has one of all its words."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        words = Words(pa.array([templates[n] for n in self.names], pa.large_string()), ALPHANUMERIC)
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, own in enumerate(self.words):
            if not len(own):
                continue
            grams = chain(own, min(GRAM, len(own)))
            for at in winnow(grams).tolist():
                self.places[int(grams[at])].append((t, at))
        self.widths = sorted({min(GRAM, len(w)) for w in self.words if len(w)})
        self.prints = np.array(sorted(self.places), np.uint64)


def align(template: np.ndarray, text: np.ndarray, start: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched, first, last) of the best local alignment of template word i with text word start + i +- band.

    A matched word counts 2, a word left out between matches -1. first and last are word places in the text.
    """
    width = 2 * band + 1
    none = (0, 0, 0)  # score, matched, -first
    before, found = [none] * (width + 2), (0, 0, 0, 0)
    for i, word in enumerate(template.tolist()):
        now = [none] * (width + 2)
        for j in range(width):
            at = start + i + j - band
            up, left = before[j + 2], now[j]  # the template word, or the text word, is left out
            best = max((up[0] - 1, *up[1:]), (left[0] - 1, *left[1:]), none)
            if 0 <= at < len(text) and int(text[at]) == word:
                score, matched, first = before[j + 1]
                hit = (score + 2, matched + 1, first if matched else -at)
                best = max(best, hit)
                found = max(found, (*hit, -at))
            now[j + 1] = best if best[0] > 0 else none
        before = now
    _, matched, first, last = found
    return matched, -first, -last


def _find(index: Index, coverage: float, batches):
    for part in slices(batches):
        words = Words(part.column("text"), ALPHANUMERIC)
        row_of = np.repeat(np.arange(part.num_rows), words.count())
        starts: dict[tuple[int, int], list[int]] = defaultdict(list)
        for width in index.widths:
            grams = chain(words.hash, width)
            spots = np.searchsorted(index.prints, grams)
            near = np.flatnonzero(index.prints[np.minimum(spots, len(index.prints) - 1)] == grams) if len(index.prints) else []
            for at in near:
                if row_of[at] == row_of[at + width - 1]:
                    for t, place in index.places[int(grams[at])]:
                        starts[int(row_of[at]), t].append(int(at - words.first[row_of[at]]) - place)
        out = []
        for (row, t), guesses in sorted(starts.items()):
            own = words.hash[words.first[row] : words.first[row + 1]]
            template, covered = index.words[t], -1
            band = max(1, min(BAND, len(template) // 3))
            last = None
            for guess in sorted(guesses):
                if last is not None and guess - last <= band // 2:
                    continue
                last = guess
                matched, first, end = align(template, own, guess, band)
                if matched >= coverage * len(template) and first > covered:
                    covered = end
                    base = words.first[row]
                    out.append((row, t, int(words.start[base + first] - words.rows[row]), int(words.end[base + end] - words.rows[row]), matched, matched / len(template)))
        texts_of = {row: part.column("text")[row].as_py().encode() for row in {o[0] for o in out}}
        points = [(len(texts_of[r][:a].decode()), len(texts_of[r][:b].decode())) for r, _, a, b, *_ in out]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id").take(pa.array([o[0] for o in out], pa.int64())),
                pa.array([index.names[o[1]] for o in out], pa.string()),
                pa.array([p[0] for p in points], pa.int64()),
                pa.array([p[1] for p in points], pa.int64()),
                pa.array([o[4] for o in out], pa.int64()),
                pa.array([o[5] for o in out], pa.float64()),
            ],
            ["doc_id", "license", "start", "end", "n_matched", "coverage"],
        )


#: The most characters that a table of templates may have, as its index is broadcast.
MOST_TEMPLATE_CHARS = 50_000_000


def read_templates(templates: DataFrame) -> dict[str, str]:
    """Templates from a table (license, text), whose size is checked; rows without either are left out, of repeated names the least text stays."""
    named = templates.where(F.col("license").isNotNull() & F.col("text").isNotNull()).groupBy("license").agg(F.min("text").alias("text"))
    size = named.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > MOST_TEMPLATE_CHARS:
        raise ValueError(f"templates of {size} characters are more than {MOST_TEMPLATE_CHARS}")
    return {r["license"]: r["text"] for r in named.collect()}


def find_licenses(documents: DataFrame, templates: dict[str, str] | DataFrame | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per place where a template stands: doc_id, license, start and end (code points), n_matched words, coverage.

    Templates are those built in, others by name, or a table (license, text). Case and punctuation don't count. Null and
    empty texts have none; repeated rows are each scanned; other columns are ignored. Matches of one template don't
    overlap. A whole license text and the notices within it are separate templates, and each is reported.
    """
    known = TEMPLATES if templates is None else read_templates(templates) if isinstance(templates, DataFrame) else templates
    held = documents.sparkSession.sparkContext.broadcast(Index(known))
    key = documents.schema["doc_id"].dataType.simpleString()
    return texts(documents, "doc_id").mapInArrow(lambda b: _find(held.value, coverage, b), f"doc_id {key}, license string, start long, end long, n_matched long, coverage double")
