"""License scan: phrases of consecutive words, and an exact set-similarity join of text blocks with license templates.

A block is a run of words one and a half times as long as a template, taken at every quarter of the template's
length, so that every passage of the template's length lies whole in some block. A block meets a template when it
holds at least ``THRESHOLD`` of the template's distinct words. Candidates come from the usual filters, none of
which loses a block:

* words are ordered by how many documents of the whole corpus hold them, rarest first;
* prefix: a block that holds ``need`` of a template's n words holds one of its first n - need + 1;
* length: a block with fewer distinct template words than ``need`` cannot meet it;
* position: if the first common word is the template's i-th, at most n - i more can be common.

Words are runs of ASCII letters, digits and any other characters beyond ASCII, with A-Z lower-cased. Missing and
empty texts have no words, no labels and score 0; repeated rows are scanned each for itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.9

# Phrase and label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Well-known notices and grants in short; several templates may carry one label.
_NOTICES: list[tuple[str, str]] = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
]

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_FREE_SOFTWARE = """This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the
Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this program. If not, see
https://www.gnu.org/licenses/"""

# Whole short licenses, and the whole notices by which longer ones are put on a file.
_LICENSES: list[tuple[str, str]] = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject
to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. """ + _AS_IS),
    ("bsd-2-clause", _BSD_CONDITIONS + " " + _BSD_WARRANTY),
    ("bsd-3-clause", _BSD_CONDITIONS + " " + _BSD_NAMES + " " + _BSD_WARRANTY),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
and by any means."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", _FREE_SOFTWARE.format(name="GNU General Public License", version="3")),
    ("lgpl", _FREE_SOFTWARE.format(name="GNU Lesser General Public License", version="2.1")),
    ("agpl", _FREE_SOFTWARE.format(name="GNU Affero General Public License", version="3")),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("cc-by-sa", """This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this
license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."""),
]
TEMPLATES = _NOTICES + _LICENSES

_LETTERS = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() and b < 0x80 else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


@dataclass(frozen=True)
class Template:
    label: str
    order: dict[bytes, int]  # distinct words, rarest in the corpus first
    need: int
    prefix: frozenset[bytes]
    block: int
    step: int


def prepare(templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float = THRESHOLD) -> list[Template]:
    made = []
    for label, text in templates:
        words = words_of(text)
        ordered = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
        need = max(1, -int(-threshold * len(ordered) // 1))
        made.append(
            Template(
                label, {w: i for i, w in enumerate(ordered)}, need, frozenset(ordered[: len(ordered) - need + 1]),
                len(words) * 3 // 2 + 1, max(1, len(words) // 4),
            )
        )
    return made


def met_blocks(words: list[bytes], places: list[int], template: Template) -> list[tuple[int, int]]:
    """Every block that meets the template: its first word, and how many of the template's distinct words it holds.

    ``places`` are where words of any template stand.
    """
    order, n = template.order, len(template.order)
    own = [(p, order[words[p]]) for p in places if words[p] in order]
    if len({rank for _, rank in own}) < template.need:
        return []
    step, block = template.step, template.block
    starts = set()
    for place, rank in own:
        if rank <= n - template.need:  # a word of the prefix
            low = max(0, place - block + 1)
            starts.update(range(-(-low // step) * step, place + 1, step))
    left = right = 0
    found = []
    held: Counter[int] = Counter()
    for start in sorted(starts):
        while right < len(own) and own[right][0] < start + block:
            held[own[right][1]] += 1
            right += 1
        while left < right and own[left][0] < start:
            held[own[left][1]] -= 1
            if not held[own[left][1]]:
                del held[own[left][1]]
            left += 1
        if len(held) >= template.need and n - min(held) >= template.need:
            found.append((start, len(held)))
    return found


class LicenseScanner:
    def __init__(self, templates: list[Template]):
        self._templates = templates
        self._rare = frozenset().union(*(t.prefix for t in templates))
        self._known = frozenset().union(*(t.order for t in templates))
        self._phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]

    def scan(self, text: str) -> dict:
        words = words_of(text)
        base: list[tuple[int, str]] = []
        if b"license" in words:
            ends = [i for i, w in enumerate(words) if w == b"license"]
            for phrase, label in self._phrases:
                n = len(phrase)
                base += [(e - n + 1, label) for e in ends if e >= n - 1 and words[e - n + 1 : e + 1] == phrase]
        labels = {label for _, label in base}
        score = 1.0 if base else 0.0
        own = set(labels)
        blocks = []
        if not self._rare.isdisjoint(words):
            known = self._known
            places = [i for i, w in enumerate(words) if w in known]
            for template in self._templates:
                for start, held in met_blocks(words, places, template):
                    share = held / len(template.order)
                    own.add(template.label)
                    score = max(score, share)
                    blocks.append({"label": template.label, "start": start, "end": min(len(words), start + template.block), "share": share})
        places = [p for p, _ in base]
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(labels)),
            "labels": ",".join(sorted(own)),
            "score": score,
            "blocks": blocks,
        }


def template_word_frequency(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> dict[bytes, int]:
    """In how many documents each word of a template occurs, over the whole corpus; one row per template word."""
    known = frozenset(w for _, text in templates for w in words_of(text))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(known.intersection(words_of(text)))
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counted = text.mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


_RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,start:long,end:long,share:double>>"
_COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]


def license_column(text: Column, templates: list[Template]) -> Column:
    @F.pandas_udf(_RESULT)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = LicenseScanner(templates)
        for texts in batches:
            frame = pd.DataFrame([scanner.scan(t) for t in texts], columns=_COLUMNS)
            yield frame.astype({"first_word": "Int64", "last_word": "Int64", "score": "float64"})

    return scanned(F.coalesce(text, F.lit("")))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id`` and the columns of ``_RESULT`` for every row; ``blocks`` by template, then place, words from 0 and ends exclusive."""
    ordered = prepare(templates, template_word_frequency(docs, templates), threshold)
    return docs.select("doc_id", license_column(F.col("text"), ordered).alias("found")).select("doc_id", "found.*")
