"""Licence notices in documents, paragraph by paragraph.

Paragraphs: lines most of whose words are licence vocabulary, and that no blank line parts, are one paragraph (notices are
often wrapped), but a line that is a confirmed notice by itself, and as near to a template as the whole, stands alone, and
so do lines of several families; every other line is one by itself. A paragraph with
fewer than two words of the vocabulary is no notice. The word 1- and 2-grams that the vocabulary knows are the features of
a multinomial logistic regression over licence families, a class for licences of no known family (`unknown`) and one for
everything else; probabilities are calibrated by a temperature fitted on held-out examples. A paragraph whose licence
class is at least `probability` likely is reported. It is compared with the templates, and confirmed if it holds enough of
the word pairs of one of its family's, and no larger share of another family's; `unknown` is never confirmed.

The training examples are made here from the templates below, which are whole notices and paragraphs of licence texts
(words dropped and added, parts taken, case changed by a seeded generator), from notices of other licences (`unknown`),
sentences that talk of licences without granting one, and running text; nothing is read from a table.

Defined results: null or empty texts have no paragraphs; repeated paragraphs and rows are reported each; a null doc_id
is reported as null; other columns are ignored. A text is read whole, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactigrid.llm.common import python_ready

OTHER, UNKNOWN = "none", "unknown"

# Notices and paragraphs of each family's licence text, as they are commonly written.
_AS_IS = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. " + _AS_IS,
        "SPDX-License-Identifier: MIT",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "SPDX-License-Identifier: ISC",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Distributed under the GPLv3.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Distributed under the GPLv2.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Released under the AGPLv3.",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ),
    "zlib": (
        "Released under the zlib license.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution license.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under the Creative Commons Attribution-NonCommercial license for noncommercial use only.",
    ),
    "CC0": (
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ),
    "proprietary": (
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "This software is proprietary and confidential; unauthorized copying is strictly prohibited.",
        "Copyright. All rights reserved.",
    ),
}
# Notices of licences that have no family here; they stand for all others.
OTHER_LICENCES = (
    "Licensed under the European Union Public Licence, version 1.2.",
    "This font software is licensed under the SIL Open Font License, Version 1.1.",
    "This library is distributed under the terms of the Artistic License 2.0.",
    "This source file is subject to version 3.01 of the PHP license, that is bundled with this package in the file LICENSE.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "This code is licensed under the Microsoft Public License.",
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "Published under the terms of the Open Government Licence, version 3.",
    "You may use this material under the site licence that came with it, subject to its conditions.",
    "Licensed under the terms of the vendor agreement; redistribution is subject to its conditions.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
)
# Sentences with the same words that grant nothing, and function words.
NEAR_MISSES = (
    "His driver license expired in May and the office renewed it.",
    "The restaurant lost its liquor license after the version of events became public.",
    "A licensed electrician must check the work before general use.",
    "The public was free to attend and the terms were agreed later.",
    "She took poetic license with the source of the story.",
    "The Apache helicopter flew over the foundation at noon.",
    "The commons voted on the creative attribution of funds.",
    "Students at MIT built a public software lab in general use.",
    "The license plate was found under the clause of the contract.",
    "Rights and conditions of the agreement were met in writing.",
    "We license music for films and share the fee.",
    "The author reserved a table and all the guests came in version order.",
    "This website uses cookies to improve your experience.",
    "Mit der Zeit und mit den anderen ist es gut.",
    "Das ist mit dem neuen Buch nicht zu sehen.",
    "Sie kommt mit ihm von der Arbeit.",
    "Un permis de conduire pour le public en general.",
    "Permission to enter the building was granted by the general.",
    "A free copy of the brochure is available at the public library.",
)
_FUNCTION_WORDS = frozenset("a an the of and or to in on is are was be it its this that these with for by as at from not no you your we our his her he she they can may must will has have had any all other under into such who which but if so than then there out up".split())
_PARTS = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class LicenseParams:
    probability: float = 0.6
    #: Share of a template's word pairs that a confirmed paragraph holds.
    similarity: float = 0.6
    #: Share of a line's words that are licence vocabulary or function words, from which it may be part of a longer paragraph.
    covered: float = 0.75
    least_known: int = 2
    examples: int = 60
    ridge: float = 0.02
    steps: int = 250
    seed: int = 31


@dataclass(frozen=True)
class LicenseModel:
    families: tuple[str, ...]  # the last are UNKNOWN and OTHER
    vocabulary: dict[tuple[bytes, ...], int]
    weights: np.ndarray  # n-grams + 1, families
    temperature: float
    templates: dict[str, tuple[tuple[str, frozenset[tuple[bytes, bytes]]], ...]]  # text and word pairs
    anchors: frozenset[bytes]
    known: frozenset[bytes]  # words of the vocabulary


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_PARTS).split()


_STOP = frozenset(w.encode() for w in _FUNCTION_WORDS)


def ngrams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """1- and 2-grams with at least one word that isn't a function word."""
    return {(w,) for w in words if w not in _STOP} | {(a, b) for a, b in zip(words, words[1:], strict=False) if a not in _STOP or b not in _STOP}


def _covered(words: list[bytes], anchors: frozenset[bytes]) -> float:
    """Root of the share of words that licence notices use: features of a long text with one such word weigh little."""
    return (sum(w in anchors or w in _STOP for w in words) / max(1, len(words))) ** 0.5


def _known(vocabulary: dict) -> frozenset[bytes]:
    return frozenset(w for g in vocabulary for w in g if w not in _STOP)


def _examples(params: LicenseParams, seed: int) -> list[tuple[str, str]]:
    rng = np.random.default_rng((params.seed, seed))
    syllables = "an er th on ti re st en at ou ing es ch le que der ung ci mente la ver au lich de ent ra so".split()

    def noise(n: int) -> list[str]:
        return ["".join(syllables[int(rng.integers(len(syllables)))] for _ in range(int(rng.integers(1, 4)))) for _ in range(n)]

    def varied(text: str) -> str:
        words = [w for w in text.split() if rng.random() > 0.08] or text.split()
        if rng.random() < 0.3:
            words = noise(int(rng.integers(1, 6))) + words
        if rng.random() < 0.3:
            words += noise(int(rng.integers(1, 6)))
        out = " ".join(words)
        return out.upper() if rng.random() < 0.1 else out

    def part(text: str) -> str:
        """Half of the times, a run of a longer paragraph's words."""
        words = text.split()
        if len(words) < 24 or rng.random() < 0.5:
            return text
        n = int(rng.integers(12, len(words)))
        first = int(rng.integers(len(words) - n + 1))
        return " ".join(words[first : first + n])

    made = [(varied(part(t)), family) for family, texts in TEMPLATES.items() for t in texts for _ in range(max(8, params.examples // len(texts)))]
    made += [(varied(part(t)), UNKNOWN) for t in OTHER_LICENCES for _ in range(params.examples // 4)]
    made += [(varied(t), OTHER) for t in NEAR_MISSES for _ in range(params.examples // 4)]
    for _ in range(params.examples * 4):  # running text with single words of templates
        words = noise(int(rng.integers(3, 40)))
        texts = TEMPLATES[list(TEMPLATES)[int(rng.integers(len(TEMPLATES)))]]
        for w in rng.choice(texts[int(rng.integers(len(texts)))].split(), 2):
            words.insert(int(rng.integers(len(words))), str(w))
        made.append((" ".join(words), OTHER))
    made += [(" ".join([*noise(int(rng.integers(0, 9))), w, *noise(int(rng.integers(1, 9)))]), OTHER) for texts in TEMPLATES.values() for t in texts for w in t.split()]  # one word of a template says nothing
    return made


def _table(examples: list[tuple[str, str]], vocabulary: dict, families: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(examples), len(vocabulary) + 1))
    x[:, -1] = 1
    anchors = _known(vocabulary)
    for i, (text, _) in enumerate(examples):
        words = words_of(text.encode())
        found = [vocabulary[g] for g in ngrams(words) if g in vocabulary]
        x[i, found] = _covered(words, anchors) / np.sqrt(max(1, len(found)))
    return x, np.array([families.index(f) for _, f in examples])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@lru_cache(maxsize=4)
def fit(params: LicenseParams = LicenseParams()) -> LicenseModel:
    families = (*TEMPLATES, UNKNOWN, OTHER)
    known = sorted({g for text in [t for ts in TEMPLATES.values() for t in ts] + [*OTHER_LICENCES, *NEAR_MISSES] for g in ngrams(words_of(text.encode()))})
    vocabulary = {g: i for i, g in enumerate(known)}
    x, y = _table(_examples(params, 0), vocabulary, families)
    target = np.eye(len(families))[y]
    w = np.zeros((x.shape[1], len(families)))
    moment = np.zeros_like(w)
    for _ in range(params.steps):  # full-batch gradient descent with momentum
        gradient = x.T @ (_softmax(x @ w) - target) / len(x) + params.ridge / len(x) * w
        moment = 0.9 * moment - 4.0 * gradient
        w += moment
    held, truth = _table(_examples(params, 1), vocabulary, families)
    z = held @ w
    losses = {t: -np.log(_softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.2, 5, 40)}
    pairs = lambda t: (w := words_of(t.encode())) and frozenset(zip(w, w[1:], strict=False))
    templates = {f: tuple((t, pairs(t)) for t in ts) for f, ts in TEMPLATES.items()}
    anchors = frozenset(w for texts in (*TEMPLATES.values(), OTHER_LICENCES) for t in texts for w in words_of(t.encode()) if w not in _STOP)
    return LicenseModel(families, vocabulary, w, float(min(losses, key=losses.get)), templates, anchors, _known(vocabulary))


def probabilities(words: list[bytes], model: LicenseModel) -> np.ndarray:
    found = [model.vocabulary[g] for g in ngrams(words) if g in model.vocabulary]
    z = model.weights[found].sum(0) * (_covered(words, model.known) / np.sqrt(max(1, len(found)))) + model.weights[-1]
    return _softmax(z[None] / model.temperature)[0]


def _judged(words: list[bytes], model: LicenseModel, params: LicenseParams) -> tuple[str, float, str, float, bool] | None:
    """(family, probability, nearest template, similarity, confirmed), None for what is no licence."""
    p = probabilities(words, model)
    best = int(p.argmax())
    family = model.families[best]
    if family == OTHER or p[best] < params.probability:
        return None
    if family == UNKNOWN:
        return family, float(p[best]), None, None, False
    own = set(zip(words, words[1:], strict=False))
    nearest = {f: max((len(own & t) / len(t), name) for name, t in templates) for f, templates in model.templates.items()}
    similarity, template = nearest[family]
    return family, float(p[best]), template, similarity, similarity >= params.similarity and similarity >= max(nearest.values())[0]


def classify(text: bytes, model: LicenseModel, params: LicenseParams = LicenseParams()) -> list[tuple]:
    """(line of the paragraph's begin, its lines, family, probability, nearest template, similarity, confirmed) of the licence paragraphs of a text."""
    if model.anchors.isdisjoint(words_of(text)):
        return []
    out: list[tuple] = []
    run: list[tuple[int, list[bytes]]] = []  # covered lines that follow each other

    def judge(lines: list[tuple[int, list[bytes]]]) -> tuple | None:
        words = [w for _, own in lines for w in own]
        if sum(w in model.anchors for w in words) >= params.least_known and (found := _judged(words, model, params)):
            return lines[0][0], len(lines), *found
        return None

    def close() -> None:
        alone = [judge([line]) for line in run] if len(run) > 1 else []
        confirmed = [r for r in alone if r and r[6]]
        whole = judge(run) if run and len({r[2] for r in confirmed}) < 2 else None
        if confirmed and not (whole and whole[6] and whole[5] > max(r[5] for r in confirmed)):
            part: list[tuple[int, list[bytes]]] = []
            for line, found in zip(run, alone, strict=True):
                if found and found[6]:
                    out.extend(r for r in (judge(part) if part else None, found) if r)
                    part = []
                else:
                    part.append(line)
            whole = judge(part) if part else None
        if whole:
            out.append(whole)
        run.clear()

    for number, line in enumerate(text.split(b"\n")):
        words = words_of(line)
        known = sum(w in model.anchors for w in words)
        if known and known + sum(w in _STOP for w in words) >= params.covered * len(words):
            run.append((number, words))
            continue
        close()
        if known and (found := judge([(number, words)])):
            out.append(found)
    close()
    return out


def scan(docs: DataFrame, params: LicenseParams = LicenseParams()) -> DataFrame:
    """doc_id, paragraph (its first line's number, from 0), n_lines, family, probability, template, similarity, confirmed."""
    python_ready(docs.sparkSession)
    model = fit(params)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *r) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True) if t for r in classify(t, model, params)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "paragraph", "n_lines", "family", "probability", "template", "similarity", "confirmed"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(read, "doc_id long, paragraph int, n_lines int, family string, probability double, template string, similarity double, confirmed boolean")
