"""Licence scans: a trained paragraph classifier, with a calibrated unknown class and template comparison.

A sparse logistic regression over word uni- and bigrams assigns a unit of text (a paragraph, or a sentence of
a long one) to a licence family or to 'unknown'. It is trained here, in numpy, on pieces of the family templates
below with seeded perturbations; unknown examples are sentences about licences that grant none, word salads made from
the templates, and units from a bounded sample of the corpus (SAMPLE_DOCUMENTS, SAMPLE_UNITS of each) that share no template
trigram. A temperature calibrates the probabilities; it is fitted on examples of templates that a model fitted without them scores, so
that no example and its own perturbations are on both sides. A prediction stands only if enough of the unit's bigrams also
come from a template of the predicted family.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require

# Paragraphs of public licences, and the statements by which files name them, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Licensed under the GNU AGPL version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. The ASF licenses this file to You under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "boost": (
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.",
        "Available under the Creative Commons Attribution license.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/.",
        "Available for noncommercial use under the Creative Commons Attribution NonCommercial license.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/.",
        "Text is available under the Creative Commons Attribution ShareAlike License.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
        "You can copy, modify, distribute and perform the work, even for commercial purposes, all without asking permission.",
    ),
    "epl-2.0": (
        "Eclipse Public License - v 2.0",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program.",
        "Released under the GNU GPL version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Licensed under the MIT license. See LICENSE for details.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "Copyright (c) the authors. All rights reserved.",
        "This document is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.",
    ),
    "wtfpl": (
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004",
        "This work is free. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "This notice may not be removed or altered from any source distribution.",
    ),
}
# Sentences about licences that are none.
ABOUT: tuple[str, ...] = (
    "He renewed his driving license last week.", "The license plate of the car was stolen.", "The bar lost its liquor license.", "Which license should I choose for my project?",
    "The software is popular and the license is a topic of debate.", "The version of the file was released under pressure.", "This program was written in the public library.",
    "The general public may visit the work at the museum.", "Use of this door is not permitted.", "The copy of the book was sold without a cover.", "Sales rose under the new version of the plan.",
    "The rights to the film were sold.", "A poetic license is taken in this translation.", "The foundation was published as a free copy.", "The MIT campus is in Cambridge.", "Creative work is common in this school.",
    "The apache helicopter was released into service.", "The fishing license costs ten dollars.", "Released in May, the work sold well.", "The terms of the agreement are under review.",
)
UNKNOWN = "unknown"
#: Documents whose units are examples of the unknown class, units of each, and words of each unit.
SAMPLE_DOCUMENTS, SAMPLE_UNITS, SAMPLE_WORDS = 2000, 4, 60
FOLDS = 3
#: Probability of any family from which a unit is a licence's, and of a family from which it is compared with its templates.
MIN_PROBABILITY, MIN_FAMILY = 0.6, 0.05
MIN_TEMPLATE_SHARE = 0.6
LONG_UNIT_WORDS = 40

_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_SENTENCE = re.compile(r"(?<=[.!?:;])[ \t]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of the units of a text: paragraphs, where wrapped lines are joined, and sentences of long ones.

    A line goes on in the next if it is short (under 100 characters), neither of them is blank, and it does not end a sentence.
    """
    spans, begin, at = [], None, 0
    for line in text.split("\n"):
        end = at + len(line)
        stripped = line.strip()
        if stripped:
            begin = at if begin is None else begin
            if len(line) >= 100 or stripped[-1] in ".!?:;":
                spans.append((begin, end))
                begin = None
        elif begin is not None:
            spans.append((begin, at - 1))
            begin = None
        at = end + 1
    if begin is not None:
        spans.append((begin, len(text)))
    out = []
    for a, b in spans:
        if text.count(" ", a, b) < LONG_UNIT_WORDS:
            out.append((a, b))
            continue
        at = a
        for m in _SENTENCE.finditer(text, a, b):
            out.append((at, m.start()))
            at = m.end()
        out.append((at, b))
    return out


def ngrams(words: list[str]) -> set:
    return set(words).union(zip(words, words[1:]))


@dataclass
class Model:
    """Weights by n-gram, template bigrams by family, temperature."""

    families: list[str]
    index: dict
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: dict[str, list[set]]

    def probabilities(self, grams: set) -> np.ndarray:
        ids = [self.index[g] for g in grams if g in self.index]
        z = (self.bias + (self.weights[ids].sum(0) / np.sqrt(len(ids)) if ids else 0)) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def template_share(self, family: str, words: list[str]) -> tuple[float, float]:
        """The greatest part of the unit's bigrams, or of a template's, that both hold; and the likeness of the likest template."""
        own = set(zip(words, words[1:])) or {(w,) for w in words}
        both = [(len(own & t), len(t)) for t in self.templates[family]]
        return max((n / max(1, min(len(own), size)) for n, size in both), default=0.0), max((2 * n / (len(own) + size) for n, size in both), default=0.0)

    def classify(self, text: str) -> tuple[str, float]:
        """(family, its probability), or unknown and that one's. Of the families that the model doesn't rule out, templates choose."""
        words = words_of(text)
        p = self.probabilities(ngrams(words))
        unknown = self.families.index(UNKNOWN)
        if 1 - p[unknown] >= MIN_PROBABILITY:
            likely = [(*self.template_share(f, words), x, f) for f, x in zip(self.families, p.tolist()) if f != UNKNOWN and x >= MIN_FAMILY]
            likely = [x for x in likely if x[0] >= MIN_TEMPLATE_SHARE]
            if likely:
                *_, x, family = max(likely, key=lambda x: (x[1], x[0], x[2]))
                return family, x
        return UNKNOWN, float(p[unknown])


def _examples(sample: list[list[str]], seed: int) -> list[tuple[str, int, list[str]]]:
    """(family, fold, words) of the training examples; all perturbations of a template are in its fold."""
    rng = np.random.default_rng(seed)
    out: list[tuple[str, int, list[str]]] = []
    every = [words_of(t) for texts in TEMPLATES.values() for t in texts]
    trigrams = {g for w in every for g in zip(w, w[1:], w[2:])}
    for family, texts in TEMPLATES.items():
        for k, text in enumerate(texts):
            words = words_of(text)
            out += [(family, k % FOLDS, words)] * 3
            for _ in range(12):
                kept = [w for w in words if rng.random() > 0.08]
                if len(kept) > 12 and rng.random() < 0.5:
                    begin = int(rng.integers(0, len(kept) - 10))
                    kept = kept[begin : begin + int(rng.integers(10, len(kept) - begin + 1))]
                out.append((family, k % FOLDS, kept))
    pool = [w for words in every for w in words]
    unknown = [words_of(t) for t in ABOUT] * 6
    unknown += [list(rng.choice(pool, int(rng.integers(2, 20)))) for _ in range(300)]
    unknown += [[w] for w in sorted(set(pool))]
    unknown += [w for w in sample if w and not trigrams.intersection(zip(w, w[1:], w[2:]))]
    folds = {tuple(w): int(f) for w, f in zip(unknown, rng.integers(0, FOLDS, len(unknown)))}  # equal ones are in one fold
    return out + [(UNKNOWN, folds[tuple(w)], w) for w in unknown]


def _fit(x: np.ndarray, y: np.ndarray, k: int, seed: int, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of a logistic regression by Adagrad; classes count by the root of their share."""
    rng = np.random.default_rng(seed)
    weights, bias = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32)
    balance = ((len(y) / (k * np.bincount(y, minlength=k).clip(1))) ** 0.5).astype(np.float32)
    speed_w, speed_b = np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 256)):
            z = x[part] @ weights + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p *= balance[y[part], None]
            gw, gb = x[part].T @ p / len(part) + np.float32(1e-5) * weights, p.mean(0)
            speed_w += gw * gw
            speed_b += gb * gb
            weights -= np.float32(0.5) * gw / np.sqrt(speed_w)
            bias -= np.float32(0.5) * gb / np.sqrt(speed_b)
    return weights, bias


def train(sample: list[list[str]], seed: int = 11, epochs: int = 25) -> Model:
    """Fit the classifier; sample: words of units of the corpus, for the unknown class."""
    families = sorted(TEMPLATES) + [UNKNOWN]
    grams = sorted({g for texts in TEMPLATES.values() for t in texts for g in ngrams(words_of(t))}, key=str)
    index = {g: i for i, g in enumerate(grams)}
    examples = _examples(sample, seed)
    x, y, fold = np.zeros((len(examples), len(grams)), np.float32), np.array([families.index(f) for f, _, _ in examples]), np.array([k for _, k, _ in examples])
    for i, (_, _, words) in enumerate(examples):
        ids = [index[g] for g in ngrams(words) if g in index]
        x[i, ids] = 1 / np.sqrt(max(1, len(ids)))
    z = np.zeros((len(y), len(families)), np.float32)
    for k in range(FOLDS):
        weights, bias = _fit(x[fold != k], y[fold != k], len(families), seed + 1 + k, epochs // 2)
        z[fold == k] = x[fold == k] @ weights + bias

    def loss(t: float) -> float:
        s = z / t - (z / t).max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    temperature = min(np.geomspace(0.25, 4, 33), key=loss)
    weights, bias = _fit(x, y, len(families), seed, epochs)
    templates = {f: [set(zip(w, w[1:])) for w in map(words_of, texts)] for f, texts in TEMPLATES.items()}
    return Model(families, index, weights, bias, float(temperature), templates)


def scan_text(model: Model, text: str) -> list[tuple[str, int, int, float]]:
    """(family, start, end, probability) of the units that hold a licence, in order.

    A unit without a bigram of any template can be confirmed by none, and is left out before the model.
    """
    lower = text.lower()
    if not model.first_words.intersection(_WORD.findall(lower)):
        return []
    out = []
    for a, b in units(text):
        words = _WORD.findall(lower[a:b]) if len(lower) == len(text) else words_of(text[a:b])
        if model.bigrams.intersection(zip(words, words[1:])):
            family, p = model.classify(text[a:b])
            if family != UNKNOWN:
                out.append((family, a, b, p))
    return out


def prepared(model: Model) -> Model:
    """The model with the sets that scan_text looks up."""
    model.bigrams = set().union(*(t for texts in model.templates.values() for t in texts))
    model.first_words = {a for a, _ in model.bigrams}
    return model


def scan(documents: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """doc_id, license (the likeliest family, or 'unknown'), probability, n_matches, matches (family:start:end, comma-joined).

    The sample for the unknown class is bounded and taken by the least hashes of doc_id; all rows are scanned whole.
    Null and empty texts hold no licence. Repeated rows are scanned each; an empty table gives no rows.
    Ties between families go to the earlier match.
    """
    require(documents, "doc_id", "text")
    spark = documents.sparkSession
    held = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    least = held.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id")).limit(sample_documents)

    def sample(batches):
        for batch in batches:
            rows = [words_of(text[a:b])[:SAMPLE_WORDS] for text in batch.column(0).to_pylist() if text for a, b in units(text)[:SAMPLE_UNITS]]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["words"])

    taken = held.join(F.broadcast(least), "doc_id", "left_semi").select("text").mapInArrow(sample, "words array<string>")  # sample_documents ids
    found = taken.groupBy("words").agg(F.count("*").alias("n")).orderBy("words").limit(sample_documents * SAMPLE_UNITS).collect()
    model = spark.sparkContext.broadcast(train([r["words"] for r in found]))

    def run(batches):
        own = prepared(model.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = scan_text(own, text) if text else []
                best = max(found, key=lambda f: f[3], default=(UNKNOWN, 0, 0, None))
                rows.append((doc_id, best[0], best[3], len(found), ",".join(f"{f}:{a}:{b}" for f, a, b, _ in found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string()))], names=["doc_id", "license", "probability", "n_matches", "matches"])

    return held.mapInArrow(run, "doc_id long, license string, probability double, n_matches long, matches string")


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    """Contract query: licence statements in every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
