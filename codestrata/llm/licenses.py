"""License scans: a trained paragraph classifier, confirmed by template comparison.

A paragraph is a run of lines up to a blank one, whatever its line ends; it is judged in windows
of twice ``REACH`` words (the longest template's) that start every ``REACH`` words, so every
notice lies whole in some window. Words are lower-case runs of letters and digits, ``.`` and ``-``
inside them included; features are the word 1- to 3-grams of the training paragraphs.

Model: a logistic regression per family, fitted together on the driver to the notices below and
to variants of them (in prose of all lengths, function words dropped), against the other
families and ordinary prose about licenses; weights that don't matter are left out. The
unknown class is what no family claims: the probability a family needs is calibrated on
held-out windows, at least ``LEAST`` and above all that any held-out window of ordinary prose or
of another family reaches. A claim is confirmed if some template of the family has at least
``SIMILAR`` of its five-word shingles in the window (a template of fewer words is one shingle).

Only windows that hold one of ``triggers()`` are judged. Those words are picked so that a window
without any of them lacks over 1 - ``SIMILAR`` of every template's shingles: nothing that could
be confirmed is passed over.

Weights and templates are bounded by the notices below and are broadcast; windows are judged
where they are, so a notice that very many documents hold makes no hot key. Texts are read once,
and work is linear in their length.

Defined results: null or empty text has one paragraph and no license; every row is judged for
itself, repeated ones alike; null doc_ids are kept; extra columns are ignored; an empty table
gives an empty result. ``license`` is the family of most windows, of several the one of the
highest probability, then similarity, then the last by name.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.shared import materialize

LEAST, SIMILAR, SHINGLE, GRAMS, VARIANTS, UNKNOWN = 0.6, 0.8, 5, 3, 16, "unknown"
WORD = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"

#: The usual notices of each family, short ones and the paragraphs of its text.
NOTICES = {
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC0": [
        "Licensed under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "EPL-2.0": ["made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
    ],
    "LGPL-2.1": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Proprietary": ["All rights reserved.", "Confidential and proprietary. All rights reserved.", "All rights reserved. No part of this work may be reproduced without written permission."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ],
    "Zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "SPDX-License-Identifier: Zlib",
    ],
}
#: Ordinary sentences about licenses and rights; every third is held out for calibration.
ORDINARY = [
    "He lost his driving license after the second offence.",
    "The city renewed the restaurant's license to serve wine.",
    "Please show your license and registration.",
    "The court heard a copyright case about a song.",
    "A fishing license costs twelve dollars a year.",
    "The dealer offers a five year warranty on every car.",
    "Her painting entered the public domain last year.",
    "They work for a licensing company in the north.",
    "License plates are made in this town.",
    "The government plans to redistribute land to farmers.",
    "Copyright law has changed often in this country.",
    "The warranty does not cover water damage.",
    "A licensed nurse visited the house twice a week.",
    "The studio bought the license to the game.",
    "Music in the public domain may be played freely.",
    "His license was suspended by the board.",
    "The team tried to redistribute the weight of the load.",
    "No license is needed to keep a dog here.",
    "The publisher holds the copyright to all her novels.",
    "The software license costs nine dollars for each seat.",
    "This version of the license form must be signed by the owner.",
    "Poetic license let the author change the ending.",
]
_FUNCTION_WORDS = {"the", "a", "of", "is", "to", "this", "and", "or", "in", "at", "you", "may"}
#: Words of notices that other prose is full of: triggers only where nothing else will do.
_PLAIN = _FUNCTION_WORDS | {"above", "all", "any", "authors", "available", "conditions", "file", "following", "form", "found", "free", "from", "general", "have", "including", "language", "list", "made", "must", "name", "names", "notice", "original", "part", "person", "public", "purpose", "rights", "see", "shall", "source", "specific", "such", "terms", "that", "under", "use", "used", "with", "without", "work"}


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


REACH = max(len(words_of(x)) for xs in NOTICES.values() for x in xs)


def shingles_of(words: list[str]) -> set[str]:
    """The distinct five-word shingles; of fewer words, all of them as one."""
    return {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


@lru_cache(maxsize=1)
def triggers() -> tuple[str, ...]:
    """Words one of which is in every window that a template can confirm, as few as a greedy choice finds."""
    templates = [[set(x.split(" ")) for x in shingles_of(words_of(t))] for ts in NOTICES.values() for t in ts]
    words = sorted({w for t in templates for x in t for w in x})
    chosen: list[str] = []

    def open_(t):
        return sum(not x.isdisjoint(chosen) for x in t) <= (1 - SIMILAR) * len(t) + 1e-9

    while left := [t for t in templates if open_(t)]:
        gain = {w: sum(min(1.0, sum(w in x and x.isdisjoint(chosen) for x in t) / ((1 - SIMILAR) * len(t) + 1e-9)) for t in left) for w in words if w not in chosen}
        chosen.append(max(gain, key=lambda w: (gain[w] * (0.1 if w in _PLAIN or len(w) < 4 else 1.0), w)))
    return tuple(sorted(chosen))


def _grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)}


def _variants(rng: random.Random, words: list[str], n: int, prose: list[str]):
    """The words, and the words with some function words dropped in prose of up to a window's length."""
    yield words
    for k in range(n - 1):
        kept = [w for w in words if w not in _FUNCTION_WORDS or rng.random() < 0.9]
        size = rng.randint(0, 2 * REACH - len(kept)) if k % 2 else rng.randint(0, 12)
        noise = [rng.choice(prose) if rng.random() < 0.5 else "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 9))) for _ in range(size)]
        at = rng.randint(0, len(noise))
        yield noise[:at] + kept + noise[at:]


@lru_cache(maxsize=1)
def train(rounds: int = 150, ridge: float = 1e-3):
    """(families, weights by n-gram: one per family, biases, needed probabilities)."""
    rng = random.Random(7)
    families = sorted(NOTICES)
    ordinary = [words_of(x) for x in ORDINARY]
    prose = [w for i, x in enumerate(ordinary) if i % 3 != 2 for w in x] + sorted(_FUNCTION_WORDS)
    fit, held = [], []
    for k, family in enumerate(families):
        for notice in NOTICES[family]:
            for i, words in enumerate(_variants(rng, words_of(notice), VARIANTS, prose)):
                (held if i % 4 == 3 else fit).append((words, k))
    for i, sentence in enumerate(ordinary):
        for words in _variants(rng, sentence, 2 * VARIANTS, prose):
            (held if i % 3 == 2 else fit).append((words, -1))
    vocabulary = sorted(set().union(*[_grams(words_of(x)) for xs in NOTICES.values() for x in xs], *[_grams(x) for i, x in enumerate(ordinary) if i % 3 != 2]))
    at = {g: i for i, g in enumerate(vocabulary)}

    def matrix(rows):
        x = np.zeros((len(rows), len(vocabulary) + 1), np.float32)
        for r, (words, _) in enumerate(rows):
            x[r, [at[g] for g in _grams(words) if g in at]] = 1
        x[:, -1] = 1
        return x

    x, y = matrix(fit), np.array([k for _, k in fit])
    target = (y[:, None] == np.arange(len(families))).astype(np.float32)
    share = np.where(target > 0, 0.5 / target.sum(0), 0.5 / (1 - target).sum(0)).astype(np.float32)  # a family weighs as much as all else
    w, m, v = np.zeros((x.shape[1], len(families)), np.float32), 0.0, 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - target) * share) + ridge * np.vstack([w[:-1], 0 * w[-1:]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w[:-1][np.abs(w[:-1]) < 1e-3] = 0
    p = 1 / (1 + np.exp(-np.clip(matrix(held) @ w, -30, 30)))
    kind = np.array([k for _, k in held])
    need = [max(LEAST, float(p[kind != k, k].max()) + 1e-6) for k in range(len(families))]
    return tuple(families), {g: w[i].astype(float).tolist() for g, i in at.items() if w[i].any()}, w[-1].astype(float).tolist(), need


def _runs(text: Column, n: int) -> Column:
    """All n-word runs of space-joined words; work is linear."""
    return F.regexp_extract_all(text, F.lit(rf"(?=(\S++(?: \S++){{{n - 1}}}+))\S++"), F.lit(1))


def _any(text: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def windows_of(text: Column) -> Column:
    """The windows to judge of a text that is lower-cased: space-joined words, with a trigger each."""
    paragraphs = F.filter(F.split(text, r"\n[ \t\r\x0B\f]*\n", -1), lambda p: _any(p, triggers()))
    joined = F.transform(paragraphs, lambda p: F.array_join(F.regexp_extract_all(p, F.lit(WORD), F.lit(0)), " "))
    pattern = rf"(?=(\S++(?: \S++){{0,{2 * REACH - 1}}}+))\S++(?: \S++){{0,{REACH - 1}}}+"
    return F.filter(F.flatten(F.transform(joined, lambda p: F.regexp_extract_all(p, F.lit(pattern), F.lit(1)))), lambda w: _any(w, triggers()))


def classify(windows: DataFrame) -> DataFrame:
    """(id, at, family, probability, similarity) of windows (id, at, norm): every confirmed family of each."""
    spark = windows.sparkSession
    families, weights, bias, need = train()
    table = spark.createDataFrame([(g, w) for g, w in weights.items()], "gram string, w array<double>")
    grams = F.array_distinct(F.concat(*[_runs(F.col("norm"), n) for n in range(1, GRAMS + 1)]))
    hits = windows.select("id", "at", F.explode(grams).alias("g")).join(F.broadcast(table), F.col("g") == F.col("gram"))
    sums = hits.groupBy("id", "at").agg(*[F.sum(F.get("w", F.lit(k))).alias(f"z{k}") for k in range(len(families))])
    claims = F.array(*[F.struct(F.lit(f).alias("family"), (1 / (1 + F.exp(-(F.col(f"z{k}") + bias[k])))).alias("p"), F.lit(need[k]).alias("need")) for k, f in enumerate(families)])
    claimed = sums.select("id", "at", F.explode(F.filter(claims, lambda c: c["p"] >= c["need"])).alias("c")).select("id", "at", "c.family", F.col("c.p").alias("probability"))
    # Templates of five words and more by their shingles, shorter ones as they are.
    templates = [(f, sorted(shingles_of(words_of(x))), len(words_of(x))) for f, xs in NOTICES.items() for x in xs]
    templates = spark.createDataFrame(templates, "f string, ts array<string>, size int")
    near = claimed.join(windows.select("id", "at", "norm").withColumn("shingles", F.array_distinct(_runs(F.col("norm"), SHINGLE))), ["id", "at"]).join(F.broadcast(templates), F.col("family") == F.col("f"))
    short = F.contains(F.concat(F.lit(" "), "norm", F.lit(" ")), F.concat(F.lit(" "), F.get("ts", F.lit(0)), F.lit(" "))).cast("double")
    similarity = F.when(F.col("size") < SHINGLE, short).otherwise(F.size(F.array_intersect("shingles", "ts")) / F.size("ts"))
    return near.groupBy("id", "at", "family", "probability").agg(F.max(similarity).alias("similarity")).filter(F.col("similarity") >= SIMILAR)


def scan(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_paragraphs, n_candidates (windows judged), license (null if none was
    confirmed), families (all, sorted), probability and similarity (the highest of the confirmed)."""
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    paragraphs = F.regexp_count("text", F.lit(r"\n[ \t\r\x0B\f]*\n")) + 1
    windows = F.when(_any(F.col("text"), triggers()), windows_of(F.col("text"))).otherwise(F.array().cast("array<string>"))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("id"), "doc_id", paragraphs.cast("long").alias("n_paragraphs"), windows.alias("windows")), "windows")
    each = rows.filter(F.size("windows") > 0).select("id", F.posexplode("windows").alias("at", "norm"))
    found = classify(each)
    count = found.groupBy("id", "family").agg(F.count("*").alias("n"), F.max("probability").alias("p"), F.max("similarity").alias("s"))
    by_row = count.groupBy(F.col("id").alias("row")).agg(F.max_by("family", F.struct("n", "p", "s", "family")).alias("license"), F.array_sort(F.collect_set("family")).alias("families"), F.max("p").alias("probability"), F.max("s").alias("similarity"))
    out = rows.join(by_row, F.col("id") == F.col("row"), "left")
    return out.select("doc_id", "n_paragraphs", F.size("windows").cast("long").alias("n_candidates"), "license", F.array_join("families", ",").alias("families"), "probability", "similarity")
