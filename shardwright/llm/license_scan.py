"""Licence scans: a trained paragraph classifier.

A paragraph is a line with the lines that it wraps into, at any width: a line that doesn't end a sentence goes on in the
next one. Lines without an ASCII letter or digit end a paragraph. Its features are its distinct words and word pairs; a multinomial logistic regression over the
families, `unknown` (other licences) and `none`, fitted here on the notices below, their variants and plain paragraphs,
has weights for the features that occur in notices. A part of the variants is kept from fitting: they give the
temperature, the least likeness that a family's paragraph needs, such that MISSED of them fall below it, and the least
probability, such that WRONG of those that are taken for a family, of all classes, are not of it. Likeness compares templates: features, each worth the less the more families use it, that the paragraph shares
with one of the family's notices, over all of the notice's or all of the paragraph's, or over 1 if that is more. A paragraph that is a
family's by the classifier but falls short is `unknown`.

Paragraphs that the model can only call `none`, whatever else they hold, are told by their words (anchors(), derived from
the weights) and go no further. The lines of a wrapped paragraph are classified too: where one of them holds a notice
of another family than the whole, the lines count, else the whole does, once, at the first line that holds a whole notice
of it by itself, or else at its first line.

Fitting takes place on the driver over the fixed notices (some thousand variants), no corpus rows. The scan is SQL
expressions: equal paragraphs are classified once, their features join the model's rows.

Defined cases: null or empty text has no paragraph; repeated rows are rows of their own; a paragraph may be of any
length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.llm.shared import written

MISSED = 0.02
WRONG = 0.01
NONE, UNKNOWN = "none", "unknown"
#: Usual words of notices; the scan doesn't go by them.
CUE = r"(?i)licen[cs]|copyright|copyleft|\bgpl|\bspdx|public domain|permission is hereby|redistribution and use|warrant(?:y|ies)|all rights reserved|creative commons|\bcc[ -]by|\bcc0|unlicense|as is"

# Fixed texts: usual licence notices by family.
NOTICES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE in the project root for license information.",
        "SPDX-License-Identifier: MIT",
        "Code: MIT license.",
        "Code: MIT",
        "License: MIT",
        "Lizenziert unter der MIT-Lizenz.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "License: Apache 2.0",
        "Released under Apache 2.0.",
        "Distributed under the Apache 2.0 license.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Licensed under the GPL v2 or later.",
        "License: GPL v3",
        "Distributed under the GPLv3.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is licensed under the LGPL v2.1.",
        "Distributed under the LGPLv3.",
    ],
    "AGPL": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Distributed under the AGPLv3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the 3-clause BSD license.",
        "License: BSD",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-NC-SA": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    ],
    "CC-BY-ND": [
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "This work is dedicated to the public domain under CC0.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "EPL": [
        "Licensed under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
        "Distributed under the EPL v1.0.",
    ],
    "EUPL": [
        "Licensed under the EUPL, Version 1.2.",
        "European Union Public Licence v1.2",
        "You may not use this work except in compliance with the European Union Public Licence.",
        "SPDX-License-Identifier: EUPL-1.2",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "Proprietary": [
        "Copyright 2020 Example Corporation. All rights reserved.",
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
# Fixed texts: notices of licences that are no family here.
OTHER = [
    "Licensed under the Apache License, Version 1.1.", "License: Apache 1.0", "SPDX-License-Identifier: Apache-1.1", "Licensed under the Apache License 1.0.", "License: CeCILL-C", "Governed by the CeCILL licence under French law.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "Licensed under CC BY-NC-ND 4.0.",
    "Licensed under the Artistic License 2.0.", "This module is free software under the terms of the Artistic License.", "SPDX-License-Identifier: Artistic-2.0",
    "This software is provided 'as-is', without any express or implied warranty, under the zlib license.", "Released under the zlib License.", "SPDX-License-Identifier: Zlib",
    "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (CDDL).",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the Microsoft Public License (Ms-PL).", "Released under the PostgreSQL License.",
    "Licensed under the Academic Free License version 3.0.", "Licensed under the Open Software License version 3.0.", "This work is licensed under the WTFPL, version 2.",
    "Distributed under the Python Software Foundation License.", "Licensed under the Server Side Public License, version 1.", "This code is available under the Business Source License 1.1.",
    "Licensed under the Elastic License 2.0.", "Licensed under the Foo Public License, version 1.", "This package is distributed under the Bar License.", "Use is subject to the licence terms of the Baz toolkit.",
    "This data is made available under the Open Database License.", "Licensed under the Acme Software Licence.", "See the accompanying licence agreement for the terms under which this program may be used.",
]
# Fixed texts: paragraphs with cue words that are no notices.
PLAIN = [
    "He lost his driving licence after the second offence and had to take the bus.",
    "The fishing license costs ten dollars a year and can be bought at the town hall.",
    "The court asked whether copyright law applies to the photograph of the painting.",
    "The museum opened its doors as is the custom on the first day of spring.",
    "The warranty on the washing machine covers parts and labour for two years.",
    "The library is in the public domain of the town council's responsibilities.",
    "A general public discussion about free software took place at the university.",
    "Apache helicopters were seen over the city in version after version of the story.",
    "The professor from MIT gave a talk on the history of mathematics.",
    "She asked for permission to use the source of the river in the documentary film.",
    "Our licensed electricians can be reached at any time of the day.",
    "The conditions of the road are met with concern by the residents.",
    "All rights to the song were reserved to the heirs of the singer.",
    "Tables are reserved for guests, and all rights of way are to be kept free.",
    "The prize and all the rights reserved to the first of the race went to her.",
    "Sie beantragte eine Lizenz und kam mit der Lizenz nach Hause.",
]
# Fixed texts: ordinary prose, whose small words notices have too (German `mit` above all).
PROSE = [
    "They walked along the shore for an hour and watched that the children did not go in.",
    "It was not the first time that she had been there, or the last, but no one knew of it.",
    "There is a house in the valley which may be seen from any of the hills.",
    "That was all. Not so. If only. In any case, no. See you. By the way.",
    "You can do with it as you like, and all of this is for you.",
    "The following day the file of soldiers, without a word, was on its way to the work at the bridge.",
    "Er ging mit seinem Bruder durch die Stadt und kam mit dem Abend nach Hause.",
    "Mit der Zeit wird alles gut, sagte sie, und mit ihm war nicht zu reden.",
    "Das ist die Frage, mit der sich der Rat in der Sitzung nicht befassen will.",
    "Nicht mit mir. Mit Geduld. Komm mit. Mit uns. Von mit. Und mit das. Mit sich die der. Das mit dem.",
    "Wir sind mit den Kindern in die Berge gefahren, um mit einer Freundin zu wandern.",
    "Elle est venue avec son frère et les enfants de la maison pour une semaine.",
    "Le chat qui dort sur la table ne veut pas que les autres en parlent par ici.",
    "La casa de los abuelos está en el centro del pueblo, con una puerta por la que no se puede pasar.",
    "Los niños y las niñas que van a la escuela no son de este lugar, a no ser por uno.",
]
#: Fixed words without weights of their own: small words of English, German, French and Spanish, `mit` (German) among them.
SMALL = set(
    "a about all also an and any are as at be been but by can do for from had has have he her his if in into is it its more no not of on one only or our see she so that the their there these they this to was we were which who will with would you your "
    "als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sich sie sind so um und vom von war wer wie wir wird zu zum zur "
    "au aux avec ce cette dans de du elle en est et il la le les leur lui mais ne nous ont ou où par pas plus pour que qui sa se ses son sont sur un une vous "
    "al con como del el ella ellos era esta este fue ha hay las lo los mi no para pero por se sin su sus también y ya".split()
)
_SPLIT = r"[^a-z0-9.+]+"


def features(line: str) -> set[str]:
    w = [x for x in re.split(_SPLIT, line.lower()) if x.strip(".")]
    w = [x.strip(".") for x in w]
    return set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}


def _variants(line: str, rng: random.Random, n: int) -> list[str]:
    """The line with some words dropped, changed or put around it."""
    words, fill = line.split(), "the of a project file our this software code please note that see for more".split()
    out = []
    for _ in range(n):
        w = [x for x in words if rng.random() > 0.08] or words[:]
        if rng.random() < 0.5:
            w.insert(rng.randrange(len(w) + 1), rng.choice(fill))
        if rng.random() < 0.4:
            w = rng.choices(fill, k=rng.randint(1, 3)) + w
        if rng.random() < 0.3:
            w += ["(c)", str(rng.randint(1990, 2024))]
        out.append(" ".join(w))
    return out


def telling(found: set[str]) -> set[str]:
    """The features that templates are compared by: all but small words."""
    return found - SMALL


def likeness(found: set[str], family: str, worth: dict[str, float]) -> float:
    """Of a paragraph's features to the family's notices."""
    of = lambda x: sum(worth.get(f, 1.0) for f in x)
    mine, best = telling(found), 0.0
    for line in NOTICES[family]:
        own = telling(features(line))
        both = of(mine & own)
        best = max(best, both / max(of(own), 1.0), both / max(of(mine), 1.0))
    return best


@lru_cache(1)
def worths() -> dict[str, float]:
    """Of each feature of the notices: one over the number of families that use it, other licences being one."""
    used = Counter(x for lines in (*NOTICES.values(), OTHER) for x in {x for line in lines for x in telling(features(line))})
    return {x: 1 / n for x, n in used.items()}


@lru_cache(1)
def trained() -> tuple[list[str], dict[str, np.ndarray], np.ndarray, float, tuple[float, float]]:
    """Classes, weights by feature, biases, temperature, and the least probability and likeness of a family."""
    rng = random.Random(7)
    families = [NONE, UNKNOWN, *NOTICES]
    texts = {NONE: PLAIN + PROSE, UNKNOWN: OTHER} | NOTICES
    rows: list[tuple[set[str], int, bool]] = []
    for k, f in enumerate(families):
        for line in texts[f]:
            rows += [(features(x), k, i % 4 == 3) for i, x in enumerate([line, *_variants(line, rng, 23)])]
            w = line.split()
            rows += [(features(" ".join(w[i : i + 10])), k, i % 4 == 3) for i in range(0, len(w) - 9) if len(w) > 12]  # hard-wrapped
    every = [w for lines in (*NOTICES.values(), PLAIN) for x in lines for w in x.lower().split()]
    for i in range(400):  # word salad of the same words, and of few of them
        rows.append((features(" ".join(rng.choices(every, k=rng.randint(4, 30)))), 0, i % 4 == 3))
    prose = [w for x in PROSE for w in x.split()]
    for i in range(400):  # and of prose, as short as one word
        rows.append((features(" ".join(rng.choices(prose, k=rng.randint(1, 12)))), 0, i % 4 == 3))
    said = {w for lines in (*NOTICES.values(), OTHER) for x in lines for w in features(x)}
    common = {x for x in said if " " not in x and worths().get(x, 1) < 1}
    for x in sorted({w for x in PROSE for w in features(x) if " " not in w} & said | common):  # shared words with little around them
        for i in range(12):
            w = rng.choices(prose, k=i % 4)
            w.insert(rng.randint(0, len(w)), x)
            rows.append((features(" ".join(w)), 0, i % 4 == 3))
    seen = Counter(x for s, _, held in rows if not held for x in s)
    names = sorted(x for x, n in seen.items() if n > 2 and not SMALL.issuperset(re.split(_SPLIT, x)))
    place = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for r, (s, _, _) in enumerate(rows):
        x[r, [place[f] for f in s if f in place]] = 1
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    y, held = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    w, b = np.zeros((len(names), len(families))), np.zeros(len(families))
    t, one, v = x[~held], np.eye(len(families))[y[~held]], np.zeros_like(w)
    for _ in range(300):
        z = t @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - one) / len(t)
        v = 0.9 * v - 8 * (t.T @ g + 1e-4 * w)
        w += v
        b -= 2 * g.sum(0)
    z = x[held] @ w + b

    def loss(k: float) -> float:
        e = z * k - (z * k).max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(e).sum(1)) - e[np.arange(len(e)), y[held]]))

    heat = min((2 ** (i / 2) for i in range(-6, 7)), key=loss)
    guess, truth, apart = z.argmax(1), y[held], [r[0] for r in rows if r[2]]
    sure = 1 / np.exp(z * heat - (z * heat).max(1, keepdims=True)).sum(1)
    like = np.array([likeness(f, families[k], worths()) if k > 1 else 0.0 for f, k in zip(apart, guess)])
    similar = float(np.quantile(like[(guess == truth) & (guess > 1)], MISSED))
    taken = np.flatnonzero((guess > 1) & (like >= similar))
    taken = taken[np.argsort(-sure[taken], kind="stable")]
    wrong = np.cumsum(guess[taken] != truth[taken]) / np.arange(1, len(taken) + 1)
    least = float(sure[taken[np.flatnonzero(wrong <= WRONG)[-1]]]), similar
    return families, {n: w[i] for n, i in place.items()}, b, heat, least


@lru_cache(1)
def anchors() -> list[str]:
    """Words of which a line needs one to be other than `none`. All words of the model's features but small ones and
    those of plain paragraphs, freed one by one as long as no line without the others can outweigh `none`: whatever n features
    it has, a family's lead is at most its n largest free weights over `none`'s by sqrt(n), which must stay below
    `none`'s lead in the biases."""
    _, weights, bias, _, _ = trained()
    lead, need = {f: w[1:] - w[0] for f, w in weights.items()}, bias[0] - bias[1:]
    held, free = {x for f in weights for x in f.split(" ")}, set()
    common = Counter(x.strip(".") for line in PLAIN + PROSE for x in re.split(_SPLIT, line.lower()))
    for x in dict.fromkeys([*sorted(SMALL), *(x for x, _ in common.most_common())]):
        own = [w for f, w in lead.items() if free.union((x,)).issuperset(f.split(" "))]
        top = np.cumsum(np.sort(np.maximum(own, 0), 0)[::-1], 0) / np.sqrt(np.arange(1, len(own) + 1))[:, None] if own else np.zeros((1, 1))
        if (top.max(0) < need - 1e-6).all():
            free.add(x)
    return sorted(held - free)


def _words(line: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(line), _SPLIT), lambda x: F.btrim(x, F.lit(".")) != ""), lambda x: F.btrim(x, F.lit(".")))


def _features(line: Column) -> Column:
    """The same features in SQL."""
    w = _words(line)
    both = F.arrays_zip(w.alias("a"), F.slice(w, 2, F.size(w)).alias("b"))
    pairs = F.transform(F.filter(both, lambda x: x["b"].isNotNull()), lambda x: F.concat_ws(" ", x["a"], x["b"]))
    return F.array_distinct(F.concat(w, pairs))


def classified(lines: DataFrame) -> DataFrame:
    """(line, family, probability, similarity, complete) of distinct paragraphs; complete: one of the family's notices is
    in the paragraph, not just the paragraph in a notice."""
    families, weights, bias, heat, (sure, similar) = trained()
    worth, spark = worths(), lines.sparkSession
    notices = [(k, telling(features(line))) for k, f in enumerate(families) for line in NOTICES.get(f, ())]
    rows = [(f, [float(x) for x in weights[f]] if f in weights else [0.0] * len(families), worth.get(f), [i for i, (_, x) in enumerate(notices) if f in x]) for f in sorted({*weights, *worth})]
    model = spark.createDataFrame(rows, "feature string, w array<double>, worth double, notices array<int>")
    small = F.array(*map(F.lit, sorted(SMALL)))
    df = lines.withColumn("f", _features(F.col("line"))).withColumn("n_telling", F.size(F.array_except("f", small)))
    hits = df.select("line", "n_telling", F.explode("f").alias("feature")).join(F.broadcast(model), "feature")  # of fixed notices: some thousand rows
    # weights count alike for known features, as the training rows were normed
    known = F.sum(F.when(F.exists("w", lambda x: x != 0), 1).otherwise(0))
    sums = hits.groupBy("line", "n_telling").agg(
        F.sqrt(F.greatest(known, F.lit(1))).alias("norm"), F.coalesce(F.sum("worth"), F.lit(0.0)).alias("worth"), F.count("worth").alias("n_known"),
        *(F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(len(families))),
        *(F.coalesce(F.sum(F.when(F.array_contains("notices", i), F.col("worth"))), F.lit(0.0)).alias(f"t{i}") for i in range(len(notices))))
    z = F.array(*((F.col(f"z{k}") / F.col("norm") + float(bias[k])) * heat for k in range(len(families))))
    own = F.greatest(F.col("n_telling") - F.col("n_known") + F.col("worth"), F.lit(1.0))  # what no notice has is worth 1
    of = lambda k: [(F.col(f"t{i}"), max(sum(worth[x] for x in f), 1.0)) for i, (g, f) in enumerate(notices) if g == k]
    whole = lambda k: F.greatest(F.lit(0.0), F.lit(0.0), *(t / size for t, size in of(k)))
    part = lambda k: F.greatest(F.lit(0.0), F.lit(0.0), *(t / own for t, _ in of(k)))
    df = sums.withColumn("z", z).withColumn("best", F.array_position("z", F.array_max("z")).cast("int"))
    df = df.withColumn("whole", F.element_at(F.array(*map(whole, range(len(families)))), F.col("best"))).withColumn("part", F.element_at(F.array(*map(part, range(len(families)))), F.col("best")))
    df = df.select(
        "line", F.element_at(F.array(*map(F.lit, families)), F.col("best")).alias("guess"),
        (1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("z")))).alias("probability"), F.greatest("whole", "part").alias("similarity"), (F.col("whole") >= similar).alias("complete"))
    unsure = (F.col("probability") < sure) | (F.col("similarity") < similar)
    return df.select("line", F.when(F.col("guess") == NONE, NONE).when(unsure, UNKNOWN).otherwise(F.col("guess")).alias("family"), "probability", "similarity", "complete")


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text that hold an anchor, as (no, text, lines): the number of the first line, the lines as one,
    and those lines (no, line) that hold an anchor."""
    held = anchors()
    clean = F.split(F.translate(text, "\x01\x02\t\r", "    "), "\n")
    marked = F.array_join(F.transform(clean, lambda x, i: F.concat(i + 1, F.lit("\x02"), F.when(x.rlike("[A-Za-z0-9]"), F.rtrim(x)).otherwise(""))), "\n")
    wrapped = F.regexp_replace(marked, "\n(?<=[^\n\x02.!?:;]\n)(?=[0-9]+\x02[^\n])", "\x01")
    found = F.filter(F.split(wrapped, "\n"), lambda p: F.exists(_words(F.regexp_replace(p, "\x01?[0-9]+\x02", " ")), lambda w: w.isin(held)))
    number, after = lambda x: F.split_part(x, F.lit("\x02"), F.lit(1)).cast("int"), lambda x: F.trim(F.split_part(x, F.lit("\x02"), F.lit(2)))
    lines = lambda p: F.filter(F.transform(F.split(p, "\x01"), lambda x: F.struct(number(x).alias("no"), after(x).alias("line"))), lambda x: F.exists(_words(x["line"]), lambda w: w.isin(held)))
    return F.transform(found, lambda p: F.struct(number(p).alias("no"), F.trim(F.regexp_replace(p, "\x01?[0-9]+\x02", " ")).alias("text"), lines(p).alias("lines")))


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, families (distinct, sorted, comma-joined; empty where there is none), n_notices,
    n_unknown, lines (number:family of each paragraph, comma-joined)."""
    found = written(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), paragraphs(F.col(text)).alias("hits")), "license-paragraphs")
    pars = found.where("size(hits) > 0").select("row", F.explode("hits").alias("x")).select("row", F.col("x.no").alias("par"), "x.text", "x.lines")
    several = F.filter("lines", lambda x: x["line"] != F.col("text"))
    parts = pars.select("row", "par", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("no"), F.col("text").alias("line"))), several)).alias("x")).select("row", "par", "x.no", "x.line")
    verdicts = classified(parts.select("line").distinct()).where(F.col("family") != NONE)
    judged = parts.join(verdicts, "line").groupBy("row", "par").agg(
        F.max(F.when(F.col("no") == 0, F.col("family"))).alias("whole"), F.array_sort(F.collect_list(F.when(F.col("no") > 0, F.struct("no", "family", "complete")))).alias("own"))  # the lines of one paragraph
    other = F.exists("own", lambda x: x["complete"] & (x["family"] != UNKNOWN) & ~x["family"].eqNullSafe(F.col("whole")))
    lines = F.transform("own", lambda x: F.struct(x["no"].alias("no"), x["family"].alias("family")))
    at = F.array_min(F.transform(F.filter("own", lambda x: x["complete"] & (x["family"] == F.col("whole"))), lambda x: x["no"]))
    kept = F.when(F.col("whole").isNull() | other, lines).otherwise(F.array(F.struct(F.coalesce(at, "par").alias("no"), F.col("whole").alias("family"))))
    per_row = judged.select("row", F.explode(kept).alias("x")).groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("v"))  # of one text
    df = found.select("doc_id", "row").join(per_row, "row", "left").withColumn("v", F.coalesce("v", F.array().cast("array<struct<no: int, family: string>>")))
    names = F.transform("v", lambda x: x["family"])
    return df.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda x: x != UNKNOWN))), ",").alias("families"),
        F.size("v").cast("long").alias("n_notices"), F.size(F.filter(names, lambda x: x == UNKNOWN)).cast("long").alias("n_unknown"),
        F.array_join(F.transform("v", lambda x: F.concat_ws(":", x["no"], x["family"])), ",").alias("lines"))
