"""Licence scan (operator 7): a paragraph classifier over word n-grams, in DataFrame operations only.

The classifier is a multinomial logistic regression, trained on the driver from the fixed notices
below and variants of them; its sparse weights become a small table that scoring joins. Scoring
uses Spark's own functions alone.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: No licence is given; one is that isn't among the families.
UNKNOWN, UNLISTED = "unknown", "unlisted"

#: Notices of each family, as they stand in files and pages.
NOTICES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the terms of the Apache License 2.0.",
        "Distributed under the Apache License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Free software under the MIT terms.",
        "The MIT License (MIT).",
        "SPDX-License-Identifier: MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GPL version 2 license or later.",
        "Distributed under the GNU GPL.",
        "Distributed under the GNU GPL v3.",
        "This code is GPLv3.",
        "This code is GPLv2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute this library under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under a BSD License.",
        "License: BSD",
    ),
    "bsd-3-clause": (
        "Released under the 3-clause BSD License.",
        "The BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "bsd-2-clause": ("Released under the 2-clause BSD License.", "The BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "isc": (
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "busl-1.1": ("Use of this software is governed by the Business Source License.", "Licensed under the Business Source License 1.1.", "SPDX-License-Identifier: BUSL-1.1"),
    "bsl-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-nc-sa": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "cc0": (
        "To the extent possible under law, the author has dedicated all copyright to the public domain worldwide under CC0 1.0.",
        "Released under the CC0 1.0 Universal license.",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
    "proprietary": ("Copyright. All rights reserved.", "No part of this work may be reproduced without written permission of the copyright holder."),
}

#: The same in German, French and Spanish.
TRANSLATED: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Lizenziert unter der Apache-Lizenz, Version 2.0.", "Sous licence Apache, version 2.0.", "Licenciado bajo la Licencia Apache, versión 2.0.", "Veröffentlicht unter der Apache-Lizenz 2.0.", "Publié sous la licence Apache 2.0.", "Publicado bajo la licencia Apache 2.0."),
    "mit": ("Veröffentlicht unter der MIT-Lizenz.", "Lizenziert unter der MIT-Lizenz.", "Publié sous la licence MIT.", "Sous licence MIT.", "Publicado bajo la licencia MIT.", "Licenciado bajo la licencia MIT."),
    "gpl": ("Veröffentlicht unter der GNU General Public License, Version 3.", "Lizenziert unter der GPL.", "Publié sous la licence GNU GPL.", "Distribué sous licence GPL.", "Publicado bajo la licencia GPL.", "Distribuido bajo la Licencia Pública General de GNU."),
    "bsd": ("Veröffentlicht unter der BSD-Lizenz.", "Publié sous la licence BSD.", "Publicado bajo la licencia BSD."),
    "cc-by": ("Lizenziert unter einer Creative Commons Namensnennung 4.0 International Lizenz.", "Sous licence Creative Commons Attribution 4.0 International.", "Bajo una licencia Creative Commons Atribución 4.0 Internacional."),
    "cc-by-sa": ("Lizenziert unter einer Creative Commons Namensnennung - Weitergabe unter gleichen Bedingungen 4.0 International Lizenz.", "Sous licence Creative Commons Attribution - Partage dans les mêmes conditions 4.0.", "Bajo una licencia Creative Commons Atribución-CompartirIgual 4.0."),
    "proprietary": ("Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados."),
}
for _family, _notices in TRANSLATED.items():
    NOTICES[_family] += _notices

#: Notices of other licences. They are told from prose, but none is confirmed.
OTHER_LICENCES = (
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "Released under the zlib license.", "Do what the fuck you want to public license.", "Licensed under the WTFPL.", "Licensed under the European Union Public Licence, version 1.2.", "Lizenziert unter der EUPL.",
    "Released under the Python Software Foundation License.", "Licensed under the Artistic License 2.0.", "This file is subject to the Common Development and Distribution License, version 1.0.", "Licensed under the SIL Open Font License, version 1.1.",
    "Licensed under the Academic Free License version 3.0.", "Released under the Microsoft Public License.", "This data is made available under the Open Database License.", "Licensed under the Server Side Public License, version 1.",
    "Distributed under the PostgreSQL License.", "Released under the Ruby license.", "Licensed under the Mulan PSL v2.", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: CDDL-1.0", "SPDX-License-Identifier: EUPL-1.2",
)

#: Sentences that name a licence and don't give it.
MENTIONS = (
    "We do not use the {} here.", "This project is not released under the {}.", "This is not licensed under the {}.", "The {} was discussed in class.", "She compared the {} with others.", "Many projects have chosen the {} for its brevity.",
    "The history of the {} is told in the third chapter.", "Unlike the {} it asks for nothing.", "He asked whether the {} would suit them.", "None of this is under the {}.", "Code under the {} was removed.", "They switched away from the {} last year.",
)

#: What the families are called; each name is a notice too.
NAMES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Apache License 2.0", "Apache-2.0"),
    "mit": ("MIT License", "MIT licence"),
    "gpl": ("GNU GPL", "GPL", "GPLv3", "GPLv2", "GNU General Public License"),
    "lgpl": ("GNU LGPL", "LGPLv3", "GNU Lesser General Public License"),
    "agpl": ("GNU AGPL", "AGPLv3", "GNU Affero General Public License"),
    "bsd-3-clause": ("BSD-3-Clause", "3-clause BSD"),
    "bsd-2-clause": ("BSD-2-Clause", "2-clause BSD"),
    "isc": ("ISC License",),
    "epl-2.0": ("Eclipse Public License", "EPL-2.0"),
    "busl-1.1": ("Business Source License", "BUSL-1.1"),
    "bsl-1.0": ("Boost Software License",),
    "mpl-2.0": ("Mozilla Public License", "MPL-2.0"),
    "cc-by": ("CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution 3.0 Unported"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC BY-SA"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC BY-NC"),
    "cc-by-nc-sa": ("CC BY-NC-SA 4.0", "CC BY-NC-SA"),
    "cc-by-nd": ("CC BY-ND 4.0", "CC BY-ND"),
    "cc0": ("CC0 1.0",),
}
for _family, _names in NAMES.items():
    NOTICES[_family] += (*_names, *(f"License: {n}" for n in _names))

#: Paragraphs that speak of licences and rights but give none.
OTHERS = (
    "The driving licence must be renewed every ten years at the town hall.",
    "He asked for permission to leave the room before the meeting ended.",
    "A fishing license costs more for visitors than for residents.",
    "The company licensed the patent to a competitor last spring.",
    "Copyright law differs between countries and changes over time.",
    "The warranty covers repairs for two years after purchase.",
    "She read about the Apache people in the library.",
    "Public domain films are shown every Sunday in the square.",
    "They discussed which license would suit the project but chose none.",
    "Redistribution of wealth was the subject of the debate.",
    "The restaurant lost its licence to serve wine.",
    "All rights of the tenants were respected by the new owner.",
    "The gnu is a large antelope that lives on open plains.",
    "Version 2.0 of the program was released under a new name.",
    "Terms of the contract were agreed without restriction.",
    "Permission from the council is required for building work.",
    "She studied physics at MIT before she joined the general staff.",
    "The eclipse was visible from every public square of the town.",
    "A boost to the software business came from the new version.",
    "The creative use of common materials is a matter of attribution.",
    "Free software was the subject of the talk, under the general title of public goods.",
    "Please contact the holder of the card about the conditions of use.",
)

#: Families that stand for a licence of which others are kinds.
KINDS = {"bsd": ("bsd-2-clause", "bsd-3-clause")}
#: Words that every notice of an unlisted licence has one of.
WORDS = ("license", "licence", "licensed", "lizenziert", "spdx-license-identifier", "wtfpl", "warranty", "redistribute")
_STOP = frozenset(
    "a an and any are as at be by for from in is it may no of on or that the this to was were with you "
    "de der die das dem den des du la le les el los las un una une dans en con".split()
) | frozenset("bcdefghijklmnopqrstuvwxyz")
_TOKEN = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
_LONGEST = 3


def tokens(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, _LONGEST + 1) for i in range(len(words) - n + 1)}


def _informative(gram: str) -> bool:
    return not set(gram.split()) <= _STOP


@dataclass(frozen=True)
class LicenceModel:
    families: tuple[str, ...]  # the unlisted class, then the unknown one, last
    bias: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]  # by n-gram
    temperature: float


def _variants(text: str, rng: random.Random, n: int) -> list[list[str]]:
    """The words of a notice as it is, and with words around it, lost or cut off."""
    words = tokens(text)
    filler = [w for t in OTHERS for w in tokens(t)]
    out = [words]
    for _ in range(n - 1):
        w = [x for x in words if rng.random() > 0.06] or words
        out.append(rng.choices(filler, k=rng.randrange(12)) + w + rng.choices(filler, k=rng.randrange(12)))
    return out


@lru_cache(1)
def train(variants: int = 6, steps: int = 500, rate: float = 4.0, lasso: float = 1e-4) -> LicenceModel:
    """Proximal gradient descent (L1) on the notices' variants; the temperature is fitted on other variants."""
    families = (*NOTICES, UNLISTED, UNKNOWN)
    # a mention has the name of some family; which one varies
    mentions = [m.format(names[(i + j) % len(names)]) for i, m in enumerate(MENTIONS) for j, names in enumerate(NAMES.values())]

    def examples(seed: int, n: int) -> tuple[list[set[str]], np.ndarray]:
        rng, x, y = random.Random(seed), [], []
        for k, name in enumerate(families[:-1]):
            for notice in NOTICES.get(name, OTHER_LICENCES):
                for words in _variants(notice, rng, n):
                    x.append({g for g in grams(words) if _informative(g)})
                    y.append(k)
        for other in OTHERS:
            for words in _variants(other, rng, n):
                x.append({g for g in grams(words) if _informative(g)})
                y.append(len(families) - 1)
        for mention in mentions:
            x.append({g for g in grams(tokens(mention)) if _informative(g)})
            y.append(len(families) - 1)
        return x, np.array(y)

    x, y = examples(1, variants)
    # what one example alone has is chance filler
    often = Counter(g for row in x for g in row)
    vocabulary = {g: k for k, g in enumerate(sorted(g for g, n in often.items() if n > 1))}

    def matrix(rows: list[set[str]]) -> np.ndarray:
        m = np.zeros((len(rows), len(vocabulary)), np.float32)
        for i, row in enumerate(rows):
            m[i, [vocabulary[g] for g in row if g in vocabulary]] = 1
        return m / 3

    a, one = matrix(x), np.eye(len(families), dtype=np.float32)[y]
    w, b = np.zeros((len(vocabulary), len(families)), np.float32), np.zeros(len(families), np.float32)
    for _ in range(steps):
        z = a @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - one) / len(y)
        w -= rate * (a.T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * lasso, 0)
        b -= rate * g.sum(axis=0)
    held, truth = examples(2, 4)
    z = matrix(held) @ w + b

    def loss(t: float) -> float:
        s = z / t
        return float((np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(truth)), truth]).mean())

    temperature = min(np.geomspace(0.05, 4, 45), key=loss)
    kept = {g: tuple(float(round(v / 3, 6)) for v in w[k]) for g, k in vocabulary.items() if np.abs(w[k]).max() > 1e-4}
    return LicenceModel(families, tuple(float(v) for v in b), kept, float(temperature))


def _gram_column(words: str):
    """All n-grams of an array of words, distinct, as a Spark expression."""
    parts = [f"transform(sequence(0, size({words}) - {n}), i -> array_join(slice({words}, i + 1, {n}), ' '))" for n in range(1, _LONGEST + 1)]
    parts = [f"if(size({words}) >= {n}, {p}, array())" for n, p in enumerate(parts, 1)]
    return F.expr(f"array_distinct(concat({', '.join(parts)}))")


def marks() -> dict[str, str]:
    """N-grams that stand in one family's notices alone, and no stop words only: gram -> family."""
    families: dict[str, set[str]] = {}
    for family, notices in NOTICES.items():
        for notice in notices:
            for g in grams(tokens(notice)):
                families.setdefault(g, set()).add(family)
    return {g: next(iter(of)) for g, of in families.items() if len(of) == 1 and _informative(g)}


@lru_cache(1)
def triggers() -> tuple[str, ...]:
    """Of each mark one word, the one in fewest notices: a paragraph without any of them holds no mark."""
    often = Counter(w for notices in NOTICES.values() for n in notices for w in set(tokens(n)))
    return tuple(sorted({min((w for w in g.split() if w not in _STOP), key=lambda w: (often[w], w)) for g in marks()} | set(WORDS)))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph_no, words) of each paragraph that holds a trigger: the words of a line or of wrapped lines.

    Every line is a paragraph, and so are lines that are wrapped: each but the last isn't blank and
    ends in no full stop, colon, semicolon, question or exclamation mark. Numbers count the lines
    first, then the wrapped paragraphs.
    """
    texts = docs.select("doc_id", F.regexp_replace(F.col("text").cast("string"), r"[ \t\r]+(?=\n|\z)", "").alias("text"))
    joined = F.regexp_replace("text", r"(?<=[^\n.:;?!])\n(?=[^\n])", "\u0001")
    wrapped = F.filter(F.split(joined, "\n"), lambda p: F.contains(p, F.lit("\u0001")))
    whole = texts.select("doc_id", F.posexplode(F.concat(F.split("text", "\n"), wrapped)).alias("paragraph_no", "paragraph"))
    words = whole.select("doc_id", "paragraph_no", F.regexp_extract_all(F.lower("paragraph"), F.lit(f"({_TOKEN})")).alias("words"))
    return words.where(F.arrays_overlap("words", F.array(*map(F.lit, triggers()))))


def classify(found: DataFrame, model: LicenceModel | None = None, confirm: float = 0.6) -> DataFrame:
    """(doc_id, paragraph_no, family, probability, template_share, families) of each distinct paragraph (doc_id, paragraph_no, words).

    family, probability: the likeliest class; template_share: how much of one of its notices'
    n-grams the paragraph holds. families: those confirmed, none if unknown is the likeliest. The
    comparison confirms the likeliest, and others that the classifier finds likelier than unknown
    and unlisted, if the paragraph holds `confirm` of the n-grams of a notice of theirs (of one of three words or
    fewer, all), and a mark of theirs.
    """
    model = model or train()
    spark: SparkSession = found.sparkSession
    names = model.families
    key = ["doc_id", "paragraph_no", "unit"]
    # all three tables are fixed in size: the model's n-grams, the notices' and the marks
    weights = spark.createDataFrame([(g, list(w)) for g, w in model.weights.items()], "gram string, w array<double>")
    templates = spark.createDataFrame([(f, g, len(grams(tokens(n))), k) for f, notices in NOTICES.items() for k, n in enumerate(notices) for g in sorted(grams(tokens(n)))], "family string, gram string, size int, notice int")
    marked = spark.createDataFrame(sorted(marks().items()), "gram string, mark_of string")
    units = found.select("doc_id", "paragraph_no", F.xxhash64("words").alias("unit"), "words").dropDuplicates(key)
    held = units.select(*key, F.explode(_gram_column("words")).alias("gram"))
    z = units.select(*key, F.lit("").alias("gram")).unionByName(held).join(F.broadcast(weights), "gram", "left")
    z = z.groupBy(*key).agg(*[F.coalesce(F.sum(F.col("w")[k]), F.lit(0.0)).alias(f"z{k}") for k in range(len(names))])
    z = z.withColumn("z", F.array(*[(F.col(f"z{k}") + model.bias[k]) / model.temperature for k in range(len(names))])).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))
    likelier = F.transform(F.filter(F.arrays_zip(F.array(*map(F.lit, names)).alias("name"), F.col("z").alias("z")), lambda x: x["z"] > F.greatest(F.element_at("z", len(names)), F.element_at("z", len(names) - 1))), lambda x: x["name"])
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("z", F.col("top")).cast("int"))
    z = z.select(*key, best.alias("family"), (1 / total).alias("probability"), likelier.alias("likelier"))
    share = held.join(F.broadcast(templates), "gram").join(F.broadcast(marked), "gram", "left").groupBy(*key, "family", "notice")
    counted = F.count(F.lit(1)) / F.first("size")
    # of a notice of three words or fewer all must be there
    share = share.agg(F.when((F.first("size") > 6) | (counted == 1), counted).otherwise(0.0).alias("share"), F.max(F.coalesce(F.col("mark_of") == F.col("family"), F.lit(False))).alias("marked"))
    share = share.groupBy(*key, "family").agg(F.max("share").alias("share"), F.max("marked").alias("marked"))
    share = share.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("family", "share"))).alias("shares"), F.collect_set(F.when(F.col("marked") & (F.col("share") >= confirm), F.col("family"))).alias("agreed"))
    out = z.alias("a").join(share.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key], "left")
    known = F.array_sort(F.array_intersect("likelier", F.coalesce("agreed", F.array().cast("array<string>"))))
    for family, kinds in KINDS.items():
        known = F.when(F.arrays_overlap(known, F.array(*map(F.lit, kinds))), F.array_remove(known, family)).otherwise(known)
    families = F.when(F.col("family").isin(UNKNOWN, UNLISTED), F.array().cast("array<string>")).otherwise(known)
    return out.select("a.doc_id", "a.paragraph_no", "family", "probability", F.coalesce(F.try_element_at("shares", "family"), F.lit(0.0)).alias("template_share"), families.alias("families"))


def scan(docs: DataFrame, confirm: float = 0.6) -> DataFrame:
    """(doc_id, n_candidates, n_confirmed, n_unlisted, licences, probability): one row for each row of docs.

    n_candidates: the paragraphs (lines, and wrapped lines together) that hold a word of a mark or of
    WORDS; all others are unknown, as the comparison asks for a mark. licences: the distinct confirmed
    families, sorted; n_unlisted: paragraphs that give a licence which isn't among the families; probability: the greatest of a confirmed paragraph's likeliest class. Null
    and empty texts have no paragraphs; rows of one doc_id share their findings; an empty table
    gives no rows.
    """
    found = classify(paragraphs(docs), confirm=confirm)
    yes = F.size("families") > 0
    found = found.groupBy(F.col("doc_id").alias("found_id")).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if(yes).alias("n_confirmed"), F.count_if(F.col("family") == UNLISTED).alias("n_unlisted"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))).alias("licences"), F.max(F.when(yes, F.col("probability"))).alias("probability"),
    )
    out = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"), F.coalesce("n_confirmed", F.lit(0)).cast("long").alias("n_confirmed"), F.coalesce("n_unlisted", F.lit(0)).cast("long").alias("n_unlisted"), F.array_join(F.coalesce("licences", none), ",").alias("licences"), F.round("probability", 6).alias("probability"))
