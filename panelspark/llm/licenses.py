"""License scans: a trained paragraph classifier with an unknown class, confirmed by templates.

A paragraph is a maximal run of lines that hold a letter or digit; its lines are joined, and as words are runs of
letters and digits, comment marks fall away. Every paragraph is judged, and every line of one that is not itself
a confirmed licence. Features are word n-grams (2 and 3 words, one of them no function word). A multinomial logistic
regression with elastic net, trained here on varied notices, notices of unnamed licences, ordinary sentences and
scraps of notices, scores each family; temperature and acceptance level are fitted on whole notices kept from the
training. A family is confirmed when a notice of it is contained and none of another family is contained better;
what is licence-like but unsure or not confirmed is `unknown`. A text without any feature has the label of the bias, `none`.

Only DataFrame expressions and Spark's own trainer are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.llm.common import checkpoint, let

#: Function words; an n-gram of these alone is no feature.
FUNCTION_WORDS = "a an and any are as at be been but by can do does for from has have he her his i if in is it its may no not of on or our she should so such that the their there these they this those to was we were which who will with you your".split()


def _gnu(name: str, version: str) -> tuple[str, ...]:
    """The standard headers of a GNU licence and its short forms."""
    return (
        *(f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version." for thing in ("program", "library")),
        *(f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} version {version} as published by the Free Software Foundation." for thing in ("program", "library")),
        f"Licensed under the GNU {name}, version {version}.", f"GNU {name} version {version}", f"GNU {name} v{version}",
        f"Distributed under the terms of the GNU {name}, version {version} or later.",
    )


#: Notices by family; headers and paragraphs as their authors publish them, and the short forms in use.
NOTICES = {
    "agpl-3.0": (*_gnu("Affero General Public License", "3"), "GNU AGPL version 3", "Licensed under the AGPL v3", "Licensed under AGPL 3.0", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "BSD 3-Clause License", "BSD 2-Clause License", "Licensed under the BSD license", "New BSD License", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
        "Distributed under the Boost Software License, Version 1.0.", "Boost Software License 1.0", "SPDX-License-Identifier: BSL-1.0",
    ),
    "cc-by-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International", "CC BY 4.0", "CC BY 4.0 license", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-nc-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International", "CC BY-NC 4.0", "CC BY-NC 4.0 license", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-sa-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike 4.0 International", "CC BY-SA 4.0", "CC BY-SA 4.0 license", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication", "Dedicated to the public domain under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"),
    "epl-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "Eclipse Public License 2.0", "Eclipse Public License version 2.0", "Licensed under EPL 2.0", "SPDX-License-Identifier: EPL-2.0"),
    "gpl-2.0": (*_gnu("General Public License", "2"), "GNU GPL version 2", "GNU GPL v2", "Licensed under the GPL v2", "Licensed under GPL 2.0", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"),
    "gpl-3.0": (*_gnu("General Public License", "3"), "GNU GPL version 3", "GNU GPL v3", "Licensed under the GPL v3", "Licensed under GPL 3.0", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES",
        "Licensed under the ISC License", "ISC license", "SPDX-License-Identifier: ISC",
    ),
    "lgpl-2.1": (*_gnu("Lesser General Public License", "2.1"), "GNU LGPL version 2.1", "GNU LGPL v2.1", "Licensed under the LGPL v2.1", "Licensed under LGPL 2.1", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "lgpl-3.0": (*_gnu("Lesser General Public License", "3"), "GNU LGPL version 3", "GNU LGPL v3", "Licensed under the LGPL v3", "Licensed under LGPL 3.0", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
        "MIT License", "Licensed under MIT", "MIT licensed", "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License version 2.0", "Licensed under MPL 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "Released under the Unlicense", "The Unlicense", "SPDX-License-Identifier: Unlicense"),
    "zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "zlib license", "SPDX-License-Identifier: Zlib"),
}
#: Notices of no family here, and ordinary sentences in the words of licences.
UNKNOWN_NOTICES = (
    "Licensed under the terms of a custom agreement.", "This file is licensed under the Acme Community License, version 1.", "Copyright by the authors. All rights reserved.", "Copyright 2019 Acme Corporation. All rights reserved.", "Copyright (c) the publisher. All rights reserved.", "(C) 2004 The Company, all rights reserved.",
    "Released under the terms of our own source license.", "Use of this product is governed by the end user license agreement.", "This material is licensed for internal use only and may not be redistributed.",
    "Distributed under a proprietary license without warranty of any kind.", "This content is licensed under the Example Data License 3.1.", "Redistribution requires prior written permission of the copyright holder.",
    "Licensed under the Foobar Public License, version 4.", "Unauthorized copying of this file, via any medium, is strictly prohibited.", "This source code is proprietary and confidential and may not be copied or distributed without written permission.",
    "Released under the Banana License 2.0.", "You may use this data set for research purposes only under the terms of the data use agreement.", "Made available under the terms of the Sample Source License.",
)
#: Names of licences of no family here, and what stands around a name.
UNKNOWN_NAMES = ("Banana License 2.0", "Foobar Public License, version 4", "Sample Source License", "Acme Community License, version 1", "Vendor License Agreement", "Orange Data License 1.0", "Example General Terms")
AROUND = ("published under the terms of the {}", "is released under a {}", "our work is licensed under {}", "available under the {} see the file", "you may use it under the {}", "distributed under the {} only", "licensed by its authors under the {}")
OTHERS = (
    "She renewed her driver license last week in the city.", "He asked for permission to leave the room early.", "The warranty of the laptop ends after two years.", "A gnu is a large antelope of the open plains.",
    "Poetic license lets the author bend the facts a little.", "The police took a warrant to search the house.", "Copyright law was debated in parliament for months.", "The license plate of the car was hard to read.",
    "Taxes redistribute income from one group to another.", "His fishing license cost twenty dollars.", "With the permission of his parents he went to the concert.", "The restaurant lost its liquor license in spring.",
    "The software is slow on old machines but the authors fixed it in version 2 and version 3.", "The apache helicopter landed near the village.", "Students at MIT built a small robot for the contest.", "The public domain of the village is kept by a gardener.",
    "A copy of the letter was sent to any person who asked.", "The general public was not allowed into the library.", "Free software was shown at the fair, and the foundation paid for it.", "The source code of the program was lost in a fire.",
)
#: Notices kept from the training, which fit temperature and acceptance level.
HELD = {
    "agpl-3.0": ("This project is licensed under the GNU Affero General Public License version 3.", "Released under the AGPL v3 license."),
    "apache-2.0": ("This project is licensed under the Apache License 2.0 - see the LICENSE file for details.", "Code in this repository is available under the Apache 2.0 license."),
    "bsd": ("This project is distributed under the BSD 3-Clause License.", "Released under the New BSD License, see LICENSE."),
    "cc-by-4.0": ("All text here is available under the Creative Commons Attribution 4.0 International License.",), "cc-by-nc-4.0": ("Images are provided under a CC BY-NC 4.0 license.",),
    "cc-by-sa-4.0": ("The article is made available under the Creative Commons Attribution-ShareAlike 4.0 International license.",), "cc0-1.0": ("The data is released under the CC0 1.0 Universal Public Domain Dedication.",),
    "gpl-2.0": ("The module is licensed under the GNU General Public License version 2 or later.",), "gpl-3.0": ("This tool is distributed under the GNU General Public License version 3.", "Released under the GNU GPL v3."),
    "isc": ("This package is released under the ISC license.",), "lgpl-2.1": ("The library is available under the GNU Lesser General Public License version 2.1.",), "lgpl-3.0": ("The library is available under the GNU Lesser General Public License version 3.",),
    "mit": ("This project is licensed under the MIT License - see the LICENSE file for details.", "Distributed under the MIT license."), "mpl-2.0": ("The code is available under the Mozilla Public License 2.0.",), "unlicense": ("This project is released under the Unlicense.",),
    "unknown": ("This software is licensed under the Orchard Source License, version 7.", "Copyright 2020 by the editors. All rights reserved.", "Licensed for internal use only; redistribution is prohibited."),
    "none": ("She lost her driver license on the way home.", "The library is open to the general public on Sundays.", "He wrote the software in the summer and sold copies to his friends."),
}
NONE, UNKNOWN = "none", "unknown"
#: Varied copies of each notice in the training, at most this many features, and the share of a notice that confirms it.
VARIANTS, FEATURES, CONFIRM = 12, 20000, 0.7
#: Share of the held-out family notices that the acceptance level takes.
ACCEPT = 0.98
STEPS = 21
#: Bits that tell which bigrams can begin a feature; others pass by chance and meet no weight.
FLAGS = 1 << 17


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _telling(gram: Column) -> Column:
    return F.size(F.array_except(F.split(F.substring_index(gram, " ", 2), " "), F.array(*[F.lit(w) for w in FUNCTION_WORDS]))) > 0


def ngrams(tokens: str, most: int = 3) -> Column:
    """Distinct n-grams of 2 to `most` words whose first two are not both function words."""
    parts = []
    for n in range(2, most + 1):
        last = F.size(tokens) - n + 1
        starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        parts.append(_joined(starts, tokens, n))
    return F.filter(F.array_distinct(F.concat(*parts)), _telling)


def _joined(starts: Column, tokens: str, n: int) -> Column:
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


@dataclass
class Model:
    """Weights as a table (gram, weights per label) of at most FEATURES rows, and what else a decision needs."""

    weights: DataFrame
    labels: list[str]
    bias: list[float]
    temperature: float
    least: float


def _examples(spark: SparkSession) -> DataFrame:
    """(label, tokens, grams) of varied notices: words dropped, filler added before and after; scraps and shuffled notices are `none`."""
    rows = [(f, t) for f, ts in NOTICES.items() for t in ts] + [(UNKNOWN, t) for t in UNKNOWN_NOTICES] + [(NONE, t) for t in OTHERS]
    # Short notices are mostly names, which stand in many phrases.
    names = [(f, t) for f, t in rows if f not in (UNKNOWN, NONE) and len(t.split()) <= 7 and not t.startswith(("SPDX", "Licensed", "Released", "Distributed", "Dedicated"))] + [(UNKNOWN, t) for t in UNKNOWN_NAMES]
    rows += [(f, phrase.format(t)) for f, t in names for phrase in AROUND]
    table = spark.createDataFrame(rows, "label string, text string").coalesce(4).withColumn("tokens", words(F.col("text")))
    varied = table.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    # Numbers tell versions apart, so only other words are dropped, and none of a short notice.
    kept = F.filter("tokens", lambda w: (F.col("v") < 4) | (F.size("tokens") < 12) | w.rlike("^v?[0-9]") | (F.pmod(F.xxhash64(w, "v", "text"), F.lit(12)) > 0))
    # Filler words say nothing about the family.
    filler = F.array(*[F.lit(w) for w in ("note", "file", "see", "below", "page", "project", "code", "data", "text", "notice")])
    def some(seed: int) -> Column:
        return F.slice(F.concat(filler, filler), F.pmod(F.xxhash64("v", "text", F.lit(seed)), F.lit(10)).cast("int") + 1, F.pmod(F.xxhash64("v", "text", F.lit(seed + 1)), F.lit(5)).cast("int"))
    whole = varied.select("label", F.concat(some(1), kept, some(3)).alias("tokens"))
    long = varied.where("size(tokens) >= 12 and v < 6")
    start = F.pmod(F.xxhash64("v", "text", F.lit(7)), F.size("tokens") - 3).cast("int") + 1
    scraps = long.where("v < 3").select(F.lit(NONE).alias("label"), F.concat(some(1), F.slice("tokens", start, F.lit(3)), some(3)).alias("tokens"))
    mixed = F.transform(F.array_sort(F.transform("tokens", lambda w, i: F.struct(F.xxhash64(w, i, "v").alias("h"), w.alias("w")))), lambda x: x["w"])
    shuffled = long.select(F.lit(NONE).alias("label"), mixed.alias("tokens"))
    return whole.unionByName(scraps).unionByName(shuffled).withColumn("grams", ngrams("tokens"))


def train(spark: SparkSession) -> Model:
    """Fit on about VARIANTS copies of each fixed notice; temperature and level come from the whole notices in HELD."""
    examples = checkpoint(_examples(spark))
    labels = sorted([*NOTICES, UNKNOWN, NONE])
    number = F.element_at(F.create_map(*[F.lit(x) for k, label in enumerate(labels) for x in (label, float(k))]), F.col("label"))
    early = examples.coalesce(2).withColumn("number", number)
    counter = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=FEATURES, minDF=2.0, binary=True).fit(early)
    fitted = LogisticRegression(labelCol="number", featuresCol="features", family="multinomial", regParam=5e-4, elasticNetParam=0.3, maxIter=40, standardization=False).fit(counter.transform(early))
    matrix = fitted.coefficientMatrix.toArray()
    rows = [(g, [float(x) for x in matrix[:, i]]) for i, g in enumerate(counter.vocabulary) if abs(matrix[:, i]).sum() > 0]
    bias = [float(x) for x in fitted.interceptVector]
    # Without features there is no licence.
    bias[labels.index(NONE)] = max(bias) + 0.01
    model = Model(spark.createDataFrame(rows, "gram string, w array<double>"), labels, bias, 1.0, 0.5)
    held = spark.createDataFrame([(k, f, t) for f, ts in HELD.items() for k, t in enumerate(ts)], "key long, label string, text string").withColumn("tokens", words(F.col("text")))
    late = checkpoint(margins(held.withColumn("grams", ngrams("tokens")), model, ["key", "label"]))
    grid = [math.exp(math.log(0.2) + k * math.log(100) / (STEPS - 1)) for k in range(STEPS)]
    hot = F.filter(F.arrays_zip(F.array(*[F.lit(x) for x in labels]).alias("n"), F.col("margins").alias("m")), lambda x: x["n"] == F.col("label"))[0]["m"]
    loss = [F.avg(_log_sum("margins", t) - hot / t).alias(str(k)) for k, t in enumerate(grid)]
    losses = late.select(*loss).first()
    model.temperature = grid[min(range(STEPS), key=lambda k: losses[k])]
    sure = late.where(~F.col("label").isin(UNKNOWN, NONE)).select((F.exp(hot / model.temperature - _log_sum("margins", model.temperature))).alias("p"))
    model.least = min(0.9, max(0.3, sure.approxQuantile("p", [1 - ACCEPT], 0.0)[0]))
    return model


#: The last session and its model.
_kept: list[tuple[SparkSession, Model]] = []


def trained(spark: SparkSession) -> Model:
    """The model of this session. It depends on the fixed notices alone, so one training serves every scan; each
    training leaves hundreds of MB of coefficient vectors for the driver to collect."""
    if not _kept or _kept[0][0] is not spark:
        _kept[:] = [(spark, train(spark))]
    return _kept[0][1]


def _log_sum(margins: str, t: float) -> Column:
    top = F.array_max(margins) / t
    return top + F.log(F.aggregate(margins, F.lit(0.0), lambda a, m: a + F.exp(m / t - top)))


def margins(rows: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """`keys` and margins (one per label) of rows with an array `grams`; keys must be unique."""
    hits = rows.select(*keys, F.explode_outer("grams").alias("gram")).join(F.broadcast(model.weights), "gram", "left")  # at most FEATURES rows
    sums = [F.coalesce(F.sum(F.col("w")[k]), F.lit(0.0)) + F.lit(model.bias[k]) for k in range(len(model.labels))]
    return hits.groupBy(*keys).agg(F.array(*sums).alias("margins"))


def judge(units: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """`keys`, family (none, unknown or a confirmed one), probability and containment of units with an array `grams`; keys must be unique."""
    names = F.array(*[F.lit(x) for x in model.labels])
    best = F.array_position("margins", F.array_max("margins")).cast("int")
    scored = margins(units, model, keys).select(*keys, F.element_at(names, best).alias("label"), F.exp(F.array_max("margins") / model.temperature - _log_sum("margins", model.temperature)).alias("probability"))
    met = scored.where(F.col("label") != NONE)
    rows = [(f, f"{f} {k}", t) for f, ts in NOTICES.items() for k, t in enumerate(ts)]
    notices = units.sparkSession.createDataFrame(rows, "of string, notice string, text string").withColumn("tokens", words(F.col("text"))).withColumn("grams", ngrams("tokens", 2))
    notices = notices.select("of", "notice", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    # Grams of a unit and of a notice are distinct, so pairs count what both hold.
    pairs = units.join(met.select(*keys), keys).select(*keys, F.explode("grams").alias("gram")).join(F.broadcast(notices), "gram")  # the bigrams of the fixed notices
    shares = pairs.groupBy(*keys, "of", "notice").agg((F.count(F.lit(1)) / F.first("n")).alias("share")).groupBy(*keys, "of").agg(F.max("share").alias("share"))
    best = met.select(*keys, "label").join(shares, keys).groupBy(*keys).agg(F.max(F.when(F.col("of") == F.col("label"), F.col("share"))).alias("containment"), F.max(F.when(F.col("of") != F.col("label"), F.col("share"))).alias("rival"))
    met = met.join(best, keys, "left").fillna(0.0, ["containment", "rival"])
    sure = (F.col("probability") >= model.least) & (F.col("containment") >= CONFIRM) & (F.col("containment") >= F.col("rival")) & (F.col("label") != UNKNOWN)
    judged = met.select(*keys, F.when(sure, F.col("label")).otherwise(UNKNOWN).alias("family"), "probability", "containment")
    return judged.unionByName(scored.where(F.col("label") == NONE).select(*keys, F.lit(NONE).alias("family"), "probability", F.lit(0.0).alias("containment")))


def classify(lines: DataFrame, model: Model) -> DataFrame:
    """(line, family, probability, containment) per distinct text in column `line`, each judged as one paragraph."""
    units = lines.select("line").distinct().withColumn("tokens", words(F.col("line"))).withColumn("grams", ngrams("tokens"))
    return judge(units, model, ["line"])


def _place(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FLAGS)).cast("int")


def flags(model: Model) -> Column:
    """FLAGS bits in longs, set where the hash of a bigram that is or starts a feature falls, or one of a notice: a constant of 16 KiB."""
    session = model.weights.sparkSession
    templates = session.createDataFrame([(t,) for ts in NOTICES.values() for t in ts], "notice string").withColumn("tokens", words(F.col("notice")))
    grams = model.weights.select(F.substring_index("gram", " ", 2).alias("gram")).unionByName(templates.select(F.explode(ngrams("tokens", 2)).alias("gram")))
    packed = [0] * (FLAGS // 64)
    for row in grams.select(_place(F.col("gram")).alias("place")).distinct().collect():  # the bigrams of the fixed notices
        packed[row.place >> 6] |= 1 << (row.place & 63)
    return F.split(F.lit(" ".join(str(x - (1 << 64) if x >> 63 else x) for x in packed)), " ").cast("array<long>")


def _evidence(text: Column, bits: Column) -> Column:
    """The n-grams of a text that may be features; only these can bring a weight or match a notice."""
    none = F.array().cast("array<string>")

    def of(tokens: Column) -> Column:
        def pair(i: Column) -> Column:
            return F.concat(F.get(tokens, i), F.lit(" "), F.get(tokens, i + 1))

        def known(i: Column) -> Column:
            return let(_place(pair(i)), lambda p: F.getbit(F.get(bits, F.shiftright(p, 6)), F.pmod(p, F.lit(64))) == 1)

        places = F.filter(F.sequence(F.lit(0), F.size(tokens) - 2), known)
        found = F.flatten(F.transform(places, lambda i: F.array(pair(i), F.concat_ws(" ", pair(i), F.get(tokens, i + 2)))))
        return F.when(F.size(tokens) > 1, F.array_distinct(found)).otherwise(none)

    return let(words(text), of)


def _units(text: Column, bits: Column) -> Column:
    """array<struct<paragraph, first_line, last_line, grams>>: paragraphs with evidence, and the lines with evidence of those of several lines."""
    def of(lines: Column) -> Column:
        def within(written: Column) -> Column:
            every = F.sequence(F.lit(0), F.size(lines) - 1)
            starts = F.filter(every, lambda i: F.get(written, i) & ~F.coalesce(F.get(written, i - 1), F.lit(False)))
            ends = F.filter(every, lambda i: F.get(written, i) & ~F.coalesce(F.get(written, i + 1), F.lit(False)))

            def judged(a: Column, b: Column) -> Column:
                def unit(first: Column, last: Column, grams: Column) -> Column:
                    return F.struct(a.alias("paragraph"), first.alias("first_line"), last.alias("last_line"), grams.alias("grams"))

                def both(grams: Column) -> Column:
                    single = F.filter(F.transform(F.sequence(a, b), lambda i: unit(i, i, _evidence(F.get(lines, i), bits))), lambda u: F.size(u["grams"]) > 0)
                    whole = F.array(unit(a, b, grams))
                    return F.when(F.size(grams) == 0, F.slice(whole, 1, 0)).when(a == b, whole).otherwise(F.concat(whole, single))

                return let(_evidence(F.array_join(F.slice(lines, a + 1, b - a + 1), " "), bits), both)

            return F.flatten(F.zip_with(starts, ends, judged))

        return let(F.transform(lines, lambda x: x.rlike(r"[\p{L}\p{N}]")), within)

    return let(F.split(text, "\n"), of)


def _chosen(spans: str, whole: str) -> Column:
    """Of a paragraph's verdict and those of its lines, the ones that stand (see `scan`)."""
    def but(x: Column) -> Column:
        return (x["family"] != UNKNOWN) & ((x["family"] == F.col(whole)["family"]) | (x["containment"] >= F.col(whole)["containment"]))

    named = F.col(whole).isNotNull() & (F.col(whole)["family"] != UNKNOWN)
    lines = F.when(named, F.filter(spans, but)).otherwise(F.col(spans))

    def joined(kept: Column) -> Column:
        add = F.when(named, ~F.exists(kept, lambda x: x["family"] == F.col(whole)["family"])).otherwise(F.col(whole).isNotNull() & (F.size(kept) == 0))
        return F.when(add, F.concat(F.array(F.col(whole)), kept)).otherwise(kept)

    return let(lines, joined)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_paragraphs, n_licences, families, spans) of every document.

    spans is array<struct<first_line, last_line, family, probability, containment>> of the licences, by line number
    from 0; families are the distinct ones, sorted. A line that is a licence by itself is a span; a paragraph of several
    lines is one where it is of a family that none of its lines shows, which then replaces unknown lines and
    lines that match another family's notice less well; it is an unknown one only where no line is a licence.
    Null texts are empty; null and repeated ids and repeated rows stay, extra columns are ignored.
    Every word is read. Equal texts, and equal paragraphs and lines, are judged once, so a notice that a third of
    the documents share costs one row.
    """
    model = model or trained(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = flags(model)
    # A paragraph starts at a line with a letter or digit after one without.
    paragraphs = F.size(F.filter(F.split(text, r"\n(?:[^\p{L}\p{N}\n]*\n)+"), lambda x: x.rlike(r"[\p{L}\p{N}]")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), paragraphs.cast("long").alias("n_paragraphs"), _units(text, bits).alias("found"))
    base = checkpoint(base)
    # Equal texts have equal licences, so evidence is gathered per text, not per row.
    units = base.where("size(found) > 0").groupBy("t1", "t2").agg(F.first("found").alias("found")).select("t1", "t2", F.explode("found").alias("x")).select("t1", "t2", "x.*")
    units = units.withColumns({"g1": F.xxhash64("grams"), "g2": F.xxhash64(F.lit("second"), "grams")})
    judged = judge(units.groupBy("g1", "g2").agg(F.first("grams").alias("grams")), model, ["g1", "g2"]).where(F.col("family") != NONE)
    span = F.struct("first_line", "last_line", "family", "probability", "containment")
    alone = (F.col("first_line") == F.col("last_line"))
    spans = units.drop("grams").join(judged, ["g1", "g2"]).groupBy("t1", "t2", "paragraph").agg(F.sort_array(F.collect_list(F.when(alone, span))).alias("own"), F.max(F.when(~alone, span)).alias("whole"))
    spans = spans.groupBy("t1", "t2").agg(F.array_sort(F.flatten(F.collect_list(_chosen("own", "whole")))).alias("spans"))
    out = base.drop("found").join(spans, ["t1", "t2"], "left")
    empty = F.array().cast("array<struct<first_line:int,last_line:int,family:string,probability:double,containment:double>>")
    out = out.withColumn("spans", F.coalesce("spans", empty))
    families = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["family"])))
    return out.select("doc_id", "n_paragraphs", F.size("spans").cast("long").alias("n_licences"), families.alias("families"), "spans")
