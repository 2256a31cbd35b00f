"""Licence scan by a trained paragraph classifier.

Paragraphs (blocks of lines between blank ones) are read in windows of WINDOW words, a new one each STEP words, so that a notice is found
inside longer prose and across line feeds. A window is counts of hashed word 1- and 2-grams; a multinomial logistic
regression with a sparse penalty tells it for one of the licence families, for a licence of another family, or for none.

It is trained on labelled notices (NOTICES, OTHER_NOTICES and NO_NOTICES below, or a table of reviewed paragraphs besides) alone and
inside windows of a bounded sample of the corpus. Notices and documents are parted before windows are cut: those held out
fit a temperature, which calibrates the probabilities, the bar at which no more than WRONG of the held-out family predictions are wrong, and
the bar at which no more than FALSE of the held-out windows without a notice are held for any licence. What is likely a licence
by the second bar, but below the first, of another family or with the name of one, is of family unknown.

A prediction is confirmed by comparison with the family's notices word by word, in order: a run of RUN_WORDS words or more of the window and the words
around it must stand in a notice, with a pair of words that no other family has, or a SHORT notice must stand in it whole.

A window is classified only if the sum of the largest advantage over none that each of its words and pairs can give to any class
is high enough for the second bar. This bound never leaves out a window that the classifier would report, and is cheap: weights are looked up by hash.

Defined results: a null text has no paragraph; blank paragraphs are of no family; equal texts get equal results, equal
rows all stay; ties of probability go to the class first in the alphabet; an empty table gives no rows; columns of the input keep their names and
values, result columns replace any of the same name.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairline.llm.common import cut, spread_join

# Notices of licence families, as their authors publish them; the last of each family is held out.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind, either express or implied.",
        "Licensed under the Apache License, Version 2.0.",
        "This project is licensed under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache License, Version 2.0.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "This project is licensed under the BSD 3-Clause License.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "You are free to share and adapt the material for any purpose, even commercially, under the Attribution term.",
        "This article is available under the Creative Commons Attribution License, CC BY 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "You may not use the material for commercial purposes, NonCommercial only.",
        "This article is available under the Creative Commons Attribution-NonCommercial License, CC BY-NC 4.0.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or at your option any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU General Public License, version 3.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense.",
        "Released under the MIT License.",
        "The MIT License (MIT).",
        "This project is licensed under the MIT License.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0. If a copy of the MPL was not distributed with this file, you can obtain one at.",
        "SPDX-License-Identifier: MPL-2.0",
        "Released under the Mozilla Public License, version 2.0.",
        "This project is licensed under the Mozilla Public License 2.0.",
    ],
    "reserved": [
        "All rights reserved.",
        "No part of this publication may be reproduced, stored or transmitted in any form without prior written permission of the copyright holder.",
        "Copyright. All rights reserved by the author.",
        "Copyright by the publisher. All rights reserved.",
    ],
}
# Notices of families that are reported as unknown; every third is held out.
OTHER_NOTICES = [
    "This work is licensed under the GNU Lesser General Public License, version 3.",
    "This program is licensed under the GNU Affero General Public License, version 3.",
    "This program and the accompanying materials are made available under the Eclipse Public License 2.0.",
    "Licensed under CC BY-SA 4.0.",
    "Licensed under the European Union Public Licence 1.2.",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "This is free and unencumbered software released into the public domain, the Unlicense.",
    "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted, the ISC License.",
    "Licensed under the Artistic License 2.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Released under the zlib License.",
    "Licensed under CC BY-ND 4.0.",
]
# Lines that share words with notices and are none; every third is held out.
NO_NOTICES = [
    "Copyright holder rights.", "Version 2.0.", "The driver's license was issued in version 3 of the form.", "She asked permission of the public library to copy the file.",
    "General conditions of the software market are free of charge.", "He was granted a commercial license to deal in wine.", "The software is distributed with source code.",
    "Terms and conditions of use.", "Any later version of the work was published by the foundation.", "The copyright notice was retained.", "Material may be adapted for any purpose.", "Without limitation, rights were reserved for members.",
]
# Notices shorter than RUN_WORDS, and words in the names of families without notices above.
SHORT = {"mit": ["the mit license"], "reserved": ["all rights reserved"]}
OTHERS = "affero agpl artistic boost bsl cddl cecill cpl ecl eclipse epl eupl fdl isc lesser lgpl library nd noderivatives noderivs ofl openssl sa sharealike sspl unlicense wtfpl zlib".split()
NONE, UNKNOWN = "none", "unknown"
CLASSES = sorted([NONE, UNKNOWN, *NOTICES])
WORD = r"[\p{L}\p{N}]+"
#: Hash values for words and for pairs; words of a window, between the starts of windows, and before and after a window that are compared too.
BUCKETS, WINDOW, STEP, AROUND = 1 << 12, 16, 4, 12
#: Documents whose windows are sampled, about, and windows of the sample that each notice is put into; allowed shares of wrong families and of false licences; words of a confirming run.
SAMPLE_DOCS, MIXED, WRONG, FALSE, RUN_WORDS = 1500, 12, 0.01, 0.001, 4
FINDINGS = "array<struct<place:int,family:string,probability:double,confirmed:boolean>>"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def paragraphs_of(text: Column) -> Column:
    return F.split(text, r"\n\s*\n", -1)


def plain_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _bucket(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def grams(words: Column) -> Column:
    """The hash values of a window's words, and of its pairs from BUCKETS on."""
    ones = F.transform(words, lambda w: _bucket(w))
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: _bucket(w, F.get(words, i + 1)) + BUCKETS)
    return F.transform(F.concat(ones, pairs), lambda g: g.cast("string"))


def labelled_rows(spark: SparkSession, docs: DataFrame, text_col: str, labelled: DataFrame | None) -> DataFrame:
    """(words, family, held): windows of notices, alone and between words of sampled documents, and windows of these; held ones calibrate."""
    rows = [(n, f, i == len(own) - 1) for f, own in NOTICES.items() for i, n in enumerate(own)]
    rows += [(n, f, i % 3 == 2) for own, f in ((OTHER_NOTICES, UNKNOWN), (NO_NOTICES, NONE)) for i, n in enumerate(own)]
    notices = spark.createDataFrame(rows, "text string, family string, held boolean")
    if labelled is not None:
        reviewed = labelled.where(F.col("text").isNotNull() & F.col("family").isin(CLASSES)).select("text", "family")
        notices = notices.union(reviewed.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(5)) == 0))
    notices = notices.select("family", "held", words_of(F.col("text")).alias("all")).where(F.size("all") > 0)
    ends = F.transform(F.sequence(F.lit(0), F.greatest(F.size("all") - WINDOW, F.lit(0)), F.lit(4)), lambda i: F.slice("all", i + 1, F.lit(WINDOW)))
    spans = notices.select("family", "held", F.explode(ends).alias("span"))
    every = max(1, docs.count() // SAMPLE_DOCS)
    text = F.col(text_col)
    sample = docs.where(F.pmod(F.xxhash64(F.lit("sample"), text), F.lit(every)) == 0).select(text.alias("text")).distinct()
    sample = sample.select((F.pmod(F.xxhash64(F.lit("held"), "text"), F.lit(5)) == 0).alias("held"), F.explode(paragraphs_of(F.col("text"))).alias("paragraph"))
    sample = sample.select("held", words_of(F.col("paragraph")).alias("all")).where(F.size("all") > 0).withColumn("hash", F.xxhash64("all"))
    # four windows of a paragraph, drawn by a hash of its words and their place, so that they are the same however rows are dealt
    drawn = F.slice(F.array_sort(F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(WINDOW)), lambda i: F.struct(F.xxhash64("hash", i).alias("draw"), i.alias("at")))), 1, 4)
    cuts = F.transform(drawn, lambda d: F.slice("all", d["at"] + 1, F.lit(WINDOW)))
    telling = sorted({t for own in [*_triples().values(), _triples({"": OTHER_NOTICES})[""]] for t in own})
    # a window of the corpus with three words of a notice in a row may be one
    plain = sample.select("held", F.explode(cuts).alias("words")).where(~F.arrays_overlap(_joined(F.col("words"), 3), F.array(*map(F.lit, telling))))
    plain = plain.withColumn("turn", F.pmod(F.xxhash64("words"), F.lit(64)))
    mixed = spans.withColumn("turn", F.explode(F.array(*[F.pmod(F.xxhash64("span", F.lit(k)), F.lit(64)) for k in range(MIXED)])))
    mixed = mixed.join(plain.groupBy("held", "turn").agg(F.min("words").alias("words")), ["held", "turn"])
    free = F.greatest(F.lit(0), F.lit(WINDOW) - F.size("span"))
    before = F.pmod(F.xxhash64("span", "turn"), free + 1).cast("int")
    between = F.concat(F.slice("words", 1, before), "span", F.slice("words", before + 1, free - before))
    out = spans.select(F.col("span").alias("words"), "family", "held").union(mixed.select(between, "family", "held"))
    return out.union(plain.select("words", F.lit(NONE), "held"))


def _pairs() -> dict[str, list[str]]:
    """The pairs of neighbouring words that only one family's notices have."""
    split = {f: [plain_words(n) for n in own] for f, own in NOTICES.items()}
    own = {f: {f"{a} {b}" for w in each for a, b in zip(w, w[1:], strict=False)} for f, each in split.items()}
    return {f: sorted(p - set().union(*[own[g] for g in own if g != f])) for f, p in own.items()}


def _triples(notices: dict[str, list[str]] = NOTICES) -> dict[str, list[str]]:
    split = {f: [plain_words(n) for n in own] for f, own in notices.items()}
    return {f: sorted({" ".join(w[i : i + 3]) for w in each for i in range(len(w) - 2)}) for f, each in split.items()}


def _by_family(lists: dict[str, list[str]]) -> Column:
    return F.create_map(*[c for f, own in sorted(lists.items()) for c in (F.lit(f), F.array(*map(F.lit, own)))])


def _joined(words: Column, n: int) -> Column:
    """The runs of n words, as strings."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (n - 1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def confirmed(words: Column, family: Column) -> Column:
    """Whether a run of the words stands in a notice of the family, in order, or a short notice in the words."""
    known = F.element_at(_by_family(_triples()), family)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def longer(s: Column, triple: Column) -> Column:
        now = F.when(F.array_contains(known, triple), s["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    run = F.aggregate(_joined(words, 3), start, longer, lambda s: s["best"])
    own = F.arrays_overlap(_joined(words, 2), F.element_at(_by_family(_pairs()), family))
    short = F.exists(F.element_at(_by_family(SHORT | {f: [] for f in NOTICES if f not in SHORT}), family).cast("array<string>"), lambda p: F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" "))))
    return F.coalesce((run >= RUN_WORDS - 2) & own | short, F.lit(False))


class Classifier:
    """A fitted classifier with its temperature and the least probabilities at which a family and any licence are believed."""

    def __init__(self, spark: SparkSession, docs: DataFrame, text_col: str = "text", labelled: DataFrame | None = None):
        rows = cut(labelled_rows(spark, docs, text_col, labelled).select("held", "family", grams(F.col("words")).alias("grams")), "licences")
        rows = rows.withColumn("label", (F.array_position(F.array(*map(F.lit, CLASSES)), F.col("family")) - 1).cast("double"))
        # a bounded sample in one order: sums of doubles, and so the model, do not depend on how documents are dealt
        own, held = (rows.where(F.col("held") == h).repartition(1).sortWithinPartitions("family", "grams") for h in (False, True))
        self.counter = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=2 * BUCKETS).fit(own)
        self.model = LogisticRegression(maxIter=40, regParam=0.0001, elasticNetParam=0.3, family="multinomial", standardization=False).fit(self.counter.transform(own))
        held = cut(self.raw(held).select("label", "raw"), "held")
        self.temperature, self.bar, self.any_bar = 1.0, 0.5, 0.5
        self._calibrate(held)

    def raw(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(self.counter.transform(rows)).withColumn("raw", vector_to_array("rawPrediction"))

    def _calibrate(self, held: DataFrame) -> None:
        """The temperature of the least loss over the held-out rows, then the lowest bar with few enough wrong families."""
        grid = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
        losses = held.agg(*[F.avg(-F.log(F.greatest(F.lit(1e-12), F.element_at(_softmax(F.col("raw"), t), F.col("label").cast("int") + 1)))).alias(f"t{i}") for i, t in enumerate(grid)]).first()
        if losses[0] is None:
            return
        self.temperature = min(zip(losses, grid, strict=True))[1]
        p = _softmax(F.col("raw"), self.temperature)
        tried = held.withColumn("p", p).withColumn("best", F.array_max("p")).withColumn("at", F.array_position("p", F.col("best")))
        tried = tried.where(~F.element_at(F.array(*map(F.lit, CLASSES)), F.col("at").cast("int")).isin(NONE, UNKNOWN))
        wrong = F.col("at") != F.col("label") + 1
        bars = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
        counts = tried.agg(*[f(c).alias(f"{k}{i}") for i, b in enumerate(bars) for k, f, c in (("n", F.count_if, F.col("best") >= b), ("w", F.count_if, (F.col("best") >= b) & wrong))]).first()
        licence = 1 - F.element_at(p, CLASSES.index(NONE) + 1)
        plain = held.where(F.col("label") == CLASSES.index(NONE)).agg(F.count("*").alias("n"), *[F.count_if(licence >= b).alias(f"w{i}") for i, b in enumerate(bars)]).first()
        self.any_bar = next((b for i, b in enumerate(bars) if plain[f"w{i}"] <= FALSE * plain["n"]), bars[-1])
        self.bar = next((b for i, b in enumerate(bars) if counts[f"w{i}"] <= WRONG * counts[f"n{i}"]), bars[-1])

    def advantage(self) -> tuple[Column, float]:
        """For each hash value the largest advantage over none that it can give to a class, as one array, and that of the intercepts less what is needed."""
        none = CLASSES.index(NONE)
        weights, base = self.model.coefficientMatrix.toArray(), self.model.interceptVector.toArray()
        best = np.delete(weights - weights[none], none, axis=0).max(axis=0)
        table = np.zeros(2 * BUCKETS)
        for gram, x in zip(self.counter.vocabulary, best.tolist(), strict=True):
            table[int(gram)] = x
        table[BUCKETS:] = np.maximum(table[BUCKETS:], 0)  # a pair may reach over the end of a window
        table += 1e-6 * (table != 0)  # rounding never lowers the bound
        needed = self.temperature * math.log(self.any_bar / (1 - self.any_bar) / (len(CLASSES) - 1))  # if all classes were alike
        return F.from_json(F.lit(json.dumps(np.round(table, 6).tolist())), "array<double>"), float(np.delete(base - base[none], none).max() - needed)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once a row: a column named in a step before may be computed anew at each use in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _softmax(raw: Column, temperature: float) -> Column:
    powers = _let(raw, lambda r: _let(F.array_max(r), lambda top: F.transform(r, lambda x: F.exp((x - top) / temperature))))
    return _let(powers, lambda p: _let(F.aggregate(p, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(p, lambda x: x / total)))


def candidates(docs: DataFrame, text_col: str, classifier: Classifier) -> DataFrame:
    """(t1, t2, place, words, around): the windows that can be held for a licence."""
    text = F.col(text_col)
    table, base = classifier.advantage()

    def starts(words: Column) -> Column:
        return F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - (WINDOW - STEP) - 1), F.lit(STEP))

    def steps(words: Column) -> Column:
        """What the words can gain, summed for each STEP words."""
        gains = F.transform(words, lambda w, i: F.get(table, _bucket(w)) + F.get(table, _bucket(w, F.get(words, i + 1)) + BUCKETS))
        return _let(gains, lambda g: F.transform(F.sequence(F.lit(0), F.size(g) - 1, F.lit(STEP)), lambda i: F.aggregate(F.slice(g, i + 1, F.lit(STEP)), F.lit(0.0), lambda s, x: s + x)))

    def likely(words: Column) -> Column:
        def sums(g: Column, i: Column) -> Column:
            return sum((F.coalesce(F.get(g, (i / STEP).cast("int") + k), F.lit(0.0)) for k in range(WINDOW // STEP)), F.lit(base))

        def window(i: Column) -> Column:
            around = F.slice(words, F.greatest(F.lit(1), i + 1 - AROUND), F.lit(WINDOW + AROUND) + F.least(i, F.lit(AROUND)))
            return F.struct(F.slice(words, i + 1, F.lit(WINDOW)).alias("words"), around.alias("around"))

        return _let(steps(words), lambda g: F.transform(F.filter(starts(words), lambda i: sums(g, i) >= 0), window))

    def found(paragraph: Column) -> Column:
        return _let(words_of(paragraph), lambda words: F.when(F.size(words) > 0, likely(words)))

    each = docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("2"), text).alias("t2"), F.posexplode(paragraphs_of(text)).alias("place", "paragraph"))
    # outer, as Spark would compute the windows twice to leave empty lists out before
    each = each.select("t1", "t2", "place", F.explode_outer(found(F.col("paragraph"))).alias("found")).where("found is not null")
    return each.select("t1", "t2", "place", "found.words", "found.around")


def predict(classifier: Classifier, rows: DataFrame) -> DataFrame:
    """rows (words) with family and calibrated probability; rows that are hardly a licence are left out. Unknown: the probability of any licence."""
    out = classifier.raw(rows.withColumn("grams", grams(F.col("words")))).withColumn("p", _softmax(F.col("raw"), classifier.temperature)).drop("grams", "features", "raw", "rawPrediction", "probability", "prediction")
    none = F.element_at("p", CLASSES.index(NONE) + 1)
    best = F.array_max("p")
    family = F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position("p", best).cast("int"))
    out = out.withColumns({"family": family, "probability": best, "none": none}).where(1 - F.col("none") >= classifier.any_bar)
    known = ~F.col("family").isin(NONE, UNKNOWN) & (F.col("probability") >= classifier.bar) & ~F.arrays_overlap("words", F.array(*map(F.lit, OTHERS)))
    out = out.withColumn("known", known)
    return out.withColumn("family", F.when(F.col("known"), F.col("family")).otherwise(UNKNOWN)).withColumn("probability", F.when(F.col("known"), F.col("probability")).otherwise(1 - F.col("none"))).drop("known", "none", "p")


def scan(docs: DataFrame, text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """docs with n_paragraphs, n_licences, families (sorted) and findings (paragraph number, family or unknown, probability of it or of any licence, confirmed).

    labelled: (text, family) of reviewed paragraphs, to learn from besides; family may be none or unknown.
    """
    added = ("n_paragraphs", "n_licences", "families", "findings")
    kept = [c for c in docs.columns if c not in added]
    classifier = Classifier(docs.sparkSession, docs, text_col, labelled)
    rated = predict(classifier, candidates(docs, text_col, classifier))
    rated = rated.withColumn("confirmed", (F.col("family") != UNKNOWN) & confirmed(F.col("around"), F.col("family")))
    # one finding of each family in a paragraph; unknown, and what is not confirmed, only beside none that is
    rated = rated.groupBy("t1", "t2", "place", "family").agg(F.max("confirmed").alias("confirmed"), F.max("probability").alias("probability"))
    sure = F.max("confirmed").over(Window.partitionBy("t1", "t2", "place"))
    rated = rated.withColumn("sure", sure).where("confirmed or not sure")
    per_text = cut(rated.groupBy("t1", "t2").agg(F.array_sort(F.collect_list(F.struct("place", "family", "probability", "confirmed"))).alias("found")), "findings")
    text = F.col(text_col)
    blocks = F.size(F.filter(paragraphs_of(text), lambda p: p.rlike(WORD)))
    n = F.when(text.isNull(), 0).otherwise(blocks).cast("long")
    keyed = docs.select(F.struct(*kept).alias("row"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("2"), text).alias("t2"), F.xxhash64(*[c for c in kept if c != text_col]).alias("other"), n.alias("n"))
    out = spread_join(keyed, per_text, ["t1", "t2"], ["other"], "left").withColumn("found", F.coalesce("found", F.expr(f"cast(array() as {FINDINGS})")))
    sure = F.filter("found", lambda x: x.confirmed)
    families = F.array_sort(F.array_distinct(F.transform(sure, lambda x: x.family)))
    return out.select(*[F.col("row")[c].alias(c) for c in kept], F.col("n").alias("n_paragraphs"), F.size(sure).cast("long").alias("n_licences"), families.alias("families"), F.col("found").alias("findings"))
