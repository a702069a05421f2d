"""Licence families of paragraphs: a trained n-gram classifier, calibrated, confirmed against templates.

Only DataFrame functions are used. The training table is bounded: windows of the notices
below and at most UNKNOWN_DOCS documents of the corpus, so it is kept in one partition and a
step of gradient descent needs no shuffle. All paragraphs of the corpus are scored, and their
lines, sentences and windows alone, in one scan: a bound on the score, one number per feature, tells
which of them can be predicted at all, and only these meet the weights of all families.
"""

from __future__ import annotations

from functools import reduce
from math import log
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.session import staged

# Notices by family, as their authors recommend them, and sentences that speak of licences but grant none.
NOTICES = {
    "agpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is published under CC0 1.0 Universal and dedicated to the public domain.",
    ],
    "gpl-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
    ],
    "gpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "lgpl-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Released under the Unlicense.",
    ],
}
_V2, _V21, _V3 = (rf"(?:version |\bv){n}(?: |$)" for n in (r"2(?:\.0)?", r"2\.1", r"3(?:\.0)?"))
# Words, joined by blanks, that tell a family from the others: a confirmed paragraph holds all of its family's patterns.
MARKS = {
    "agpl-3.0": [r"\bgnu affero general public license\b", _V3],
    "apache-2.0": [r"\bapache(?: license version |-)2\.0\b"],
    "bsd": [r"\bredistribution and use in source\b|\bredistributions of source code\b|\bbsd-"],
    "cc-by": [r"\bcreative commons attribution \d|\bcc by \d"],
    "cc-by-nc": [r"\bcreative commons attribution-noncommercial \d|\bcc by-nc \d"],
    "cc-by-sa": [r"\bcreative commons attribution-sharealike \d|\bcc by-sa \d"],
    "cc0": [r"\bcc0\b|\bwaived all copyright\b"],
    "epl-2.0": [r"\beclipse public license (?:version |v)?2\.0\b|\bepl-2\.0\b"],
    "gpl-2.0": [r"\bgnu general public license\b", _V2],
    "gpl-3.0": [r"\bgnu general public license\b", _V3],
    "isc": [r"\bpermission to use copy modify and or distribute\b|\bisc\b"],
    "lgpl-2.1": [r"\bgnu lesser general public license\b", _V21],
    "lgpl-3.0": [r"\bgnu lesser general public license\b", _V3],
    "mit": [r"\bmit\b|\bpermission is hereby granted free of charge\b"],
    "mpl-2.0": [r"\bmozilla public license\b", r"\b2\.0\b"],
    "proprietary": [r"\ball rights reserved\b|\bno part of this publication\b"],
    "unlicense": [r"\bfree and unencumbered software\b|\bunlicense\b"],
}
NO_LICENCE = [
    "The driver must show a license to the officer before leaving the road.",
    "Her fishing license was renewed in the spring for two more years.",
    "He asked for permission to leave the room and the teacher agreed.",
    "Copyright law is a difficult subject for most students of music.",
    "The company sells a license for its own product under terms that are not public.",
    "No warranty is given for goods that were bought at the market.",
    "Users are free to choose the version of the program they like.",
    "The public domain is discussed in the second chapter of the book.",
    "This work was published by the foundation in three volumes.",
    "Licensed plumbers and electricians worked under the house for days.",
]
CUES = r"(?i)(?=[lcprwsu])(?:licen[sc]|copyright|permission|redistribut|warrant|public domain|creative commons|rights reserved|spdx|\bcc0\b|\bcc by|unlicense|unencumbered)".replace(" ", r"[\s/*#;%]+")
# A line ends its paragraph after a full stop, before a line without words, and where it or the next one is longer than a wrapped one.
WRAP = 120
PARTED = (
    r"\n(?:(?<=[.!?][\"')]{0,2}[ \t\r]{0,2}\n)|"
    rf"(?<=[^\n]{{{WRAP + 1}}}\n)|(?=[^\n]{{{WRAP + 1}}})|"
    r"(?=[^\p{L}\p{N}\n]*(?:\n|$)))"
)
SENTENCES = r"(?<=[.!?][\"')\]]{0,2})\s+"
SPAN, STEP = 16, 8  # words of a window and from one to the next: any STEP + 1 words lie in one window
WRAPPED = r"\s*\n[\s/*#;%.!-]*(?:(?:dnl|rem)\s+)?"

# Each match of a mark holds one of these or of SHORT_HINTS.
HINTS = (
    "gnu affero general public", "gnu general public", "gnu lesser general public", "apache", "redistribution", "bsd-", "creative commons attribution",
    "cc by", "cc0", "waived all copyright", "eclipse public license", "epl-2.0", "permission to use copy", "permission is hereby granted",
    "mozilla public license", "all rights reserved", "no part of this publication", "unencumbered", "unlicense",
)
SHORT_HINTS = r"\b(?:isc|mit)\b"
UNKNOWN = "unknown"
FAMILIES = [*NOTICES, UNKNOWN]
UNKNOWN_DOCS = 500
UNKNOWN_LINES = 4000
QUIET_CHARS, QUIET_LINES, QUIET_WORDS = 4000, 8, 40
FEATURES = 1 << 16
STEPS, RATE, DECAY = 24, 8.0, 1e-4
FALSE_ALARMS = 0.01
COVER = 0.6
LEAST_RUNS = 3
WHOLE = 20
GRAM = 3


def plain_words(text: Column) -> Column:
    """Lower-case words of letters, digits and inner points, pluses and hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"), F.lit(0))


def _grams(words: Column) -> Column:
    """Distinct feature numbers of the words and of neighbouring words."""
    count = F.size(words)
    pairs = F.when(
        count > 1, F.transform(F.sequence(F.lit(0), count - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    ).otherwise(F.array().cast("array<string>"))
    both = F.transform(F.concat(words, pairs), lambda g: F.pmod(F.xxhash64(g), F.lit(FEATURES)).cast("int"))
    return F.array_distinct(both)


def _features(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per feature, one with null for a paragraph without any; a paragraph's features have unit length together."""
    listed = rows.withColumn("fs", _grams(F.col("words")))
    length = F.sqrt(F.greatest(F.size("fs"), F.lit(1)))
    return listed.select(*keep, (1 / length).alias("v"), F.explode_outer("fs").alias("f"))


def paragraphs(text: Column) -> Column:
    """Paragraphs with words as structs (unit, whole, line): each with its wrapped lines joined, and where it has several its lines."""
    worded = lambda p: p.rlike(r"[\p{L}\p{N}]")

    def parts(unit: Column, i: Column) -> Column:
        one = lambda whole, line: F.struct(i.alias("unit"), F.lit(whole).alias("whole"), line.alias("line"))
        lines = F.transform(F.filter(F.split(unit, "\n"), worded), lambda p: one(False, p))
        wrapped = F.concat(F.array(one(True, F.regexp_replace(unit, WRAPPED, " "))), lines)
        return F.when(unit.contains("\n"), wrapped).otherwise(F.array(one(True, unit)))

    return F.flatten(F.transform(F.filter(F.split(text, PARTED), worded), parts))


def pieces(part: Column) -> Column:
    """What is tried of a struct of ``paragraphs``, as structs (unit, words): all of it, its sentences and windows of SPAN words of long ones."""
    made = lambda words: F.struct(part["unit"].alias("unit"), words.alias("words"))

    def windows(words: Column) -> Column:
        last = F.size(words) - SPAN
        starts = F.sequence(F.lit(0), F.ceil(last / STEP).cast("int"))
        cut = F.transform(starts, lambda i: F.slice(words, F.least(i * STEP, last) + 1, SPAN))
        return F.when(last > 0, cut).otherwise(F.array().cast("array<array<string>>"))

    def listed(found: Column) -> Column:
        sentences = F.when(F.size(found) > 1, found).otherwise(F.array().cast("array<array<string>>"))
        return F.concat(F.array(F.flatten(found)), sentences, F.when(part["whole"], F.flatten(F.transform(found, windows))).otherwise(sentences))

    texts = F.when(part["whole"], F.split(part["line"], SENTENCES)).otherwise(F.array(part["line"]))
    words = F.flatten(F.transform(F.array(F.transform(texts, plain_words)), listed))  # bound once, so no pattern runs twice
    return F.transform(F.filter(words, lambda w: F.size(w) > 0), made)


def _margins(weights: DataFrame) -> DataFrame:
    """One row, ``margins``: per feature the most that it can add to the bound of any family.

    See ``_least_bound``: the bound of a family is twice its sum, less that of ``unknown`` and the mean of all others.
    """
    w = [F.coalesce(f"w{k}", F.lit(0.0)) for k in range(len(FAMILIES))]
    total, unknown = reduce(lambda a, b: a + b, w), w[FAMILIES.index(UNKNOWN)]
    most = F.greatest(*[2 * x - unknown - (total - x) / (len(FAMILIES) - 1) for x in w if x is not unknown])
    numbers = weights.sparkSession.range(FEATURES).select(F.col("id").cast("int").alias("f"))
    dense = numbers.join(weights, "f", "left").select("f", most.cast("float").alias("c"))
    return staged(dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "c"))), lambda x: x["c"]).alias("margins")))


def _least_bound(heat: float, least: float) -> float:
    """What the bound of a predicted family reaches at least.

    Its probability is at least ``least`` and that of ``unknown`` at most the rest, so its sum exceeds that of ``unknown`` by
    heat * ln(least / (1 - least)), and the mean of the other 17 by heat * ln(17 * least / (1 - least)), as the sum of 17
    exponentials is at least 17 times that of their mean. Margins are floats: their rounding is far below the hundredth.
    """
    odds = least / max(1 - least, 1e-12)
    return heat * (log((len(FAMILIES) - 1) * odds) + log(odds)) - 0.01


def _may_be_predicted(words: Column, least: float) -> Column:
    """False only if no family can be predicted; ``least`` is the least bound."""

    def enough(features: Column) -> Column:
        total = F.aggregate(features, F.lit(0.0), lambda a, f: a + F.get("margins", f))
        return total / F.sqrt(F.greatest(F.size(features), F.lit(1))) >= least

    return F.get(F.transform(F.array(_grams(words)), enough), F.lit(0))


def _marked(words: str, family: str) -> Column:
    joined = F.array_join(words, " ")
    return reduce(and_, [joined.rlike(m) for m in MARKS[family]])


def _may_be_marked(joined: str) -> Column:
    """False only if no family's marks can match words joined by blanks."""
    return reduce(or_, [F.col(joined).contains(h) for h in HINTS]) | F.col(joined).rlike(SHORT_HINTS)


def training_rows(spark: SparkSession, docs: DataFrame, text: str) -> DataFrame:
    """(y, words, whole, cue): windows of all notices by family, and paragraphs without a licence as ``unknown``.

    The unknown ones are windows of NO_LICENCE, at most UNKNOWN_LINES different paragraphs with a
    cue word but without the marks of any family (``cue``; the smallest hashes), and the lines of
    at most UNKNOWN_DOCS documents without cue words (the smallest hashes of the text).
    """
    unknown = FAMILIES.index(UNKNOWN)
    listed = [(FAMILIES.index(k), t) for k, texts in NOTICES.items() for t in texts]
    fixed = spark.createDataFrame([*listed, *[(unknown, t) for t in NO_LICENCE]], "y int, t string")
    sized = fixed.select("y", plain_words(F.col("t")).alias("w")).withColumn("size", F.explode(F.array(*map(F.lit, (5, 8, 16, 400)))))
    last = F.greatest(F.size("w") - F.col("size"), F.lit(0))
    windows = sized.withColumn("at", F.explode(F.sequence(F.lit(0), last))).select(
        "y", F.slice("w", F.col("at") + 1, F.col("size")).alias("words"), (F.col("size") >= F.size("w")).alias("whole"), F.lit(True).alias("cue")
    )
    cued_lines = docs.filter(F.col(text).rlike(CUES)).select(F.explode(paragraphs(F.col(text))).alias("part")).filter(F.col("part.line").rlike(CUES))
    found = cued_lines.select(plain_words(F.col("part.line")).alias("words"))
    other = found.filter((F.size("words") > 0) & ~reduce(or_, [_marked("words", k) for k in NOTICES]))
    cued = other.select(F.lit(unknown).alias("y"), "words").distinct().orderBy(F.xxhash64("words"), "words").limit(UNKNOWN_LINES)
    quiet = docs.filter(F.col(text).isNotNull() & ~F.col(text).rlike(CUES)).select(F.substring(F.col(text), 1, QUIET_CHARS).alias("t"))
    sample = quiet.orderBy(F.xxhash64("t"), "t").limit(UNKNOWN_DOCS)
    lines = sample.select(F.explode(F.slice(F.split("t", "\n"), 1, QUIET_LINES)).alias("t")).select(
        F.lit(unknown).alias("y"), F.slice(plain_words(F.col("t")), 1, QUIET_WORDS).alias("words"), F.lit(False).alias("whole"), F.lit(False).alias("cue")
    )
    cued = cued.select("y", "words", F.lit(False).alias("whole"), F.lit(True).alias("cue"))
    known = windows.unionByName(cued).unionByName(lines).filter(F.size("words") > 0)
    return known.groupBy("y", "words").agg(F.max("whole").alias("whole"), F.max("cue").alias("cue"))


def _weighted(features: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    sums = [F.sum(F.coalesce(f"w{k}", F.lit(0.0)) * F.col("v")).alias(f"z{k}") for k in range(len(FAMILIES))]
    return features.join(weights, "f", "left").groupBy(*keys).agg(*sums)


def _chances(heat: Column | float = 1.0) -> Column:
    """Probabilities of all families from the sums z0, z1, ..."""
    z = F.array(*[F.col(f"z{k}") / heat for k in range(len(FAMILIES))])
    parts = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    total = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
    return F.transform(parts, lambda x: x / total)


def _best(sums: DataFrame, keys: list[str], heat: float) -> DataFrame:
    """The likeliest family and its probability (likely, chance): as ``_chances`` has it, without arrays."""
    names = [f"y{k}" for k in range(len(FAMILIES))]
    scaled = sums.select(*keys, *[(F.col(f"z{k}") / heat).alias(f"y{k}") for k in range(len(FAMILIES))])
    topped = scaled.withColumn("top", F.greatest(*names))
    total = reduce(lambda a, b: a + b, [F.exp(F.col(n) - F.col("top")) for n in names])
    likely = F.coalesce(*[F.when(F.col(n) == F.col("top"), family) for n, family in zip(names, FAMILIES, strict=True)])
    return topped.select(*keys, (1 / total).alias("chance"), likely.alias("likely"))


def train(rows: DataFrame) -> DataFrame:
    """Weights (f, w0, w1, ...) of a multinomial logistic regression, by gradient descent on all rows.

    Families weigh alike, however many rows they have, and whole notices WHOLE times as much
    as a window of one.
    """
    weight = F.when(F.col("whole"), float(WHOLE)).otherwise(1.0)
    numbered = rows.select(F.xxhash64("y", "words").alias("row"), "y", "words", weight.alias("weight"))
    share = numbered.groupBy("y").agg((1.0 / F.sum("weight") / len(FAMILIES)).alias("share"))
    parts = numbered.join(share, "y").withColumn("part", F.col("weight") * F.col("share"))
    x = staged(_features(parts, ["row", "y", "part"]).coalesce(1))
    weights = staged(x.select("f").distinct().coalesce(1).select("f", *[F.lit(0.0).alias(f"w{k}") for k in range(len(FAMILIES))]))
    for _ in range(STEPS):
        ones, old = x.coalesce(1), weights.coalesce(1)
        z = _weighted(ones, old, ["row", "y", "part"])
        error = z.withColumn("p", _chances()).select(
            "row",
            *[
                ((F.get("p", F.lit(k)) - F.when(F.col("y") == k, 1.0).otherwise(0.0)) * F.col("part")).alias(f"e{k}")
                for k in range(len(FAMILIES))
            ],
        )
        slope = ones.select("row", "f", "v").join(error, "row").groupBy("f").agg(
            *[F.sum(F.col("v") * F.col(f"e{k}")).alias(f"g{k}") for k in range(len(FAMILIES))]
        )
        moved = [
            (F.col(f"w{k}") * (1 - DECAY) - RATE * len(FAMILIES) / 2 * F.col(f"g{k}")).alias(f"w{k}") for k in range(len(FAMILIES))
        ]
        weights = staged(old.join(slope, "f").select("f", *moved))
    return weights


def calibrate(rows: DataFrame, weights: DataFrame) -> tuple[float, float]:
    """Temperature and least probability from rows that were not trained on.

    The temperature has the least log loss on a grid; the least probability of a family is
    the one that all but FALSE_ALARMS of the unknown rows with a cue word stay below: they
    are the ones most like a notice.
    """
    numbered = rows.select(F.xxhash64("y", "words").alias("row"), "y", "words", "cue")
    z = staged(_weighted(_features(numbered, ["row", "y", "cue"]), F.broadcast(weights), ["row", "y", "cue"]))
    grid = z.withColumn("heat", F.explode(F.array(*[F.lit(2.0**i) for i in range(-4, 4)])))
    p = F.get(_chances(F.col("heat")), F.col("y"))
    heats = grid.groupBy("heat").agg(F.sum(-F.log(F.greatest(p, F.lit(1e-12)))).alias("loss")).orderBy("loss", "heat")
    best = heats.first()
    heat = best["heat"] if best else 1.0
    top = F.array_max(F.slice(_chances(heat), 1, len(FAMILIES) - 1))
    least = z.filter((F.col("y") == FAMILIES.index(UNKNOWN)) & F.col("cue")).agg(F.percentile(top, 1 - FALSE_ALARMS)).first()[0]
    return heat, max(0.5, least or 0.0)


def _runs(words: str) -> Column:
    width = F.least(F.size(words), F.lit(GRAM))
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.array_join(F.slice(words, i, width), " "))
    return F.when(F.size(words) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def templates(spark: SparkSession) -> DataFrame:
    listed = [(k, t) for k, texts in NOTICES.items() for t in texts]
    rows = spark.createDataFrame(listed, "family string, t string").select("family", plain_words(F.col("t")).alias("words"))
    return rows.select("family", _runs("words").alias("template"))


def scan(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, paragraphs, families, probability, unconfirmed.

    Paragraphs are lines, or runs of wrapped lines joined (PARTED), that hold a letter or digit.
    All are classified whole, and their lines, their sentences and windows of their words also alone, so
    that a notice is found wherever it stands among other words. A family is predicted when it is likelier than ``unknown`` and than the calibrated least
    probability, and confirmed when the text holds the words that tell the family from others
    (MARKS) and at least 60 % of the word triples of one of its notices, or a notice holds as
    much of a text of LEAST_RUNS or more triples. ``families`` lists the confirmed ones in
    order, ``probability`` is their largest one, ``unconfirmed`` counts paragraphs with
    predictions none of which is confirmed. A null or empty text has no paragraphs. Repeated
    rows get a row each; an empty table gives none; extra columns are not read.
    """
    spark = docs.sparkSession
    rows = staged(training_rows(spark, docs, text))
    held = (F.pmod(F.xxhash64("words"), F.lit(4)) == 0) & ~F.col("whole")
    weights = train(rows.filter(~held))
    heat, least = calibrate(rows.filter(held), weights)
    bound = _least_bound(heat, least)
    listed = docs.select(F.col(id_).alias("id"), F.monotonically_increasing_id().alias("row"), paragraphs(F.col(text)).alias("parts"))
    counted = listed.withColumn("n", F.when(F.col("parts").isNotNull(), F.size(F.filter("parts", lambda p: p["whole"]))).otherwise(0))
    tried = counted.select("id", "row", "n", F.flatten(F.transform("parts", pieces)).alias("pieces")).crossJoin(F.broadcast(_margins(weights)))
    left = tried.select("id", "row", "n", F.filter("pieces", lambda p: _may_be_predicted(p["words"], bound)).alias("pieces"))
    asked = left.select("id", "row", "n", F.posexplode_outer("pieces").alias("at", "part")).select("id", "row", "n", "at", "part.unit", "part.words")
    # only words that may confirm a family travel with the sums
    keys = ["id", "row", "n", "at", "unit", "kept"]
    joined = asked.withColumn("joined", F.array_join("words", " "))
    features = _features(joined.withColumn("kept", F.when(_may_be_marked("joined"), F.col("words"))), keys)
    # at most FEATURES rows of weights
    # stored before it is filtered: pushed below, the filter would spell out every probability again and again
    best = staged(_best(_weighted(features, F.broadcast(weights), keys), keys, heat))
    likely = F.col("likely")
    predicted = best.withColumn("family", F.when((likely != UNKNOWN) & (F.col("chance") >= least), likely)).filter(
        F.col("family").isNotNull() | (F.coalesce("at", F.lit(0)) == 0)
    )
    known = templates(spark).groupBy("family").agg(F.collect_list("template").alias("templates"))
    compared = predicted.join(F.broadcast(known), "family", "left").withColumn("runs", _runs("kept"))

    def cover(template: Column) -> Column:
        smaller = F.greatest(F.least(F.size("runs"), F.size(template)), F.least(F.size(template), F.lit(LEAST_RUNS)))
        return F.size(F.array_intersect("runs", template)) / smaller

    marked = reduce(or_, [(F.col("family") == k) & _marked("kept", k) for k in NOTICES])
    judged = compared.withColumn("sure", F.when(marked, F.array_max(F.transform("templates", cover)) >= COVER).otherwise(False))
    sure = F.col("sure")
    per_row = judged.groupBy("row").agg(
        F.max("id").alias(id_),
        F.max("n").cast("bigint").alias("paragraphs"),
        F.array_sort(F.collect_set(F.when(sure, F.col("family")))).alias("families"),
        F.round(F.max(F.when(sure, F.col("chance"))), 6).alias("probability"),
        # units with a prediction, less those with a confirmed one
        (F.size(F.collect_set(F.when(F.col("family").isNotNull(), F.col("unit")))) - F.size(F.collect_set(F.when(sure, F.col("unit")))))
        .cast("bigint")
        .alias("unconfirmed"),
    )
    return per_row.drop("row")
