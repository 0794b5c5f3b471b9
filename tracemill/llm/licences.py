"""Licence scans by a trained paragraph classifier (operator 10), in DataFrame operations only.

A paragraph is a sentence, over line ends; one of many words comes as windows that overlap. Every paragraph of every text is
classified by a multinomial logistic regression on hashed word n-grams, trained on notices of each family, bare and
amid the corpus's own prose, on licensing that names no family, and on plain prose. Its probabilities are calibrated by a
temperature. A paragraph is of a family if the probability is high enough and the comparison with all families' names and
sentences confirms that it is most like that one; else it is unknown, or no licence at all.
"""

import random
import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.store import stored

FEATURES = 1 << 14
#: A paragraph of more words comes as windows of so many, each beginning half a window after the one before; no notice is longer than half a window.
WINDOW = 64
#: A family needs such a probability, and such a share of the word pairs of a name or sentence of its own in the paragraph.
PROBABLE, ALIKE = 0.6, 0.8
#: At most so many documents, the first by a hash, give their prose as examples of no licence, so many paragraphs each.
SAMPLE, EACH = 1000, 3
NONE, UNKNOWN = "none", "unknown"
#: Where a text is cut into paragraphs.
CUT = r"\n\s*\n|(?<=[A-Za-z0-9)'\x22][.!?])\s+(?=[^a-z0-9])"
#: Names of licences by family, siblings being families of their own.
NAMES = {
    "agpl-3.0": ["the GNU Affero General Public License, version 3", "AGPL v3", "AGPL-3.0"],
    "apache-2.0": ["the Apache License, Version 2.0", "Apache 2.0", "Apache-2.0"],
    "artistic-2.0": ["the Artistic License 2.0", "Artistic-2.0"],
    "bsd-2-clause": ["the BSD 2-Clause License", "the simplified BSD License", "BSD-2-Clause"],
    "bsd-3-clause": ["the BSD 3-Clause License", "the new BSD License", "BSD-3-Clause"],
    "bsl-1.0": ["the Boost Software License, Version 1.0", "BSL-1.0"],
    "cc-by-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nc-sa-4.0": ["CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nd-4.0": ["CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0-1.0": ["CC0 1.0", "the CC0 1.0 Universal public domain dedication"],
    "epl-2.0": ["the Eclipse Public License, version 2.0", "EPL-2.0"],
    "eupl-1.2": ["the European Union Public Licence, version 1.2", "EUPL-1.2"],
    "gpl-2.0": ["the GNU General Public License, version 2", "GPL v2", "GPL-2.0"],
    "gpl-3.0": ["the GNU General Public License, version 3", "GPL v3", "GPL-3.0"],
    "isc": ["the ISC License", "ISC license terms"],
    "lgpl-2.1": ["the GNU Lesser General Public License, version 2.1", "LGPL v2.1", "LGPL-2.1"],
    "lgpl-3.0": ["the GNU Lesser General Public License, version 3", "LGPL v3", "LGPL-3.0"],
    "mit": ["the MIT License", "MIT license terms"],
    "mpl-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License, v. 2.0", "MPL-2.0"],
    "ofl-1.1": ["the SIL Open Font License, Version 1.1", "OFL-1.1"],
    "unlicense": ["the Unlicense", "the Unlicense terms"],
    "zlib": ["the zlib License", "the zlib/libpng License"],
}
#: Sentences of licence texts by family, at most half a window long.
SENTENCES = {
    "apache-2.0": ["you may not use this file except in compliance with the License"],
    "bsd-3-clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"],
    "cc0-1.0": ["the author has waived all copyright and related or neighboring rights to this work"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "zlib": ["This software is provided as-is, without any express or implied warranty"],
}
#: How a notice names a licence.
VERBS = ("Released under {}.", "Licensed under {}.", "This work is licensed under {}.", "This library is licensed under {}.", "Distributed under the terms of {}.", "Available under {}.", "This file is subject to the terms of {}.", "{}")
#: What stands for a name in licensing that names no family, and whole sentences of that kind.
NAMELESS = ("the terms of the vendor agreement", "a commercial license", "a proprietary license", "the house license, version 1.0", "the license of its owner", "the agreement between the parties", "the terms of the public license of the house")
OTHERS = (
    "All rights reserved.", "See the license file for details.", "The license of this work is not known.", "You need the permission of the owner.", "This program comes without any warranty.",
    "The copyright of this work belongs to its author.", "This library is in the public domain of the land.", "No part of this work may be copied without permission.",
)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _windows(words: Column) -> Column:
    """Windows of an array of words, the last reaching its end; the array itself if it is no longer than one."""
    half = WINDOW // 2
    starts = F.sequence(F.lit(0), F.ceil((F.size(words) - WINDOW) / half).cast("int"))
    return F.when(F.size(words) <= WINDOW, F.array(words)).otherwise(F.transform(starts, lambda i: F.slice(words, i * half + 1, WINDOW)))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(row, twin, pos, words): the words of each paragraph that has any; row and twin hash doc_id and text, pos numbers sentences."""
    text = F.col("text").cast("string")
    # explode would first filter on the array's size, and so make the array twice
    rows = docs.where(text.isNotNull()).select(F.xxhash64("doc_id", "text").alias("row"), F.xxhash64(F.lit(1), "text", "doc_id").alias("twin"), F.posexplode_outer(F.transform(F.split(text, CUT, -1), _words)).alias("pos", "all"))
    return rows.where("size(all) > 0").select("row", "twin", "pos", F.explode_outer(_windows(F.col("all"))).alias("words"))


def _pairs(words: str) -> str:
    return f"case when size({words}) > 1 then zip_with(slice({words}, 1, size({words}) - 1), slice({words}, 2, size({words}) - 1), (a, b) -> concat(a, ' ', b)) else array() end"


def _features(df: DataFrame) -> DataFrame:
    """``df`` (words, ...) with features: which hashed words and pairs there are."""
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
    return hashing.transform(df.withColumn("grams", F.expr(f"concat(words, {_pairs('words')})"))).drop("grams")


def training(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(words, family, held): notices bare and amid prose; licensing without a family; paragraphs of the corpus. held rows calibrate.

    The prose is that of at most ``SAMPLE`` documents, ``EACH`` paragraphs of ``WINDOW`` words at most each: what reaches
    the driver is bounded by that. A paragraph of it that holds a name of a licence is no example of none.
    """
    part = min(1.0, 0.95 * SAMPLE / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < int(part * (1 << 40))).limit(SAMPLE)
    spread = F.row_number().over(Window.partitionBy("row", "twin").orderBy(F.xxhash64("words")))
    prose = [r["text"] for r in paragraphs(some).withColumn("n", spread).where(F.col("n") <= EACH).select(F.array_join("words", " ").alias("text")).distinct().orderBy("text").collect()]
    bare = [" ".join(_plain(n)) for names in NAMES.values() for n in names]
    prose = [p for p in prose if not any(f" {n} " in f" {p} " for n in bare)]
    rng, rows = random.Random(3), [(p, NONE) for p in prose]
    notices = [(v.format(n), f) for f, names in NAMES.items() for n in names for v in VERBS] + [(s, f) for f, sentences in SENTENCES.items() for s in sentences for _ in range(4)]
    notices += [(v.format(n), UNKNOWN) for n in NAMELESS for v in VERBS[:-1] for _ in range(2)] + [(o, UNKNOWN) for o in OTHERS for _ in range(8)]
    for notice, family in notices:
        rows.append((" ".join(_plain(notice)), family))
        for _ in range(2 if prose else 0):
            before, after = (rng.choice(prose).split() for _ in range(2))
            rows.append((" ".join([*before[: rng.randint(0, 25)], *_plain(notice), *after[: rng.randint(0, 12)]]), family))
    df = spark.createDataFrame(sorted(set(rows)), "text string, family string")
    return df.select(F.split("text", " ").alias("words"), "family", (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("held"))


def _plain(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def fit(spark: SparkSession, docs: DataFrame) -> tuple[list[str], LogisticRegressionModel, float]:
    """(families, model, temperature): the temperature that suits the held rows best."""
    families = [*sorted(NAMES), UNKNOWN, NONE]
    index = F.array_position(F.lit(families), F.col("family")) - 1
    rows = _features(stored(training(spark, docs).withColumn("label", index.cast("double")), "licence_training")).coalesce(1)
    model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60, standardization=False).fit(rows.where("not held"))
    scores = model.transform(rows.where("held")).select("label", vector_to_array("rawPrediction").alias("logits"))
    loss = lambda t: F.avg(F.expr(f"ln(aggregate(logits, 0D, (a, x) -> a + exp((x - array_max(logits)) / {t}))) - (get(logits, cast(label as int)) - array_max(logits)) / {t}"))
    grid = [0.25 * 1.25**i for i in range(14)]
    losses = scores.agg(*(loss(t).alias(f"t{i}") for i, t in enumerate(grid))).first()
    best = min(zip(grid, losses, strict=True), key=lambda x: x[1] if x[1] is not None else 0)[0]
    return families, model, best


def _likeness() -> str:
    """The families' best shares, in order of name: how many of the word pairs of a name or sentence are among those of a paragraph (_pairs)."""
    shares = []
    for family in sorted(NAMES):
        own = []
        for text in (*NAMES[family], *SENTENCES.get(family, ())):
            words = [w for w in _plain(text) if w not in ("the", "a")] if text in NAMES[family] else _plain(text)
            pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
            listed = ", ".join(f"'{p}'" for p in pairs)
            own.append(f"size(array_intersect(_pairs, array({listed}))) / {len(pairs)}.0D" if pairs else f"cast(array_contains(words, '{words[0]}') as double)")
        shares.append(f"greatest({', '.join(own)}, 0D)")
    return f"array({', '.join(shares)})"


def classify(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``found`` (words, ...) that name or grant some licence, with family, probability and alike (the best share of the guess).

    A family needs both thresholds, and to be the one that the paragraph is most like; what is likelier to name some licence
    than none is unknown. Paragraphs of none are left out.
    """
    spark = docs.sparkSession
    families, model, temperature = fit(spark, docs)
    keep = found.columns
    # the condition is always true; it holds the filter above the model, which it would else repeat
    logits = F.when(F.monotonically_increasing_id() >= 0, F.transform(vector_to_array("rawPrediction"), lambda x: x / temperature))
    scored = model.transform(_features(found)).select(*keep, logits.alias("_z"))
    # stored, as what follows reads it several times; most paragraphs end here
    some = stored(scored.where(F.element_at("_z", -1) < F.array_max("_z")), "licence_paragraphs")
    some = some.withColumn("_e", F.expr("transform(_z, x -> exp(x - array_max(_z)))")).withColumn("_p", F.expr("transform(_e, x -> x / aggregate(_e, 0D, (a, y) -> a + y))"))
    some = some.withColumn("probability", F.array_max("_p")).withColumn("_guess", F.get(F.lit(families), F.array_position("_p", F.col("probability")).cast("int") - 1))
    some = some.withColumn("_pairs", F.expr(_pairs("words"))).withColumn("_alike", F.expr(_likeness()))
    own = F.get("_alike", (F.array_position(F.lit(families), F.col("_guess")) - 1).cast("int"))
    some = some.withColumn("alike", F.coalesce(own, F.lit(0.0)))
    first = F.size(F.filter("_alike", lambda x: x >= F.col("alike"))) == 1
    family = F.when((F.col("_guess") != UNKNOWN) & (F.col("probability") >= PROBABLE) & (F.col("alike") >= ALIKE) & first, F.col("_guess")).otherwise(UNKNOWN)
    return some.withColumn("family", family).select(*keep, "family", "probability", "alike")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, n_unknown, families) per row of ``docs`` (doc_id, text).

    n_paragraphs counts the sentences that name a known family, n_unknown those that are of some licence but of none that is
    known, and families lists the known ones by name, each once, comma-joined; empty without any. A null or empty text
    has none; rows alike get the same; an empty table gives no rows. Other columns are not read.
    """
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.xxhash64(F.lit(1), "text", "doc_id").alias("twin"))
    marked = stored(classify(paragraphs(docs), docs).select("row", "twin", "pos", "family").distinct(), "licence_families")
    known = F.col("family") != UNKNOWN
    sentences = marked.groupBy("row", "twin", "pos").agg(F.max(known).alias("known"), F.collect_set(F.when(known, F.col("family"))).alias("own"))
    found = sentences.groupBy("row", "twin").agg(F.count_if("known").alias("n_paragraphs"), F.count_if(~F.col("known")).alias("n_unknown"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))), ",").alias("families"))
    return rows.join(found, ["row", "twin"], "left").select("doc_id", F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"), F.coalesce("families", F.lit("")).alias("families"))
