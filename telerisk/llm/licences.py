"""Licence notices by a trained paragraph classifier, all in DataFrame operations.

Sparse word two- and three-grams of template sentences and of variants of them train a multinomial logistic
regression over licence families and an unknown class; a temperature fitted on held-out variants calibrates its
probabilities.  A paragraph's logits are sums over its n-grams, so scoring is an equi-join of n-grams with the table
of weights (bounded by the templates) and a sum.  A predicted family counts where its probability is high enough and a
template sentence of that family shares enough of its n-grams with the paragraph.

N-grams without a distinctive word are no features, so a paragraph without such a word has none and is unknown.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telerisk.llm.keys import keyed, public_id

# Families and sentences of their notices.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0"],
    "mit": [
        "Released under the MIT License", "This project is licensed under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "SPDX-License-Identifier: MIT"],
    "bsd": [
        "Licensed under the BSD License", "Released under the BSD 3-Clause License", "Distributed under the 2-Clause BSD license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3", "Licensed under the GPL v3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "either version 2 of the License, or (at your option) any later version of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License version 2.1",
        "SPDX-License-Identifier: LGPL-2.1-only"],
    "agpl": [
        "Licensed under the GNU Affero General Public License", "under the terms of the GNU Affero General Public License version 3",
        "SPDX-License-Identifier: AGPL-3.0-only"],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": [
        "Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "available under the Creative Commons Attribution License"],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "available under the Creative Commons Attribution-ShareAlike License"],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "available under the Creative Commons Attribution-NonCommercial License"],
    "public-domain": [
        "This work has been released into the public domain", "Licensed under CC0 1.0 Universal Public Domain Dedication",
        "This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: CC0-1.0"],
    "all-rights-reserved": [
        "All rights reserved", "Copyright, all rights reserved", "No part of this publication may be reproduced without prior written permission of the publisher"],
}
# Sentences that look like notices and are none.
OTHERS = [
    "the driver showed a license and the license plate was written down", "a fishing license is valid for one year", "the public domain of the town was open to all",
    "she was released under the condition that she stay at home", "all rights and duties pass to the buyer", "the apache language is spoken in the south",
    "permission is granted to enter the building", "you may not use this door", "the general public was invited to the opening", "under the terms of the lease the rent is due",
    "the mit campus lies at the river", "free of charge to any person under twelve", "version 2 of the plan was better", "a copy of the letter was sent to the publisher",
    "creative people share common ground", "all tickets were reserved in advance", "the software was written last year", "the conditions are met when the work is done"]
# Words too common to tell anything.
COMMON = frozenset("""a an and any are at be by copy for free forms has in into is it may no not of on one or other part person prior provided public
    released shall source state that the this to under use version was with without work written you your all above following met
    can code file general later may notice option portions project terms binary either included international obtaining obtain
    publication publisher purpose reproduced subject substantial http www org com v 0 1 2 3 4 form program""".split())
UNKNOWN = "unknown"
#: probability and share of a template sentence's n-grams from which a notice counts
PROBABILITY, SIMILARITY = 0.6, 0.5
_FOLDS = 5


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def ngrams(tokens: Column) -> Column:
    """Distinct two- and three-grams; single words never occur among them."""
    def runs(n: int) -> Column:
        return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
                      ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(runs(2), runs(3)))


def distinctive() -> list[str]:
    found = {w for texts in TEMPLATES.values() for t in texts for w in "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()}
    return sorted(w for w in found - COMMON if not w.isdigit())


def marked(text: Column) -> Column:
    """Whether a text has a distinctive word."""
    return F.coalesce(text.rlike("(?i)(?<![A-Za-z0-9])(?:" + "|".join(distinctive()) + ")(?![A-Za-z0-9])"), F.lit(False))


def examples(spark: SparkSession) -> DataFrame:
    """``family``, ``variant`` and ``terms``: sentences, sentences that lack every fifth word, and sentences inside other words."""
    rows = [(family, n, t) for family, texts in [*TEMPLATES.items(), (UNKNOWN, OTHERS)] for n, t in enumerate(texts)]
    base = spark.createDataFrame(rows, "family string, sentence int, text string").withColumn("tokens", words(F.col("text")))
    lacking = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.filter("tokens", lambda w, i: (F.size("tokens") < 5) | (i % 5 != k)))
    inside = F.array(F.concat(F.array(F.lit("this"), F.lit("document"), F.lit("is")), "tokens"), F.concat("tokens", F.array(F.lit("see"), F.lit("notice"))))
    variants = base.select("family", "sentence", F.posexplode(F.concat(F.array("tokens"), lacking, inside)).alias("variant", "tokens"))
    has = lambda t: F.exists(F.split(t, " "), lambda w: w.isin(distinctive()))
    return variants.select("family", "sentence", "variant", F.filter(ngrams(F.col("tokens")), has).alias("terms"))


@dataclass
class Classifier:
    """``terms``: term, weight of each family and ids of the template sentences that hold it; the rest is constants."""
    families: list[str]
    intercepts: list[float]
    temperature: float
    terms: DataFrame
    sentence_terms: list[int]
    sentence_family: list[str]


def train(spark: SparkSession, ridge: float = 0.002) -> Classifier:
    """Fit on all variants; the temperature on one variant in five that a first fit has not seen."""
    data = examples(spark).withColumn("fold", F.pmod(F.xxhash64("family", "sentence", "variant"), F.lit(_FOLDS)))
    families = sorted([*TEMPLATES, UNKNOWN])
    numbered = F.create_map(*[x for i, f in enumerate(families) for x in (F.lit(f), F.lit(float(i)))])
    data = data.withColumn("label", F.element_at(numbered, F.col("family"))).cache()
    shape = CountVectorizer(inputCol="terms", outputCol="features", binary=True, minDF=1.0).fit(data)
    learner = LogisticRegression(family="multinomial", regParam=ridge, maxIter=60)

    def fitted(rows: DataFrame):
        model = learner.fit(shape.transform(rows))
        return model.coefficientMatrix.toArray(), [float(x) for x in model.interceptVector.toArray()]

    def table(matrix) -> DataFrame:
        return spark.createDataFrame([(t, [float(x) for x in matrix[:, i]]) for i, t in enumerate(shape.vocabulary)], "term string, weight array<double>")

    # classes that a fold lacks have no row in its matrix, so every family has to keep a sentence outside the fold
    first, bias = fitted(data.where("fold > 0 OR variant = 0"))
    logits = logit_sums(data.where("fold = 0 AND variant > 0").select("family", "sentence", "variant", "label", F.explode("terms").alias("term")),
                        table(first), ["family", "sentence", "variant", "label"], len(bias))
    scores = F.transform("logits", lambda x, i: x + F.element_at(F.array(*map(F.lit, bias)), i + 1))
    tried = F.explode(F.array(*[F.lit(t) for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0)]))
    loss = logits.select("label", scores.alias("s"), tried.alias("t")).select(
        "t", (F.log(F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x / F.col("t")))) - F.element_at("s", F.col("label").cast("int") + 1) / F.col("t")).alias("loss"))
    best = loss.groupBy("t").agg(F.avg("loss").alias("loss")).orderBy("loss", "t").first()
    matrix, bias = fitted(data)
    sentences = data.where((F.col("variant") == 0) & (F.col("family") != UNKNOWN)).select("family", "sentence", "terms").collect()
    data.unpersist()
    holding: dict[str, list[int]] = {}
    for n, s in enumerate(sentences):
        for t in s.terms:
            holding.setdefault(t, []).append(n)
    terms = spark.createDataFrame([(t, [float(x) for x in matrix[:, i]], holding.get(t, [])) for i, t in enumerate(shape.vocabulary)],
                                  "term string, weight array<double>, sentences array<int>")
    return Classifier(families, bias, float(best.t) if best else 1.0, terms, [len(s.terms) for s in sentences], [s.family for s in sentences])


def logit_sums(rows: DataFrame, terms: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """Sums of the weights of each key's terms, as one array."""
    found = rows.join(F.broadcast(terms.select("term", "weight")), "term")  # bounded by the templates
    sums = found.groupBy(*keys).agg(*[F.sum(F.element_at("weight", k + 1)).alias(f"_{k}") for k in range(classes)])
    return sums.select(*keys, F.array(*[F.col(f"_{k}") for k in range(classes)]).alias("logits"))


def scan(docs: DataFrame, classifier: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text",
         probability: float = PROBABILITY, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``paragraph``, ``family``, ``probability``, ``similarity`` and ``confirmed`` of every paragraph taken for a notice.

    Paragraphs are lines, numbered from 0.  Rows come for paragraphs whose likeliest class is a family; ``confirmed`` asks
    for the probability and for the template comparison.  Null and empty texts have no paragraphs; rows equal in id and
    text count once; other columns are not read; an empty table gives no rows.
    """
    c = classifier or train(docs.sparkSession)
    n = len(c.families)
    lines = keyed(docs, id_col, text_col).where(marked(F.col("text"))).select("doc", "copy", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    grams = lines.where(marked(F.col("line"))).select("doc", "copy", "paragraph", ngrams_of("line"))
    hits = grams.join(F.broadcast(c.terms), "term")  # bounded by the templates
    keys = ["doc", "copy", "paragraph"]
    sums = hits.groupBy(*keys).agg(*[F.sum(F.element_at("weight", k + 1)).alias(f"_{k}") for k in range(n)],
                                   F.flatten(F.collect_list("sentences")).alias("held"))
    logits = F.array(*[F.exp((F.col(f"_{k}") + F.lit(c.intercepts[k])) / F.lit(c.temperature)) for k in range(n)])
    scored = sums.select(*keys, "held", logits.alias("e")).select(
        *keys, "held", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)).alias("p"))
    top = scored.withColumn("probability", F.array_max("p")).withColumn(
        "family", F.element_at(F.array(*[F.lit(f) for f in c.families]), F.array_position("p", F.col("probability")).cast("int")))
    shares = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(i).alias("id"), F.lit(float(max(1, size))).alias("size"))
                       for i, (f, size) in enumerate(zip(c.sentence_family, c.sentence_terms))])
    alike = F.array_max(F.transform(F.filter(shares, lambda s: s["family"] == F.col("family")),
                                    lambda s: F.size(F.filter("held", lambda h: h == s["id"])) / s["size"]))
    return top.where(F.col("family") != UNKNOWN).withColumn("similarity", F.coalesce(alike, F.lit(0.0))).select(
        public_id().alias("doc_id"), "paragraph", "family", "probability", "similarity",
        ((F.col("probability") >= probability) & (F.col("similarity") >= similarity)).alias("confirmed"))


def ngrams_of(column: str) -> Column:
    # the tokens are bound once, as the one element of an array
    return F.explode(F.element_at(F.transform(F.array(words(F.col(column))), ngrams), 1)).alias("term")
