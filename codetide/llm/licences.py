"""Licence scan: a trained paragraph classifier with an unknown class, confirmed against templates.

A paragraph is a line that is not blank, or a run of neighbouring lines that each hold a telling word, joined:
so a wrapped notice is judged as a whole. Its terms are the distinct single words and pairs of neighbouring
words, letters and digits in lower case. A multinomial logistic regression with an L1 share in its penalty
is fitted on the template notices and bodies of each family, bodies weighing as much as all notices of a
name, and, as class `unknown`, on at most `lines` lines (those with the smallest hashes) of `negatives` documents that share no three words in a row
with a template. The weights left are the model: a paragraph without such a term is unknown, and only the
others are scored. The unknown class is calibrated on held-out training paragraphs: its score is raised
until all but a thousandth of them stay unknown. What is still called a family must share half of its pairs
with a template of that family, or half of the template's pairs; else it stays unknown.

All of it is DataFrame work; no Python runs on the executors. Terms are made of words that are evaluated once,
so a line costs in proportion to its length. Terms outside the templates are dropped where the lines lie.
Documents meet the weights, bounded by the vocabulary of the templates, in one pass; only lines with a
telling word are shuffled, by document and run.

Null and empty texts have no paragraphs. Equal rows get equal results, each row kept; null ids are told
apart by their text. Extra columns are not returned.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetide.session import Stages

UNKNOWN = "unknown"
NEGATIVES, LINES, SHARE, COMMON, STAYS = 300, 4000, 0.5, 0.01, 0.999
# Names and usual wordings of licence notices.
NAMES = {
    "mit": ("MIT License", "MIT licence", "Expat License", "MIT"),
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD-3-Clause", "BSD 2-Clause License", "BSD-2-Clause", "simplified BSD license"),
    "gpl": ("GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GPL-3.0", "GPLv3", "GPL-2.0", "GPLv2"),
    "lgpl": ("GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv2.1", "GNU LGPL"),
    "agpl": ("GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"),
    "mpl": ("Mozilla Public License", "Mozilla Public License, version 2.0", "MPL-2.0", "MPL 2.0"),
    "cc-by": ("CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc0": ("CC0", "CC0 1.0", "CC0-1.0", "Creative Commons Zero", "CC0 1.0 Universal public domain dedication"),
    "unlicense": ("Unlicense", "The Unlicense"),
    "isc": ("ISC License", "ISC licence"),
}
NOTICES = (
    "Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "This work is licensed under {}.",
    "This work is licensed under the {}.", "This software is distributed under the terms of the {}.", "This file is part of a program available under the {}.",
    "Published under the terms of the {}; see the LICENSE file for details.", "License: {}", "SPDX-License-Identifier: {}",
    "This project uses the {}.", "The text of this page is available under {}.",
)
TEXTS = {
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "apache-2.0": ("you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
            "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
            "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.",
             "You should have received a copy of the GNU Lesser General Public License along with this library."),
    "agpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
             "You should have received a copy of the GNU Affero General Public License along with this program."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "cc-by": ("To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons.",),
    "cc-by-sa": ("To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons.",),
    "cc-by-nc": ("To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons.",),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
            "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law."),
    "unlicense": ("This is free and unencumbered software released into the public domain.",
                  "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."),
}
# Ordinary sentences with words that notices use as well.
ORDINARY = (
    "She passed the test and got her driving license last week.", "The bar lost its licence after the third complaint.",
    "The album was released under a new name in 2004.", "All of this is available under the counter, if you know whom to ask.",
    "Permission to enter the garden is granted by the owner.", "The general public was not admitted to the hearing.",
    "The terms of the agreement were published in the newspaper.", "Version 2.0 of the program was released in March.",
    "He works at MIT and lives in Boston.", "The Apache helicopter landed near the village.", "This work was done in a hurry.",
    "The file is part of a larger collection.", "You may use the kitchen until ten.", "Creative people are common in this town.",
    "The copy was sold for a small fee.", "The warranty of the car ended without notice.", "Free software is a good thing, he said.",
    "The foundation gave money to the museum.", "See the details on page 4.", "The project uses a lot of water.",
)


def words(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bound(column: Column, made) -> Column:
    """made(column), with the column evaluated once: a column that is only projected may be copied into each use, and so into each step of a loop over it."""
    return F.transform(F.array(column), made)[0]


def grams(w: Column, n: int) -> Column:
    pieces = lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - n + 1), lambda i: F.concat_ws(" ", *[F.element_at(x, i + k) for k in range(n)]))
    return bound(w, lambda x: F.when(F.size(x) >= n, pieces(x)).otherwise(F.array().cast("array<string>")))


def terms(w: Column) -> Column:
    return bound(w, lambda x: F.array_distinct(F.concat(x, grams(x, 2))))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.trim(p) != "")


@dataclass
class Model:
    classes: list[str]  # classes[0] is unknown
    intercepts: list[float]
    weights: dict[str, list[float]]  # term -> weight of each class
    raised: float  # what is added to the score of unknown
    rare: list[str]  # words of which a paragraph with a term of the model has at least one


def template_rows() -> list[tuple[str, str, float]]:
    """(family, paragraph, weight) of every template notice and body."""
    notices = [(family, notice.format(name), 1.0) for family, names in NAMES.items() for name in names for notice in NOTICES]
    return notices + [(family, text, float(len(NOTICES))) for family, texts in TEXTS.items() for text in texts]


def template_terms(paragraph: str, sizes: tuple[int, ...] = (1, 2)) -> set[str]:
    """Terms of a template, which is a constant in plain ASCII."""
    w = re.findall("[a-z0-9]+", paragraph.lower())
    return {" ".join(w[i:i + n]) for n in sizes for i in range(len(w) - n + 1)}


def templates(spark) -> DataFrame:
    """family, paragraph of every template notice."""
    return spark.createDataFrame([r[:2] for r in template_rows()], "family string, paragraph string")


def strings(values) -> Column:
    return F.array(*map(F.lit, sorted(values))) if values else F.array().cast("array<string>")


def ordinary_lines(documents: DataFrame, vocabulary: set[str], doc: str, text: str, negatives: int, lines: int) -> DataFrame:
    """held, terms: lines of sampled documents without three words in a row of a template; only terms of `vocabulary`."""
    spark = documents.sparkSession
    # Hashes are drawn first: `negatives` rows are fit for a broadcast, and no task gathers texts.
    mark = F.xxhash64(doc, text)
    drawn = documents.where(F.col(text).isNotNull()).select(mark.alias("mark")).distinct().orderBy("mark").limit(negatives)
    sampled = documents.where(F.col(text).isNotNull()).select(mark.alias("mark"), F.col(text).alias("t")) \
        .join(F.broadcast(drawn), "mark", "left_semi").select(F.explode(paragraphs(F.col("t"))).alias("paragraph"))
    worded = sampled.select(F.xxhash64("paragraph").alias("n"), words(F.col("paragraph")).alias("w"))
    triples = strings(set().union(*(template_terms(r[1], (3,)) for r in template_rows())))
    slim = worded.where(~F.arrays_overlap(grams(F.col("w"), 3), triples)).select("n", F.array_intersect(terms(F.col("w")), strings(vocabulary)).alias("terms"))
    slim = slim.groupBy("n").agg(F.first("terms").alias("terms")).orderBy("n").limit(lines)
    own = spark.createDataFrame([(sorted(template_terms(p) & vocabulary),) for p in ORDINARY], "terms array<string>")
    return slim.select((F.pmod("n", F.lit(5)) == 0).alias("held"), "terms").union(own.select(F.lit(False), "terms"))


def trained(documents: DataFrame, keep, *, doc: str = "doc_id", text: str = "text", negatives: int = NEGATIVES, lines: int = LINES) -> Model:
    spark, classes = documents.sparkSession, [UNKNOWN, *NAMES]
    rows = template_rows()
    mass = Counter()
    for _, paragraph, weight in rows:
        mass.update(dict.fromkeys(template_terms(paragraph), weight))
    candidates = {term for term, weight in mass.items() if weight >= 2}
    # At most `lines` rows with terms of the templates only, in one order, so that sums are equal in every run.
    ordinary = keep(ordinary_lines(documents, candidates, doc, text, negatives, lines).coalesce(1).sortWithinPartitions("held", "terms"), "ordinary")
    limit = max(COMMON * ordinary.count(), 5)
    common = {r["term"] for r in ordinary.select(F.explode("terms").alias("term")).groupBy("term").count().where(F.col("count") > limit).collect()}
    # Terms that ordinary text is full of tell nothing, and pairs of two such words neither.
    vocabulary = sorted(t for t in candidates if t not in common and not set(t.split(" ")) <= common)
    notices = spark.createDataFrame([(float(classes.index(f)), weight, sorted(template_terms(p))) for f, p, weight in rows], "label double, weight double, terms array<string>")
    examples = notices.coalesce(1).union(ordinary.where("NOT held").select(F.lit(0.0), F.lit(1.0), "terms"))
    data = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="features").setBinary(True).transform(examples).coalesce(1)
    fitted = LogisticRegression(family="multinomial", weightCol="weight", regParam=0.0005, elasticNetParam=0.5, maxIter=60, standardization=False).fit(data)
    matrix = fitted.coefficientMatrix.toArray()
    weights = {term: matrix[:, j].tolist() for j, term in enumerate(vocabulary) if matrix[:, j].any()}
    rare = sorted({next((w for w in term.split(" ") if w not in common), term.split(" ")[0]) for term in weights})
    model = Model(classes, fitted.interceptVector.toArray().tolist(), weights, 0.0, rare)
    # Bounded: the held-out lines of the bounded sample, as one number.
    held = ordinary.where("held").select(F.monotonically_increasing_id().alias("id"), "terms")
    over = scores(held, model, ["id"]).agg(F.percentile(F.array_max(F.slice("score", 2, len(classes))) - F.col("score")[0], STAYS).alias("m")).first()["m"]
    model.raised = max(0.0, over + 0.5) if over is not None else 0.0
    return model


def weight_table(spark, model: Model) -> DataFrame:
    return spark.createDataFrame(list(model.weights.items()) or [("", [0.0] * len(model.classes))], "term string, weight array<double>")


def scores(frame: DataFrame, model: Model, key: list[str]) -> DataFrame:
    """key, score (array, one per class) for rows with at least one term of the model; `frame` has key and terms."""
    table = F.broadcast(weight_table(frame.sparkSession, model))  # bounded by the templates' vocabulary
    sums = [(F.lit(model.intercepts[i] + (model.raised if i == 0 else 0.0)) + F.sum(F.col("weight")[i])) for i in range(len(model.classes))]
    return frame.select(*key, F.explode("terms").alias("term")).join(table, "term").groupBy(*key).agg(F.array(*sums).alias("score"))


def found(documents: DataFrame, model: Model, *, doc: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """doc, version, run, at, family, probability, confirmed of every paragraph that the model takes for a licence.

    `run` numbers the runs of neighbouring lines with a telling word; `at` is the line, or null for the whole run.
    """
    spark = documents.sparkSession
    lines = documents.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(F.split(F.col(text), "\n")).alias("at", "p")) \
        .select("doc", "version", "at", words(F.col("p")).alias("w")).where(F.exists("w", lambda x: x.isin(*model.rare)) if model.rare else F.lit(False))
    # Of repeated rows one line is left; line minus rank is equal for neighbours only.
    gathered = lines.groupBy("doc", "version").agg(F.sort_array(F.collect_set(F.struct("at", "w"))).alias("lines")) \
        .select("doc", "version", F.posexplode("lines").alias("rank", "line")).select("doc", "version", "line.*", (F.col("line.at") - F.col("rank")).alias("run"))
    runs = gathered.groupBy("doc", "version", "run").agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("lines")).where(F.size("lines") > 1)
    whole = runs.select("doc", "version", "run", F.lit(None).cast("int").alias("at"), F.flatten(F.transform("lines", lambda x: x["w"])).alias("w"))
    key = ["doc", "version", "run", "at"]
    rows = gathered.select(*key, "w").union(whole).select(*key, terms(F.col("w")).alias("terms"), grams(F.col("w"), 2).alias("pairs"))
    table = F.broadcast(weight_table(spark, model))
    scored = rows.select(*key, "pairs", F.explode("terms").alias("term")).join(table, "term").groupBy(*key).agg(
        F.first("pairs").alias("pairs"), F.array(*[
            F.lit(model.intercepts[i] + (model.raised if i == 0 else 0.0)) + F.sum(F.col("weight")[i]) for i in range(len(model.classes))]).alias("score"))
    peak = F.array_max("score")
    probability = 1 / F.aggregate("score", F.lit(0.0), lambda acc, s: acc + F.exp(s - peak))
    best = F.array_position("score", peak).cast("int")
    called = scored.select(*key, "pairs", F.element_at(F.array(*map(F.lit, model.classes)), best).alias("family"), probability.alias("probability")) \
        .where(F.col("family") != UNKNOWN)
    wording = spark.createDataFrame([(f, sorted(template_terms(p, (2,)))) for f, p, _ in template_rows()], "of string, template array<string>").distinct()
    common = F.size(F.array_intersect("pairs", "template"))
    alike = (common >= share * F.size(F.array_distinct("pairs"))) | (common >= share * F.size("template"))
    compared = called.join(F.broadcast(wording), called["family"] == wording["of"])  # the templates of one family
    return compared.groupBy(*key).agg(F.first("family").alias("family"), F.first("probability").alias("probability"),
                                      F.max((F.size("template") > 0) & alike & (common > 0)).alias("confirmed"))


def scanned(documents: DataFrame, *, doc: str = "doc_id", text: str = "text", negatives: int = NEGATIVES, share: float = SHARE) -> DataFrame:
    """doc_id, n_paragraphs (lines), n_licence, families (sorted, comma-joined), probability (highest confirmed, else 0) per document.

    A run counts as many licences as lines of it are confirmed, or one if only the whole is.
    """
    model = trained(documents, Stages(documents.sparkSession).keep, doc=doc, text=text, negatives=negatives)
    per_run = found(documents, model, doc=doc, text=text, share=share).where("confirmed").groupBy("doc", "version", "run").agg(
        F.greatest(F.count("at"), F.lit(1)).alias("n"), F.collect_set("family").alias("families"), F.max("probability").alias("top"))
    per_doc = per_run.groupBy("doc", "version").agg(
        F.sum("n").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))), ",").alias("list"), F.max("top").alias("top"))
    base = documents.select(F.col(doc).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.size(paragraphs(F.col(text))).cast("long").alias("n_paragraphs"))
    joined = base.join(per_doc, base["doc_id"].eqNullSafe(per_doc["doc"]) & (base["text_hash"] == per_doc["version"]), "left")
    return joined.select("doc_id", "n_paragraphs", F.coalesce("n", F.lit(0)).alias("n_licence"), F.coalesce("list", F.lit("")).alias("families"),
                         F.round(F.coalesce("top", F.lit(0.0)), 6).alias("probability"))
