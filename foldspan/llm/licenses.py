"""Licence scan: a paragraph classifier by sparse word n-gram logistic regression, with a calibrated unknown class, and
template comparison that confirms its predictions. DataFrame functions and Spark's own learner only.

Lines with a word that notices have at least one of are the candidates; tests hold how many notices of four languages the
gate lets pass. A candidate is classified as a whole and by all word windows of its paragraph around such a word, so a
notice inside a longer line or over several lines is seen; the best window stands for the line. A paragraph is a run of
lines that have words. The classifier's features are the word n-grams of the fixed texts, and one for all other words. It is
trained on word windows of the templates, on sentences that use the same words otherwise, and on the counts of its features
in all plain lines of the input, which have no such word; a fifth of these lines, by their words, is held out. Its threshold
is set on all lines held out, each as a whole: the lowest probability that at most one in a hundred of them passes, and one
in ten of held-out sentences that use a notice's words otherwise. A prediction is confirmed if half of the window's word
triples stand in a template of the family, or half of such a template's in the window.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspan.llm.common import written

#: Fixed texts: notices of licence families.
TEMPLATES = {
    "MIT": (
        "SPDX-License-Identifier: MIT", "The MIT License (MIT)", "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT License.", "MIT licensed, see the license file.",
        "Veröffentlicht unter der MIT-Lizenz.", "Lizenziert unter der MIT-Lizenz.", "Publié sous licence MIT.", "Distribué sous la licence MIT.", "Publicado bajo la licencia MIT.", "Distribuido bajo la licencia MIT.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
    ),
    "Apache-2.0": (
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0.", "This file is licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.", "Released under the Apache 2.0 license.",
        "Lizenziert unter der Apache-Lizenz, Version 2.0.", "Veröffentlicht unter der Apache-Lizenz 2.0.", "Sous licence Apache, version 2.0.", "Distribué sous la licence Apache 2.0.", "Licenciado bajo la licencia Apache, versión 2.0.", "Publicado bajo la licencia Apache 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind.",
    ),
    "BSD": (
        "SPDX-License-Identifier: BSD-3-Clause",
        "Licensed under the BSD 3-Clause License.", "Released under the BSD 2-Clause license.", "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "GPL": (
        "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GPL version 2 or later.", "Released under the GNU GPL v3.",
        "Lizenziert unter der GNU General Public License, Version 3.", "Veröffentlicht unter der GPL, Version 2 oder neuer.", "Publié sous la licence publique générale GNU, version 3.", "Publicado bajo la licencia pública general de GNU, versión 3.",
        "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    ),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software under the terms of the GNU Lesser General Public License.", "Released under the LGPL version 3 license."),
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL v3 license.", "This program is free software under the terms of the GNU Affero General Public License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License 2.0.", "Released under the MPL 2.0 license."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Content is available under the Creative Commons Attribution license."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike license."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under the Creative Commons Attribution-NonCommercial license."),
    "Public-Domain": ("This work has been dedicated to the public domain.", "Released into the public domain under CC0 1.0 license.", "Licensed under CC0 1.0 Universal public domain dedication.", "This is free and unencumbered software released into the public domain."),
    "Proprietary": ("All rights reserved.", "Copyright 2020. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without written permission.", "Confidential and proprietary: copyright, all rights reserved.", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados."),
}
#: Fixed texts: the same words in other use.
OTHERWISE = (
    "He lost his driving license on the way to the city.", "The council granted a license to sell fish at the market.", "A poetic license was taken with the facts of the story.", "The license plate of the car was covered in mud.",
    "She is a licensed pilot and doctor with many years of work.", "The permission to enter was given by the guard at the gate.", "A copyright dispute kept the film from the screens for years.", "Redistribution of wealth was the aim of the new law.",
    "The apache tribe lived in the hills of the south.", "The warranty of the washing machine ran out last week.", "Fishing licenses are sold at the office from nine to five.", "The public domain of the town was sold to a builder.",
    "The students of MIT won the prize this year.", "All rights of passage were closed by the village.", "Er verlor seinen Führerschein und die Lizenz zum Fliegen im Winter.", "Il avait une licence de lettres et aimait la mer.", "La licencia de conducir se quedó en la casa de su tía.", "Die Rechte der Bauern wurden im Dorf gelesen.", "The software was slow, and the version was old.", "Creative people in common rooms share their ideas.",
    "The license of the inn hung over the bar for all to see.", "Without a license he could not sell the wine.", "The apache helicopter flew low over the version of the map.", "Their general was known to the public as a quiet man.", "A free copy of the paper was given to each person in the room.", "No rights were left to the farmers after the flood.",
    "Der Wirt bekam seine Lizenz erst im zweiten Jahr.", "Die Lizenz des Trainers wurde nach der Version des Berichts geprüft.", "Alle Rechte der Gemeinde standen in dem alten Buch.", "La licence du pilote fut perdue dans la mer.", "Les droits de la ville étaient réservés aux marchands.", "Sous la lampe, sa licence de pêche brillait.",
    "La licencia de la taberna colgaba de la pared.", "Los derechos del pueblo fueron leídos en la plaza.", "Publicó la versión del libro bajo otro nombre.",
)
#: A candidate line has one of these; every template has one too.
ANCHORS = "(?i)licen[sc]|lizen[zs]|copyright|public domain|permission|redistribut|free software|warrant|rights reserved|rechte vorbehalten|droits réservés|derechos reservados|creative commons|software foundation|spdx|\\b[al]?gplv?[0-9]?\\b|\\bcc0\\b|creativecommons"
WINDOW, CONFIRMS = (5, 8, 12, 20), 0.5
#: Shares of held-out lines, and of held-out sentences with a notice's words, that may pass the threshold.
FALSE_SHARE, FALSE_HARD = 0.01, 0.1
#: Weight of all counts of plain lines in the fit; a window of the fixed texts has weight 1.
PLAIN_WEIGHT = 3000.0
#: The feature of words that no fixed text has; no token is like it.
OTHER = "\\0"
#: Bins of probabilities from 1/2 to 1 that held-out lines are counted in.
BINS = 1 << 14


_ALTERNATIVES = ANCHORS.removeprefix("(?i)").split("|")
_ONE, _TWO = ("(?i)" + "|".join(x for x in _ALTERNATIVES if (" " in x) == two) for two in (False, True))
#: Every text that ANCHORS finds, with its words parted by whatever, has one of these, which are quick to look for.
_HINTS = "licens licenc lizenz lizens copyright domain permission redistribut software warrant reserved vorbehalten réservés reservados commons spdx gpl cc0".split()
#: As ANCHORS, with the words of an alternative parted by anything that parts words.
_ANYWHERE = ANCHORS.replace(" ", "[^\\p{L}\\p{N}]+")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once: a lambda over a one-element array."""
    return F.transform(F.array(value), body)[0]


def hinted(text: Column) -> Column:
    """Whether a text may hold an anchor."""
    return let(F.lower(text), lambda x: reduce(lambda a, b: a | b, [x.contains(h) for h in _HINTS]))


def tokens(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def grams(words: Column, n: int) -> Column:
    built = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, built).otherwise(F.array().cast("array<string>"))


def _table(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("family"), F.lit(b).alias("line")) for a, b in rows])))


def _fixed(spark: SparkSession) -> DataFrame:
    return _table(spark, [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [("unknown", t) for t in OTHERWISE])


def _known_grams(spark: SparkSession) -> list[str]:
    """All n-grams of the fixed texts, then OTHER."""
    all_ = _fixed(spark).select(tokens(F.col("line")).alias("words"))
    found = all_.select(F.explode(F.concat("words", grams(F.col("words"), 2), grams(F.col("words"), 3))).alias("gram")).distinct()
    return [*sorted(r["gram"] for r in found.collect()), OTHER]


def known_grams(words: Column, known: list[str]) -> Column:
    """The known n-grams among words, however often each, and OTHER for each word that is not known."""
    of = lambda n: [g for g in known if g != OTHER and g.count(" ") == n - 1]

    def joined(n: int) -> Column:
        begin = [*{g.split(" ")[0] for g in of(n)}]
        built = F.transform(words, lambda w, i: F.when(w.isin(begin), F.concat_ws(" ", F.slice(words, i + 1, n))))
        return F.filter(built, lambda g: g.isin(of(n)))

    return F.concat(F.transform(words, lambda w: F.when(w.isin(of(1)), w).otherwise(OTHER)), joined(2), joined(3))


def _features(df: DataFrame, known: list[str]) -> DataFrame:
    return df.withColumn("grams", let(F.col("words"), lambda words: known_grams(words, known)))


def _cut(words: str, starts: Column, n: int) -> Column:
    """The n words from each of the starts. A default argument of the lambda would be taken for its index."""
    return F.transform(starts, lambda i: F.slice(words, i, n))


def training(spark: SparkSession) -> DataFrame:
    """(family, words, held, hard): whole texts and word windows of templates and of other uses (hard). All windows of a text
    are held out or none is: a third of the other uses by their hash; templates are not."""
    held = (F.col("family") == "unknown") & (F.pmod(F.xxhash64("line"), F.lit(3)) == 0)
    words = _fixed(spark).select("family", (F.col("family") == "unknown").alias("hard"), tokens(F.col("line")).alias("all"), held.alias("held"))
    starts = lambda n: F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - n + 1), F.lit(2))
    cut = [words.select("family", "hard", "held", F.explode(_cut("all", starts(n), n)).alias("words")) for n in WINDOW]
    rows = words.select("family", "hard", "held", F.col("all").alias("words"))
    for c in cut:
        rows = rows.unionByName(c)
    return rows.filter(F.size("words") > 2).groupBy("family", "words").agg(F.min("held").alias("held"), F.max("hard").alias("hard"))


def plain_lines(text: DataFrame) -> DataFrame:
    """(line, held): all lines of text that have no anchor; a fifth of them, by their hash, is held out."""
    lines = F.split("text", "\n")
    plain = F.when(hinted(F.col("text")), F.filter(lines, lambda x: ~x.rlike(ANCHORS))).otherwise(lines)
    return text.select(F.explode(plain).alias("line")).select("line", (F.pmod(F.xxhash64("line"), F.lit(5)) == 0).alias("held"))


def plain_counts(lines: DataFrame, known: list[str]) -> dict[str, int]:
    """How often each known n-gram, or OTHER, stands in the plain lines that are not held out."""
    found = lines.filter("not held").select(F.explode(let(tokens(F.col("line")), lambda words: known_grams(words, known))).alias("gram"))
    return {r["gram"]: r["count"] for r in found.groupBy("gram").count().collect()}


def plain_cut(scored: DataFrame) -> float:
    """The lowest edge of a bin, 1/2 at least, that at most FALSE_SHARE of the rows of scored (top) pass."""
    place = F.when(F.col("top") >= 0.5, F.least(F.floor((2 * F.col("top") - 1) * BINS), F.lit(BINS - 1)))
    found = {r["bin"]: r["count"] for r in scored.groupBy(place.cast("int").alias("bin")).count().collect()}
    room, cut = FALSE_SHARE * sum(found.values()), BINS
    while cut and found.get(cut - 1, 0) <= room:
        cut -= 1
        room -= found.get(cut, 0)
    return 0.5 + cut / BINS / 2


def split_lines(texts: DataFrame) -> DataFrame:
    """Each line of text, numbered by k from 0, beside the other columns."""
    return texts.select(*[c for c in texts.columns if c != "text"], F.posexplode(F.split("text", "\n")).alias("k", "line"))


def windows(marked: DataFrame) -> DataFrame:
    """(row, k, words): for each line k of the texts of marked (row, text) with an anchor, its own words and the windows of
    its paragraph that hold the anchor; an anchor that goes over a line's end belongs to the line where it begins."""
    broken = F.array(F.struct(F.lit(None).cast("string").alias("w"), F.lit(-1).alias("k")))
    numbered = F.transform(F.split("text", "\n"), lambda x, k: let(tokens(x), lambda t: F.when(F.size(t) > 0, F.transform(t, lambda w: F.struct(w.alias("w"), k.alias("k")))).otherwise(broken)))
    most = max(WINDOW)

    def near_anchors(all_: Column) -> Column:
        at = lambda i, f: F.try_element_at(all_, i).getField(f)
        held = lambda i: at(i, "w").rlike(_ONE) | F.coalesce(F.concat_ws(" ", at(i, "w"), at(i + 1, "w")).rlike(_TWO) & at(i + 1, "w").isNotNull(), F.lit(False))
        places = F.filter(F.sequence(F.lit(1), F.size(all_)), lambda i: at(i, "w").isNotNull() & held(i))
        around = lambda i: F.struct(at(i, "k").alias("k"), F.least(i, F.lit(most)).alias("i"), F.transform(F.slice(all_, F.greatest(F.lit(1), i - most + 1), 2 * most - 1), lambda x: x["w"]).alias("near"))
        return F.transform(places, around)

    def own_lines(lines: Column, near: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(near, lambda x: x["k"])), lambda k: F.struct(k.alias("k"), F.transform(F.get(lines, k), lambda x: x["w"]).alias("words")))

    # let() holds the words of a text as a value: a column of them would be put back, and computed again, wherever it is used
    found = let(numbered, lambda lines: let(let(F.flatten(lines), near_anchors), lambda near: F.struct(near.alias("near"), own_lines(lines, near).alias("own"))))
    placed = marked.select("row", found.alias("found"))
    near = placed.select("row", F.inline("found.near"))
    first = lambda n: F.greatest(F.lit(1), F.col("i") - n + 1)
    last = lambda n: F.least("i", F.size("near") - n + 1)
    cut = [F.when(last(n) >= first(n), _cut("near", F.sequence(first(n), last(n)), n)).otherwise(F.array().cast("array<array<string>>")) for n in WINDOW]
    inner = near.select("row", "k", F.explode(F.filter(F.concat(*cut), lambda x: ~F.exists(x, lambda w: w.isNull()))).alias("words"))
    whole = placed.select("row", F.inline("found.own"))
    return whole.unionByName(inner)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Candidate lines with the family predicted: (doc_id, line_no, family, probability, overlap, confirmed, line).

    family is unknown if no family passes the calibrated threshold or the template comparison fails; probability and overlap
    are those of the line's best window, confirmed ones and those with more triples in templates first. Windows below the
    threshold are not compared and overlap nothing. A line that holds
    notices of several families gives one of them. Lines count from 1. Null and empty texts have no lines; equal rows give
    equal results; ids may be null. Texts of any length are read whole, no line is cut, and cost grows with words and anchors
    in sum. An empty table gives an empty one. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    plain = plain_lines(text)
    marked = written(text.filter(hinted(F.col("text")) & F.col("text").rlike(_ANYWHERE)).withColumn("row", F.monotonically_increasing_id()), "marked")
    known, families = _known_grams(spark), [*TEMPLATES, "unknown"]
    counts = plain_counts(plain, known)
    every = float(sum(counts.values()))
    rows = _features(training(spark), known).select("family", "grams", "held", "hard", F.lit(1.0).alias("weight"))
    if counts:
        one = spark.createDataFrame(pa.table({"gram": [*counts], "weight": [PLAIN_WEIGHT * n / every for n in counts.values()]}))
        rows = rows.unionByName(one.select(F.lit("unknown").alias("family"), F.array("gram").alias("grams"), F.lit(False).alias("held"), F.lit(False).alias("hard"), "weight"))
    number = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    rows = written(rows.withColumn("y", number.cast("double")), "training")
    model = Pipeline(stages=[CountVectorizerModel.from_vocabulary(known, "grams", "features"), LogisticRegression(labelCol="y", weightCol="weight", family="multinomial", regParam=2e-4, maxIter=40)]).fit(rows.filter("not held").coalesce(4))
    scored = lambda df: model.transform(df).withColumn("p", vector_to_array("probability"))
    top = F.array_max(F.slice("p", 1, len(families) - 1))
    cut = scored(rows.filter("held")).agg(F.percentile(top, 1 - FALSE_HARD).alias("hard")).first()
    held = scored(plain.filter("held").select(let(tokens(F.col("line")), lambda words: F.when(F.size(words) > 2, known_grams(words, known))).alias("grams")).filter("grams is not null"))
    threshold = max(plain_cut(held.select(top.alias("top"))), cut["hard"] or 0.0)
    shapes = _table(spark, [(f, t) for f, ts in TEMPLATES.items() for t in ts]).groupBy("family").agg(F.collect_list(F.array_distinct(grams(tokens(F.col("line")), 3))).alias("shapes"))
    shapes = shapes.select("family", F.filter("shapes", lambda x: F.size(x) > 0).alias("shapes"))
    names = F.array(*map(F.lit, families))
    best = scored(_features(windows(marked), known)).withColumn("probability", top).withColumn("family", F.element_at(names, F.array_position("p", top).cast("int")))
    best = best.join(F.broadcast(shapes), "family", "left").withColumn("own", F.array_distinct(grams(F.col("words"), 3)))
    met = F.transform("shapes", lambda x: F.struct(F.size(F.array_intersect("own", x)).alias("n"), F.size(x).alias("of")))
    best = best.withColumn("met", F.when(F.col("probability") >= threshold, met))
    share = F.array_max(F.transform("met", lambda m: m["n"] / F.least(m["of"], F.greatest(F.size("own"), F.lit(1)))))
    best = best.withColumn("same", F.coalesce(F.array_max(F.transform("met", lambda m: m["n"])), F.lit(0))).withColumn("overlap", F.coalesce(share, F.lit(0.0)))
    confirmed = (F.col("probability") >= threshold) & (F.col("overlap") >= CONFIRMS)
    ranked = F.struct(confirmed.alias("confirmed"), "same", "overlap", "probability", "family")
    found = best.groupBy("row", "k").agg(F.max(ranked).alias("best")).select("row", "k", "best.*")
    found = found.join(split_lines(marked), ["row", "k"])
    return found.select("doc_id", (F.col("k") + 1).alias("line_no"), F.when(F.col("confirmed"), F.col("family")).otherwise("unknown").alias("family"), "probability", "overlap", "confirmed", "line")
