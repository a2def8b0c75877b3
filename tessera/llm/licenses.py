"""License scans: a trained paragraph classifier, applied with DataFrame functions only.

A sparse logistic regression over word n-grams, n = 1 and 2, tells licence families, an unknown class of
licence talk and other text apart. It is fitted on the driver, on the notices below, with an L1 penalty, and
its probabilities are calibrated by a temperature
that is set on lines it wasn't fitted on. A text is cut at line ends; a paragraph that holds none of
the licence words has no n-gram of the model, and is passed over. A family that the classifier predicts is
confirmed if enough of the words of one of its notices stand in the paragraph, and is unknown otherwise.
A notice that is wrapped over lines is a paragraph too: where licence talk is left unconfirmed, neighbouring
lines without a blank one or a confirmed one between them are judged together.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read_table

# Notices by family.
NOTICES = (
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License version 3."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "Use of this source code is governed by a BSD-style license."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("cc0", "Dedicated to the public domain under CC0."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl", "This library is free software under the terms of the GNU Lesser General Public License, version 2.1."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("mit", "Distributed under the MIT License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "This software is proprietary and confidential; unauthorized copying is prohibited. All rights reserved."),
)
# Licence talk of no family, and other text.
UNKNOWN = (
    "Licensed under the terms of the license agreement.",
    "Distributed under the Foo Public License, version 1.",
    "See the file LICENSE for the license of this software.",
    "This license grants you no rights to the trademarks of the licensor.",
    "Released under a license of our own.",
    "The software is provided as is, without warranty of any kind.",
    "Use of this work is subject to the license that came with it.",
    "Copyright 2020 the authors.",
)
OTHER = (
    "The bridge over the river was opened to traffic on Monday, after repairs that took three years.",
    "She sat by the window and read the letter again, in the last of the light.",
    "Version 2 of the report is free to download, and the work went on under a new director.",
    "The general asked for permission to leave, and the public was told nothing.",
    "He got his driving license in May and sold the car in June.",
    "The right to vote was granted to all.",
    "All seats are reserved for the guests of the library.",
    "The new software can copy a file in a second.",
    "Common law has it that the author keeps the copy.",
    "The apache helicopter flew over the city.",
)
# Lines that the model isn't fitted on, by which its probabilities are calibrated.
HELD = (
    ("agpl-3.0", "You may copy this under the terms of the GNU Affero General Public License, version 3 of the License."),
    ("apache-2.0", "This project is available under the Apache License 2.0, see LICENSE for details."),
    ("apache-2.0", "Code is licensed under Apache-2.0."),
    ("bsd", "Distributed under the 3-Clause BSD License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without changes, are permitted."),
    ("cc-by", "All pictures are licensed under a Creative Commons Attribution 4.0 license."),
    ("cc-by-nc", "Photos by the author, licensed CC BY-NC 4.0."),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License 4.0."),
    ("cc0", "The data set is dedicated to the public domain under CC0 1.0."),
    ("gpl-2.0", "Released under the GNU General Public License version 2."),
    ("gpl-3.0", "You can redistribute it under the terms of the GNU General Public License, version 3."),
    ("lgpl", "This library is distributed under the GNU Lesser General Public License, version 2.1."),
    ("mit", "The code is free to use under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("mpl-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
    ("proprietary", "Copyright 2021 Example Corp. All rights reserved."),
    ("unknown", "Released under the terms of the Example Community License."),
    ("unknown", "The license of this library can be found on its page."),
    ("unknown", "Provided without any warranty."),
    ("unknown", "Licensed for use at one site only."),
    ("none", "The driver had his license taken away in March."),
    ("none", "A general of the army was given the rights to the land."),
    ("none", "The library keeps a copy of each letter for the public."),
)
#: Words that every n-gram of the model holds one of; without any of them a paragraph can't be licence talk.
LICENCE_WORDS = frozenset(
    "license licensed licence licensor mit apache apache-2.0 gnu gpl lgpl agpl bsd bsd-style mozilla mpl cc by-nc by-sa cc0 creative commons attribution-noncommercial attribution-sharealike attribution affero "
    "copyright rights reserved warranty redistribution redistribute proprietary spdx-license-identifier hereby domain waived noninfringement 3-clause permitted version".split()
)
WORD = r"[a-z0-9][a-z0-9+-]*(?:\.[a-z0-9]+)*"
#: Shape of the training: steps, L1 penalty; probability that a prediction needs, and share of a notice's words that confirms it.
STEPS, PENALTY, SURE, COVER = 1500, 0.0015, 0.5, 0.6
DIGITS = 4


def ngrams(text: str) -> list[str]:
    """Distinct licence n-grams of a paragraph: single words and pairs that hold a licence word."""
    w = re.findall(WORD, text.lower())
    one = [x for x in w if x in LICENCE_WORDS]
    two = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if a in LICENCE_WORDS or b in LICENCE_WORDS]
    return sorted({*one, *two})


@cache
def model() -> tuple[list[str], list[float], dict[str, list[float]]]:
    """(classes, their biases, weights by n-gram): the last two classes are unknown licence talk and other text."""
    families = sorted({f for f, _ in NOTICES})
    classes = [*families, "unknown", "none"]
    texts = [*((t, families.index(f)) for f, t in NOTICES), *((t, len(families)) for t in UNKNOWN), *((t, len(families) + 1) for t in OTHER)]
    # Notices occur with words around them: each is also a line with a beginning or an end that says nothing.
    spread = [(x, k) for t, k in texts for x in (t, f"Note: {t}", f"{t} Thank you for reading.")]
    names = sorted({g for t, _ in spread for g in ngrams(t)})
    at = {g: i for i, g in enumerate(names)}
    x, y = np.zeros((len(spread), len(names) + 1)), np.zeros((len(spread), len(classes)))
    for row, (t, k) in enumerate(spread):
        x[row, [at[g] for g in ngrams(t)]] = 1
        x[row, -1] = 1
        y[row, k] = 1
    w, speed = np.zeros((x.shape[1], len(classes))), 1.0
    for _ in range(STEPS):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= speed * (x.T @ (p - y) / len(x))
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - speed * PENALTY, 0)
    # Calibration: the temperature under which lines that the model wasn't fitted on are the most likely.
    held = [(t, classes.index(k)) for k, t in HELD]
    hx = np.zeros((len(held), x.shape[1]))
    for row, (t, _) in enumerate(held):
        hx[row, [at[g] for g in ngrams(t) if g in at]] = 1
        hx[row, -1] = 1
    z, rows = hx @ w, np.arange(len(held))

    def loss(scale: float) -> float:
        s = z * scale
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[rows, [k for _, k in held]]).mean())

    w *= min(np.geomspace(0.25, 4, 33).tolist(), key=loss)
    w = np.round(w, DIGITS)
    return classes, w[-1].tolist(), {g: w[i].tolist() for g, i in at.items() if w[i].any()}


@cache
def notice_words() -> list[tuple[str, list[str]]]:
    """Each notice's family and distinct words."""
    return [(f, sorted(set(re.findall(WORD, t.lower())))) for f, t in NOTICES]


def reach() -> int:
    """Words that a wrapped notice may take between its first and its last line: twice those of the longest notice."""
    return 2 * max(len(re.findall(WORD, t.lower())) for _, t in NOTICES)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def any_of(text: Column) -> Column:
    """Whether a lower-case text has any licence word, be it within a longer one."""
    short = [w for w in LICENCE_WORDS if not any(v != w and v in w for v in LICENCE_WORDS)]
    found = F.lit(False)
    for w in sorted(short):
        found = found | text.contains(w)
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_paragraphs, n_unknown, families and score.

    A paragraph is a line, or the lines of a wrapped notice; comment markers are no words, and a line of
    them alone is blank. n_paragraphs counts paragraphs of licence talk, n_unknown those of no confirmed family;
    families are the confirmed ones, sorted and joined by commas; score is the highest probability of a
    confirmed paragraph, 0 without one. Null and empty texts and texts without licence talk: zeros and an
    empty string. Null ids and repeated rows stay; other columns are not read. No rows in: no rows out.
    Row by row, without a shuffle: the model is part of the plan.
    """
    classes, bias, weights = model()
    zeros = F.array(*[F.lit(0.0)] * len(classes))
    table = F.create_map(*[x for g, w in sorted(weights.items()) for x in (F.lit(g), F.array(*map(F.lit, w)))])
    licence = F.array(*map(F.lit, sorted(LICENCE_WORDS)))
    low = F.lower(F.col("text"))

    def judged(words: Column) -> Column:
        return let(words, of_words)

    def of_words(words: Column) -> Column:
        one = F.array_intersect(words, licence)
        pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when(F.array_contains(licence, a) | F.array_contains(licence, b), F.concat(a, F.lit(" "), b)))
        grams = F.array_distinct(F.concat(one, F.filter(pairs, lambda g: g.isNotNull())))
        known = F.filter(F.transform(F.array_sort(grams), lambda g: F.try_element_at(table, g)), lambda w: w.isNotNull())
        logits = F.aggregate(known, F.array(*map(F.lit, bias)), lambda s, w: F.zip_with(s, w, lambda a, b: a + b))
        return F.struct(words.alias("words"), logits.alias("logits"))

    def verdict(j: Column) -> Column:
        top = F.array_max(j["logits"])
        best = F.element_at(F.array(*map(F.lit, classes)), F.array_position(j["logits"], top).cast("int"))
        chance = 1.0 / F.aggregate(j["logits"], F.lit(0.0), lambda s, z: s + F.exp(z - top))
        return let(F.struct(best.alias("best"), F.round(chance, 6).alias("chance")), lambda v: F.struct(v["best"].alias("best"), v["chance"].alias("chance"), share(j["words"], v["best"]).alias("share"), F.arrays_overlap(j["words"], licence).alias("talk")))

    def share(words: Column, best: Column) -> Column:
        """The highest share of a notice's words among those of the family's notices that are confirmed, and else 0."""
        found = F.lit(0.0)
        for family in sorted({f for f, _ in NOTICES}, reverse=True):
            of = [F.size(F.array_intersect(words, F.array(*map(F.lit, notice)))) for f, notice in notice_words() if f == family]
            sizes = [len(notice) for f, notice in notice_words() if f == family]
            shares = [F.when(hits >= COVER * size, hits / F.lit(float(size))).otherwise(0.0) for hits, size in zip(of, sizes, strict=True)]
            found = F.when(best == family, F.greatest(*shares, F.lit(0.0))).otherwise(found)
        return found

    def is_sure(v: Column) -> Column:
        return (v["share"] > 0) & (v["chance"] >= SURE) & (v["best"] != "unknown")

    def words_in(line: Column) -> Column:
        return F.regexp_extract_all(line, F.lit(f"({WORD})"))

    most = reach()

    def joined(lines: Column, k: Column) -> Column:
        """The surest of the paragraphs of two lines or more that begin with line k, as an array of one or none."""
        first = lines[k]["words"]
        first = F.slice(first, F.greatest(F.size(first) - most + 1, F.lit(1)), F.lit(most))
        start = F.struct(first.alias("words"), F.lit(0).alias("inner"), F.lit(0).alias("last"), (lines[k]["open"] & (F.size(first) > 0)).alias("on"), F.array().cast("array<array<string>>").alias("out"))

        def longer(s: Column, line: Column) -> Column:
            on = s["on"] & line["open"] & (F.size(line["words"]) > 0) & (s["inner"] < most)
            words = F.concat(s["words"], F.slice(line["words"], 1, most))
            return F.when(on, F.struct(words.alias("words"), (s["inner"] + F.size(line["words"])).alias("inner"), (s["last"] + 1).alias("last"), F.lit(True).alias("on"), F.concat(s["out"], F.array(words)).alias("out"))).otherwise(
                F.struct(s["words"].alias("words"), s["inner"].alias("inner"), s["last"].alias("last"), F.lit(False).alias("on"), s["out"].alias("out"))
            )

        windows = F.aggregate(F.slice(lines, k + 2, F.lit(most)), start, longer, lambda s: s["out"])
        told = F.transform(windows, lambda words, n: let(F.when(F.arrays_overlap(words, licence), verdict_of(words)), lambda v: F.struct(v["share"].alias("share"), (-n).alias("short"), v["chance"].alias("chance"), k.alias("from"), (k + n + 1).alias("to"), v.alias("v"))))
        sure = F.filter(told, lambda w: F.coalesce(is_sure(w["v"]), F.lit(False)))
        return F.slice(F.array_sort(sure, lambda a, b: F.when(before(a, b), -1).when(before(b, a), 1).otherwise(0)), 1, 1)

    def before(a: Column, b: Column) -> Column:
        key = lambda w: F.struct(w["share"], w["short"], w["chance"], -w["from"])
        return key(a) > key(b)

    def verdict_of(words: Column) -> Column:
        return let(judged(words), verdict)

    def wrapped(text: Column) -> Column:
        """The verdicts of a text with unconfirmed licence talk, its lines taken together where that confirms a notice."""

        def marked(line: Column) -> Column:
            v = F.when(any_of(line), verdict_of(words_in(line)))
            return let(v, lambda v: F.struct(words_in(line).alias("words"), v.alias("v"), (~F.coalesce(is_sure(v), F.lit(False))).alias("open")))

        def of_lines(lines: Column) -> Column:
            # Blocks around unconfirmed talk only: from elsewhere, no line can begin a wrapped notice.
            here = lambda k: F.exists(F.slice(lines, k + 1, F.lit(most + 1)), lambda l: l["open"] & F.coalesce(l["v"]["talk"], F.lit(False)))
            starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), here)
            every = F.flatten(F.transform(starts, lambda k: joined(lines, k)))
            best = F.array_sort(every, lambda a, b: F.when(before(a, b), -1).when(before(b, a), 1).otherwise(0))
            none = F.slice(best, 1, 0)
            taken = F.aggregate(best, none, lambda s, w: F.when(F.exists(s, lambda o: (o["from"] <= w["to"]) & (w["from"] <= o["to"])), s).otherwise(F.concat(s, F.array(w))))
            return let(taken, lambda t: F.concat(F.transform(t, lambda w: w["v"]), alone(lines, t)))

        def alone(lines: Column, taken: Column) -> Column:
            own = F.transform(lines, lambda l, k: F.when(~F.exists(taken, lambda w: (w["from"] <= k) & (k <= w["to"])), l["v"]))
            return F.filter(own, lambda v: v.isNotNull())

        return let(F.transform(F.split(text, "\n"), marked), of_lines)

    lines = F.transform(F.filter(F.split(low, "\n"), any_of), lambda line: verdict_of(words_in(line)))
    empty = F.array().cast("array<struct<best:string,chance:double,share:double,talk:boolean>>")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", low.alias("low"), F.coalesce(F.when(any_of(low), lines), empty).alias("told"))
    told = F.when(F.exists("told", lambda v: v["talk"] & ~is_sure(v)) & F.col("low").contains("\n"), wrapped(F.col("low"))).otherwise(F.col("told"))
    rows = rows.select("doc_id", let(told, lambda t: F.filter(t, lambda v: v["best"] != "none")).alias("found"))
    sure = F.filter("found", is_sure)
    return rows.select("doc_id", F.size("found").cast("long").alias("n_paragraphs"), "found", sure.alias("sure")).select(
        "doc_id",
        "n_paragraphs",
        (F.col("n_paragraphs") - F.size("sure")).cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("sure", lambda v: v["best"]))), ",").alias("families"),
        F.coalesce(F.array_max(F.transform("sure", lambda v: v["chance"])), F.lit(0.0)).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 over documents: one row a document, whole texts; null and empty texts have no paragraphs."""
    return scan(read_table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same scan as DuckDB SQL: paragraphs, their n-grams and the model as relations."""
    classes, bias, weights = model()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(g)}, {k}, {x!r}::DOUBLE)" for g, w in sorted(weights.items()) for k, x in enumerate(w) if x)
    names = ", ".join(f"({k}, {quote(c)}, {b!r}::DOUBLE)" for k, (c, b) in enumerate(zip(classes, bias, strict=True)))
    notices = ", ".join(f"({k}, {quote(f)}, {quote(w)}, {len(words)})" for k, (f, words) in enumerate(notice_words()) for w in words)
    words = ", ".join(f"({quote(w)})" for w in sorted(LICENCE_WORDS))
    return f"""
WITH model(gram, class, weight) AS (VALUES {values}),
classes(class, name, bias) AS (VALUES {names}),
notices(notice, family, word, size) AS (VALUES {notices}),
licence(word) AS (VALUES {words}),
lines AS (SELECT row_number() OVER () AS line, row, lower(l) AS l FROM (SELECT row, unnest(string_split(text, chr(10))) AS l FROM (SELECT row_number() OVER () AS row, text FROM documents))),
near AS (SELECT line, row, regexp_extract_all(l, {quote(WORD)}) AS words FROM lines WHERE {" OR ".join(f"contains(l, {quote(w)})" for w in sorted(LICENCE_WORDS))}),
spread AS (SELECT line, row, unnest(words) AS w, generate_subscripts(words, 1) AS at FROM near),
grams AS (
  SELECT line, w AS gram FROM spread WHERE w IN (SELECT word FROM licence)
  UNION
  SELECT a.line, a.w || ' ' || b.w FROM spread a JOIN spread b ON a.line = b.line AND b.at = a.at + 1
  WHERE a.w IN (SELECT word FROM licence) OR b.w IN (SELECT word FROM licence)),
logits AS (
  SELECT n.line, n.row, c.class, c.name, c.bias + coalesce(s.z, 0) AS z
  FROM near n CROSS JOIN classes c LEFT JOIN (SELECT line, class, sum(weight) AS z FROM grams JOIN model USING (gram) GROUP BY ALL) s ON s.line = n.line AND s.class = c.class),
best AS (SELECT line, row, arg_max(name, (z, -class)) AS best, max(z) AS top FROM logits GROUP BY ALL),
chances AS (SELECT b.line, any_value(b.row) AS row, any_value(b.best) AS best, round(1 / sum(exp(l.z - b.top)), 6) AS chance FROM best b JOIN logits l ON l.line = b.line GROUP BY b.line),
covered AS (
  SELECT DISTINCT line, family FROM (
    SELECT s.line, n.notice, n.family, n.size, count(DISTINCT n.word) AS hits FROM spread s JOIN notices n ON n.word = s.w GROUP BY ALL) WHERE hits >= {COVER} * size),
judged AS (SELECT c.*, v.family IS NOT NULL AND chance >= {SURE} AND best <> 'unknown' AS sure FROM chances c LEFT JOIN covered v ON v.line = c.line AND v.family = c.best WHERE best <> 'none'),
texts AS (SELECT row_number() OVER () AS row, doc_id FROM documents)
SELECT any_value(t.doc_id)::BIGINT AS doc_id, count(j.line)::BIGINT AS n_paragraphs, (count(j.line) - count(j.line) FILTER (WHERE sure))::BIGINT AS n_unknown,
  coalesce(string_agg(DISTINCT best, ',' ORDER BY best) FILTER (WHERE sure), '') AS families, coalesce(max(chance) FILTER (WHERE sure), 0)::DOUBLE AS score
FROM texts t LEFT JOIN judged j ON j.row = t.row GROUP BY t.row"""
