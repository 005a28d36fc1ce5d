"""License scans: MinHash bands over overlapping windows find templates, shingles verify them.

A template of a size class is compared with windows larger than the class, at steps small enough that
each stretch half as long again as the class lies whole in a window, wherever it begins.  Their smallest salted hashes agree in
some band with near certainty; what agrees is then verified by exact containment of
shingles in every such stretch.  Templates shorter than a shingle are found exactly, as sequences of whole words.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
CONTAINED = 0.8
#: Hashes a window, each a band of its own.  A window holds at most twice the largest template of its
#: class, the smallest being half as large: at containment 0.8 a window and a template share 0.19 of
#: their shingles at least, and all bands miss with probability 0.81^64 = 0.000001.
BANDS = 64
WORD = r"[\p{L}\p{N}]+"

# Notices and opening paragraphs of public licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
     " software and associated documentation files (the \"Software\"), to deal in the Software"
     " without restriction, including without limitation the rights to use, copy, modify, merge,"
     " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to"
     " whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain"
     " a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed"
     " under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF"
     " ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the"
     " terms of the GNU General Public License as published by the Free Software Foundation, either"
     " version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the"
     " terms of the GNU General Public License as published by the Free Software Foundation; either"
     " version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the"
     " terms of the GNU Lesser General Public License as published by the Free Software Foundation;"
     " either version 2.1 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are"
     " permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
     " without fee is hereby granted, provided that the above copyright notice and this permission"
     " notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International"
     " License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0"
     " International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or"
     " neighboring rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# Short notices and SPDX lines.  Words hold no punctuation, so the MIT line is found in MIT-0 too.
NOTICES = [
    ("All-rights-reserved", "All rights reserved"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1"),
    ("BSD", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used inside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _places(words: Column) -> Column:
    """Positions, from 0, at which a shingle starts."""
    return F.when(F.size(words) >= SHINGLE_WORDS,
                  F.sequence(F.lit(0), F.size(words) - SHINGLE_WORDS)).otherwise(
        F.array().cast("array<int>"))


def _hashes(words: Column) -> Column:
    return _let(words, lambda w: F.transform(_places(w), lambda i: F.xxhash64(
        *[F.get(w, i + k) for k in range(SHINGLE_WORDS)])))


def _shingles(words: Column) -> Column:
    """In their order, repeated ones too."""
    return _let(words, lambda w: F.transform(_places(w), lambda i: F.array_join(
        F.slice(w, i + 1, F.lit(SHINGLE_WORDS)), " ")))


def _salts() -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda k: F.xxhash64(k))


def _minima(hashes: Column) -> Column:
    """The smallest hash under each salt; for random hashes two sets agree in one with the
    probability of their Jaccard similarity."""
    return _let(hashes, lambda found: F.transform(_salts(), lambda s: F.array_min(
        F.transform(found, lambda h: h.bitwiseXOR(s)))))


def _read(docs: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    rows = docs.sparkSession.createDataFrame(
        [(license, k, text) for k, (license, text) in enumerate(templates)],
        "license string, template int, text string")
    return rows.withColumn("words", words_of(F.col("text")))


def template_table(docs: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """One row a template of five words or more: license, template, size (class, a power of two),
    shingles and minima.  Shorter ones are in ``short_templates``."""
    read = _read(docs, templates)
    hashed = read.select("license", "template", F.array_distinct(_shingles(F.col("words"))).alias("shingles"),
                         _hashes(F.col("words")).alias("hashes")).where(F.size("shingles") > 0)
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("shingles")))).cast("int")
    return hashed.select("license", "template", size.alias("class"), "shingles",
                         _minima(F.col("hashes")).alias("minima"))


def short_templates(docs: DataFrame, templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """License and words of each template of fewer than five words.  One without a word could match
    nothing and is refused."""
    short = _read(docs, templates).where(F.size("words") < SHINGLE_WORDS).orderBy("template").collect()
    empty = [(row["license"], row["text"]) for row in short if not row["words"]]
    if empty:
        raise ValueError(f"templates without a word: {empty}")
    return [(row["license"], row["words"]) for row in short]


def _short_found(docs: DataFrame, short: list[tuple[str, list[str]]]) -> DataFrame:
    """doc_id, license and containment (1) where the words of a short template follow each other."""
    inside, between = WORD[:-1], "[^" + WORD[1:]
    patterns = [between.join(words) for _, words in short]
    whole = "(?<!{0})(?:{1})(?!{0})".format
    texts = docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text"))
    some = texts.where(F.col("text").rlike(whole(inside, "|".join(patterns))))
    which = F.array(*[F.when(F.col("text").rlike(whole(inside, pattern)), F.lit(license))
                      for (license, _), pattern in zip(short, patterns)])
    return some.select("doc_id", F.explode(F.array_compact(which)).alias("license"),
                       F.lit(1.0).alias("containment"))


def _windows(count: Column, size: int) -> Column:
    """Windows over ``count`` shingles for a class, at steps of half a class, such that each stretch
    lies whole in one: (class, at, length)."""
    step = max(size // 2, 1)
    starts = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda at: F.struct(
        F.lit(size).alias("class"), at.alias("at"), F.lit(size + 2 * step - 1).alias("length")))


def _containment(signs: Column, shingles: Column, size: Column) -> Column:
    """The largest part of ``signs`` in a stretch of ``shingles`` half as long again as the class."""
    length = size + F.greatest(F.floor(size / 2), F.lit(1)).cast("int")
    return _let(shingles, lambda s: F.array_max(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(s) - length, F.lit(0)) + 1),
        lambda at: F.size(F.array_intersect(signs, F.slice(s, at, length))) / F.size(signs))))


def _long_found(docs: DataFrame, known: DataFrame, contained: float) -> DataFrame:
    """doc_id, license and containment for each window and template of ``known`` that agree."""
    listed = known.select("class", "minima").collect()
    salts = docs.sparkSession.range(1).select(_salts().alias("s")).first()["s"]
    heads = sorted({m ^ s for row in listed for m, s in zip(row["minima"], salts)})
    wanted = F.lit(heads).cast("array<bigint>")
    # Made as a generated row, so that a filter on it does not compute it a second time.
    both = _let(words_of(F.col("text")), lambda w: F.struct(w.alias("words"),
                                                            _hashes(w).alias("hashes")))
    hashed = docs.select(F.col("doc_id").cast("long"), F.inline(F.array(both))).where(
        F.arrays_overlap("hashes", wanted))
    classes = sorted({row["class"] for row in listed})
    sized = F.concat(*[_windows(F.size("hashes"), size) for size in classes])
    # One row a window with its words, so that what follows needs no long text again.
    windows = hashed.select("doc_id", "words", "hashes", F.explode(sized).alias("w")).select(
        "doc_id", "w.class",
        F.slice("words", F.col("w.at") + 1, F.col("w.length") + SHINGLE_WORDS - 1).alias("words"),
        F.slice("hashes", F.col("w.at") + 1, F.col("w.length")).alias("hashes"))
    near = windows.where(F.arrays_overlap("hashes", wanted))
    found = near.select("doc_id", "class", "words", F.inline(F.array(F.struct(
        _minima(F.col("hashes")).alias("lows"))))).select(
        "*", F.posexplode("lows").alias("band", "minimum"))
    bands = known.select("license", "template", "class", "shingles", "minima",
                         F.posexplode("minima").alias("band", "minimum"))
    # A window and a template are verified once, in the first band in which they agree.
    same = F.zip_with("lows", "minima", lambda a, b: a == b)
    agreed = found.join(F.broadcast(bands), ["class", "band", "minimum"]).where(
        F.array_position(same, F.lit(True)) == F.col("band") + 1)
    part = _containment(F.col("shingles"), _shingles(F.col("words")), F.col("class")).alias("containment")
    return agreed.select("doc_id", "license", part).where(F.col("containment") >= contained)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES + NOTICES,
         contained: float = CONTAINED) -> DataFrame:
    """doc_id, license and containment: the largest part of a template's shingles that one stretch
    holds, of ``contained`` at least; a row for each license of a document.  A stretch is half as long
    again as the template's class and may begin at any shingle.

    Whole texts of ``docs`` (doc_id, text).  A window can only agree with a template in a band if it
    holds the shingle that gives the template's minimum, so texts without any of these shingles
    are left out before windows are made.  A template shorter than a shingle has containment 1 where
    its whole word sequence stands; one without a word is an error.  Templates are a bounded list and
    are broadcast.  Null and empty texts match nothing; repeated rows and rows without doc_id count as one document
    a doc_id; an empty table gives an empty result; other columns are not looked at.
    """
    short = short_templates(docs, templates)
    parts = [_short_found(docs, short)] if short else []
    if len(short) < len(templates):
        parts.append(_long_found(docs, template_table(docs, templates), contained))
    return (reduce(DataFrame.unionByName, parts).groupBy("doc_id", "license")
            .agg(F.max("containment").alias("containment")))


def _template_sql(templates: list[tuple[str, str]]) -> str:
    return ", ".join("({}, {}, '{}')".format(k, repr(license), text.replace("'", "''"))
                     for k, (license, text) in enumerate(templates))


#: The scan in SQL: a template shorter than a shingle is one shingle, and a stretch
#: may begin at any place.
SCAN_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id,
                      regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS words FROM documents),
templates(template, license, text) AS (VALUES {_template_sql(TEMPLATES + NOTICES)}),
read AS (SELECT template, license, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS words FROM templates),
known AS (SELECT *, least(len(words), 5) AS width FROM read),
signs AS (SELECT DISTINCT template, license, width, array_to_string(words[pos + 1:pos + width], ' ') AS shingle
          FROM (SELECT *, unnest(range(0, len(words) - width + 1)) AS pos FROM known)),
sizes AS (SELECT template, count(*) AS size, pow(2, ceil(log2(count(*))))::INTEGER AS class
          FROM signs GROUP BY template),
placed AS (SELECT rid, doc_id, words, width, unnest(range(0, len(words) - width + 1)) AS pos
           FROM texts, (SELECT DISTINCT width FROM known) WHERE len(words) >= width),
shingled AS (SELECT rid, doc_id, width, pos, array_to_string(words[pos + 1:pos + width], ' ') AS shingle FROM placed),
hits AS (SELECT rid, doc_id, pos, template, license, shingle, size, class + greatest(class // 2, 1) AS length
         FROM shingled JOIN signs USING (width, shingle) JOIN sizes USING (template)),
parts AS (SELECT a.doc_id, a.license, count(DISTINCT b.shingle) / any_value(a.size) AS containment
          FROM hits a JOIN hits b ON a.rid = b.rid AND a.template = b.template
               AND b.pos >= a.pos AND b.pos < a.pos + a.length
          GROUP BY a.rid, a.doc_id, a.license, a.template, a.pos)
SELECT doc_id, license, max(containment) AS containment FROM parts
WHERE containment >= 0.8 GROUP BY doc_id, license
"""
