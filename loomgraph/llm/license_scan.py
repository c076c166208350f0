"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

All of it is DataFrame functions; no Python runs on executors. Words are runs of a-z and 0-9 after A-Z are lower-cased, shingles
are five words. A template matches a window that contains `share` (0.8) or more of the template's distinct shingles.

Windows come in width classes that grow by a quarter; a template of T words belongs to the least width w >= T, and its windows
are w + s words long at every s-th word, with s = max(1, w / 4): a passage of up to w words lies whole in a window. Jaccard
similarity of such a window and a template that it contains to 0.8 is then 0.4 at least, and with `bands` = 32 bands of one
row each the retrieval probability is 1 - 0.6^32 > 0.9999999.

Most documents have no license at all. Cue words are derived from the templates so that of every template fewer than 0.8 of the
shingles are without a cue: a text without any cue cannot match, and neither can a window without one. So only documents, and
in them windows, with a cue are hashed; nothing that could match is skipped. Templates with their bands are broadcast; their
number is checked (`most_templates`), it does not grow with the data. Long texts are cut into segments that overlap by the longest
window, so that time and memory follow a text's length.

Defined cases: null and empty texts, and texts of fewer than five words, match nothing; very long texts are scanned whole; rows
that repeat a key, or have none, are one document, which has the licenses of all its texts; of windows that match equally well
the first is told; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
#: Words of a segment of a long text.
SEGMENT = 512

#: Public license texts and notices, by SPDX name where there is one. Fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def shingles_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def width_class(n: int) -> int:
    w = SHINGLE
    while w < n:
        w = max(w + 1, w * 5 // 4)
    return w


def cue_words(templates, share: float) -> list[str]:
    """Words so that every template matched to `share` has a shingle with one of them; long words first, as few as it takes."""
    open_ = {i: shingles_of(words_of(t)) for i, (_, t) in enumerate(templates)}
    sizes = {i: len(s) for i, s in open_.items()}
    cues: list[str] = []
    while open_ := {i: s for i, s in open_.items() if len(s) >= share * sizes[i]}:
        gain: dict[str, float] = {}
        for i, s in open_.items():
            for shingle in s:
                for w in set(shingle.split()):
                    gain[w] = gain.get(w, 0) + min(len(w), 7) ** 2 / sizes[i]
        best = max(sorted(gain), key=lambda w: gain[w])
        cues.append(best)
        open_ = {i: {x for x in s if best not in x.split()} for i, s in open_.items()}
    return cues


def _words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[^a-z0-9]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    return F.when(F.size(words) >= SHINGLE, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")))).otherwise(F.array().cast("array<string>"))


def _bands(shingles: Column, bands: int) -> Column:
    """The least hash of the shingles under each of `bands` hash functions."""
    hashed = F.transform(shingles, lambda s: F.xxhash64(s))
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda k: F.array_min(F.transform(hashed, lambda h: F.xxhash64(h, k))))


def template_table(spark: SparkSession, templates=TEMPLATES, bands: int = 32) -> DataFrame:
    """width, band, value, template, license, shingles: one row per template and band."""
    rows = [(i, name, width_class(len(words_of(text))), sorted(shingles_of(words_of(text)))) for i, (name, text) in enumerate(templates)]
    t = spark.createDataFrame(rows, "template int, license string, width int, template_shingles array<string>")
    return t.select("*", F.posexplode(_bands(F.col("template_shingles"), bands)).alias("band", "value"))


def license_matches(df: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, share: float = 0.8, bands: int = 32, most_templates: int = 5000) -> DataFrame:
    """key, license, template, containment (greatest), start_word (of the first such window): one row per document and template."""
    spark = df.sparkSession
    if len(templates) > most_templates or any(len(words_of(t)) < SHINGLE for _, t in templates):
        raise ValueError(f"templates must be {most_templates} at most, of {SHINGLE} words at least")
    cues = cue_words(templates, share)
    found = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").rlike("(?i)" + "|".join(cues)))
    found = found.select("key", _words(F.col("text")).alias("words")).filter(F.size("words") >= SHINGLE)
    classes = sorted({width_class(len(words_of(t))) for _, t in templates})
    most = max(w + max(1, w // 4) for w in classes)
    # Cut into segments first: what follows copies a segment per window, not the text. A segment has the windows that start in it.
    cut = F.transform(F.sequence(F.lit(0), ((F.size("words") - 1) / SEGMENT).cast("int")), lambda i: F.struct((i * SEGMENT).alias("base"), F.slice("words", i * SEGMENT + 1, SEGMENT + most).alias("words")))
    found = found.select("key", F.explode(cut).alias("s")).select("key", "s.base", "s.words")
    cue_list = F.array(*map(F.lit, cues))
    # Positions of cues (from 0, in the text); only these are looked at below.
    found = found.withColumn("at", F.filter(F.transform(F.col("words"), lambda w, i: F.when(F.array_contains(cue_list, w), i + F.col("base"))), lambda i: i.isNotNull())).filter(F.size("at") > 0)
    found = found.withColumn("width", F.explode(F.array(*map(F.lit, classes))))
    found = found.withColumn("step", F.greatest(F.lit(1), (F.col("width") / 4).cast("int"))).withColumn("long", F.col("width") + F.col("step"))
    first = lambda p: F.greatest(F.ceil(F.col("base") / F.col("step")), F.ceil((p - F.col("long") + 1) / F.col("step"))).cast("int")
    last = lambda p: F.floor(F.least(p, F.col("base") + SEGMENT - 1) / F.col("step")).cast("int")
    window = F.array_distinct(F.flatten(F.transform(F.col("at"), lambda p: F.when(first(p) <= last(p), F.sequence(first(p), last(p))).otherwise(F.array().cast("array<int>")))))
    found = found.withColumn("window", F.explode(window)).withColumn("start_word", (F.col("window") * F.col("step")).cast("long"))
    found = found.select("key", "width", "start_word", _shingles(F.slice("words", (F.col("start_word") - F.col("base") + 1).cast("int"), F.col("long"))).alias("shingles")).filter(F.size("shingles") > 0)
    banded = found.select("key", "width", "start_word", "shingles", F.posexplode(_bands(F.col("shingles"), bands)).alias("band", "value"))
    hit = banded.join(F.broadcast(template_table(spark, templates, bands)), ["width", "band", "value"])
    hit = hit.withColumn("containment", F.size(F.array_intersect("shingles", "template_shingles")) / F.size("template_shingles")).filter(F.col("containment") >= share)
    best = hit.groupBy("key", "license", "template").agg(F.max(F.struct("containment", (-F.col("start_word")).alias("before"))).alias("b"))
    return best.select(F.col("key").alias(key), "license", "template", F.col("b.containment").alias("containment"), (-F.col("b.before")).alias("start_word"))


def license_report(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, n_licenses, licenses (names in order, comma-joined), templates (template@start_word, comma-joined): one row per row of df."""
    found = license_matches(df, key, text, **options)
    said = F.concat(F.col("template").cast("string"), F.lit("@"), F.col("start_word").cast("string"))
    per = found.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_set("license")).alias("names"), F.sort_array(F.collect_list(F.struct("template", said.alias("said")))).alias("hits"))
    out = df.select(key).join(per, F.col(key).eqNullSafe(F.col("_key")), "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return out.select(key, F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.coalesce(F.array_join(F.transform("hits", lambda h: h["said"]), ","), F.lit("")).alias("templates"))
