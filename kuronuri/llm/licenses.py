"""Licence scans: TF-IDF cosine of licence passages to templates, then inheritance by directory.

The library's records name no path of a document, so the operator takes files
``files(doc_id, path, text)``.  What a text says of its licence goes before what its directories
say.  DataFrame functions only.
"""

from __future__ import annotations

from importlib.resources import files as resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kuronuri.llm.tables import stored

# How licences are named in notices, and the opening words of their texts.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use "
                   "this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Released under the 3-clause BSD License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without "
                     "modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files, to deal in the Software without "
            "restriction"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
)
#: Standard header texts from their telling word on.
HEADERS = (
    *(t for t in TEMPLATES if t[0] != "Proprietary"),
    *((f"{a}GPL-{v}.0", "redistribute it and/or modify it under the terms of the GNU "
       f"{kind}General Public License as published by the Free Software Foundation, either version {v} of "
       "the License, or") for a, kind, v in (("A", "Affero ", 3), ("L", "Lesser ", 3), ("", "", 2), ("", "", 3))),
    ("LGPL-2.1", "redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                 "License as published by the Free Software Foundation; either version 2.1 of the License, or"),
    ("MPL-2.0", "License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
                "obtain one at https://mozilla.org/MPL/2.0/."),
)
#: A passage is told by one of these in a word, with so many words on either side on its line.
TELLING = r"(?i)licen[cs]|copyright|permission|redistribut|public\x20domain|rights\x20reserved"
BEFORE, AFTER = 8, 20
#: Least cosine for a match.
LEAST = 0.75
#: Names of files that speak for their directory.
LICENCE_FILE = r"(?i)^(?:un)?licen[cs]e|^copying|^notice"

_WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
_GAP = r"[\x20\t]+"
_TOLD = r"[^\s]*(?:licen[cs]|copyright|permission|redistribut|public\x20domain|rights\x20reserved)[^\s]*"
PASSAGE = rf"(?i)(?:[^\s]+{_GAP}){{0,{BEFORE}}}{_TOLD}(?:{_GAP}[^\s]+){{0,{AFTER}}}"
#: From every telling word on, whatever stands before it.
FROM_TOLD = rf"(?i)(?<![^\s])(?=({_TOLD}(?:{_GAP}[^\s]+){{0,{AFTER + 8}}}))"
#: A line end with the comment marks around it.
WRAP = r"[\x20\t]*(?:\*/|-->)?[\x20\t]*[\r\n]+(?:[\x20\t]*(?:#+|/{2,}|/\*+|\*+|--+|;+|%+|<!--|\x22{3}|\.\.)(?=[\x20\t\r\n]|$))*[\x20\t\r\n]*"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def directory(path: Column) -> Column:
    """The directory of a path without closing slash; the top is the empty text."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame(
        [(k, licence, text) for k, (licence, text) in enumerate(templates)],
        "template int, license string, text string")


def whole_texts(spark: SparkSession) -> DataFrame:
    """Full licence texts, one template each, as :func:`template_table` has them."""
    texts = sorted((f for f in resources("kuronuri.llm").joinpath("licence_texts").iterdir()
                    if f.name.endswith(".txt")), key=lambda f: f.name)
    return template_table(spark, [(f.name[:-4], f.read_text(encoding="utf-8")) for f in texts])


def unwrapped(files: DataFrame) -> DataFrame:
    """``file, n, passage`` of files that are no licence files, over line ends and comment marks."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    line = F.regexp_replace("text", WRAP, " ")
    parts = F.when(~name.rlike(LICENCE_FILE) & F.col("text").rlike(TELLING),
                   F.regexp_extract_all(line, F.lit(FROM_TOLD), F.lit(1)))
    return files.select("file", F.posexplode(parts).alias("n", "passage"))


def match_texts(parts: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """``file, license, similarity`` as :func:`match_templates`, for longer texts.

    A word counts ``1 + ln(tf)`` times, so that common words do not rule, and its weight comes from the
    templates, so that an answer does not depend on other files.
    """
    told = templates.select("template", "license", F.explode(_tokens(F.col("text"))).alias("w"))
    damped = (1 + F.log(F.count("*"))).alias("tf")
    theirs = told.groupBy("template", "license", "w").agg(damped)
    idf = theirs.groupBy("w").agg(F.count("*").alias("df")).crossJoin(
        templates.agg(F.count("*").alias("total"))).select(
        "w", (F.log((1.0 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))
    weight = F.col("tf") * F.col("idf")
    theirs = theirs.join(idf, "w").select("template", "license", "w", weight.alias("tw"))
    length = theirs.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"))
    own = stored(
        parts.select("file", "n", F.explode(_tokens(F.col("passage"))).alias("w")).join(idf, "w")
        .groupBy("file", "n", "w", "idf").agg(damped).select("file", "n", "w", weight.alias("pw")), "tf")
    norm = own.groupBy("file", "n").agg(F.sqrt(F.sum(F.col("pw") * F.col("pw"))).alias("pn"))
    near = (
        own.join(theirs.join(length, "template"), "w")
        .groupBy("file", "n", "template", "license", "tn")
        .agg(F.sum(F.col("pw") * F.col("tw")).alias("dot")).join(norm, ["file", "n"])
        .select("file", "license",
                F.round(F.col("dot") / (F.col("tn") * F.col("pn")), 9).alias("similarity")))
    return near.where(F.col("similarity") >= least).groupBy("file").agg(
        F.min_by(F.struct("license", "similarity"), F.struct(-F.col("similarity"), "license"))
        .alias("m")).select("file", "m.license", "m.similarity")


def passages(files: DataFrame) -> DataFrame:
    """``file, n, passage``: what files say of licences, by whole texts.

    A licence file is one passage; other files have one for each place where a telling word stands.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    parts = F.when(name.rlike(LICENCE_FILE), F.array("text")).when(
        F.col("text").rlike(TELLING), F.regexp_extract_all("text", F.lit(PASSAGE), F.lit(0)))
    return files.select("file", F.posexplode(parts).alias("n", "passage"))


def match_templates(parts: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """``file, license, similarity``: the best template of each file, if it is like enough.

    Vectors are sparse: they hold words of templates only, weighed by ``tf * idf`` with frequencies
    over all passages of all files.  Of equal cosines the licence first by name wins.
    """
    words = parts.select("file", "n", F.explode(_tokens(F.col("passage"))).alias("w"))
    told = templates.select("template", "license", F.explode(_tokens(F.col("text"))).alias("w"))
    known = told.select("w").distinct()
    tf = stored(words.join(known, "w").groupBy("file", "n", "w").agg(F.count("*").alias("tf")), "tf")
    total = parts.count()
    idf = known.join(tf.groupBy("w").agg(F.count("*").alias("df")), "w", "left").select(
        "w", (F.log(F.lit(1.0 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))
    weight = F.col("tf") * F.col("idf")
    theirs = told.groupBy("template", "license", "w").agg(F.count("*").alias("tf")).join(
        idf, "w").select("template", "license", "w", weight.alias("tw"))
    length = theirs.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"))
    theirs = theirs.join(length, "template")
    own = tf.join(idf, "w").select("file", "n", "w", weight.alias("pw"))
    norm = own.groupBy("file", "n").agg(F.sqrt(F.sum(F.col("pw") * F.col("pw"))).alias("pn"))
    near = (
        own.join(theirs, "w").groupBy("file", "n", "template", "license", "tn")
        .agg(F.sum(F.col("pw") * F.col("tw")).alias("dot")).join(norm, ["file", "n"])
        .select("file", "license",
                F.round(F.col("dot") / (F.col("tn") * F.col("pn")), 9).alias("similarity")))
    return near.where(F.col("similarity") >= least).groupBy("file").agg(
        F.min_by(F.struct("license", "similarity"), F.struct(-F.col("similarity"), "license"))
        .alias("m")).select("file", "m.license", "m.similarity")


def scan_licenses(files: DataFrame, templates: DataFrame | None = None,
                  least: float = LEAST) -> DataFrame:
    """``doc_id, path, license, similarity, inherited_from`` for every row of ``files``.

    ``license`` is what the text says, else what the licence file in the nearest directory above
    says (``inherited_from``: that directory; of several files there the most similar one, then the first
    by path), else null.  Null text is empty; a null path is at the top and is no licence file; rows that repeat
    stay, each with its answer.  Where no notice answers, licence files are compared to whole licence texts
    and other files to standard headers over line ends, unless ``templates`` are given.  Other columns are left out; an empty table gives no rows.
    """
    rows = files.select("doc_id", "path", F.coalesce("text", F.lit("")).alias("text"))
    # A file is told by its path and text, so that rows that repeat are read once.
    marked = rows.withColumn("file", F.xxhash64(F.coalesce("path", F.lit("")), "text"))
    wanted = marked.withColumn("path", F.coalesce("path", F.lit("")))
    parts = stored(passages(wanted).dropDuplicates(["file", "n"]), "passages")
    own = stored(match_templates(
        parts, template_table(files.sparkSession) if templates is None else templates, least), "own")
    if templates is None:
        # What no notice tells: whole licence texts, and headers over several lines.  Passages are cut
        # where the files are read, so that no other text moves.
        name = F.regexp_extract("path", r"([^/]*)$", 1)
        whole = wanted.where(name.rlike(LICENCE_FILE)).join(own, "file", "left_anti").select(
            "file", F.lit(0).alias("n"), F.col("text").alias("passage")).dropDuplicates(["file"])
        headers = stored(unwrapped(wanted), "headers").join(own, "file", "left_anti").dropDuplicates(
            ["file", "n"])
        own = own.union(match_texts(whole, whole_texts(files.sparkSession), least)).union(
            match_texts(headers, template_table(files.sparkSession, HEADERS), least))
    placed = marked.select("doc_id", "path", "file", directory(F.coalesce("path", F.lit("")))
                           .alias("dir")).join(own, "file", "left")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    said = placed.where(F.col("license").isNotNull() & name.rlike(LICENCE_FILE)).groupBy(
        F.col("dir").alias("above")).agg(
        F.min_by("license", F.struct(-F.col("similarity"), "path")).alias("from_above"))
    # Directories, not files, go up the path, so that a crowded one costs no more than any.
    dirs = placed.where(F.col("license").isNull()).select("dir").distinct()
    steps = F.split("dir", "/")
    ups = dirs.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(steps)))).withColumn(
        "above", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/"))
    nearest = ups.join(said, "above").groupBy(F.col("dir").alias("of")).agg(
        F.max_by(F.struct("above", "from_above"), "depth").alias("m"))
    return placed.join(nearest, F.col("dir") == F.col("of"), "left").select(
        "doc_id", "path", F.coalesce("license", F.col("m.from_above")).alias("license"), "similarity",
        F.when(F.col("license").isNull(), F.col("m.above")).alias("inherited_from"))
