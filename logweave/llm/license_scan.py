"""Licence scans in DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance along directories.

1. Candidate headers are the lines that hold a cue word and, whatever the line breaks, the runs of words that stand to an
   anchor word as in one of the notices (``places``); whole texts that hold an anchor are candidate licence files.
2. Each candidate's terms and every template's terms are weighted ``tf * idf`` and met in a sparse join on the term; the
   cosine decides the best template. Headers meet the notices (idf over all candidate lines and notices; runs overlap
   with lines and aren't counted), whole texts meet the whole licences (idf over all candidate texts and licences).
3. A document takes the whole licence it is near to, if at least half of its words are words of that licence, else the
   best header of its own.  A document that is a licence file (near to a whole licence, or its best header holds at least
   half of its words) licenses its directory; one without a licence of its own inherits from the nearest ancestor
   directory that has one, found by joining the path's ancestors with the licensed directories.

The template tables are fixed and small (their size is known), so they are the broadcast side; the directory table is not
hinted. No row pairs documents with documents.

Rows are told apart by a hash of key, text and path, so null and shared keys keep their own licences.
Defined results: null texts have no lines; null or empty paths have no directory and inherit nothing; equal scores take the
template first in alphabetical order; two licence files of one directory: the one with the higher score, then the smaller
path; repeated rows give one row each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.rows import row_hash
from logweave.plans.session import written

#: Licence notices by SPDX-like name.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following two conditions are met.", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "Proprietary": ("All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}
CUES = "licen[cs]e|licensed|copyright|spdx|permission is hereby|redistribution and use|public domain|all rights reserved|proprietary"

#: Single words of the cues: every notice is placed in a text by its first one.
ANCHORS = "licen[cs]e|copyright|spdx|proprietary|permission|redistribution|domain|reserved"
#: Whole licences by the same names, as they are published; read on the driver.
WHOLE: dict[str, tuple[str, ...]] = {f.stem: (f.read_text(encoding="utf-8"),) for f in sorted(Path(__file__).with_name("licences").glob("*.txt"))}


def places(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, int, int]]:
    """``(anchor, words before it, words)`` of all notices."""
    out = set()
    for notice in (t for texts in templates.values() for t in texts):
        words = re.sub(r"[^\w.]+|_|\.(?!\d)|(?<!\d)\.", " ", notice.lower()).split()
        first = next(((i, m[0]) for i, w in enumerate(words) if (m := re.search(ANCHORS, w))), None)
        if first:
            out.add((first[1].replace("licence", "license"), first[0], len(words)))
    return sorted(out)


def _terms(line: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}.]+|\.(?!\d)|(?<!\d)\.", " "), " +"), "")


def template_terms(spark: SparkSession, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``template, license, term, tf``: one row for each term of each notice."""
    rows = [(i, name, text) for i, (name, text) in enumerate((n, t) for n, texts in (templates or TEMPLATES).items() for t in texts)]
    values = ", ".join("({}, '{}', '{}')".format(i, n.replace("'", "''"), re.sub(r"['\\\\]", " ", t)) for i, n, t in rows)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, license, notice)")
    return table.select("template", "license", F.explode(_terms(F.col("notice"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))


def _best(found: DataFrame, templates: dict[str, tuple[str, ...]], least: float) -> DataFrame:
    """``id, license, score, n_words, n_known``: the best template of every candidate of ``found(id, line, times)``, if its cosine is at least ``least``."""
    marks = template_terms(found.sparkSession, templates)
    terms = found.select("id", "times", F.explode(_terms(F.col("line"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("times").alias("times"))
    n_templates = sum(map(len, templates.values()))
    total = found.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("lines"))
    seen = terms.groupBy("term").agg(F.sum("times").alias("df"))
    own = marks.groupBy("term").agg(F.count("*").alias("own"))
    # Terms that no template knows count in a line's norm with the weight of a common word.
    known = own.join(seen, "term", "left").select("term", (F.coalesce("df", F.lit(0)) + F.col("own")).alias("df"))
    weights = known.join(F.broadcast(total), F.lit(True)).select("term", (1 + F.log((F.col("lines") + n_templates + 1) / (F.col("df") + 1))).alias("idf"))
    template = marks.join(weights, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = template.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    side = F.broadcast(template.join(norms, "template").select("template", "license", "term", (F.col("w") / F.col("norm")).alias("tw")))
    weighed = terms.join(F.broadcast(weights), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    line_norm = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("n_words"))
    dots = weighed.join(side, "term").groupBy("id", "license", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"), F.sum("tf").alias("n_known"))
    scored = dots.join(line_norm, "id").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= least)
    best = scored.groupBy("id").agg(F.min_by(F.struct("license", "score", "n_words", "n_known"), F.struct(-F.col("score"), F.col("license"))).alias("b"))
    return best.select("id", "b.*")


def _candidates(docs: DataFrame, key: str, text: str, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """``k, line, times``: distinct candidates of each document; runs of words count no time, as they overlap with lines."""
    anchored = docs.where(F.lower(text).rlike(ANCHORS)).select(F.col(key).alias("k"), F.col(text).alias("body"))
    each = F.explode(F.array_distinct(F.filter(F.split("body", r"\n"), lambda x: F.lower(x).rlike(CUES))))
    lines = anchored.select("k", each.alias("raw")).select("k", F.trim("raw").alias("line"), F.lit(1).alias("times"))
    kinds = F.array(*[F.struct(F.lit(a).alias("anchor"), F.lit(o).alias("before"), F.lit(n).alias("n")) for a, o, n in places(templates)])
    words = anchored.select("k", _terms(F.col("body")).alias("words"))
    anchor = lambda w: F.regexp_replace(F.regexp_extract(w, ANCHORS, 0), "licence", "license")
    marked = words.select("k", "words", F.filter(F.transform("words", lambda w, i: F.struct(anchor(w).alias("anchor"), i.alias("at"))), lambda x: x["anchor"] != "").alias("found"))

    def run(x: Column, p: Column) -> Column:
        start = F.greatest(x["at"] - p["before"], F.lit(0))
        return F.array_join(F.slice(F.col("words"), start + 1, x["at"] - p["before"] + p["n"] - start), " ")

    runs = F.flatten(F.transform("found", lambda x: F.transform(F.filter(kinds, lambda p: p["anchor"] == x["anchor"]), lambda p: run(x, p))))
    return lines.unionByName(marked.select("k", F.explode(F.array_distinct(runs)).alias("line"), F.lit(0).alias("times")))


def _matched(candidates: DataFrame, templates: dict[str, tuple[str, ...]], least: float) -> DataFrame:
    """``k`` and the columns of ``_best`` for each of ``candidates(k, line, times)`` that is near to a template; equal lines are scored once."""
    kept = written(candidates.withColumn("id", F.md5(F.col("line").cast("binary"))), "license-candidates")
    found = written(kept.groupBy("id").agg(F.first("line").alias("line"), F.sum("times").alias("times")), "license-lines")
    return kept.select("k", "id").join(_best(found, templates, least), "id")


def scan(docs: DataFrame, path: Column, key: str = "doc_id", text: str = "text", least: float = 0.6, templates: dict[str, tuple[str, ...]] | None = None, whole: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per document: ``key, path, license, score, via`` (``header``, ``inherited`` or ``none``) and ``licensed_dir``."""
    notices = templates or TEMPLATES
    row = row_hash(key, text, path)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), path.alias("path"), row.alias("k"))
    anchored = F.lower("text").rlike(ANCHORS)
    headers = _matched(_candidates(docs, "k", "text", notices), notices, least).select("k", F.lit(0).alias("whole"), "license", "score", "n_words")
    bodies = docs.where(anchored).select("k", F.col("text").alias("line"), F.lit(1).alias("times"))
    files = _matched(bodies, whole or WHOLE, least).where("2 * n_known >= n_words").select("k", F.lit(1).alias("whole"), "license", "score", "n_words")
    order = F.struct(-F.col("whole"), -F.col("score"), F.col("license"), -F.col("n_words"))
    heads = headers.unionByName(files).groupBy("k").agg(F.min_by(F.struct("license", "score", "n_words"), order).alias("own"))
    size = F.when(anchored, F.size(_terms(F.col("text"))))
    rows = docs.select("key", "k", "path", size.alias("size")).join(heads, "k", "left")
    parts = F.split(F.col("path"), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    ancestors = F.when(F.size(parts) > 1, up).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("ancestors", F.coalesce(ancestors, F.array().cast("array<string>")))
    files = rows.where(F.col("own").isNotNull() & (2 * F.col("own.n_words") >= F.col("size")) & (F.size("ancestors") > 0))
    folders = files.groupBy(F.try_element_at("ancestors", F.lit(-1)).alias("dir")).agg(F.min_by(F.col("own.license"), F.struct(-F.col("own.score"), F.col("path"))).alias("dir_license"), F.max("own.score").alias("dir_score"))
    # Directories of documents are few for each directory name: the nearest licensed ancestor is found once for each.
    dirs = rows.where(F.size("ancestors") > 0).select(F.try_element_at("ancestors", F.lit(-1)).alias("at"), "ancestors").groupBy("at").agg(F.first("ancestors").alias("ancestors"))
    nearest = dirs.select("at", F.posexplode("ancestors").alias("depth", "dir")).join(folders, "dir").groupBy("at").agg(F.max_by(F.struct("dir", "dir_license", "dir_score"), "depth").alias("up"))
    rows = rows.withColumn("at", F.when(F.size("ancestors") > 0, F.try_element_at("ancestors", F.lit(-1)))).join(nearest, "at", "left")
    return rows.select(
        F.col("key").alias(key),
        "path",
        F.coalesce("own.license", "up.dir_license").alias("license"),
        F.coalesce("own.score", "up.dir_score").alias("score"),
        F.when(F.col("own").isNotNull(), "header").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("via"),
        F.when(F.col("own").isNull(), F.col("up.dir")).alias("licensed_dir"),
    )
