"""Licence scans in DataFrame operations only: TF-IDF cosine of lines, headers and whole files to templates, then inheritance from directories."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import only
from .scratch import materialise

#: SPDX names that tags and titles are made for, with the titles of their texts.
TITLES = [
    ("MIT", "MIT License"), ("Apache-2.0", "Apache License Version 2.0"), ("GPL-3.0", "GNU General Public License Version 3"), ("GPL-2.0", "GNU General Public License Version 2"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3"), ("AGPL-3.0", "GNU Affero General Public License Version 3"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"), ("ISC", "ISC License"), ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"), ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
]
#: The notices, headers and licence texts that are looked for, by SPDX name (or all-rights-reserved).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("all-rights-reserved", "All rights reserved"),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *TITLES,
    *[(name, f"SPDX-License-Identifier: {name}") for name, _ in TITLES],
]
THRESHOLD = 0.7
#: Lines without a term part the blocks of a text.
GAP = "\\n[^a-z0-9]*\\n"


def terms(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), "[^a-z0-9]+"), "")


def _terms(line: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", line.lower()) if t]


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns, each computed once a row: what a generator makes is not computed again in filters that name it."""
    made = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return rows.select("*", made.alias("__made")).select(*rows.columns, "__made.*")


def units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __text, kind, pos, edge, terms) of what is compared with templates: each line, each block of several lines and each whole text of several blocks.

    ``edge`` marks what makes a file a licence file: its first or last line, its first block, its whole text.
    """
    held = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__text"), F.lower(text_col).alias("low"))
    lines = held.select("__id", "__text", F.split("low", "\n").alias("ls")).select("__id", "__text", F.size("ls").alias("n"), F.posexplode_outer("ls").alias("pos", "body"))
    lines = lines.select("__id", "__text", F.lit(0).alias("kind"), "pos", ((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1)).alias("edge"), "body")
    cut = held.filter(F.contains("low", F.lit("\n"))).select("__id", "__text", "low", F.split("low", GAP).alias("bs"))
    blocks = cut.select("__id", "__text", F.posexplode_outer("bs").alias("pos", "body")).filter(F.contains("body", F.lit("\n")))
    blocks = blocks.select("__id", "__text", F.lit(1).alias("kind"), "pos", (F.col("pos") == 0).alias("edge"), "body")
    whole = cut.filter(F.size("bs") > 1).select("__id", "__text", F.lit(2).alias("kind"), F.lit(0).alias("pos"), F.lit(True).alias("edge"), F.col("low").alias("body"))
    every = lines.unionByName(blocks).unionByName(whole)
    return once(every, terms=terms(F.col("body"))).drop("body").filter(F.size("terms") > 0)


def license_units(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __text, kind, pos, edge, license, score) of each of :func:`units` whose cosine to a template is at least ``threshold``; kind 0: line, 1: block, 2: text.

    Term weights are tf * idf with idf = ln((lines + 1) / (lines with the term +
    1)) + 1 over all lines that have a term, for every word. The best template wins, the first listed among
    equals. By Cauchy-Schwarz a unit can only reach the threshold if the terms
    it shares hold that share of a template's length, so units without any of
    a template's heaviest terms, or with fewer of its terms than its heaviest ones that would do, are not scored.
    """
    spark = docs.sparkSession
    names = TEMPLATES if templates is None else templates
    counts = [Counter(_terms(t)) for _, t in names]
    vocabulary = sorted(set().union(*counts))
    split = units(docs, id_col, text_col)
    every = split.filter("kind = 0").select(F.explode_outer(F.concat(F.array(F.lit("")), F.array_distinct("terms"))).alias("term"))  # "" counts the lines
    counted = materialise(every.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "terms")
    df = {r["term"]: r["n"] for r in counted.filter(F.col("term").isin(["", *vocabulary])).collect()}
    n = df.get("", 0)
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary}
    weights = [{t: c * idf[t] for t, c in own.items()} for own in counts]
    lengths = [math.sqrt(sum(w * w for w in own.values())) for own in weights]
    needed: set[str] = set()
    fewest: dict[int, list[tuple[str, ...]]] = {}
    for own, length in zip(weights, lengths, strict=True):
        light = 0.0
        for t, w in sorted(own.items(), key=lambda x: (x[1], x[0])):
            light += w * w
            if light >= threshold**2 * length**2 * (1 - 1e-9):
                needed.add(t)
        heavy, least = 0.0, 0
        for w in sorted(own.values(), reverse=True):
            if heavy < threshold**2 * length**2 * (1 - 1e-9):
                heavy, least = heavy + w * w, least + 1
        fewest.setdefault(least, []).append(tuple(sorted(own)))
    # a unit's words that templates have, few, are picked once; what follows looks at those only
    inner = once(split, inner=F.filter("terms", lambda t: t.isin(vocabulary))).filter(F.size("inner") >= min(fewest, default=0))
    few = once(inner, few=F.array_distinct("inner")).filter(F.arrays_overlap("few", F.array(*[F.lit(t) for t in sorted(needed)])))
    enough = [F.size(F.array_intersect("few", F.array(*[F.lit(t) for t in own]))) >= least for least, group in sorted(fewest.items()) for own in sorted(set(group))]
    candidates = few.filter(reduce(lambda a, b: a | b, enough, F.lit(False)))
    # first only the templates' words are counted; each other word weighs 1 at least, which bounds the cosine from above
    key = F.xxhash64(F.coalesce(F.col("__id").cast("string"), F.lit("")), "__text", "kind", "pos").alias("u")
    held = candidates.select(key, "__id", "__text", "kind", "pos", "edge", "terms", "inner")
    held = held.withColumn("others", F.size("terms") - F.size("inner"))
    tf = held.select("u", "__id", "__text", "kind", "pos", "edge", "others", F.explode("inner").alias("term")).groupBy("u", "__id", "__text", "kind", "pos", "edge", "others", "term").agg(F.count(F.lit(1)).alias("tf"))
    table = spark.createDataFrame([(t, idf[t], *[own.get(t, 0.0) for own in weights]) for t in vocabulary], "term string, idf double, " + ", ".join(f"t{i} double" for i in range(len(names))))
    weighed = tf.join(F.broadcast(table), "term").withColumn("w", F.col("tf") * F.col("idf"))
    dots = weighed.groupBy("u", "__id", "__text", "kind", "pos", "edge", "others").agg(F.sum(F.col("w") * F.col("w")).alias("mass"), *[F.sum(F.col("w") * F.col(f"t{i}")).alias(f"d{i}") for i in range(len(names))])
    most = F.greatest(*[F.col(f"d{i}") / length for i, length in enumerate(lengths)], F.lit(0.0))
    dots = materialise(dots.filter(most >= threshold * F.sqrt(F.col("mass") + F.col("others")) * (1 - 1e-6)), "bounded")
    # only the documents that have such a unit are cut again
    hashed = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col), F.xxhash64(text_col).alias("__text"))
    again = units(only(hashed, dots, "__text").drop("__text"), id_col, text_col).select(key, "terms")
    outer = only(again, dots, "u").join(dots.select("u").distinct(), "u").select("u", F.explode(F.filter("terms", lambda t: ~t.isin(vocabulary))).alias("term"))
    outer = materialise(outer.groupBy("u", "term").agg(F.count(F.lit(1)).alias("tf")), "outer")
    common = only(counted, outer, "term").select("term", (F.log(F.lit(n + 1.0) / (F.col("n") + 1)) + 1).alias("rarity"))
    rest = outer.join(common, "term").withColumn("w", F.col("tf") * F.col("rarity")).groupBy("u").agg(F.sum(F.col("w") * F.col("w")).alias("rest"))
    dots = dots.join(rest, "u", "left").withColumn("norm", F.sqrt(F.col("mass") + F.coalesce("rest", F.lit(0.0))))
    cosine = F.array(*[F.round(F.col(f"d{i}") / (F.col("norm") * length), 6) for i, length in enumerate(lengths)])
    scored = dots.select("__id", "__text", "kind", "pos", "edge", cosine.alias("cos")).withColumn("score", F.array_max("cos")).filter(F.col("score") >= threshold)
    place = F.array_position("cos", F.col("score")).cast("int")
    return scored.select("__id", "__text", "kind", "pos", "edge", F.element_at(F.array(*[F.lit(x) for x, _ in names]), place).alias("license"), "score")


def license_lines(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The single lines of :func:`license_units`."""
    return license_units(docs, templates, threshold, id_col, text_col).filter("kind = 0")


def license_scan(docs: DataFrame, path: Column, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, path, license, score, origin, license_dir) of each row of ``docs``.

    ``origin`` is ``own`` if a line of the text, a block of its lines or the whole text matches a template (the best
    wins; then the first template by name). Else it is
    ``inherited`` if the row's directory or an ancestor has a licence file, a
    file whose first or last line, first block or whole text matches: the nearest such directory counts, and in it
    the best score, then the smallest name. Else it is ``none`` with a null
    license and score. ``license_dir`` is the directory inherited from. Paths
    are split at "/"; the root directory is "". A null text has no line; a null
    path is in no directory. Rows that repeat are returned each; columns besides
    id, text and those of the path are not read. An empty table gives an empty
    result.
    """
    found = materialise(license_units(docs, templates, threshold, id_col, text_col), "licences")
    order = F.struct((-F.col("score")).alias("s"), "license")
    own = found.groupBy("__id", "__text").agg(F.min(order).alias("best")).select("__id", "__text", F.col("best.license").alias("own"), (-F.col("best.s")).alias("own_score"))
    places = docs.select(F.col(id_col).alias("__own_id"), F.xxhash64(text_col).alias("__own_text"), path.alias("path"))
    places = places.withColumn("dir", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit("")))
    same = F.col("__own_id").eqNullSafe(F.col("__id")) & (F.col("__own_text") == F.col("__text"))
    heads = found.filter("edge")
    declared = places.join(heads, same).filter("dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
    declared = materialise(declared.select(F.col("dir").alias("license_dir"), F.col("best.license").alias("theirs"), (-F.col("best.s")).alias("their_score")), "directories")
    parts = F.split("dir", "/")
    ancestors = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    dirs = places.select("dir").filter("dir is not null").distinct().select("dir", F.explode(ancestors).alias("license_dir"))
    nearest = dirs.join(declared, "license_dir").groupBy("dir").agg(F.max(F.struct(F.size(F.split("license_dir", "/")).alias("depth"), F.length("license_dir").alias("long"), "license_dir", "theirs", "their_score")).alias("near"))
    nearest = materialise(nearest.select("dir", "near.license_dir", "near.theirs", "near.their_score"), "nearest")
    whole = places.join(materialise(own, "own"), same, "left").join(nearest, "dir", "left")
    mine = F.col("own").isNotNull()
    return whole.select(
        F.col("__own_id").alias(id_col), "path", F.coalesce("own", "theirs").alias("license"), F.when(mine, F.col("own_score")).otherwise(F.col("their_score")).alias("score"),
        F.when(mine, "own").when(F.col("theirs").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(~mine, F.col("license_dir")).alias("license_dir"),
    )


def document_path(id_col: str = "doc_id", source_col: str = "source") -> Column:
    """Where a document of the corpus lies: source/thousand/name, or source/thousand/ten/name if its id doesn't end in 0."""
    number = F.col(id_col)
    top = F.concat_ws("/", F.coalesce(F.col(source_col), F.lit("none")), F.floor(number / 1000).cast("string"))
    return F.concat_ws("/", top, F.when(number % 10 != 0, F.floor(number / 10).cast("string")), F.concat(number.cast("string"), F.lit(".txt")))


def license_sql(threshold: float = THRESHOLD) -> str:
    """The scan of documents by :func:`document_path`, for DuckDB."""
    rows = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''").replace("\n", " ")) for i, (name, text) in enumerate(TEMPLATES))
    return f"""
WITH tpl(i, license, body) AS (VALUES {rows}),
     tt AS (SELECT i, license, term, count(*) AS tf FROM (SELECT i, license, unnest(string_split_regex(lower(body), '[^a-z0-9]+')) AS term FROM tpl) WHERE term <> '' GROUP BY ALL),
     low AS (SELECT doc_id, lower(text) AS t, string_split_regex(lower(text), '{GAP}') AS bs FROM documents WHERE text IS NOT NULL),
     lines AS (SELECT doc_id, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS pos, unnest(string_split(t, chr(10))) AS body, len(string_split(t, chr(10))) AS n FROM low),
     blocks AS (SELECT doc_id, generate_subscripts(bs, 1) - 1 AS pos, unnest(bs) AS body FROM low),
     units AS (SELECT doc_id, 0 AS kind, pos, pos = 0 OR pos = n - 1 AS edge, body FROM lines UNION ALL SELECT doc_id, 1, pos, pos = 0, body FROM blocks WHERE contains(body, chr(10)) UNION ALL SELECT doc_id, 2, 0, true, t FROM low WHERE len(bs) > 1),
     words AS MATERIALIZED (SELECT doc_id, kind, pos, edge, term, count(*) AS tf FROM (SELECT doc_id, kind, pos, edge, unnest(string_split_regex(body, '[^a-z0-9]+')) AS term FROM units) WHERE term <> '' GROUP BY ALL),
     total AS (SELECT count(*)::DOUBLE AS n FROM (SELECT DISTINCT doc_id, pos FROM words WHERE kind = 0)),
     idf AS MATERIALIZED (SELECT term, ln((SELECT n + 1 FROM total) / (sum(c) + 1)) + 1 AS idf FROM (SELECT term, 1 AS c FROM words WHERE kind = 0 UNION ALL SELECT DISTINCT term, 0 FROM tt) GROUP BY term),
     tw AS (SELECT i, license, term, tf * idf AS w FROM tt JOIN idf USING (term)),
     tn AS (SELECT i, license, sqrt(sum(w * w)) AS norm FROM tw GROUP BY ALL),
     ww AS (SELECT doc_id, kind, pos, edge, term, tf * idf AS w FROM words JOIN idf USING (term)),
     wn AS (SELECT doc_id, kind, pos, sqrt(sum(w * w)) AS norm FROM ww GROUP BY ALL),
     dots AS (SELECT doc_id, kind, pos, edge, i, license, sum(ww.w * tw.w) AS d FROM ww JOIN tw USING (term) GROUP BY ALL),
     cos AS (SELECT doc_id, kind, pos, edge, i, d.license, round(d / (wn.norm * tn.norm), 6) AS score FROM dots d JOIN wn USING (doc_id, kind, pos) JOIN tn USING (i)),
     found AS (SELECT doc_id, kind, pos, edge, arg_min(license, (-score, i)) AS license, max(score) AS score FROM cos GROUP BY ALL HAVING max(score) >= {threshold}),
     own AS (SELECT doc_id, arg_min(license, (-score, license)) AS own, max(score) AS own_score FROM found GROUP BY ALL),
     places AS (SELECT doc_id, concat_ws('/', source, CAST(doc_id // 1000 AS VARCHAR), CASE WHEN doc_id % 10 <> 0 THEN CAST(doc_id // 10 AS VARCHAR) END) AS dir,
                concat_ws('/', source, CAST(doc_id // 1000 AS VARCHAR), CASE WHEN doc_id % 10 <> 0 THEN CAST(doc_id // 10 AS VARCHAR) END, doc_id || '.txt') AS path FROM documents),
     declared AS (SELECT dir AS license_dir, arg_min(license, (-score, license)) AS theirs, max(score) AS their_score FROM places JOIN found USING (doc_id) WHERE edge GROUP BY ALL),
     near AS (SELECT p.dir, arg_max(license_dir, length(license_dir)) AS license_dir, arg_max(theirs, length(license_dir)) AS theirs, arg_max(their_score, length(license_dir)) AS their_score
              FROM (SELECT DISTINCT dir FROM places) p JOIN declared d ON p.dir = license_dir OR starts_with(p.dir, license_dir || '/') GROUP BY ALL)
SELECT doc_id, path, coalesce(own, theirs) AS license, CASE WHEN own IS NOT NULL THEN own_score ELSE their_score END AS score,
       CASE WHEN own IS NOT NULL THEN 'own' WHEN theirs IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN own IS NULL THEN license_dir END AS license_dir
FROM places LEFT JOIN own USING (doc_id) LEFT JOIN near USING (dir)"""
