"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.
DataFrame expressions only.

There are two collections of templates: notices of a sentence (short), and standard headers and whole licence texts (full).
The latter are kept as counts of their terms, made from the public texts, in license_terms.json.

Every whole text is cut into statements (lines, and sentences within lines) and paragraphs (lines between blank ones,
joined, without comment marks); these and the text as a whole are the units that are compared with the short templates,
wherever they stand. Paragraphs and texts as a whole are compared with the full ones, too. A unit's terms are weighed by
1 + ln(frequency) times the inverse document frequency that the collection gives; a term of no template has that of no
occurrence. The unit and template of the greatest cosine, at least THRESHOLD, give the file its license; they must have
more than one term in common, not all of them ordinary words.

A licence file of its directory is a file with a license that is named like one, or whose text as a whole reaches
THRESHOLD: it says nothing else. A file without a license of its own takes that of the nearest directory at or above its
own that has a licence file.

Units are shuffled only where they can reach THRESHOLD. Against short templates: they hold one of the templates' terms that
is no ordinary word, and the part of their weight that lies on terms of templates is large enough (a cosine is at most
that part's norm over the whole norm). Both lose nothing. Against full templates, a unit must hold one of the words that
licences call themselves by (MARKS), as every full template does.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmesh.llm.frame import cut, table

THRESHOLD = 0.6
#: Similarities are rounded to 6 digits; bounds leave room for that.
SLACK = 1e-6
NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.\-_].*)?$"
MARKS = "(?i)licen[cs]|copyright|permission|warrant"
COMMENT = r"\n[\x20\x09]*(//+|/?\*+/?|#+|--+|;+|%+|<!--)[\x20\x09]*"
BLANK = r"(\n[\x20\x09\r]*){2,}"
#: Ordinary words. They weigh like any other term, but to have none but these in common is no likeness.
ORDINARY = frozenset("a about all an and any are as at be by can copy except file files following for form forms free from has have in is it its law may no not of on or other person possible provided subject that the this to under use used version with without work you your".split())
Templates = dict[str, tuple[str, ...]]
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.", "SPDX-License-Identifier: GPL-3.0"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
}




def terms(text: str) -> list[str]:
    """Runs of a-z, 0-9 and inner points, lower-cased; the twin of the expression in _clean()."""
    return [t for t in re.sub(r"\.+( |$)", r"\1", re.sub(r"[^a-z0-9.]+", " ", text.lower())).split(" ") if t]


class Collection:
    """Templates, as bags of terms, made unit vectors: names and weights by template, inverse frequencies by term. Core
    terms are those that are no ordinary words."""

    def __init__(self, bags: list[tuple[str, dict[str, int]]], threshold: float = 0.0) -> None:
        rows = sorted(bags, key=lambda r: (r[0], sorted(r[1].items())))
        self.names, n = [name for name, _ in rows], len(rows)
        seen = Counter(t for _, b in rows for t in b)
        self.idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in sorted(seen.items())}
        self.unseen = math.log(1 + n) + 1
        self.vectors: list[dict[str, float]] = []
        for _, b in rows:
            raw = {t: (1 + math.log(k)) * self.idf[t] for t, k in sorted(b.items())}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            self.vectors.append({t: x / norm for t, x in raw.items()})
        self.least = max(threshold - SLACK, 0.0) ** 2
        self.core = sorted(set(self.idf) - ORDINARY)

    def core_pattern(self) -> str:
        return "(?i)(^|[^a-z0-9])(" + "|".join(re.escape(t) for t in self.core) + ")([^a-z0-9]|$)"


def _made(notices: Templates | None, threshold: float) -> tuple[Collection, Collection]:
    """The collections of short and of full templates; with notices given, these are the short ones and there are no full
    ones."""
    kept = json.loads(Path(__file__).with_name("license_terms.json").read_text())
    short = [(name, Counter(terms(t))) for name, texts in (notices or NOTICES).items() for t in texts]
    if notices:
        return Collection(short, threshold), Collection([])
    return Collection(short, threshold), Collection([(n, b) for n, b in (*kept["headers"], *kept["texts"])])


def within_reach(words: Column, known: Column, made: Collection) -> Column:
    """Whether the part of a unit's squared norm on terms of templates allows the threshold. known: the terms of templates
    among the words, once each. First with each other term counted once, which takes no pass over sorted words and holds
    for every unit that the exact sums hold for; then exactly."""
    idf = F.create_map(*[F.lit(x) for pair in made.idf.items() for x in pair])

    def weight(n: Column) -> Column:
        return F.when(n > 0, (1 + F.log(n)) * (1 + F.log(n))).otherwise(F.lit(0.0))

    def add(a: Column, t: Column) -> Column:
        found = F.try_element_at(idf, t)
        w = F.coalesce(found, F.lit(made.unseen))
        run = F.when(t == a["t"], a["run"]).otherwise(F.lit(0.0))
        more = w * w * (weight(run + 1) - weight(run))
        return F.struct(t.alias("t"), (run + 1).alias("run"), (a["all"] + more).alias("all"), (a["part"] + F.when(found.isNotNull(), more).otherwise(F.lit(0.0))).alias("part"))

    def fits(a: Column) -> Column:
        return a["part"] * F.lit(1 + 1e-9) >= F.lit(made.least) * a["all"]  # a hair's breadth for sums in another order

    def count(t: Column) -> Column:
        return (F.size(words) - F.size(F.array_remove(words, t))).cast("double")

    others = F.size(F.array_distinct(words)) - F.size(known)
    part = lambda a, t: a + weight(count(t)) * F.pow(F.coalesce(F.try_element_at(idf, t), F.lit(0.0)), F.lit(2.0))
    roughly = F.aggregate(known, F.lit(0.0), part, lambda a: fits({"part": a, "all": a + F.lit(made.unseen**2) * others}))
    start = F.struct(F.lit("").alias("t"), F.lit(0.0).alias("run"), F.lit(0.0).alias("all"), F.lit(0.0).alias("part"))
    return roughly & F.aggregate(F.sort_array(words), start, add, fits)


def _clean(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9.]+", " "), r"\.+( |$)", "$1")
    return F.array_remove(F.split(plain, " "), "")


def _units(text: Column) -> Column:
    """Of a text (kind, at, unit): statements, then paragraphs of more than a line, then the whole."""
    unit = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x.alias("unit"))
    statements = F.split(F.regexp_replace(text, r"([.!?])[\x20\x09]+", "$1\n"), "[\r\n]+")
    bare = F.regexp_replace(F.concat(F.lit("\n"), text), COMMENT, "\n")
    paragraphs = F.transform(F.split(bare, BLANK), unit(1))
    return F.concat(F.transform(statements, unit(0)), F.filter(paragraphs, lambda p: F.instr(p["unit"], "\n") > 0), F.array(unit(2)(bare, F.lit(0))))


def _similar(units: DataFrame, made: Collection, threshold: float) -> DataFrame:
    """(path, hash, kind, at, k, similarity) of the units (path, hash, kind, at, words) that reach it. Units are shuffled
    once, as arrays of words; all that follows groups by unit and needs no other shuffle."""
    spark, unit = units.sparkSession, ["path", "hash", "kind", "at"]
    bags = units.repartition(*unit).select(*unit, F.explode_outer("words").alias("term")).where("term is not null")
    idf = F.broadcast(spark.createDataFrame(list(made.idf.items()), "term string, idf double"))
    vectors = F.broadcast(spark.createDataFrame([(t, k, w, t not in ORDINARY) for k, v in enumerate(made.vectors) for t, w in v.items()], "term string, k int, w double, telling boolean"))
    counts = bags.groupBy(*unit, "term").agg(F.count("*").alias("n"))
    weighed = counts.join(idf, "term", "left").withColumn("x", (1 + F.log(F.col("n"))) * F.coalesce("idf", F.lit(made.unseen)))
    norms = weighed.groupBy(*unit).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(vectors, "term").groupBy(*unit, "k").agg(F.sum(F.col("x") * F.col("w")).alias("dot"), F.count("*").alias("shared"), F.max("telling").alias("telling")).where("shared > 1 and telling")
    return dots.join(norms, unit).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("similarity") >= threshold).select(*unit, "k", "similarity")


def own_licenses(files: DataFrame, short: Collection, full: Collection, threshold: float) -> DataFrame:
    """(path, hash, license, similarity, whole) of files (path, hash, text) with a license of their own: that of the best
    unit; among equals, full texts after short templates, earlier units, then earlier templates first. whole: whether the
    text as a whole reaches the threshold."""
    spark = files.sparkSession
    names = F.broadcast(spark.createDataFrame([(0, i, n) for i, n in enumerate(short.names)] + [(1, i, n) for i, n in enumerate(full.names)], "full int, k int, license string"))
    # One row a text: rows that repeat path and text would only count their terms twice.
    marked = files.where(F.col("text").rlike(short.core_pattern()) | F.col("text").rlike(MARKS)).dropDuplicates(["path", "hash"])
    marked = cut(marked)
    unit = ["path", "hash", "kind", "at"]
    # explode_outer: of a plain explode Spark infers filters, and computes what is exploded once more for each of them.
    units = lambda texts: texts.select("path", "hash", F.explode_outer(_units(F.col("text"))).alias("u")).select("path", "hash", "u.*")
    words = units(marked.where(F.col("text").rlike(short.core_pattern()))).select(*unit, _clean(F.col("unit")).alias("words"))
    words = words.withColumn("known", F.array_intersect("words", F.array(*[F.lit(t) for t in short.idf])))
    # What two common terms, one of them a core term, and the reach ask for.
    held = (F.size("known") > 1) & F.arrays_overlap("known", F.array(*[F.lit(t) for t in short.core])) & within_reach(F.col("words"), F.col("known"), short)
    near_enough = words.select(*unit, F.explode_outer(F.when(held, F.array("words"))).alias("words")).where("words is not null")
    near = _similar(near_enough, short, threshold).withColumn("full", F.lit(0))
    if full.names:
        longer = units(marked.where(F.col("text").rlike(MARKS))).where((F.col("kind") > 0) & F.col("unit").rlike(MARKS))
        near = near.unionByName(_similar(longer.select(*unit, _clean(F.col("unit")).alias("words")), full, threshold).withColumn("full", F.lit(1)))
    key = F.struct("similarity", (-F.col("full")).alias("full"), (-F.col("kind")).alias("kind"), (-F.col("at")).alias("at"), (-F.col("k")).alias("k"))
    best = near.groupBy("path", "hash").agg(F.max(key).alias("b"), F.max(F.col("kind") == 2).alias("whole"))
    return best.select("path", "hash", "b.similarity", "whole", (-F.col("b.k")).alias("k"), (-F.col("b.full")).alias("full")).join(names, ["full", "k"]).drop("full", "k")


def scan(files: DataFrame, path: Column, text: str = "text", notices: Templates | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The files with path, license, similarity, via ('header', 'directory' or null) and license_dir, the directory that
    a license is inherited from.

    Null texts have no license of their own. Of several licence files in a directory the most similar counts, then that
    of the least path. A null path has no directory. Repeated rows are alike; an empty table gives no rows. Columns of
    the given table that are named like the new ones are replaced; its others are kept, whatever their names.
    """
    short, full = _made(notices, threshold)
    new = ("path", "license", "similarity", "via", "license_dir")
    kept = [c for c in files.columns if c not in new]
    # Columns of the caller's are held in one struct, so that none can clash with a name used here.
    held = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(1).alias("none"))
    rows = files.select(held.alias("__row"), path.alias("__path"), F.xxhash64(F.col(f"`{text}`")).alias("__hash"), F.col(f"`{text}`").alias("__text"))
    rows = rows.withColumn("__key", F.coalesce("__path", F.lit("")))
    own = own_licenses(rows.select(F.col("__key").alias("path"), F.col("__hash").alias("hash"), F.col("__text").alias("text")), short, full, threshold)
    own = cut(own.select(F.col("path").alias("__p"), F.col("hash").alias("__h"), F.col("license").alias("__own"), F.col("similarity").alias("__sim"), F.col("whole").alias("__whole")))
    rows = rows.drop("__text").join(own, (F.col("__key") == F.col("__p")) & (F.col("__hash") == F.col("__h")), "left").drop("__p", "__h")
    rows = rows.withColumn("__dir", F.when(F.instr("__path", "/") > 0, F.regexp_replace("__path", "/[^/]*$", "")))
    told = F.col("__whole") | F.element_at(F.split("__p", "/"), -1).rlike(NAMES)
    deep = own.where(told & (F.instr("__p", "/") > 0)).withColumn("__above", F.regexp_replace("__p", "/[^/]*$", ""))
    by_dir = deep.groupBy("__above").agg(F.min_by("__own", F.struct(-F.col("__sim"), F.col("__p"))).alias("__given"))
    dirs = rows.where("__dir is not null").select("__dir").distinct()
    parts = F.split("__dir", "/")
    ups = dirs.select("__dir", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("__depth")).withColumn("__above", F.array_join(F.slice(parts, 1, F.col("__depth")), "/"))
    nearest = cut(ups.join(by_dir, "__above").groupBy("__dir").agg(F.max_by(F.struct("__above", "__given"), "__depth").alias("__near")))
    joined = rows.join(nearest, "__dir", "left")
    has = F.col("__own").isNotNull()
    return joined.select(
        *[F.col("__row").getField(c).alias(c) for c in kept],
        F.col("__path").alias("path"),
        F.coalesce("__own", "__near.__given").alias("license"),
        F.col("__sim").alias("similarity"),
        F.when(has, "header").when(F.col("__near").isNotNull(), "directory").alias("via"),
        F.when(~has, F.col("__near.__above")).alias("license_dir"),
    )


def document_path() -> Column:
    """Documents as files: source / language / number."""
    return F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null doc_ids, sources and languages are named ``none`` in paths; null texts take their directory's license."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return scan(docs, document_path()).select("doc_id", "path", "license", "similarity", "via", "license_dir")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) if not isinstance(x, str) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


def op1_sql() -> str:
    """The same scan by brute force: every term of every unit that holds a core term, no bound on reach, any depth of
    directories. The templates come in as data."""
    short, full = _made(None, 0.0)
    core = _made(None, THRESHOLD)[0].core_pattern().replace("'", "''")
    idf = _values([(f, t, f"{x!r}") for f, made in enumerate((short, full)) for t, x in made.idf.items()])
    vectors = _values([(f, k, made.names[k], t, f"{x!r}") for f, made in enumerate((short, full)) for k, v in enumerate(made.vectors) for t, x in v.items()])
    ordinary = ", ".join(f"'{w}'" for w in sorted(ORDINARY))
    clean = r"string_split(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'), '\.+( |$)', '\1', 'g'), ' ')"
    return rf"""
WITH idf(f, t, x) AS MATERIALIZED (SELECT c0, c1, CAST(c2 AS DOUBLE) FROM (VALUES {idf}) v(c0, c1, c2)),
vec(f, k, name, t, w) AS MATERIALIZED (SELECT c0, c1, c2, c3, CAST(c4 AS DOUBLE) FROM (VALUES {vectors}) v(c0, c1, c2, c3, c4)),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS dir,
             coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || coalesce(CAST(doc_id AS VARCHAR), 'none') AS path,
             regexp_replace(chr(10) || text, '{COMMENT}', chr(10), 'g') AS bare,
             regexp_split_to_array(regexp_replace(text, '([.!?])[ 	]+', '' || chr(10), 'g'), '[
]+') AS parts FROM documents),
u AS (SELECT rid, 0 AS f, 0 AS kind, unnest(parts) AS s, generate_subscripts(parts, 1) - 1 AS pos FROM d WHERE regexp_matches(text, '{core}')
      UNION ALL SELECT * FROM (SELECT rid, 0, 1, unnest(regexp_split_to_array(bare, '{BLANK}')) AS s, generate_subscripts(regexp_split_to_array(bare, '{BLANK}'), 1) - 1 FROM d WHERE regexp_matches(text, '{core}')) WHERE contains(s, chr(10))
      UNION ALL SELECT rid, 0, 2, bare, 0 FROM d
      UNION ALL SELECT * FROM (SELECT rid, 1, 1, unnest(regexp_split_to_array(bare, '{BLANK}')) AS s, generate_subscripts(regexp_split_to_array(bare, '{BLANK}'), 1) - 1 FROM d WHERE regexp_matches(text, '{MARKS}')) WHERE contains(s, chr(10))
      UNION ALL SELECT rid, 1, 2, bare, 0 FROM d),
b AS (SELECT rid, f, kind, pos, unnest({clean}) AS t FROM u WHERE regexp_matches(s, CASE WHEN f = 1 THEN '{MARKS}' ELSE '{core}' END)),
x AS MATERIALIZED (SELECT rid, b.f, kind, pos, b.t, (1 + ln(count(*))) * coalesce(max(idf.x), CASE WHEN b.f = 0 THEN {short.unseen!r} ELSE {full.unseen!r} END) AS x
      FROM b LEFT JOIN idf ON b.t = idf.t AND b.f = idf.f WHERE b.t <> '' GROUP BY 1, 2, 3, 4, 5),
n AS (SELECT rid, f, kind, pos, sqrt(sum(x * x)) AS norm FROM x GROUP BY 1, 2, 3, 4),
c AS (SELECT x.rid, x.f, x.kind, x.pos, vec.k, any_value(vec.name) AS name, sum(x.x * vec.w) AS dot FROM x JOIN vec ON x.t = vec.t AND x.f = vec.f GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 1 AND bool_or(vec.t NOT IN ({ordinary}))),
o AS MATERIALIZED (SELECT rid, arg_max(struct_pack(sim := sim, name := name), (sim, -f, -kind, -pos, -k)) AS own, bool_or(kind = 2) AS whole
      FROM (SELECT c.*, round(dot / norm, 6) AS sim FROM c JOIN n USING (rid, f, kind, pos)) WHERE sim >= {THRESHOLD} GROUP BY 1),
g AS (SELECT d.dir AS above, arg_min(o.own.name, (-o.own.sim, d.path)) AS given FROM d JOIN o USING (rid) WHERE o.whole GROUP BY 1),
p AS (SELECT dir, depth, array_to_string(list_slice(string_split(dir, '/'), 1, depth), '/') AS above FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS depth FROM (SELECT DISTINCT dir FROM d))),
near AS (SELECT dir, arg_max(above, depth) AS above, arg_max(given, depth) AS given FROM p JOIN g USING (above) GROUP BY 1)
SELECT d.doc_id, d.path, coalesce(o.own.name, near.given) AS license, o.own.sim AS similarity,
       CASE WHEN o.rid IS NOT NULL THEN 'header' WHEN near.given IS NOT NULL THEN 'directory' END AS via,
       CASE WHEN o.rid IS NULL THEN near.above END AS license_dir
FROM d LEFT JOIN o USING (rid) LEFT JOIN near USING (dir)
"""
