r"""License scans: MinHash bands over overlapping word windows, then exact containment; no Python.

Words are runs of ``[a-z0-9]`` after ASCII lower-casing, shingles five words.  Windows
are two strides long and overlap by one, a stride being the longest template, so every
copy of a template lies whole in some window.  A window is reduced to the shingles that
occur in any template, and windows that keep none are gone before the first shuffle.

Templates form classes by the doubling of their number of shingles, and a window's set for a
class holds the class's shingles alone.  A band is one MinHash value: the least hash of a set
under the band's own hash function, so a window and a template of similarity ``j`` share a
band with probability ``j``.  A window that contains enough of a template has at least the ``j``
that follows from the smallest template of the class, what a match may lack, and the most
shingles a window can hold of the class; a class has as many bands as make the chance
that such a window shares none at most ``MISS``.  Pairs of window and license that share a band
are retrieved, and only they are verified, by counting the template's distinct shingles in the
window.

Defined cases: a null or wordless text matches nothing, templates under five words can't
be matched, without templates there is no result, rows that repeat id and text count once, a
null id is kept, ties go to the earliest window; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsift.llm.common import ascii_lower, scratch, stored

SHINGLE = 5
MIN_CONTAINMENT = 0.8
#: The most that the chance of losing a match in the bands may be.
MISS = 1e-9
#: Template shingles up to this number are looked up in the scan, more are joined.
LITERALS = 4096
KEY = ("doc_id", "text_key", "window")

# FIXED VALUES: sentences of public license notices, by SPDX-like name.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                    "following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                      "License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                "documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), "[^a-z0-9]+", -1), lambda w: w != "")


def shingle_hashes(hashed_words: Column) -> Column:
    """Hash of every run of five words, from the words' hashes; shorter texts have none."""
    whole = F.slice(hashed_words, F.lit(1), F.greatest(F.size(hashed_words) - (SHINGLE - 1), F.lit(0)))
    return F.transform(whole, lambda first, i: F.xxhash64(first, *[F.get(hashed_words, i + k) for k in range(1, SHINGLE)]))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles_of(text: Column) -> Column:
    return once(F.transform(words(text), lambda w: F.xxhash64(w)), shingle_hashes)


def classes(shingles: DataFrame, window_shingles: int, min_containment: float, miss: float = MISS) -> DataFrame:
    """``license, whole, cls, bands``: each template's shingles, its class and the number of bands of that class."""
    whole = shingles.groupBy("license").agg(F.array_sort(F.collect_set("shingle")).alias("whole"))
    n = F.size("whole")
    whole = whole.withColumn("cls", F.floor(F.log2(n)).cast("int"))
    most = whole.select("cls", F.explode("whole").alias("shingle")).groupBy("cls").agg(F.count_distinct("shingle").alias("universe"))
    need = F.greatest(F.ceil(n * F.lit(float(min_containment)) - 1e-9), F.lit(1))  # fewer shingles are no match
    held = F.least(F.col("universe"), F.lit(window_shingles))
    least = whole.join(most, "cls").groupBy("cls").agg(F.min(F.least(need / (n + held - need), F.lit(1.0))).alias("j"))
    bands = F.when(F.col("j") < 1, F.ceil(F.log(F.lit(miss)) / F.log1p(-F.col("j")))).otherwise(1)
    return whole.join(least.select("cls", bands.cast("int").alias("bands")), "cls")


def banded(rows: DataFrame, whole: str, *keep: str) -> DataFrame:
    """``keep, cls, band, value``: one MinHash value of the set ``whole`` per band."""
    values = F.transform(F.sequence(F.lit(0), F.col("bands") - 1), lambda band: F.array_min(F.transform(whole, lambda s: F.xxhash64(s, band))))
    return rows.select(*keep, "cls", F.posexplode(values).alias("band", "value"))


def retrieve(windows: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of window and license that share a band; ``windows`` has a row per shingle, ``known`` is what ``classes`` gives."""
    universe = known.select("cls", "bands", F.explode("whole").alias("shingle")).distinct()
    sets = windows.join(universe, "shingle").groupBy(*KEY, "cls", "bands").agg(F.collect_set("shingle").alias("held"))  # a window's shingles at most
    return banded(sets, "held", *KEY).join(banded(known, "whole", "license"), ["cls", "band", "value"]).select(*KEY, "license").distinct()


def count(windows: DataFrame, retrieved: DataFrame, shingles: DataFrame) -> DataFrame:
    """Distinct shingles and first place of each retrieved pair; other pairs are not counted."""
    right = retrieved.select(*[F.col(c).alias(f"r_{c}") for c in KEY], "license")
    same = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in KEY]
    return (windows.join(right, same).join(shingles, ["license", "shingle"]).groupBy(*KEY, "license")
            .agg(F.count_distinct("shingle").alias("n_matched"), F.min("pos").cast("long").alias("first_word")))


def template_table(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, int]:
    """Shingles of the templates, and the longest template in words."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, template string")
    longest = rows.agg(F.max(F.size(words(F.col("template"))))).first()[0]  # one number
    shingles = rows.select("license", F.explode(F.array_distinct(shingles_of(F.col("template")))).alias("shingle"))
    return shingles, longest or SHINGLE


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """``doc_id, license, n_matched, n_shingles, containment, first_word``: the best window per document and license."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    shingles, stride = template_table(spark, TEMPLATES if templates is None else templates)
    known = stored(classes(shingles, 2 * stride - (SHINGLE - 1), min_containment), folder, "classes")
    universe = [r["shingle"] for r in shingles.select("shingle").distinct().limit(LITERALS + 1).collect()]  # a bounded number
    placed = F.transform(shingles_of(F.col("text")), lambda h, i: F.struct(i.alias("pos"), h.alias("shingle")))
    if 0 < len(universe) <= LITERALS:
        placed = F.filter(placed, lambda s: s["shingle"].isin(*sorted(universe)))
    # the outer form keeps the planner from testing for empty arrays first, which would hash every text twice
    hits = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.inline_outer(placed)).filter(F.col("pos").isNotNull())
    if not 0 < len(universe) <= LITERALS:
        hits = hits.join(shingles.select("shingle").distinct(), "shingle", "left_semi")
    home = F.floor(F.col("pos") / stride).cast("long")
    windows = hits.select("doc_id", "text_key", "pos", "shingle", F.explode(F.array(home, home - 1)).alias("window")).filter("window >= 0")
    windows = stored(windows, folder, "windows")

    sizes = shingles.groupBy("license").agg(F.count("*").alias("n_shingles"))
    verified = count(windows, retrieve(windows, known), shingles).join(sizes, "license")
    containment = F.col("n_matched") / F.col("n_shingles")
    verified = verified.withColumn("containment", containment).filter(F.col("containment") >= min_containment)
    best = F.max(F.struct("n_matched", (-F.col("window")).alias("early"), "first_word", "containment", "n_shingles"))
    return verified.groupBy("doc_id", "text_key", "license").agg(best.alias("best")).select(
        "doc_id", "license", "best.n_matched", "best.n_shingles", "best.containment", "best.first_word")


def _literals() -> str:
    return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))


def _sql_words(x: str) -> str:
    low = f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({low}, '[a-z0-9]+')"


ORACLE = f"""
with t as (select license, {_sql_words('template')} as w from (values {_literals()}) v(license, template)),
ts as (select distinct license, array_to_string(w[i:i+4], ' ') as shingle from (select license, w, unnest(range(1, len(w) - 3)) as i from t)),
size as (select license, count(*) as n_shingles from ts group by license),
stride as (select max(len(w)) as n from t),
d as (select distinct doc_id, text, {_sql_words('text')} as w from documents),
ds as (select doc_id, text, i - 1 as pos, array_to_string(w[i:i+4], ' ') as shingle from (select *, unnest(range(1, len(w) - 3)) as i from d)),
h as (select doc_id, text, pos, shingle, license from ds join ts using (shingle)),
win as (select *, pos // n as wi from h, stride union all select *, pos // n - 1 from h, stride),
c as (select doc_id, text, license, wi, count(distinct shingle) as n_matched, min(pos) as first_word from win where wi >= 0 group by all),
v as (select *, row_number() over (partition by doc_id, text, license order by n_matched desc, wi) as r from c join size using (license)
  where n_matched / n_shingles >= 0.8)
select doc_id, license, n_matched, n_shingles, n_matched / n_shingles as containment, cast(first_word as bigint) as first_word from v where r = 1
"""
