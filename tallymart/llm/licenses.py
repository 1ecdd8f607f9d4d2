"""License scan: MinHash bands over overlapping windows find templates, containment confirms them.

Texts and templates are sets of hashed five-word shingles. A template with t distinct shingles belongs
to the class whose stride s is the smallest power of two not below t; windows of the class hold 2 s
shingles and start every s, so some window holds any unbroken copy of the template whole. If a window
holds the share x of the template, its Jaccard similarity to it is above x / (4 - x), and one of ``BANDS``
minimum hashes, each a band of its own, agrees with probability above 1 - (1 - x / (4 - x)) ** 64: about
1 - 1e-6 for 0.8, and 0.999 for the 0.4 of a copy that foreign words break in the middle. Windows that
agree in a band retrieve the template, and containment is then counted over the whole document.

A band can agree only where a window holds the very shingle that is the template's minimum. Windows
without such a shingle are not sketched; that changes no result. Everything is Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.functions.sizes import broadcast_if_small
from tallymart.functions.values import computed_once
from tallymart.llm import frames

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 64
LISTED = 4096

WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"

# Sentences that state a license.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def templates(spark: SparkSession) -> DataFrame:
    """The built-in templates as rows (template_id, license, text)."""
    rows = [(i, name, text) for i, (name, text) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template_id long, license string, text string")


def words(text: Column) -> Column:
    """Runs of letters and digits, A-Z lower-cased, and characters beyond ASCII."""
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def shingles(word_list: Column) -> Column:
    """The hash of each run of five words; none for shorter texts."""
    return F.when(
        F.size(word_list) >= SHINGLE,
        F.transform(
            F.sequence(F.lit(1), F.size(word_list) - (SHINGLE - 1)),
            lambda i: F.xxhash64(F.slice(word_list, i, SHINGLE)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def bands(held: Column) -> Column:
    """For each band the key of the smallest permuted shingle, and that shingle."""

    def band(k: Column) -> Column:
        least = F.array_min(F.transform(held, lambda h: F.struct(F.xxhash64(h, k).alias("p"), h.alias("h"))))
        return F.struct(F.xxhash64(k, least["p"]).alias("key"), least["h"].alias("h"))

    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), band)


def scan(
    docs: DataFrame,
    known: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    containment: float = CONTAINMENT,
) -> DataFrame:
    """Rows (doc_id, template_id, license, containment, first_word, span_words).

    One row for each document and template of which it holds the share ``containment`` or more, wherever
    its shingles stand; first_word and span_words span them all. ``known`` has template_id, license and
    text, any table of notices. Null, empty and short texts hold nothing; templates of fewer than five words
    find nothing; equal shares each give their row. Long texts are scanned whole, repeated rows each
    give their own result, and other columns are left out. A copy scattered over so many windows
    that none holds two fifths of it may be missed.
    """
    if not 0.8 <= containment <= 1:
        raise ValueError("containment must be between 0.8 and 1: bands are set for 0.8")
    spark = docs.sparkSession
    known = templates(spark) if known is None else known
    models = computed_once(known, {"words": words(F.coalesce("text", F.lit("")))}, [F.col("template_id"), F.col("license")])
    models = computed_once(models, {"own": F.array_distinct(shingles(F.col("words")))}, [F.col("template_id"), F.col("license")])
    models = models.where(F.size("own") > 0)
    # The stride: the smallest power of two that is not below the number of shingles.
    stride = F.expr("cast(1 as int) << cast(length(bin(size(own) - 1)) as int)")
    models = models.withColumn("stride", F.when(F.size("own") == 1, 1).otherwise(stride))
    models = frames.store(models.withColumn("bands", bands(F.col("own"))), "templates")
    lows = models.select("stride", F.explode("bands.h").alias("h")).distinct()

    # Words and shingles are computed once a row: inside a higher-order function an expression that
    # is not a column of its own would be evaluated for each element.
    ids = frames.col(docs, id_col).alias("doc_id")
    cut = computed_once(docs, {"words": words(frames.col(docs, text_col))}, [ids])
    rows = computed_once(cut, {"all": shingles(F.col("words"))}, [F.col("doc_id")])
    listed = lows.limit(LISTED + 1).collect()
    if len(listed) <= LISTED:
        wanted: dict[int, list[int]] = {}
        for r in listed:
            wanted.setdefault(r["stride"], []).append(r["h"])
        met = [h for group in wanted.values() for h in group]
        rows = rows.where(F.exists("all", lambda h: h.isin(met))) if met else rows.where("false")
        starts = [_starts(_places(F.col("all"), group), stride) for stride, group in sorted(wanted.items())]
        hit = F.flatten(F.array(*starts)) if starts else F.array().cast("array<struct<stride:int,at:int>>")
        near = F.array_distinct(
            F.flatten(F.transform(hit, lambda w: F.array(w, F.struct(w["stride"].alias("stride"), (w["at"] - 1).alias("at")))))
        )
        # The row's number comes first: behind the explode each window would have its own.
        rows = frames.store(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "all"), "shingles")
        held = rows.select("row", "doc_id", "all", F.explode(near).alias("w"))
        held = held.select("row", "doc_id", "all", "w.stride", "w.at")
    else:
        # Very many templates: the same windows by a join on the shingles.
        rows = frames.store(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "all"), "shingles")
        hits = rows.select("row", F.posexplode("all").alias("pos", "h")).join(broadcast_if_small(lows), "h")
        near = F.floor(F.col("pos") / F.col("stride")).cast("int")
        spots = hits.select("row", "stride", F.explode(F.array(near, near - 1)).alias("at")).distinct()
        held = spots.join(rows, "row").select("row", "doc_id", "all", "stride", "at")
    part = F.slice("all", F.col("at") * F.col("stride") + 1, 2 * F.col("stride"))
    spot = [F.col(c) for c in ("row", "doc_id", "stride", "at")]
    held = computed_once(held.where("at >= 0"), {"held": part}, spot)
    sketch = F.transform(bands(F.col("held")), lambda b: b["key"]).alias("keys")
    windows = frames.store(held.select("row", "stride", sketch), "windows")

    keys = models.select("template_id", "stride", F.explode(F.array_distinct(F.col("bands.key"))).alias("key"))
    found = (
        windows.select("row", "stride", F.explode("keys").alias("key"))
        .join(broadcast_if_small(keys), ["stride", "key"])
        .select("row", "template_id")
        .distinct()
    )
    named = broadcast_if_small(models.select("template_id", "license", "own"))
    met = found.join(rows, "row").join(named, "template_id")
    share = F.size(F.array_intersect("own", "all")) / F.size("own")
    exact = met.withColumn("share", share).where(F.col("share") >= containment)
    held_at = F.filter(F.transform("all", lambda h, i: F.when(F.array_contains("own", h), i)), lambda i: i.isNotNull())
    keep = [F.col(c) for c in ("doc_id", "template_id", "license", "share")]
    placed = computed_once(exact, {"at": held_at}, keep)
    first, last = F.array_min("at"), F.array_max("at")
    return placed.select(
        "doc_id", "template_id", "license",
        F.col("share").alias("containment"),
        first.cast("long").alias("first_word"),
        (last - first + SHINGLE).cast("long").alias("span_words"),
    )


def _places(all_shingles: Column, wanted: list[int]) -> Column:
    """Positions (from 0) of the wanted shingles."""
    marked = F.transform(all_shingles, lambda h, i: F.when(h.isin(wanted), i))
    return F.filter(marked, lambda i: i.isNotNull())


def _starts(places: Column, stride: int) -> Column:
    """For each position the last window of the class that begins at or before it."""
    return F.transform(
        places, lambda i: F.struct(F.lit(stride).alias("stride"), F.floor(i / stride).cast("int").alias("at"))
    )


def oracle() -> str:
    """The same result in DuckDB SQL, over whole documents: no windows and no sketches."""
    values = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(TEMPLATES))
    cut = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
    return f"""
WITH model(template_id, license, text) AS (VALUES {values}),
model_words AS (SELECT template_id, license, {cut} AS w FROM model),
own AS (
  SELECT DISTINCT template_id, license, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM model_words)),
sizes AS (SELECT template_id, count(*) AS t FROM own GROUP BY 1),
doc_words AS (SELECT row_number() OVER () AS r, doc_id, {cut} AS w FROM documents),
grams AS (
  SELECT r, doc_id, i - 1 AS pos, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM doc_words)),
held AS (
  SELECT r, doc_id, template_id, license, count(DISTINCT g) AS n, min(pos) AS first, max(pos) AS last
  FROM grams JOIN own USING (g) GROUP BY ALL)
SELECT doc_id, CAST(template_id AS BIGINT) AS template_id, license, CAST(n / t AS DOUBLE) AS containment,
  CAST(first AS BIGINT) AS first_word, CAST(last - first + {SHINGLE} AS BIGINT) AS span_words
FROM held JOIN sizes USING (template_id) WHERE n / t >= {CONTAINMENT}
"""
