"""License scans with DataFrame functions only.

Texts and templates are sets of five-word shingles. A text is covered by overlapping windows of
``WINDOW`` shingles, ``STRIDE`` apart; templates are cut into chunks of up to STRIDE shingles, so a
chunk that occurs anywhere lies whole in a window. Windows and chunks get ``BANDS`` MinHash values,
each a band of one row: a chunk with c shingles in a window meets it in some band with probability
1 - (1 - c / WINDOW) ** BANDS: a single shingle is missed with 4e-8, three with 1e-26. Chunks
retrieve their templates, and a template is reported if the text holds at least 0.8 of its shingles
(exact containment, on 64-bit hashes).

The MinHash values are evaluated where they can matter only: a window's band equals a chunk's just
if the window holds the shingle that is the chunk's minimum in it, so texts without any of these
shingles are passed over before windows are laid out. The result is the same.

Everything happens in the row of the text: nothing is shuffled, and templates (at most
``MAX_TEMPLATES``) are literals of the plan.

Defined cases: null, empty and shorter texts than five words match nothing; repeated rows and ids
are scanned one by one; templates need five words at least; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, WINDOW, STRIDE, BANDS, CONTAINMENT, MAX_TEMPLATES = 5, 8, 4, 128, 0.8, 2000

#: Short notices of common licences. The wording is the licences' own.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(w: Column) -> Column:
    """64-bit hashes of each run of five words of an array column; empty for fewer words."""
    n = F.size(w) - (SHINGLE - 1)
    run = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), run)).otherwise(
        F.array().cast("array<bigint>")
    )


def bands_of(window: Column) -> list[Column]:
    """MinHash values of an array of shingles; each is tagged with its band."""

    def band(j: int) -> Column:
        return F.xxhash64(F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(j)))), F.lit(j))

    return [band(j) for j in range(BANDS)]


def _minimum(chunk: Column, j: int) -> Column:
    """The shingle of a chunk whose j-th hash is least."""
    pairs = F.transform(chunk, lambda x: F.struct(F.xxhash64(x, F.lit(j)).alias("h"), x.alias("x")))
    return F.array_min(pairs)["x"]


def _templates(spark: SparkSession, templates: dict[str, str]) -> tuple[list, Column, Column, Column]:
    """Templates as literals: (id, shingles, band keys), with all keys and all minima."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    rows = (
        spark.createDataFrame(list(templates.items()), "license string, text string")
        .withColumn("w", words(F.col("text")))
        .withColumn("shingles", F.array_distinct(shingles_of(F.col("w"))))
        .withColumn("start", F.explode_outer(F.sequence(F.lit(1), F.greatest(F.size("shingles"), F.lit(1)), F.lit(STRIDE))))
        .withColumn("chunk", F.slice("shingles", F.col("start"), STRIDE))
        .withColumn("keys", F.array(*bands_of(F.col("chunk"))))
        .withColumn(
            "minima",
            F.array(*[_minimum(F.col("chunk"), j) for j in range(BANDS)]),
        )
        .groupBy("license")
        .agg(
            F.first("shingles").alias("shingles"),
            F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"),
            F.array_distinct(F.flatten(F.collect_list("minima"))).alias("minima"),
        )
        .orderBy("license")
        .collect()
    )
    short = [r.license for r in rows if not r.shingles]
    if short:
        raise ValueError(f"templates need {SHINGLE} words: {short}")
    longs = lambda xs: F.array(*[F.lit(x) for x in xs])
    as_column = F.array(
        *[
            F.struct(F.lit(r.license).alias("license"), longs(r.shingles).alias("shingles"), longs(r["keys"]).alias("keys"))
            for r in rows
        ]
    )
    every = lambda name: longs(sorted({x for r in rows for x in r[name]}))
    return rows, as_column, every("keys"), every("minima")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, n_shared, n_template, containment and first_word of each match."""
    _, patterns, all_keys, minima = _templates(docs.sparkSession, templates or TEMPLATES)
    none = F.array().cast("array<bigint>")
    # plain selects, no filters on computed columns: a filter would be pushed below and compute them again
    hit = (
        docs.where("text is not null")
        .select("doc_id", words(F.col("text")).alias("w"))
        .select("doc_id", shingles_of(F.col("w")).alias("all"))
        .select("doc_id", F.when(F.arrays_overlap("all", minima), F.col("all")).otherwise(none).alias("sh"))
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size("sh"), F.lit(1)), F.lit(STRIDE))
    keys = F.flatten(F.transform(starts, lambda i: F.array(*bands_of(F.slice("sh", i, WINDOW)))))
    met = F.when(F.size("sh") > 0, F.array_intersect(keys, all_keys)).otherwise(none)
    shared = lambda t: F.size(F.array_intersect(t.shingles, F.col("sh")))
    found = (
        hit.withColumn("met", met)
        .withColumn(
            "match",
            F.explode(
                F.transform(
                    F.filter(patterns, lambda t: F.arrays_overlap(t.keys, F.col("met"))),
                    lambda t: F.struct(
                        t.license.alias("license"),
                        shared(t).cast("long").alias("n_shared"),
                        F.size(t.shingles).cast("long").alias("n_template"),
                        F.array_min(F.transform(t.shingles, lambda x: F.nullif(F.array_position(F.col("sh"), x), F.lit(0).cast("long")))).alias("first_word"),
                    ),
                )
            ),
        )
        .select("doc_id", "match.*")
    )
    return found.where(F.col("n_shared") >= containment * F.col("n_template") - 1e-9).select(
        "doc_id", "license", "n_shared", "n_template", (F.col("n_shared") / F.col("n_template")).alias("containment"), "first_word"
    )


def oracle(templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> str:
    """DuckDB SQL of the same rows, by comparing every text with every template."""
    rows = ", ".join("('" + k.replace("'", "''") + "', '" + t.replace("'", "''") + "')" for k, t in (templates or TEMPLATES).items())
    cut = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
    runs = "unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: struct_pack(i := i, s := list_aggregate(w[i:i + 4], 'string_agg', ' '))))"
    return f"""
with t as (select license, {cut.format('text')} as w from (values {rows}) v(license, text)),
ts as (select distinct license, x.s as s from (select license, {runs} as x from t)),
tn as (select license, count(*) as n from ts group by 1),
d as (select doc_id, {cut.format('text')} as w from documents where text is not null),
ds as (select doc_id, x.s as s, min(x.i) as i from (select doc_id, {runs} as x from d) group by 1, 2)
select ds.doc_id, license, count(*) as n_shared, any_value(n) as n_template, count(*) / any_value(n) as containment, min(i) as first_word
from ds join ts using (s) join tn using (license)
group by ds.doc_id, license having count(*) >= {containment} * any_value(n) - 1e-9"""
