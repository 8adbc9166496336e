"""License scan: MinHash bands over overlapping windows retrieve license templates, exact
shingle containment verifies them. Native operations only.

Words are lower-cased runs of letters and digits, shingles five words. A window is
``WINDOW`` adjacent shingles, one starts at every shingle. Its signature has one row a
band: the least shingle hash after a fixed exclusive-or with the band's constant, which
reorders the hashes. A template is retrieved by a window that has the template's value
in a band.

*Guarantee.* The template's value in a band is that of one of its shingles, t. A window
inside a copy that holds t has that value too, so a whole copy is found in every band,
and a copy lacking a fifth of the shingles is missed by all bands with a chance of 0.2
to the power of their number. Where a window holds t and foreign shingles, t has to be
the least: two shingles are ordered by the first bit in which they differ, and as the
constants come in complementary pairs, t is the least in half of the bands. So even a
template of one shingle cannot be missed.

A retrieved template is verified around the window, at most its own length away: the
share of its different shingles found there (as strings) has to be ``MIN_CONTAINED``.

Null texts and texts under five words match nothing, templates under five words are an
error. Repeated rows give one match, documents without an id one for the null id. Texts
are scanned whole, in one task each; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import saved, words

SHINGLE, WINDOW, MIN_CONTAINED = 5, 2, 0.8

# Four constants and their complements.
_HALF = (0x1D8E4E27C47D124F, 0x72B1F0C93A6E85D3, 0x49C3A7516FE20B98, 0x0B6F3D9E85A1C274)
BANDS = tuple(c for half in _HALF for c in (half, ~half))

# The wording of common license statements.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software"),
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-redistribution": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation"),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def shingle_hashes(of: Column) -> Column:
    """Hashes of the shingles of a word array."""
    count = F.size(of) - (SHINGLE - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(
        *[F.get(of, i + k if k else i) for k in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))


def shingle_strings(of: Column, start: Column, count: Column) -> Column:
    """Different shingles, as strings, from position ``start`` (from 0) on."""
    last = F.least(start + count, F.size(of) - (SHINGLE - 1)) - 1
    return F.when(last >= start, F.array_distinct(F.transform(F.sequence(start, last), lambda i: F.concat_ws(
        " ", *[F.get(of, i + k) for k in range(SHINGLE)])))).otherwise(F.array().cast("array<string>"))


def band_value(hashes: Column, at: Column, band: int) -> Column:
    """Least value of the window that starts at ``at``; the last window is shorter."""
    return F.least(*[F.get(hashes, at + k if k else at).bitwiseXOR(F.lit(band)) for k in range(WINDOW)])


def template_table(like: DataFrame, templates: dict[str, str]) -> DataFrame:
    """``license, shingles, bands``: as small as the list of templates is."""
    rows = like.sparkSession.createDataFrame(list(templates.items()), "license string, text string")
    rows = rows.withColumn("_w", words(F.col("text")))
    rows = rows.withColumns({"_h": shingle_hashes(F.col("_w")),
                             "shingles": shingle_strings(F.col("_w"), F.lit(0), F.size("_w"))})
    bands = F.array(*[F.array_min(_xored(F.col("_h"), c)) for c in BANDS])
    return rows.select("license", "shingles", bands.alias("bands"))


def _xored(hashes: Column, band: int) -> Column:
    return F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(band)))


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id",
            text_col: str = "text", min_contained: float = MIN_CONTAINED) -> DataFrame:
    """``doc_id, license, containment`` of every license found in a document."""
    table = saved(template_table(docs, templates or TEMPLATES), "templates")
    known = [row["bands"] for row in table.select("bands").collect()]
    if any(None in bands for bands in known):
        raise ValueError(f"templates need at least {SHINGLE} words")
    # One set for all bands is looked up fast; the join below asks for the right band.
    values = sorted({value for bands in known for value in bands})

    # No filter on what is computed here: it would be pushed below and computed twice.
    read = docs.select(F.col(id_col).alias("_id"), words(F.col(text_col)).alias("_w"))
    hashed = read.withColumn("_h", shingle_hashes(F.col("_w")))

    def retrieves(at: Column) -> Column:
        out = F.lit(False)
        for band in BANDS:
            out |= band_value(F.col("_h"), at, band).isin(values)
        return out

    starts = F.slice(F.sequence(F.lit(0), F.size("_h")), F.lit(1), F.size("_h"))
    found = hashed.withColumn("_at", F.filter(starts, retrieves))
    # The outer form, as the other one has such a filter inferred.
    window = (found.select("_id", "_w", "_h", F.explode_outer("_at").alias("_at")).where("_at is not null")
              .withColumn("_bands", F.array(*[band_value(F.col("_h"), F.col("_at"), band) for band in BANDS]))
              .drop("_h"))
    # A few windows of a few documents are left.
    named = table.select("license", "shingles", F.posexplode("bands").alias("_j", "_v"))
    pairs = (window.select("_id", "_w", "_at", F.posexplode("_bands").alias("_j", "_v"))
             .join(F.broadcast(named), ["_j", "_v"])
             .groupBy("_id", "_at", "license").agg(F.first("_w").alias("_w"), F.first("shingles").alias("_t")))
    length = F.size("_t")
    start = F.greatest(F.col("_at") - length, F.lit(0))
    near = shingle_strings(F.col("_w"), start, F.col("_at") + length + WINDOW - start)
    share = F.size(F.array_intersect(near, F.col("_t"))) / length
    return (pairs.select(F.col("_id").alias(id_col), "license", share.alias("containment"))
            .groupBy(id_col, "license").agg(F.max("containment").alias("containment"))
            .where(F.col("containment") >= min_contained))


def oracle_sql(templates: dict[str, str] | None = None, min_contained: float = MIN_CONTAINED) -> str:
    """The same matches without MinHash: every shingle of every text is looked up."""
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in (templates or TEMPLATES).items())
    split = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    shingles = ("SELECT {key}, i - 1 AS pos, array_to_string(w[i : i + 4], ' ') AS s FROM "
                "(SELECT {key}, w, unnest(range(1, len(w) - 3)) AS i FROM {source})")
    return f"""
    WITH t AS (SELECT license, {split.format('text')} AS w FROM (VALUES {rows}) AS v(license, text)),
    ts AS (SELECT license, s, count(*) OVER (PARTITION BY license) AS n FROM
      (SELECT DISTINCT license, s FROM ({shingles.format(key='license', source='t')}))),
    d AS (SELECT DISTINCT doc_id, {split.format('text')} AS w FROM documents WHERE text IS NOT NULL),
    hits AS (SELECT doc_id, pos, ts.license, ts.s, n FROM ({shingles.format(key='doc_id', source='d')}) AS ds JOIN ts USING (s)),
    anchors AS (SELECT DISTINCT doc_id, license, n, pos - k AS at FROM hits, (VALUES (0), (1)) AS o(k) WHERE pos - k >= 0),
    scored AS (SELECT a.doc_id, a.license, a.at, count(DISTINCT h.s) / any_value(a.n)::DOUBLE AS containment
      FROM anchors a JOIN hits h ON a.doc_id IS NOT DISTINCT FROM h.doc_id AND a.license = h.license
        AND h.pos BETWEEN a.at - a.n AND a.at + a.n + {WINDOW - 1} GROUP BY ALL)
    SELECT doc_id, license, max(containment) AS containment FROM scored
    GROUP BY doc_id, license HAVING max(containment) >= {min_contained}"""
