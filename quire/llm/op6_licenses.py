"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Native throughout: only DataFrame and SQL functions. Words are runs of other than the six ASCII white-space characters with A-Z lower-cased,
shingles five words. A template of s shingles belongs to the least window size W of 2, 4, 6, 8, 12, 16, 24, 32 ... that is at least 2 s; windows of W
shingles start every W/2, so an occurrence lies whole in one of them. Each window has HASHES MinHash values and every one
is a band of its own. W is at most 3 s, so a window that holds 0.8 of a template has a similarity of 0.25 or more to it, and no band agrees
with a probability of 0.75 ** HASHES, 1e-8, or less. A band can only agree if the window holds the shingle that is the template's
minimum there, so only windows around such shingles are made, and each is cut out of its text where it is made: work follows text length.
Candidates are verified by the exact share of the template's distinct shingles in the window.

Result: a row for each document and template found, with the best share (matched of shingles) and the first window, in words, that has it.

Nulls and odd cases: texts that are null, empty or under five words match nothing; repeated rows match each on its own; a
null doc_id is kept; very long texts are windowed whole; an empty table gives no rows; other columns are not looked at. The
templates are a parameter and are broadcast: more than TEMPLATES of them or SHINGLES shingles in all, or a template under five words, are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import TEXTS

WORDS, HASHES, SHARE, TEMPLATES, SHINGLES = 5, 64, 80, 500, 1 << 20

NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
} | TEXTS

_GAP = "[\\x20\\x09-\\x0D]+"


def template_words(text: str) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return low.translate({c: " " for c in (0x20, *range(9, 14))}).split(" ") if text else []


def template_shingles(text: str) -> list[str]:
    w = [x for x in template_words(text) if x]
    return list(dict.fromkeys(" ".join(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)))


def window_size(shingles: int) -> int:
    size = 2
    while size < 2 * shingles:
        size = size * 4 // 3 if size % 3 == 0 else size * 3 // 2 if size > 2 else 4
    return size


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: inside another lambda the optimiser would compute it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column) -> Column:
    """Array of the hashes of all five-word shingles, in order; null with fewer words."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def hashes(p: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(p) - WORDS), lambda i: F.xxhash64(*(F.get(p, i + j) for j in range(WORDS))))
        return F.when(F.size(p) >= WORDS, each)

    return _let(F.filter(F.split(low, _GAP), lambda w: w != ""), hashes)


def signature(hashes: Column) -> Column:
    return _let(hashes, lambda win: F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda k: F.array_min(F.transform(win, lambda h: F.xxhash64(h, k)))))


def _longs(values) -> list[Column]:
    return [F.lit(v).cast("long") for v in sorted(values)]


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, matched, shingles, start_word, n_windows of each document and template found in it."""
    shingles = {name: template_shingles(text) for name, text in sorted((NOTICES if templates is None else templates).items())}
    if short := [name for name, s in shingles.items() if not s]:
        raise ValueError(f"templates of under {WORDS} words: {short}")
    if len(shingles) > TEMPLATES or sum(map(len, shingles.values())) > SHINGLES:
        raise ValueError(f"more than {TEMPLATES} templates or {SHINGLES} shingles of them")
    spark = docs.sparkSession

    def local(df: DataFrame) -> DataFrame:
        """The same rows, as values: an expression that a lambda refers to is computed for every element."""
        return spark.createDataFrame(df.collect(), df.schema)

    known = spark.createDataFrame([(name, window_size(len(s)), [x.split(" ") for x in s]) for name, s in shingles.items()], "license string, w int, s array<array<string>>")
    known = local(known.select("license", "w", F.transform("s", lambda x: F.xxhash64(*(x[j] for j in range(WORDS)))).alias("th")))
    known = local(known.withColumn("tsig", signature(F.col("th"))))
    bands = known.select("license", "w", F.posexplode("tsig").alias("k", "v"))
    # the shingles that are a minimum of some template; a bounded model: at most TEMPLATES * HASHES values
    lowest = F.transform("tsig", lambda v, k: F.get(F.filter("th", lambda h: F.xxhash64(h, k) == v), F.lit(0)))
    least: dict[int, set] = {}
    for r in known.select("w", F.explode(lowest).alias("h")).distinct().collect():
        least.setdefault(r.w, set()).add(r.h)
    every = _longs(set().union(*least.values())) or [F.lit(None).cast("long")]

    def windows_of(sh: Column, at: Column, w: int, hs: set) -> Column:
        """Windows of w shingles with one of hs, as (w, start, win)."""
        starts = F.flatten(F.transform(F.filter(at, lambda i: F.get(sh, i).isin(_longs(hs))), lambda i: F.array(i - i % (w // 2), i - i % (w // 2) - w // 2)))
        starts = F.array_distinct(F.filter(starts, lambda i: i >= 0))
        return F.transform(starts, lambda i: F.struct(F.lit(w).alias("w"), i.alias("start"), F.array_distinct(F.slice(sh, i + 1, F.lit(w))).alias("win")))

    none = F.expr("cast(array() as array<struct<w:int,start:int,win:array<bigint>>>)")

    def cut(sh: Column) -> Column:
        found_at = F.when(sh.isNotNull(), F.filter(F.sequence(F.lit(0), F.size(sh) - 1), lambda i: F.get(sh, i).isin(every)))
        return _let(found_at, lambda at: F.when(F.size(at) > 0, F.concat(none, *(windows_of(sh, at, w, hs) for w, hs in sorted(least.items())))))

    # a row number for each row keeps repeated rows and null ids apart, and filters from being pushed below the windows, which would be cut twice
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), _let(shingle_hashes(F.col(text_col)), cut).alias("windows"))
    windows = rows.select("row", "doc_id", F.explode("windows").alias("x")).select("row", "doc_id", "x.w", "x.start", "x.win")
    signed = windows.withColumn("sig", signature(F.col("win"))).select("*", F.posexplode("sig").alias("k", "v"))
    # bands of a window meet in its own task: no shuffle stands between windows and their verdict; the first band that agrees speaks for all
    found = signed.join(F.broadcast(bands), ["w", "k", "v"]).join(F.broadcast(known.select("license", "th", "tsig")), "license")
    found = found.where(F.array_position(F.zip_with("sig", "tsig", lambda x, y: x == y), True) == F.col("k") + 1)
    verified = found.select("row", "doc_id", "license", "start", F.size(F.array_intersect("win", "th")).alias("matched"), F.size("th").alias("shingles")).where(f"matched * 100 >= {SHARE} * shingles")
    best = verified.groupBy("row", "doc_id", "license", "shingles").agg(F.max(F.struct("matched", (-F.col("start")).alias("first"))).alias("m"), F.count("*").alias("n_windows"))
    return best.select("doc_id", "license", F.col("m.matched").cast("long").alias("matched"), F.col("shingles").cast("long").alias("shingles"), (-F.col("m.first")).cast("long").alias("start_word"), F.col("n_windows").cast("long").alias("n_windows"))


def oracle(documents: str = "documents") -> str:
    """Brute force in DuckDB: every window against every template by the words themselves."""
    values = ", ".join(f"('{n}', {window_size(len(s))}, {len(s)}, '{x.replace(chr(39), chr(39) * 2)}')" for n, t in sorted(NOTICES.items()) if (s := template_shingles(t)) for x in s)
    return f"""
WITH t(license, w, shingles, s) AS (VALUES {values}),
d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS p FROM {documents} WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest(range(0, len(p) - 4)) AS i, p FROM d WHERE len(p) >= 5),
h AS (SELECT doc_id, i, array_to_string(p[i + 1 : i + 5], ' ') AS s FROM g),
m AS (SELECT h.doc_id, h.i, t.* FROM h JOIN t USING (s)),
win AS (SELECT doc_id, license, shingles, s, unnest([x FOR x IN range(0, i + 1, w // 2) IF x > i - w]) AS start FROM m),
c AS (SELECT doc_id, license, shingles, start, count(DISTINCT s) AS matched FROM win GROUP BY ALL HAVING count(DISTINCT s) * 100 >= {SHARE} * shingles)
SELECT doc_id, license, max(matched)::BIGINT AS matched, shingles::BIGINT AS shingles,
  arg_max(start, matched * 1000000000::BIGINT - start)::BIGINT AS start_word, count(*)::BIGINT AS n_windows
FROM c GROUP BY doc_id, license, shingles"""
