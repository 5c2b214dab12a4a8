"""License scans: MinHash bands over windows, then exact containment (operator 2). DataFrame operations only."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import checkpointed

#: License and a passage that grants it or names it, each so cut that passages of sibling licenses aren't alike.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-2.0", "terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-3.0", "the GNU General Public License, version 3"),
    ("GPL-3.0", "terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-2.1", "terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to this work"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)
#: Highest probability that a window with enough containment isn't retrieved.
MISSED = 1e-9


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.translate({c: c + 32 for c in range(65, 91)}))


def _anchors(templates: Sequence[tuple[str, str]], k: int, least: float) -> list[str]:
    """Words of which at least one is in any text that holds a share `least` of the shingles of any template.

    For each template words of more than five letters (short ones are in every text) are taken, those in most shingles first, until the shingles
    without any of them are less than that share.
    """
    chosen: set[str] = set()
    for _, text in templates:
        w = _words(text)
        shingles = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}
        free = lambda: sum(not chosen & set(s) for s in shingles)  # noqa: E731,B023
        for x in sorted(set(w), key=lambda x: (-sum(x in s for s in shingles) - 100 * (x.startswith("licens")), -len(x), x)):
            if free() < least * len(shingles):
                break
            if len(x) > 5 or not any(len(y) > 5 for y in w):
                chosen.add(x)
    return sorted(chosen)


def _shingles(words: Column, k: int) -> Column:
    """Hashes of the shingles, by position."""
    n = F.greatest(F.size(words) - (k - 1), F.lit(1))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i, k))))


def window_words(n: int) -> int:
    """Words of the windows in which a template of n words is looked for: the next power of two, eight at least."""
    return max(8, 2 ** math.ceil(math.log2(n)))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, k: int = 5, containment: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and license found: doc_id, license, containment (the best), first_word (the first place of that; from 0).

    A document holds a license if window_words() of its words in a row have `containment` or more of the k-word shingles of one of that
    license's templates (words: [a-z0-9]+ after A-Z are lower-cased). Templates are dealt into classes by length; the windows of
    a class are longer by half and overlap, so that each place a template can be in is in one of them. Bands of one MinHash value each retrieve
    templates; a class has so many that a window with enough containment is missed with a probability of MISSED at most. What is retrieved is then
    verified on the exact shingles, at every start.
    Only windows with a word of _anchors() are made, which any match must have. Templates are a parameter of at most a few hundred passages: they become
    constants of the plan. Cut a long license into passages that tell it from its siblings.
    Null and empty texts have no license; repeated rows give rows of their own, by their place; an empty table gives none.
    """
    anchors = _anchors(templates, k, containment)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("_text"))
    has = F.lit(False)
    for a in [x for x in anchors if not any(y != x and y in x for y in anchors)]:
        has = has | F.contains("_text", F.lit(a))
    rows = rows.filter(has).select("doc_id", F.monotonically_increasing_id().alias("_row"), F.regexp_extract_all("_text", F.lit("[a-z0-9]+"), F.lit(0)).alias("_w"))
    marks = F.array(*[F.lit(a) for a in anchors])
    at = F.filter(F.transform("_w", lambda w, i: F.when(F.array_contains(marks, w), i)), lambda i: i.isNotNull())
    rows = checkpointed(rows.withColumn("_marks", at).filter(F.size("_marks") > 0))  # each class reads it

    classes: dict[int, list[tuple[int, str, list[str]]]] = {}
    for i, (name, passage) in enumerate(templates):
        w = _words(passage)
        classes.setdefault(window_words(len(w)), []).append((i, name, w))
    spark, found = docs.sparkSession, None
    for length, members in sorted(classes.items()):
        stride = length // 2
        width = length + stride
        # a window holds the passage; Jaccard is least when all its other shingles differ
        shingles = [max(1, len(w) - k + 1) for *_, w in members]
        jaccard = min(math.ceil(containment * n) / (width - k + 1 + n - math.ceil(containment * n)) for n in shingles)
        bands = math.ceil(math.log(MISSED) / math.log(1 - jaccard))
        # the windows with a mark: those that start at multiples of the stride up to one before it
        starts = F.array_distinct(F.flatten(F.transform("_marks", lambda m: F.transform(F.sequence(F.greatest(F.lit(0), F.floor((m - width) / stride) + 1), F.floor(m / stride)), lambda s: (s * stride).cast("int")))))  # noqa: B023
        windows = rows.select("doc_id", "_row", F.explode(starts).alias("_start"), "_w").withColumn("_h", _shingles(F.slice(F.col("_w"), F.col("_start") + 1, width), k)).drop("_w")
        band = lambda h: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(h, lambda x: F.xxhash64(x, b))).alias("low")))  # noqa: E731,B023
        said = [F.struct(F.lit(i).alias("_template"), F.lit(name).alias("license"), F.lit(" ".join(w)).alias("_text")) for i, name, w in members]
        known = spark.range(1).select(F.inline(F.array(*said))).select("_template", "license", F.array_distinct(_shingles(F.split("_text", " "), k)).alias("_t"))
        index = known.select(F.explode(band(F.col("_t"))).alias("_b"), "_template").groupBy("_b").agg(F.collect_set("_template").alias("_ts"))
        lookup = index.agg(F.map_from_entries(F.collect_list(F.struct("_b", "_ts")))).first()[0]
        table = F.create_map(*[F.lit(x) for b, ts in sorted(lookup.items(), key=str) for x in (f"{b['band']} {b['low']}", ",".join(map(str, sorted(ts))))])
        # the bands of a constant set of templates are a constant map: no join, no shuffle
        hits = F.transform(band(F.col("_h")), lambda b: F.try_element_at(table, F.concat_ws(" ", b["band"].cast("string"), b["low"].cast("string"))))  # noqa: B023
        ids = F.array_distinct(F.flatten(F.transform(F.filter(hits, lambda x: x.isNotNull()), lambda x: F.split(x, ","))))
        got = windows.withColumn("_template", F.explode(ids)).withColumn("_template", F.col("_template").cast("int"))
        got = got.join(F.broadcast(known), "_template").filter(F.size(F.array_intersect("_h", "_t")) >= F.size("_t") * F.lit(containment))
        got = got.withColumn("_m", F.filter(F.transform("_h", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.array_contains("_t", s["x"])))
        inside = lambda s: F.filter("_m", lambda o: (o["i"] >= s["i"]) & (o["i"] <= s["i"] + F.lit(length - k)))  # noqa: E731,B023
        held = F.array_max(F.transform("_m", lambda s: F.struct(F.size(F.array_distinct(F.transform(inside(s), lambda o: o["x"]))).alias("n"), (-s["i"]).alias("s"))))
        got = got.withColumn("_best", held).select("doc_id", "_row", "license", (F.col("_best.n") / F.size("_t")).alias("containment"), (F.col("_start") - F.col("_best.s")).alias("_start"))
        got = got.filter(F.col("containment") >= containment)
        found = got if found is None else found.unionByName(got)
    best = F.max(F.struct("containment", (-F.col("_start")).alias("_s"))).alias("_best")
    return found.groupBy("_row", "doc_id", "license").agg(best).select("doc_id", "license", F.col("_best.containment").alias("containment"), (-F.col("_best._s")).cast("long").alias("first_word"))
