"""Licence scans: the lines and paragraphs of a text against licence templates, by the Dice coefficient over word bigrams.

Texts and templates are normalised alike: lower case, every run of other characters than letters and digits one space. Two
sets of n and m bigrams can reach a coefficient t only if n >= m t / (2 - t) and m >= n t / (2 - t), so a piece is compared
with the templates of fitting size alone, and not at all if it shares no bigram with any. All of it is built-in functions; the
templates are a literal, and only matches are shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import fixed

#: Statements and notices as they are published.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "bsd-3-clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0-1.0": ["This work has been dedicated to the public domain under CC0 1.0 Universal."],
}


def bigrams(text: str) -> set[str]:
    """Distinct word bigrams of a template."""
    words = re.findall(r"[^\W_]+", text.lower())
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def _pair(words: Column) -> Column:
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, k: F.concat_ws(" ", F.get(words, k), w))
    return F.array_distinct(pairs)


def scan(docs: DataFrame, least: float = 0.9, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and licence found: id, license, dice (of the best piece), n_lines, n_paragraphs.

    Pieces are the lines of a text and its paragraphs of several lines (between empty lines). A piece counts once
    for each template that it reaches `least` with. Null and empty texts have no piece; repeated rows count as one document, and so do
    rows with a null id; other columns are ignored; an empty table gives an empty result.
    """
    sets = sorted((name, sorted(found)) for name, some in (templates or TEMPLATES).items() for found in {tuple(sorted(bigrams(x))) for x in some} if found)
    literal = F.array(*(F.struct(F.lit(n).alias("license"), F.lit(len(g)).alias("n"), F.lit(g).alias("grams")) for n, g in sets))
    every = F.lit(sorted({x for _, g in sets for x in g}))
    low, high = min(len(g) for _, g in sets) * least / (2 - least), max(len(g) for _, g in sets) * (2 - least) / least

    flat = F.regexp_replace(F.lower(text_col), r"[^\p{L}\p{N}\n]+", " ")
    piece_of = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), F.split(F.trim(F.regexp_replace(x, " *\n *", " ")), " ").alias("words"))
    lines = F.transform(F.split(flat, "\n"), piece_of("line"))
    blocks = F.filter(F.split(flat, r"\n(?: *\n)+"), lambda x: F.trim(x, F.lit("\n ")).contains("\n"))
    pieces = docs.select(F.col(id_col), F.explode_outer(F.concat(lines, F.transform(blocks, piece_of("paragraph")))).alias("p"))
    words = pieces.select(id_col, F.col("p.kind").alias("kind"), F.col("p.words").alias("words")).filter((F.size("words") > low))
    n = F.size("grams")
    grams = words.select(id_col, "kind", fixed(_pair(F.col("words"))).alias("grams"))
    grams = grams.filter((n >= low) & (n <= high)).filter(F.arrays_overlap("grams", every))
    fits = F.filter(literal, lambda t: (t["n"] >= n * least / (2 - least)) & (n >= t["n"] * least / (2 - least)))
    dice = lambda t: 2.0 * F.size(F.array_intersect(F.col("grams"), t["grams"])) / (n + t["n"])
    best = F.transform(fits, lambda t: F.struct(t["license"].alias("license"), dice(t).alias("dice")))
    found = grams.select(id_col, "kind", F.explode_outer(F.filter(best, lambda t: t["dice"] >= least)).alias("t")).filter("t is not null")
    n_of = lambda kind: F.count_if(F.col("kind") == kind)
    return found.groupBy(id_col, F.col("t.license").alias("license")).agg(F.round(F.max("t.dice"), 9).alias("dice"), n_of("line").alias("n_lines"), n_of("paragraph").alias("n_paragraphs"))
