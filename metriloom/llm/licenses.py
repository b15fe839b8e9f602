"""Licence scan: normalised text against licence templates by Dice over word bigrams.

A text is compared as a whole and line by line, as notices mostly stand in a line of their own. Text and
templates are lower-cased and cut into runs of letters and digits. With |A| and |B| different bigrams the
Dice coefficient is 2 |A and B| / (|A| + |B|); it can reach ``threshold`` only if |B| lies between
|A| t / (2 - t) and |A| (2 - t) / t, so candidates of other sizes are left out before any comparison, and
a segment that shares no bigram with any template is left out too. Both bounds lose nothing.

All of it is built-in functions over whole texts. Null and empty texts, and segments of fewer than two
words, have no bigrams and no licence. Ties go to the first template by name. Repeated rows are scanned
alike, an empty table gives an empty table, and columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Wordings of public licence notices.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased; every other character parts words."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def bigrams(w: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.element_at(w, i), F.lit(" "), F.element_at(w, i + 1)))
    return F.when(F.size(w) > 1, F.array_distinct(pairs))


def template_bigrams(templates: Mapping[str, str]) -> dict[str, list[str]]:
    import re

    out = {}
    for name in sorted(templates):
        w = re.findall("[a-z0-9]+", templates[name].lower())
        out[name] = list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))
    return {n: b for n, b in out.items() if b}


def scan(df: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, license, dice, n_segments`` of every row: the best template, its coefficient, and how many
    segments reach the threshold. ``license`` is null where none does, and ``dice`` then 0."""
    known = template_bigrams(templates)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least = min(len(b) for b in known.values()) * low
    most = max(len(b) for b in known.values()) * high
    every = F.array(*[F.lit(b) for b in sorted({b for bs in known.values() for b in bs})])
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    lines = F.split("_text", "\n")
    # lines of one document, those by size first: fewer characters than words cannot hold the bigrams
    segments = F.concat(F.filter(lines, lambda s: F.length(s) >= 2 * least), F.when(F.size(lines) > 1, F.array("_text")).otherwise(F.array().cast("array<string>")))
    normal = F.transform(segments, words)
    sized = F.filter(normal, lambda w: (F.size(w) > 1) & (F.size(w) > least))
    pairs = F.filter(F.transform(sized, bigrams), lambda b: (F.size(b) >= least) & (F.size(b) <= most) & F.arrays_overlap(b, every))

    def best(b: Column) -> Column:
        found = [
            F.when(
                (F.size(b) >= len(t) * low) & (F.size(b) <= len(t) * high),
                F.struct(
                    (2.0 * F.size(F.array_intersect(b, F.array(*[F.lit(x) for x in t]))) / (F.size(b) + F.lit(len(t)))).alias("dice"),
                    F.lit(-i).alias("place"),
                    F.lit(name).alias("license"),
                ),
            )
            for i, (name, t) in enumerate(known.items())
        ]
        return F.greatest(*found) if len(found) > 1 else found[0]

    hits = F.filter(F.transform(pairs, best), lambda h: h["dice"] >= threshold)
    top = F.array_max("_hits")
    return rows.select("doc_id", hits.alias("_hits")).select(
        "doc_id", top["license"].alias("license"), F.coalesce(F.round(top["dice"], 6), F.lit(0.0)).alias("dice"), F.size("_hits").cast("bigint").alias("n_segments")
    )
