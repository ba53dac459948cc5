"""License scans by Dice coefficient over word bigrams (operator 7), DataFrame functions only.

A text is normalised (lower case, runs of letters and digits are words, line breaks and marks are not) and
its word windows are compared with licence templates: Dice = 2 |A and B| / (|A| + |B|) over the bags of
word bigrams, so a notice is found whether it stands on its own line, is wrapped, or is part of a longer
sentence. A template's score is its best window's; it matches from ``threshold`` on.

With |B| = b, a window can only reach the threshold t with t / (2 - t) * b to (2 - t) / t * b bigrams, and only
if it holds at least t / (2 - t) * b template bigrams. These size bounds prune three times: texts
that lack so many different template bigrams are done with a template at once; windows longer than the bound
are never looked at; and a window that neither begins nor ends with a template bigram is never better
than the one inside it that does, so windows run from hit to hit only. From each hit one running sum
over the hits that follow, at most the size bound of them, gives the best window that begins there. A
repeated bigram counts as often as the template has it; of a window's occurrences those beyond that
are told by the place of the occurrence that many before.

Cost: one pass over the words for the hits, then hits times size bound for the few templates left; texts
are not shuffled and may be of any length. Templates are a parameter of known size and stand in the plan.
Bigrams are compared by 64-bit hashes, then as strings.

Defined results: null and empty texts, and texts of under two words, match nothing; equal scores are all
reported, the best is the first by name; a template of under two words never matches; repeated rows are
scanned one by one; an empty table gives an empty result; extra columns pass through, but for those
named like RESULTS, which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from math import ceil, floor

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import others

THRESHOLD = 0.8
RESULTS = ("licenses", "n_licenses", "best_license", "best_score")

# Notices by which texts name their licence, and texts of short licences.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must"
        " retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of"
        " conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work has been dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"
        " of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission"
        " notice appear in all copies."
    ),
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without"
        " restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom"
        " the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions"
        " of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A"
        " PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT"
        " OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
        " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"
    ),
}


def plain_words(text: str) -> list[str]:
    """The template side of ``normal``."""
    return re.findall(r"[^\W_]+", text.lower())


def normal(text: Column) -> Column:
    """Words: lower case, runs of letters and digits."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def bounds(b: int, threshold: float) -> tuple[int, int]:
    """The least and the greatest number of bigrams of a window that can match a template of ``b``."""
    return ceil(threshold / (2 - threshold) * b - 1e-9), floor((2 - threshold) / threshold * b + 1e-9)


def _code(gram: str) -> int:
    """Spark's xxhash64 of a bigram's two words."""
    first, second = gram.split(" ")
    h = xxhash.xxh64_intdigest(second.encode(), xxhash.xxh64_intdigest(first.encode(), 42))
    return h - (1 << 64) if h >= 1 << 63 else h


def hits(words: str, grams: list[str]) -> Column:
    """Places of the bigrams ``grams`` in the array column ``words``: structs of i (place, from 0) and g (the bigram), in order."""
    m = F.greatest(F.size(words) - 1, F.lit(0))
    both = F.arrays_zip(F.slice(words, 1, m).alias("a"), F.slice(words, 2, m).alias("b"))
    codes = [_code(g) for g in grams]
    near = F.transform(both, lambda z, i: F.when(F.xxhash64(z["a"], z["b"]).isin(codes), F.struct(i.alias("i"), F.concat_ws(" ", z["a"], z["b"]).alias("g"))))
    return F.filter(near, lambda x: x.isNotNull() & x["g"].isin(grams))


def allowed(gram: Column, counts: dict[str, int]) -> Column:
    """How often the template has the bigram."""
    c = F.lit(1)
    for n in sorted({n for n in counts.values() if n > 1}):
        c = F.when(gram.isin(sorted(k for k, v in counts.items() if v == n)), n).otherwise(c)
    return c


def _given(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def best_window(found: Column, counts: dict[str, int], threshold: float) -> Column:
    """The greatest Dice of a window of the text with a template; ``found``: the template's hits, in order."""
    b = sum(counts.values())
    _, most = bounds(b, threshold)

    def barred(own: Column) -> Column:
        # bar: the occurrence that many before as the template has the bigram; only windows from after it on count this one.
        def one(x: Column, j: Column) -> Column:
            first = F.greatest(j - most, F.lit(0))
            near = F.transform(F.slice(own, first + 1, j - first), lambda y, k: F.when(y["g"] == x["g"], k + first))
            bar = F.try_element_at(F.filter(near, lambda k: k.isNotNull()), -allowed(x["g"], counts))
            return F.struct(x["i"].alias("i"), F.coalesce(bar, F.lit(-1)).alias("bar"))

        return F.transform(own, one)

    def begun(all_: Column, x: Column, j: Column) -> Column:
        def step(s: Column, y: Column) -> Column:
            size = y["i"] - x["i"] + 1
            m = s["m"] + F.when(y["bar"] < j, 1).otherwise(0)
            return F.struct(m.alias("m"), F.when(size <= most, F.greatest(s["best"], 2.0 * m / (size + b))).otherwise(s["best"]).alias("best"))

        return F.aggregate(F.slice(all_, j + 1, F.lit(most)), F.struct(F.lit(0).alias("m"), F.lit(0.0).cast("double").alias("best")), step, lambda s: s["best"])

    return _given(found, lambda own: _given(barred(own), lambda all_: F.array_max(F.transform(all_, lambda x, j: begun(all_, x, j)))))


def scanned(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without ``text``, with licenses (names, comma-joined), n_licenses, best_license and best_score (both null without a match)."""
    bags = {}
    for name, t in sorted((TEMPLATES if templates is None else templates).items()):
        w = plain_words(t)
        if len(w) > 1:
            bags[name] = Counter(f"{a} {b}" for a, b in zip(w, w[1:]))
    every = sorted(set().union(*bags.values()))
    kept = [F.col(c) for c in others(docs, text, *RESULTS)]
    # Each select below uses the last one's arrays more than once, which keeps Spark from inlining them.
    rows = docs.select(*kept, normal(F.col(text)).alias("_ls_w")).select(*kept, hits("_ls_w", every).alias("_ls_h"))
    rows = rows.select(*kept, "_ls_h", F.array_distinct("_ls_h.g").alias("_ls_d"))
    fewest = min((bounds(sum(c.values()), threshold)[0] / max(c.values()) for c in bags.values()), default=1)

    def score(name: str) -> Column:
        counts = bags[name]
        own = sorted(counts)
        could = F.aggregate(F.filter("_ls_d", lambda g: g.isin(own)), F.lit(0), lambda a, g: a + allowed(g, counts))
        found = F.filter("_ls_h", lambda x: x["g"].isin(own))
        return F.struct(F.when(could >= bounds(sum(counts.values()), threshold)[0], best_window(found, counts, threshold)).alias("score"), F.lit(name).alias("name"))

    none = F.array().cast("array<struct<score:double,name:string>>")
    matched = F.filter(F.array(*[score(n) for n in bags]), lambda x: x["score"] >= threshold - 1e-12) if bags else none
    rows = rows.select(*kept, F.when(F.size("_ls_d") >= fewest, matched).otherwise(none).alias("_ls_m"))
    top = F.aggregate("_ls_m", F.lit(None).cast("struct<score:double,name:string>"), lambda a, x: F.when(a.isNull() | (x["score"] > a["score"]), x).otherwise(a))
    rows = rows.select(*kept, "_ls_m", top.alias("_ls_top"))
    names = F.array_join(F.transform("_ls_m", lambda x: x["name"]), ",")
    return rows.select(*kept, names.alias("licenses"), F.size("_ls_m").cast("long").alias("n_licenses"), F.col("_ls_top.name").alias("best_license"), F.col("_ls_top.score").alias("best_score"))
