"""Licence scan by the Dice coefficient over word bigrams, in DataFrame functions only.

A text is normalised to lower-case words of letters a-z and digits; a stretch of it has the
set of distinct pairs of neighbouring words. A stretch matches a template when
2 * common / (its pairs + the template's pairs) is at least ``percent``/100. Compared are

* each line and sentence of the text with the notices of ``TEMPLATES``, and
* windows over the whole text, across line and sentence ends, with these notices and the
  ``BODIES``: a window has a template's number of words and starts at one of its pairs.

Where matches overlap, the one with more common pairs stays; then a line or sentence before
a window, the larger value, the name first in order. They are settled from left to right.

Size bounds prune: the value can only be reached when the common pairs are at least
percent/(200 - percent) of the template's, so the text is compared only with templates of
which it has so many pairs, and most texts with none. The scan works inside the row on
whole texts; it joins and shuffles nothing.

Defined results: a null or empty text, and one without a match, has no licences: 0
matches, an empty list of names, null best name and Dice 0. Ties for the best go to the
name first in order. Repeated rows each get their result; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERCENT = 80
SEGMENT_END = r"\n|(?<=[.!?;:])\s"

# Notices by which texts declare their licence.
TEMPLATES = {
    "agpl-3.0": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\")",
    ],
    "bsd-3-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted",
    ],
    "lgpl-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
}


# Standard headers and whole licence texts; windows are compared with these too.
_GNU = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published "
    "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have "
    "received a copy of the {0} along with this program.",
]
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. {0}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
    "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS "
    "FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
BODIES = {
    "agpl-3.0": [t.format("GNU Affero General Public License") for t in _GNU],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ],
    "bsd-2-clause": [_BSD.format("")],
    "bsd-3-clause": [
        _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                    "or promote products derived from this software without specific prior written permission. "),
    ],
    "gpl-3.0": [t.format("GNU General Public License") for t in _GNU],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ],
    "lgpl-3.0": [t.format("GNU Lesser General Public License") for t in _GNU],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the "
        "author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to "
        "this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ],
}
MARK = "Z"  # stands for a segment end; the words are lower case


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def pairs_of(notice: str) -> list[str]:
    """The word pairs of a template, by the same normal form as the texts."""
    words = words_of(notice)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _bound(expr: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(expr), body), F.lit(0))


def _words(text: Column, other: str = "") -> Column:
    return F.split(F.trim(F.regexp_replace(text, f"[^a-z0-9{other}]+", " ")), " ")


def _pairs(words: Column) -> Column:
    """The pairs of neighbouring words, by place; none of a single word."""
    return _bound(words, lambda words: F.when(F.size(words) > 1, F.transform(
        F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i))
    )).otherwise(F.array().cast("array<string>")))


def _match(first: Column, last: Column, both: Column, whole: int, dice: Column, name: Column) -> Column:
    return F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), both.cast("int").alias("both"),
                    F.lit(whole).alias("whole"), dice.cast("double").alias("dice"), name.alias("name"))


def _settled(found: Column) -> Column:
    """Number, names and best of the matches that stay, in one pass from left to right: ``now``
    is the best of those that overlap, ``under`` the first that gave way to a better one."""
    none = _match(F.lit(-1), F.lit(-2), F.lit(0), 0, F.lit(0.0), F.lit(None).cast("string"))
    start = F.struct(none.alias("now"), none.alias("under"), F.lit(0).cast("long").alias("n"),
                     F.array().cast("array<string>").alias("names"),
                     F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("best"))

    def counted(s: Column, m: Column, if_: Column) -> Column:
        """The counts of ``s`` with ``m``."""
        closer = if_ & ((m["dice"] > s["dice"]) | ((m["dice"] == s["dice"]) & (m["name"] < s["best"])))
        return F.struct(s["now"].alias("now"), s["under"].alias("under"),
                        F.when(if_, s["n"] + 1).otherwise(s["n"]).alias("n"),
                        F.when(if_, F.array_union(s["names"], F.array(m["name"]))).otherwise(s["names"]).alias("names"),
                        F.when(closer, m["dice"]).otherwise(s["dice"]).alias("dice"),
                        F.when(closer, m["name"]).otherwise(s["best"]).alias("best"))

    def closed(s: Column) -> Column:
        now = counted(s, s["now"], s["now"]["first"] >= 0)
        return _bound(now, lambda t: counted(t, t["under"], (t["under"]["first"] >= 0)
                                             & (t["under"]["last"] < t["now"]["first"])))

    def placed(s: Column, now: Column, under: Column) -> Column:
        return F.struct(now.alias("now"), under.alias("under"), s["n"].alias("n"), s["names"].alias("names"),
                        s["dice"].alias("dice"), s["best"].alias("best"))

    def better(a: Column, b: Column) -> Column:
        key = lambda m: F.struct(m["both"], m["whole"], m["dice"])
        return (key(a) > key(b)) | ((key(a) == key(b)) & (a["name"] < b["name"]))

    def step(s: Column, m: Column) -> Column:
        return (F.when(m["first"] > s["now"]["last"], _bound(closed(s), lambda t: placed(t, m, none)))
                .when(better(m, s["now"]),
                      placed(s, m, F.when(s["under"]["first"] >= 0, s["under"]).otherwise(s["now"])))
                .otherwise(s))

    return F.aggregate(F.array_sort(found), start, step, closed)


def scan(docs: DataFrame, percent: int = PERCENT, templates: dict[str, list[str]] | None = None,
         bodies: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, n_matches, licences, best, dice) for each row; see the module. ``bodies`` are
    ``BODIES`` unless ``templates`` are given."""
    if bodies is None:
        bodies = BODIES if templates is None else {}
    known = [(name, whole, len(words_of(t)) - 1, pairs_of(t))
             for whole, given in ((True, templates or TEMPLATES), (False, bodies))
             for name, notices in sorted(given.items()) for t in notices]
    least = min(len(p) for *_, p in known) * percent / (200 - percent)
    several = lambda pairs: F.split(F.lit(",".join(pairs)), ",")
    every = several(sorted({p for *_, pairs in known for p in pairs}))
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(whole).alias("whole"), F.lit(long).alias("long"),
                               F.lit(len(pairs)).alias("n"), F.lit(-(-percent * len(pairs) // (200 - percent))).alias("need"),
                               several(pairs).alias("pairs")) for name, whole, long, pairs in known))

    # the templates of which the text has enough pairs, and only then its places
    text = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    text = text.select("*", F.array_intersect(_pairs(_words(F.col("text"))), every).alias("present"))
    text = text.select("doc_id", "text", F.when(F.size("present") >= least, F.filter(table, lambda t: (
        F.size(F.array_intersect("present", t["pairs"])) >= t["need"]))).alias("near"))
    some = F.size("near") > 0
    marked = _words(F.concat(F.regexp_replace("text", SEGMENT_END, f" {MARK} "), F.lit(f" {MARK}")), MARK)
    text = text.select("doc_id", "near", F.when(some, marked).alias("marked"))
    places = F.sequence(F.lit(0), F.size("marked") - 1)
    at = lambda wanted: F.when(some, F.filter(places, lambda i: wanted(F.get("marked", i))))
    text = text.select("*", at(lambda w: w != MARK).alias("at"), at(lambda w: w == MARK).alias("ends"))
    text = text.select("*", F.when(some, _pairs(F.filter("marked", lambda w: w != MARK))).alias("pairs"))

    def match(p: Column, t: Column, first: Column, last: Column, whole: int) -> Column:
        both = F.size(F.array_intersect(p, t["pairs"]))
        return _bound(F.struct(both.alias("both"), (t["n"] + F.size(p)).alias("all")), lambda x: F.when(
            200 * x["both"] >= percent * x["all"],
            _match(first, last, x["both"], whole, 2.0 * x["both"] / x["all"], t["name"])))

    found = lambda matches: F.filter(matches, lambda m: m.isNotNull())

    def segment(first: Column, end: Column) -> Column:  # one licence for a segment: the closest template
        def closest(p: Column) -> Column:
            fits = F.filter("near", lambda t: t["whole"] & (F.size(p) > 0) & (
                (200 - percent) * F.least(t["n"], F.size(p)) >= percent * F.greatest(t["n"], F.size(p))))
            good = found(F.transform(fits, lambda t: match(p, t, first, end - 1, 1)))
            return F.reduce(good, F.get(good, F.lit(0)), lambda a, m: F.when(
                (m["dice"] > a["dice"]) | ((m["dice"] == a["dice"]) & (m["name"] < a["name"])), m).otherwise(a))

        pairs = F.transform(F.sequence(first + 1, end - 1),
                            lambda i: F.concat_ws(" ", F.get("marked", i - 1), F.get("marked", i)))
        return F.when(end - first > 1, _bound(F.array_distinct(pairs), closest))

    def windows(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size("pairs") - 1),
                          lambda i: F.array_contains(t["pairs"], F.get("pairs", i)))

        def dense(starts: Column) -> Column:  # enough of the template's pairs follow within its length
            return F.filter(starts, lambda i, k: F.coalesce(F.get(starts, k + t["need"] - 1) < i + t["long"], F.lit(False)))

        def compared(i: Column) -> Column:
            end = F.least(i + t["long"], F.size("pairs"))
            pairs = F.transform(F.sequence(i, end - 1), lambda j: F.get("pairs", j))
            return match(F.array_distinct(pairs), t, F.get("at", i), F.get("at", end), 0)

        return found(F.transform(_bound(starts, dense), compared))

    segments = found(F.transform("ends", lambda end, k: segment(
        F.when(k > 0, F.get("ends", k - 1) + 1).otherwise(F.lit(0)), end)))
    hits = text.select("doc_id", F.when(some, F.concat(segments, F.flatten(F.transform("near", windows)))).alias("hits"))
    kept = hits.select("doc_id", F.when(F.size("hits") > 0, _settled(F.col("hits"))).alias("kept"))
    return kept.select("doc_id", F.coalesce("kept.n", F.lit(0).cast("long")).alias("n_matches"),
                       F.coalesce(F.concat_ws(",", F.array_sort("kept.names")), F.lit("")).alias("licences"),
                       F.col("kept.best").alias("best"), F.coalesce(F.round("kept.dice", 6), F.lit(0.0)).alias("dice"))
