"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Shingles are five lower-cased (A-Z) words, hashed with xxhash64. Windows are 1, 4, 16, 64, 256, ... shingles long, up to the longest template,
and start every quarter of their length (the shortest two: at every shingle); the end of a text has a window of its own,
and texts shorter than a window are one. A template is looked for in windows of the shortest length that
holds it, so it fills more than a quarter of one, and over 0.2 of one within an eighth of a window's length of either end.
A window has BANDS bands of one MinHash each: at a similarity of 1/4 all 48 bands miss with a chance of 1e-6
(four windows overlap each place, so it is less), at 0.5 with 4e-15. Retrieved templates are then checked exactly: the
share of the template's distinct shingles (words, not hashes) found in the whole text must reach `least`.

A band collides only on a shingle that text and template share, so only windows that hold a shingle of some template of their length are
hashed; that loses nothing, and a text costs what it shares with templates instead of 48 hashes a shingle.

All of it happens within a text's row, in built-in functions: no row meets another, nothing is shuffled, and hot sources
or copies cost what they weigh. The band keys of all templates are a literal of BANDS numbers a template.

Defined cases: a null text is empty and has no license; empty tables give empty results; repeated rows are scanned
each; a template that occurs more than once counts once; other columns pass through, but for one with the result's name, which gives way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import SPACE

WIDTH, LEAST, BANDS = 5, 0.8, 48

#: Notices and whole texts to look for, by id; callers may pass others, of any length. Public standard phrases and license texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-3-Clause-header": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0-or-later-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Apache-2.0-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "GPL-warranty": 'This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0-header": 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.',
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "all-rights-reserved": "Copyright. All rights reserved. No part may be reproduced without permission.",
}


def word_list(text: Column) -> Column:
    """Lower-cased words of a text (null: none)."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, SPACE), lambda w: w != "")


def _hashes(words: str) -> Column:
    """A hash of each shingle of the column `words`; shorter texts have one of all their words."""
    at = ", ".join(f"{words}[i + {k}]" for k in range(WIDTH))
    return F.expr(f"CASE WHEN size({words}) >= {WIDTH} THEN transform(sequence(0, size({words}) - {WIDTH}), i -> xxhash64({at})) WHEN size({words}) > 0 THEN array(xxhash64({words})) ELSE cast(array() AS array<bigint>) END")


def _shingles(words: str) -> Column:
    """The distinct shingles themselves."""
    return F.expr(f"array_distinct(CASE WHEN size({words}) >= {WIDTH} THEN transform(sequence(0, size({words}) - {WIDTH}), i -> concat_ws(' ', slice({words}, i + 1, {WIDTH}))) WHEN size({words}) > 0 THEN array(concat_ws(' ', {words})) ELSE cast(array() AS array<string>) END)")


def _starts(length: int) -> str:
    """SQL for the starts of the windows of `length` shingles that hold one of the places `at`; n is the number of shingles."""
    step = max(1, length // 4)
    regular = f"filter(transform(sequence(greatest((p - {length - step}) div {step}, 0), p div {step}), k -> k * {step}), s -> s + {length} <= n AND s + {length} > p)"
    last = f"CASE WHEN p >= n - {length} THEN array(greatest(n - {length}, 0)) ELSE cast(array() AS array<int>) END"
    return f"array_distinct(flatten(transform(at, p -> concat({regular}, {last}))))"


def _minhashes(hashes: str, starts: str, length: int) -> str:
    """SQL for each window's MinHash of each band (array<array<bigint>>)."""
    return f"transform({starts}, s -> transform(sequence(0, {BANDS - 1}), b -> array_min(transform(slice({hashes}, s + 1, {length}), h -> xxhash64(h, b)))))"


def _window_length(shingles: int) -> int:
    length = 1
    while length < shingles:
        length *= 4
    return length


def template_keys(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """license, shingles, hashes, window and keys (a MinHash a band) of each template; a fixed list of a few rows."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string").withColumn("words", word_list(F.col("text"))).where(F.size("words") > 0)
    rows = rows.withColumn("hashes", _hashes("words")).withColumn("keys", F.expr(f"transform(sequence(0, {BANDS - 1}), b -> array_min(transform(hashes, h -> xxhash64(h, b))))"))
    out = [r.asDict() for r in rows.select("license", _shingles("words").alias("shingles"), "hashes", "keys").collect()]
    return [r | {"window": _window_length(len(r["shingles"]))} for r in out]


def _longs(values: list[int]) -> str:
    return "array(" + ", ".join(f"{v}L" if v > -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ")"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, name: str = "licenses", text: str = "text") -> DataFrame:
    """docs with `licenses`: array<struct<license, found, total>>, sorted by license; found of total shingles are there."""
    docs = docs.drop(name)
    known = template_keys(docs.sparkSession, templates or TEMPLATES)
    none = F.expr("cast(array() AS array<struct<license: string, found: int, total: int>>)")
    if not known:
        return docs.withColumn(name, none)
    # the input's columns travel as one, so that none can clash with ours
    rows = docs.select(F.struct(*docs.columns).alias("row"), word_list(F.col(text)).alias("words")).withColumn("hashes", _hashes("words")).withColumn("n", F.size("hashes"))
    lengths = sorted({t["window"] for t in known})
    for length in lengths:
        some = _longs(sorted({h for t in known if t["window"] == length for h in t["hashes"]}))
        rows = rows.withColumn(f"own{length}", F.when(F.expr(f"arrays_overlap(hashes, {some})"), F.expr(f"array_intersect(hashes, {some})")))
    for length in lengths:
        rows = rows.withColumn("at", F.when(F.col(f"own{length}").isNotNull(), F.expr(f"filter(sequence(0, n - 1), i -> array_contains(own{length}, hashes[i]))")))
        rows = rows.withColumn(f"starts{length}", F.when(F.col("at").isNotNull(), F.expr(_starts(length)))).drop("at")
        rows = rows.withColumn(f"w{length}", F.when(F.col(f"starts{length}").isNotNull(), F.expr(_minhashes("hashes", f"starts{length}", length))))
    shared = reduce(lambda x, y: x | y, [F.col(f"own{length}").isNotNull() for length in lengths])
    rows = rows.withColumn("shingles", F.when(shared, _shingles("words")))
    verdicts = []
    for t in known:
        retrieved = F.expr(f"exists(w{t['window']}, w -> exists(zip_with(w, {_longs(t['keys'])}, (m, k) -> m = k), x -> x))")
        own = F.array(*[F.lit(s) for s in t["shingles"]])
        found = F.size(F.array_intersect(F.col("shingles"), own))
        entry = F.struct(F.lit(t["license"]).alias("license"), found.alias("found"), F.lit(len(t["shingles"])).alias("total"))
        verdicts.append(F.when(retrieved, F.when(found >= F.lit(least * len(t["shingles"])), entry)))
    licenses = F.when(shared, F.filter(F.array(*verdicts), lambda x: x.isNotNull())).otherwise(none)
    return rows.select("row.*", licenses.alias(name))
