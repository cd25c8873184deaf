"""License scans by canonical digest lookup.

A text is normalised (case, equivalent spellings, copyright lines, punctuation, blanks) and
its SHA-256 is hash-joined to the digests of known licence texts.  Whole texts are looked up,
and so is every line by itself, since a notice is often one line of a page.  The catalogue is
a fixed list of this module (or the caller's), so broadcasting it has a known bound.

Defined cases: null and empty texts, and texts that normalise to nothing, match nothing; rows
with equal ids are looked up each on its own; other columns pass through, and one named
``scan`` is replaced; an empty table gives an empty table.
"""

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import whole

MAX_CATALOGUE = 10_000

# Public licence texts and notices, by SPDX identifier.
LICENSES = [
    ("MIT", 'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
]

_BSD_2 = dict(LICENSES)["BSD-2-Clause"]
# Whole texts and the whole GPL notice, beside the shorter ones above; the folder holds one text per identifier.
WHOLE = [
    *((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))),
    ("BSD-3-Clause", _BSD_2.replace("\n\nTHIS SOFTWARE", "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE")),
    ("GPL-3.0-or-later", dict(LICENSES)["GPL-3.0-or-later"] + "\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
]

# Spellings counted as equal (after lower-casing).
SPELLINGS = [
    ("licence", "license"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("https", "http"),
    ("version", "v"),
]
_BODY = "notice|holder|owner|licen[sc]e|law|statement|interest|disclaimer|treat(?:y|ie)|permission|protection|right|work|claim|and|or|on|in|is|to|of|as|under|for|that|the above"
#: A line that states a year, a sign or a holder, and not a line of a body that happens to begin with these words:
#: what a statement begins with, and what the first two must not go on with (they are apart, as not every engine looks ahead).
STATED = [
    (r"copyright\b[^\S\n]*[^\s,;.-]", rf"copyright[^\S\n]+(?:{_BODY})s?\b"),
    (r"\(c\)", r"\(c\)[^\S\n]+(?:you|if|any|to|for|such|this|in|each|no|all|where|when)\b"),
    ("©|all rights reserved", None),
]
COPYRIGHT_STATEMENT = r"(?m)^[^\S\n]*(?:" + "|".join((f"(?!{no})" if no else "") + f"(?:{yes})" for yes, no in STATED) + r")[^\n]*$"


def normalised(text: Column) -> Column:
    """Lower case, without copyright statements and punctuation, one spelling, single blanks."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT_STATEMENT, " ")
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.btrim(F.regexp_replace(t, r"[^a-z0-9]+", " "), F.lit(" "))


def digest(text: Column) -> Column:
    """Bare lower-case hexadecimal SHA-256 of the normalised text."""
    return F.sha2(normalised(text), 256)


def catalogue(spark: SparkSession, licenses=None) -> DataFrame:
    """license, digest: one row per known text (at most ``MAX_CATALOGUE``)."""
    known = list(licenses or LICENSES + WHOLE)
    if len(known) > MAX_CATALOGUE:
        raise ValueError("the catalogue is broadcast and must stay small")
    rows = spark.range(1).select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("known")) for n, t in known])).alias("r")
    )
    return (
        rows.select("r.license", digest(F.col("r.known")).alias("digest"))
        .groupBy("digest").agg(F.min("license").alias("license"))
    )


def scan_licenses(docs: DataFrame, licenses=None) -> DataFrame:
    """``docs`` with a struct ``scan``: digest, license (whole text; null if unknown), notices (sorted, distinct, of lines)."""
    known = catalogue(docs.sparkSession, licenses)
    pairs = [F.lit(x) for row in known.collect() for x in (row["digest"], row["license"])]
    table = F.create_map(*pairs)
    text = whole(docs["text"])
    joined = docs.withColumn("__digest", digest(text)).join(
        F.broadcast(known.select(F.col("digest").alias("__d"), F.col("license").alias("__license"))),
        F.col("__digest") == F.col("__d"),
        "left",
    )
    found = F.transform(F.split(text, "\n"), lambda x: F.try_element_at(table, digest(x)))
    notices = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != "scan"],
        F.struct(F.col("__digest").alias("digest"), F.col("__license").alias("license"), notices.alias("notices")).alias("scan"),
    )
