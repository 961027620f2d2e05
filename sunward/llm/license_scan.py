"""Licence scans: Dice coefficient over word bigrams against licence templates (operator 2).

DataFrame operations only. A text is compared as a whole, by its paragraphs and by its lines,
each normalised to lower-case words. Two bags of bigrams of sizes a and b have a Dice
coefficient of at most 2 min(a, b) / (a + b), so a part whose size is outside the bounds of
every template is dropped before its bigrams are listed, and a bigram only meets templates
within bounds of its part. The coefficient is then exact: twice the common bigrams, counted
with repeats, over both sizes.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .decontamination import SEPARATOR, fingerprint
from .shared import lower_ascii, words_of

#: Least Dice coefficient of a match, in hundredths.
THRESHOLD = 80

# Public licence texts and the customary notices of licences.
_WARRANTY = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
             'FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, '
             'WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.')
_BSD_END = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
            'WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, '
            'INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, '
            'OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR '
            'OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.')
_BSD_START = ('Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: '
              '1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. '
              '2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation '
              'and/or other materials provided with the distribution. ')
_GPL = ('This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software '
        'Foundation, either version {} of the License, or (at your option) any later version.')
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the '
                   'License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is '
                   'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing '
                   'permissions and limitations under the License.'),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
                                  "software without specific prior written permission. " + _BSD_END),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GPL.format(2)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL.format(3)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
            "and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
            "notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one "
                "at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def words(text) -> Column:
    return words_of(lower_ascii(text), SEPARATOR)


def template_bigrams(spark: SparkSession, templates=TEMPLATES) -> tuple[DataFrame, list[int]]:
    """One row a different bigram of a template: license, template, size, bigram, times; and the sizes.

    Templates are a list of the caller's, so the table is as small as that list.
    """
    rows = spark.createDataFrame([(name, i, text) for i, (name, text) in enumerate(templates)], "license string, template int, text string")
    cut = rows.select("license", "template", words(F.col("text")).alias("ws")).select("*", (F.size("ws") - 1).alias("size"))
    sizes = sorted({r[0] for r in cut.select("size").collect() if r[0] > 0})
    each = cut.filter("size > 0").select("license", "template", "size", "ws", F.posexplode("ws").alias("at", "w")).filter(F.col("at") < F.col("size"))
    return each.select("license", "template", "size", bigram("ws", "at").alias("bigram")).groupBy("license", "template", "size", "bigram").agg(F.count(F.lit(1)).alias("times")), sizes


def bigram(ws: str, at: str) -> Column:
    return F.xxhash64(F.get(ws, F.col(at)), F.get(ws, F.col(at) + 1))


def bounded(n, size, threshold) -> Column:
    """Whether bags of n and ``size`` bigrams can have the coefficient: 200 min >= threshold (n + size)."""
    return F.least(n, F.lit(size) if isinstance(size, int) else size) * 200 >= (n + size) * threshold


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, print, part, ws: the whole text, then paragraphs and lines that are not the whole."""
    text = F.coalesce("text", F.lit(""))
    cut = F.array_distinct(F.concat(F.array(text), F.split(text, r"\n[\x20\x09-\x0D]*\n"), F.split(text, "\n")))
    each = docs.select("doc_id", fingerprint(F.col("text")).alias("print"), F.posexplode(cut).alias("part", "span"))
    return each.select("doc_id", "print", "part", words(F.col("span")).alias("ws"))


def matches(docs: DataFrame, templates=TEMPLATES, threshold=THRESHOLD) -> DataFrame:
    """doc_id, print, part, license, template, dice: every part of a text that matches a template.

    Several templates may match a part. Rows are told apart by id and text; repeated rows are one.
    """
    bigrams, sizes = template_bigrams(docs.sparkSession, templates)
    n = F.size("ws") - 1
    near = F.lit(False)
    for size in sizes:
        near = near | bounded(n, size, threshold)
    sized = parts(docs).withColumn("n", n).filter((F.col("n") > 0) & near)
    each = sized.select("doc_id", "print", "part", "n", "ws", F.posexplode("ws").alias("at", "w")).filter(F.col("at") < F.col("n"))
    met = each.select("doc_id", "print", "part", "n", bigram("ws", "at").alias("bigram")).join(F.broadcast(bigrams), "bigram").filter(bounded(F.col("n"), F.col("size"), threshold))
    keys = ["doc_id", "print", "part", "n", "license", "template", "size"]
    common = met.groupBy(*keys, "bigram").agg(F.least(F.count(F.lit(1)), F.first("times")).alias("shared")).groupBy(*keys).agg(F.sum("shared").alias("shared"))
    return common.filter(F.col("shared") * 200 >= (F.col("n") + F.col("size")) * threshold).select("doc_id", "print", "part", "license", "template", (F.col("shared") * 2.0 / (F.col("n") + F.col("size"))).alias("dice"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold=THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, license, dice, n_licenses.

    The licence of the best part (ties: first by name), its Dice coefficient, and how many
    different licences match; NULL, NULL and 0 where none does. NULL and empty texts match
    nothing, NULL ids are ids like others, rows that share an id are judged by their own texts.
    """
    found = matches(docs, templates, threshold).groupBy("doc_id", "print").agg(F.min(F.struct((-F.col("dice")).alias("worst"), "license")).alias("best"), F.countDistinct("license").alias("n"))
    found = found.select(F.col("doc_id").alias("d"), F.col("print").alias("p"), "best", "n")
    rows = docs.select("doc_id", fingerprint(F.col("text")).alias("print"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")), "left")
    return out.select("doc_id", F.col("best.license").alias("license"), (-F.col("best.worst")).alias("dice"), F.coalesce("n", F.lit(0)).cast("long").alias("n_licenses"))
