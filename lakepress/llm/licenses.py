"""License scan by diagonal voting, in DataFrame functions only (operator 9).

Every template and every text is a row of words. All rolling word k-gram hashes of the texts are joined with the
template places of equal hashes; a hit votes for the diagonal (text place minus template place). Votes are gathered
by text, template and diagonal, neighbouring diagonals (words put in or left out) are merged in bands of bounded
width, and a span is verified by the share of the template's places that voted, each counted once however often its
words stand in the span. Fixed phrases must stand word for word: all their k-grams on one diagonal.

The template table is fixed and small (under two thousand rows), so it is broadcast. Each text adds one marker row to
its k-grams that a template row of its own matches: so texts without a hit, and those with fewer than k words, come
through the same join and sums, and no text is read twice. Sums are by row, so no key is hot.

Defined results: null and empty texts have no words; ids may be null or repeated, each row gets its own result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


K = 3
#: Phrases that must stand word for word, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices that are found from a share of their words on.
NOTICES = {
    "gpl-3": [
        "this work is licensed under the gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "gpl-2": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"],
    "apache-2": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc": ["this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"],
}
#: More templates of the same kinds: the whole texts of short licenses, and the notices that long ones ask for.
TEXTS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "boost": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "gpl-2": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc.""",
    "lgpl-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "agpl-3": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text):
    """Words of ASCII letters, A-Z in lower case, digits and characters beyond ASCII; null for null."""
    return F.array_remove(F.split(F.translate(F.col(text), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _gram(w, i, k: int):
    return F.xxhash64(*[F.element_at(w, i + 1 + j) for j in range(k)])


def _grams(w, k: int):
    """Rolling k-gram hashes of an array of words; empty if it is shorter."""
    n = F.size(w) - k
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: _gram(w, i, k))).otherwise(F.array().cast("array<bigint>"))


def _templates() -> list[tuple[int, str, bool, list[str]]]:
    rows = [(i, label, True, text.split()) for i, (text, label) in enumerate(PHRASES.items())]
    rows += [(len(PHRASES) + i, label, False, t.split()) for i, (label, t) in enumerate([*((a, t) for a, ts in NOTICES.items() for t in ts), *((a, " ".join(_words(t))) for a, t in TEXTS.items())])]
    return rows


def templates(spark, k: int = K) -> DataFrame:
    """(h, tid, label, base, t_grams, t_pos) for every k-gram of every phrase and notice, and the marker's row."""
    rows = _templates()
    t = spark.createDataFrame(rows, "tid int, label string, base boolean, w array<string>")
    t = t.select("tid", "label", "base", _grams(F.col("w"), k).alias("g"))
    t = t.select("tid", "label", "base", F.size("g").alias("t_grams"), F.posexplode("g").alias("t_pos", "h"))
    marker = spark.createDataFrame([(-1, None, False, 0, 0)], "tid int, label string, base boolean, t_grams int, t_pos int").withColumn("h", _marker())
    return t.unionByName(marker)


def _marker():
    return F.xxhash64(F.lit("a row of its own"), F.lit(0))


def license_scan(docs: DataFrame, share: float = 0.6, slack: int = 4, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) per row of docs.

    spans: label:first:end of each verified span, in words. score: the largest share of a template found.
    """
    spark = docs.sparkSession
    t = F.broadcast(templates(spark, k))
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(text_col).alias("w"))
    d = d.select("row", "doc_id", F.coalesce(F.size("w"), F.lit(0)).alias("n"), F.coalesce(_grams(F.col("w"), k), F.array().cast("array<bigint>")).alias("g"))
    d = d.select("row", "doc_id", F.when(F.col("n") > 0, F.col("n")).otherwise(0).cast("long").alias("n_words"), F.posexplode(F.concat(F.array(_marker()), "g")).alias("at", "h"))
    hits = d.join(t, "h").repartition("row").select("row", "doc_id", "n_words", "tid", "label", "base", "t_grams", "t_pos", (F.col("at") - 1).alias("place"), (F.col("at") - 1 - F.col("t_pos")).alias("diag"))
    votes = hits.groupBy("row", "doc_id", "n_words", "tid", "label", "base", "t_grams", "diag").agg(F.collect_set("t_pos").alias("at"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    # neighbouring diagonals meet in bands, each of them in two that overlap, so that a span drifts by a bounded number
    # of words; a phrase has its diagonal alone
    width = F.lit(slack) + F.floor(F.col("t_grams") / 8).cast("int")
    band = F.floor(F.col("diag") / width).cast("int")
    banded = votes.withColumn("band", F.explode(F.when(F.col("base") | (F.col("tid") < 0), F.array("diag")).otherwise(F.array(band, band + 1))))
    # every place of a template votes once in a band, however often its words stand there
    spans = banded.groupBy("row", "doc_id", "n_words", "tid", "label", "base", "t_grams", "band").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("votes"), F.min("lo").alias("first"), (F.max("hi") + k).alias("end")
    )
    spans = spans.withColumn("part", F.when(F.col("tid") >= 0, F.col("votes") / F.col("t_grams")))
    found = F.when(F.col("base"), F.col("votes") == F.col("t_grams")).otherwise(F.col("part") >= share)
    # of templates that are much alike, the one found best stands for the place. Only spans that were found, and each
    # text's marker, go on; no span is longer than its template, two bands and a k-gram, so any that overlaps another
    # begins within that many words of it
    spans = spans.where(found | (F.col("tid") < 0))
    longest = max(len(w) + 2 * (slack + len(w) // 8) for _, _, _, w in _templates()) + k
    by = Window.partitionBy("row", "doc_id", "n_words").orderBy("first").rangeBetween(-longest, longest)
    near = F.collect_list(F.when(~F.col("base") & found, F.struct("label", "part", "first", "end"))).over(by)
    part, first, end, label = F.col("part"), F.col("first"), F.col("end"), F.col("label")
    spans = spans.withColumn("near", near)
    beaten = F.exists("near", lambda o: (o["label"] != label) & (o["part"] > part) & (2 * (F.least(o["end"], end) - F.greatest(o["first"], first)) >= end - first))
    found = found & (F.col("base") | ~beaten)
    base = F.col("base") & found
    out = spans.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(found, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("part"))), F.lit(0.0)).alias("score"),
        F.array_join(F.array_sort(F.collect_set(F.when(found, F.concat_ws(":", "label", "first", "end")))), ",").alias("spans"),
    )
    return out.drop("row")
