"""License scans by canonical digest, in DataFrame operations only.

A text is made canonical: lower case, copyright lines out, equivalent spellings made one, punctuation and white space
levelled. Its digest is looked up among the digests of known license texts by a hash join; so is that of each of its
lines that speaks of a license, among known notices. A match is of a whole text or a whole line, never of a part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import q, settle, without

#: Spellings that count as equal.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "behaviour": "behavior",
    "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center", "colour": "color",
    "copyright holders": "copyright holder", "copyright owner": "copyright holder", "copyright owners": "copyright holder", "defence": "defense", "emphasised": "emphasized", "favour": "favor",
    "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "licenced": "licensed", "licences": "licenses", "licencing": "licensing", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "non commercial": "noncommercial",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "per cent": "percent", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sub licence": "sublicense", "sub license": "sublicense", "sublicence": "sublicense", "sublicenced": "sublicensed", "sublicences": "sublicenses", "sublicencing": "sublicensing",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

#: Texts of licenses, without their copyright lines.
MIT = """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_TWO = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """zlib License
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
TEXTS = {
    "MIT": [MIT, MIT.partition("\n")[2], f"The {MIT}"],
    "ISC": [ISC, ISC.partition("\n")[2]],
    "0BSD": [f"{x}Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{ISC.splitlines()[2]}" for x in ("", "BSD Zero Clause License\n")],
    "BSD-2-Clause": ["\n".join([*x, BSD_HEAD, BSD_ONE, BSD_TWO, BSD_TAIL]) for x in ([], ["BSD 2-Clause License"])],
    "BSD-3-Clause": ["\n".join([*x, BSD_HEAD, BSD_ONE, BSD_TWO, BSD_THREE, BSD_TAIL]) for x in ([], ["BSD 3-Clause License"])],
    "Zlib": [ZLIB, ZLIB.partition("\n")[2]],
    "Unlicense": [UNLICENSE],
    "Apache-2.0": [APACHE_NOTICE],
}
#: Names by which notices call licenses.
NAMES = {
    "MIT": ["MIT License", "MIT"], "ISC": ["ISC License"], "Zlib": ["zlib License"], "Unlicense": ["Unlicense"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"], "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"], "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"], "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"], "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0"], **{f"CC-{k}-{v}": [f"CC {k} {v}"] for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")},
}
#: Identifiers that stand after SPDX-License-Identifier.
IDENTIFIERS = """
0BSD AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0
CC-BY-SA-4.0 EPL-1.0 EPL-2.0 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0 LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0
LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 Unlicense Zlib
""".split()
#: Digests of the canonical forms of longer license texts: whole, and where they have an end of terms, up to it and
#: with it.
DIGESTS = {
    "Apache-2.0": [
        "6074c3536c43b739207170b87d1681477d0f07374ed3d862ba461334cce848e3",
        "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64",
        "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe",
    ],
    "CC0-1.0": [
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    ],
    "GFDL-1.2": [
        "fdbd790ae9850ae81a2c777de181b7ceb77f56f8916bab9409c3a7724c8f131a",
    ],
    "GFDL-1.3": [
        "9af8b09a25e07e574718758cdf5a64581433b2e9f0cd27bd6665cce5b182563b",
    ],
    "GPL-1.0": [
        "b0b451371aa8b1fca2656e1c4adfd20298318818523446f7571338a5b932e23f",
        "446a870fbe7a20405d807d04a8642f55ba2ff4183a84ca8236d78f7718c612c3",
        "59967477eafa5c999df136ce4729e98a72b0bde54cf327c732f475447201a313",
    ],
    "GPL-2.0": [
        "c683128a79af968653f7a06709159e41adcfcb00ca1e8ab9ffa1d516dcf82123",
        "a93fe78d4730818406bfd92d5ca51c742bb44757809e9df2b528ee23601c6446",
        "393d838a3fcdf4be802c0512341c9f00cc4c10adb56ebbf01687ff37049a19dd",
    ],
    "GPL-3.0": [
        "ab0ff01b5102d67da216e91690a50504aebf46513a85db94155933b2db63283f",
        "f5faf9b905f587deca8a69ec8502726a00807a41ff4a410e1f8ecd7b6cc3e134",
        "22fb9eab6c587ba29bf311c60aba8ee70bbd3dc03ec5eecdfb7f3b4188c969cd",
    ],
    "LGPL-2.0": [
        "b64047590f42a52d46a8a93fad9485df2e189694e4b51288546e57ce10e59769",
        "24f90d254e58b80510e11141dd34919c3540d2724873a5956bd674033ae5a36b",
        "2d380dbc5ad94744c5d444af2bdcf1542b0848aa1587d6c7f3efb54e87ce54a5",
    ],
    "LGPL-2.1": [
        "bc7898eef7d53923eff574c7a898468049b8e1e90eef19ba0b8132904dd70a66",
        "161c1b11462a7e927417540b0d51bf241c84e045a9aa72dd5bf5537c35d8d1c1",
        "e8fee7034b6432f7d6c16577b34654c02947180c540389d03e5e06c427f0f4f5",
    ],
    "LGPL-3.0": [
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ],
    "MPL-1.1": [
        "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",
    ],
    "MPL-2.0": [
        "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
    ],
    "Artistic-1.0-Perl": [
        "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    ],
}
#: What stands before the name in a notice.
OPENINGS = ["Licensed under", "Released under", "Distributed under", "This work is licensed under", "This software is licensed under", "This project is licensed under", "This file is licensed under", "SPDX-License-Identifier:"]
SPEAKS = r"(?i)licen[sc]e|released under|distributed under|copyright"


#: Lines that don't count: a copyright sign or word with a year or a sign, and the usual reservation.
UNCOUNTED = (r"(?m)^[^\w\n©]*(?:copyright|\(c\)|©)[^\n]*(?:[0-9]{4}|©|\(c\))[^\n]*$", r"(?m)^\W*all rights reserved\W*$")


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    c = F.lower(text)
    for line in UNCOUNTED:
        c = F.regexp_replace(c, line, " ")
    # two spaces between words, so that each has its own on either side and neighbours are replaced too
    c = F.concat(F.lit(" "), F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        c = F.replace(c, F.lit(_spaced(old)), F.lit(_spaced(new)))
    return F.trim(F.replace(c, F.lit("  "), F.lit(" ")))


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def entries() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(license, text) of license texts, and of notices."""
    texts = [(k, t) for k, all_ in TEXTS.items() for t in all_]
    notices = [(k, f"{o} {the}{n}") for k, names in NAMES.items() for n in names for o in OPENINGS for the in ("", "the ")]
    return texts, notices + [(re.sub("-(only|or-later)$", "", k), f"SPDX-License-Identifier: {k}") for k in IDENTIFIERS]


def known(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(digest, license) of license texts, and of notices: tables of a size that is fixed here."""
    texts, notices = entries()
    frame = lambda rows: spark.createDataFrame(rows, "license string, text string").select(digest(F.col("text")).alias("digest"), "license")
    more = spark.createDataFrame([(d, k) for k, all_ in DIGESTS.items() for d in all_], "digest string, license string")
    one = lambda rows: rows.groupBy("digest").agg(F.min("license").alias("license"))
    return one(frame(texts).union(more)), one(frame(notices))


def sql(table: str) -> str:
    """What scan() gives of (doc_id, text) rows with distinct ids, without the text, as DuckDB SQL."""
    text = lambda v: "'" + v.replace("'", "''") + "'"

    def hashed(c: str) -> str:
        c = f"lower({c})"
        for line in UNCOUNTED:
            c = f"regexp_replace({c}, {text(line)}, ' ', 'g')"
        c = f"' ' || trim(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || ' '"
        for old, new in SPELLINGS.items():
            c = f"replace({c}, {text(_spaced(old))}, {text(_spaced(new))})"
        return f"sha256(trim(replace({c}, '  ', ' ')))"

    rows = ["(values " + ", ".join(f"({text(k)}, {text(t)})" for k, t in part) + ") v(license, t)" for part in entries()]
    more = ", ".join(f"({text(k)}, {text(d)})" for k, all_ in DIGESTS.items() for d in all_)
    pick = lambda r: f"(select {hashed('t')} as digest, min(license) as license from {r} group by 1)"
    return f"""with d as (select doc_id, coalesce(text, '') as text from {table}), notices as {pick(rows[1])},
    texts as (select digest, min(license) as license from (select * from {pick(rows[0])} union all select digest, license from (values {more}) w(license, digest)) group by 1),
    lines as (select doc_id, unnest(string_split(text, chr(10))) as x from d),
    said as (select doc_id, string_agg(distinct n.license, ',' order by n.license) as notices from
        (select doc_id, {hashed('x')} as h from lines where regexp_matches(x, {text(SPEAKS)})) l join notices n on l.h = n.digest group by 1)
    select d.doc_id, {hashed('d.text')} as digest, t.license, coalesce(s.notices, '') as notices
    from d left join texts t on t.digest = {hashed('d.text')} left join said s on s.doc_id = d.doc_id"""


ADDED = ("digest", "license", "notices")


def scan(df: DataFrame, col: str = "text", keep_text: bool = True) -> DataFrame:
    """df with digest (of the canonical whole text), license (of the known text that equals it, or null) and notices (sorted
    distinct licenses of the lines that are known notices).

    Null counts as an empty text: its digest matches nothing. Very long texts are hashed whole. Repeated rows get
    equal results and an empty table gives an empty one. Columns of df named as one of the new ones (in any case) are
    replaced. Without keep_text, col is left out.
    """
    keep = [c for c in without(df, ADDED) if keep_text or c != col]
    text = F.coalesce(F.col(q(col)), F.lit(""))
    lines = F.filter(F.split(text, r"\n"), lambda x: x.rlike(SPEAKS))
    base = df.select(*(F.col(q(c)).alias(f"__keep{i}") for i, c in enumerate(keep)), digest(text).alias("digest"), F.transform(lines, digest).alias("__lines"), F.monotonically_increasing_id().alias("__row"))
    base = settle(base)
    texts, notices = known(df.sparkSession)
    said = base.where(F.size("__lines") > 0).select("__row", F.explode("__lines").alias("digest")).join(F.broadcast(notices), "digest")
    said = said.groupBy("__row").agg(F.array_sort(F.collect_set("license")).alias("notices"))
    out = base.drop("__lines").join(F.broadcast(texts), "digest", "left").join(said, "__row", "left")
    return out.select(*(F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)), "digest", "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))
