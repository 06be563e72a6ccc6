import os

import pytest

from sheaf.llm import licenses, queries


def test_whole_texts_and_lines(spark, make_docs):
    dressed = "Copyright (c) 2020 Some Body\n\n" + licenses.MIT.upper().replace("SUBLICENSE", "Sub­licence".replace("­", "")).replace(",", " ,")
    texts = [dressed, licenses.MIT + "\nand one more word", licenses.ISC, "Licenced under the Apache License, version 2.0!", "some text\nReleased under the MIT License.\nmore", "MIT", None, "", "licensed under CC BY-NC 4.0", "we speak of a license here"]
    rows = {r["doc_id"]: r for r in licenses.scan(make_docs(texts)).collect()}
    assert [rows[i]["license"] for i in range(len(texts))] == ["MIT", None, "ISC", None, None, None, None, None, None, None]
    assert [rows[i]["notices"] for i in range(3, len(texts))] == [["Apache-2.0"], ["MIT"], [], [], [], ["CC-BY-NC-4.0"], []]


def test_no_text_has_two_licenses(spark):
    texts, notices = licenses.known(spark)
    assert texts.count() == sum(map(len, licenses.TEXTS.values())) + sum(map(len, licenses.DIGESTS.values())) and notices.count() > 200


def test_spellings_beside_each_other_and_long_lines(spark, make_docs):
    texts = ["licence licence copyright owners whilst wilful sub-licence", "license license copyright holder while willful sublicense", "x\nReleased under the MIT License." + " " * 500 + "\ny", "SPDX-License-Identifier: GPL-3.0-or-later"]
    rows = [r for r in licenses.scan(make_docs(texts)).orderBy("doc_id").collect()]
    assert rows[0]["digest"] == rows[1]["digest"]
    assert rows[2]["notices"] == ["MIT"] and rows[3]["notices"] == ["GPL-3.0"]


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no license texts on this machine")
def test_long_licenses_in_other_dress(spark, make_docs):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    whole = {k: open(f"/usr/share/common-licenses/{f}", encoding="utf-8").read() for k, f in names.items()}

    def dress(t):
        t = "\n".join(x.strip() for x in t.upper().splitlines()).replace("SUBLICENSE", "SUBLICENCE").replace("LICENSES", "LICENCES").replace(",", " ;").replace("COPYRIGHT HOLDER ", "COPYRIGHT OWNER ")
        return "Copyright (C) 1999 Nobody At All\n\n" + t

    texts = [*whole.values(), *map(dress, whole.values()), *(t + " more" for t in whole.values()), *(t[: len(t) // 2] for t in whole.values())]
    rows = {r["doc_id"]: r["license"] for r in licenses.scan(make_docs(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == [*whole, *whole, *[None] * (2 * len(whole))]


def test_odd_rows(odd_docs):
    rows = licenses.scan(odd_docs).collect()
    assert len(rows) == 8 and all(r["license"] is None and r["notices"] == [] for r in rows)
    assert licenses.scan(odd_docs.limit(0)).count() == 0


def test_query_finds_the_notices(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    known = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for r in queries.op9_licenses(spark, sf_dir).collect():
        want = sorted({known[x] for x in texts[r["doc_id"]].split("\n") if x in known})
        assert set(want) <= set(filter(None, r["notices"].split(",")))


def test_same_as_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    got = queries.op9_licenses(spark, sf_dir).select("doc_id", "digest", "license", "notices").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.oracle_sql()["op9_licenses"]).fetchall())
