from runloom.llm.queries import op9_license_bands

SF = "/root/testdata/sf0.1"
#: The kinds of licence line in the tables, and the template of each.
LINES = {
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
    "All rights reserved.": "reserved-short",
}


def test_every_licence_line_of_the_table_is_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {(r.doc_id, name) for r in docs for line, name in LINES.items() if r.text and line in (x.strip() for x in r.text.split("\n"))}
    got = {(r.doc_id, r.license) for r in op9_license_bands(spark, SF).select("doc_id", "license").collect()}
    assert {name for _, name in want} == set(LINES.values()) and len(want) >= 300
    assert want <= got
