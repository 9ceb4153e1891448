"""Licence scans: rules by hand, the query against its SQL on odd rows."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from roadgrain.llm import licences

MIT = f"{licences.SENTENCES['mit-title']}\n\nCopyright 2020 Someone\n\n{licences.SENTENCES['mit-grant']}\n\n{licences.SENTENCES['mit-notice']}"


def test_rules_match_in_order(docs):
    swapped = "\n".join(licences.SENTENCES[i] for i in ("bsd-endorse", "bsd-allowed"))
    rows = [
        (1, "Some words. Released under   the mit licEnse!  More."),
        (2, MIT),
        (3, swapped),
        (4, swapped + "\n" + licences.SENTENCES["bsd-endorse"]),
        (5, "It was not released under the MIT License."),
        (6, " ".join(licences.SENTENCES[i] for i in ("apache-grant", "apache-comply", "apache-copy", "apache-basis"))),
        (7, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."),
    ]
    found = {r["doc_id"]: r for r in licences.licence_scan(docs(rows)).collect()}
    assert {i: (r["licences"], r["rules"]) for i, r in found.items()} == {
        1: ("MIT", "mit-short"),
        2: ("MIT", "mit-text"),
        4: ("BSD-3-Clause", "bsd-text"),
        6: ("Apache-2.0", "apache-header"),
        7: ("CC-BY-NC-4.0", "cc-by-nc"),
    }
    assert found[2]["sentence_ids"] == "mit-title,mit-grant,mit-notice" and found[7]["n_sentences"] == 2


WRAPPED = {
    "apache-header": """/*
 * Copyright 2020 Someone
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */""",
    "gpl3-notice": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.""",
    "cc0": "To the extent possible under law, the author has waived all copyright\r\nand related rights to this work.",
}


def test_wrapped_licences_are_found(docs):
    import textwrap

    texts = dict(WRAPPED)
    for rule, steps in (("mit-text", ("mit-title", "mit-grant", "mit-notice")), ("bsd-text", ("bsd-allowed", "bsd-endorse"))):
        texts[rule] = "\n\n".join(textwrap.fill(licences.SENTENCES[i], 75) for i in steps)
    names = list(texts)
    found = {names[r["doc_id"]]: r for r in licences.licence_scan(docs(enumerate(texts.values()))).collect()}
    assert {n: r["rules"] for n, r in found.items()} == {n: n for n in names}
    assert found["mit-text"]["sentence_ids"] == "mit-title,mit-grant,mit-notice"
    assert found["apache-header"]["sentence_ids"] == "apache-grant,apache-comply,apache-copy,apache-basis"


def test_lines_count_by_themselves_too(docs):
    rows = [
        (1, 'Licensed under the Apache License, Version 2.0\n(the "License"); and more'),
        (2, "Released under. the MIT License."),
        (3, "Not released under the\nMIT License."),
        (4, "Words\nreleased under\nthe MIT License\nwords"),
    ]
    ids = docs(rows).select("doc_id", licences.sentence_ids(F.col("text")).alias("ids")).collect()
    assert {r["doc_id"]: r["ids"] for r in ids} == {1: ["apache-short", "apache-grant"], 2: [], 3: ["mit-title"], 4: ["mit-short"]}


def test_padded_sentences_are_found(docs):
    rows = [(1, "Released under" + " " * 5_000 + "the MIT License."), (2, "=" * 5_000 + " Released under the MIT License " + "=" * 5_000)]
    assert {r["doc_id"]: r["rules"] for r in licences.licence_scan(docs(rows)).collect()} == {1: "mit-short", 2: "mit-short"}


def test_every_sentence_is_recognised_by_itself(docs):
    names = list(licences.SENTENCES)
    found = docs([(i, licences.SENTENCES[n]) for i, n in enumerate(names)])
    ids = found.select("doc_id", licences.sentence_ids(found["text"]).alias("ids")).collect()
    missed = [names[r["doc_id"]] for r in ids if r["ids"] != [names[r["doc_id"]]]]
    assert missed == []


def test_odd_rows(odd, empty):
    assert licences.licence_scan(empty).count() == 0
    assert licences.licence_scan(odd).count() == 0


def test_query_equals_its_sql(docs):
    rows = [(i, f"words here. {s} Tail? {t}") for i, (s, t) in enumerate(zip(licences.SENTENCES.values(), [*list(licences.SENTENCES.values())[1:], ""], strict=True))]
    rows += [(100, None), (101, ""), (102, MIT)]
    df = docs(rows)
    documents = df.select("doc_id", "text").toPandas()  # noqa: F841
    want = duckdb.sql(licences.sql()).df()
    got = licences.licence_scan(df).toPandas()[list(want.columns)]
    key = ["doc_id"]
    assert got.astype(str).sort_values(key).values.tolist() == want.astype(str).sort_values(key).values.tolist()
    assert len(got) > 20
