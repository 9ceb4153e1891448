"""Licence scans by sentence rules.

A text is normalised and cut at sentence ends and at line ends; each run of whole lines within a
sentence that is a known licence sentence, on one line or wrapped, becomes its identifier; the sequence of identifiers is matched against ordered rules. All of it happens within
the row, by DataFrame functions: no shuffle and no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.llm.shared import documents, text_or_empty

#: Sentences of public licences, by identifier, each ending at ``.``, ``!``, ``?``, ``;`` or ``:`` before white space, or at a line end.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",
    "apache-basis": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "mit-short": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "MIT License",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "mit-notice": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-short": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-software": "This program is free software:",
    "gpl-free": (
        "you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl3-short": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl3-short": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "bsd-title": "BSD 3-Clause License",
    "bsd-allowed": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."
    ),
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd": "Licensed under CC BY-NC-ND 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "public-domain": "This is free and unencumbered software released into the public domain.",
}

#: Fixed values: (licence, rule, identifiers that must come in this order; others may stand between).
RULES = (
    ("AGPL-3.0", "agpl3-short", ("agpl3-short",)),
    ("Apache-2.0", "apache-header", ("apache-grant", "apache-comply", "apache-copy", "apache-basis")),
    ("Apache-2.0", "apache-short", ("apache-short",)),
    ("BSD-3-Clause", "bsd-text", ("bsd-allowed", "bsd-endorse")),
    ("BSD-3-Clause", "bsd-title", ("bsd-title", "bsd-allowed")),
    ("CC-BY-4.0", "cc-by", ("cc-by",)),
    ("CC-BY-NC-4.0", "cc-by-nc", ("cc-by-nc",)),
    ("CC-BY-NC-ND-4.0", "cc-by-nc-nd", ("cc-by-nc-nd",)),
    ("CC-BY-NC-SA-4.0", "cc-by-nc-sa", ("cc-by-nc-sa",)),
    ("CC-BY-ND-4.0", "cc-by-nd", ("cc-by-nd",)),
    ("CC-BY-SA-4.0", "cc-by-sa", ("cc-by-sa",)),
    ("CC0-1.0", "cc0", ("cc0",)),
    ("GPL-2.0", "gpl2-short", ("gpl2-short",)),
    ("GPL-3.0", "gpl3-notice", ("gpl-software", "gpl-free", "gpl-hope", "gpl-implied")),
    ("GPL-3.0", "gpl3-short", ("gpl3-short",)),
    ("LGPL-3.0", "lgpl3-short", ("lgpl3-short",)),
    ("MIT", "mit-licensed", ("mit-licensed",)),
    ("MIT", "mit-short", ("mit-short",)),
    ("MIT", "mit-text", ("mit-grant", "mit-notice")),
    ("MPL-2.0", "mpl2-form", ("mpl2-form",)),
    ("Unlicense", "public-domain", ("public-domain",)),
)

NOT_WORD = "[^a-z0-9]+"


def known_sentences(sentences: dict[str, str]) -> dict[str, str]:
    """Normalised sentence -> identifier: lower case, runs of anything but a-z and 0-9 as one space."""
    import re

    return {re.sub(NOT_WORD, " ", text.lower()).strip(" "): name for name, text in sentences.items()}


def marked(text: Column) -> Column:
    """The normalised text between ``S``; ``S`` stands for each sentence end in it, ``L`` for each line end.

    Signs and blanks beside a mark are gone, and with them comment marks and empty lines.
    """
    text = F.concat(F.lit(".\n"), F.lower(text), F.lit(".\n"))
    text = F.regexp_replace(text, "[.!?;:][\\x20\\x09-\\x0D][^a-z0-9]*+", "S")
    text = F.regexp_replace(text, "[\n\r][^a-z0-9S]*+", "L")
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9LS]++", " "), " (?=[LS])|L(?=S)", "")


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """The identifiers of the known sentences of a text, in order.

    A known sentence starts and ends at sentence ends or line ends; between its words there may be
    line ends. Where one starts with lines that are a shorter one, both are found.
    """
    ids = {norm: name for norm, name in known_sentences(sentences).items() if norm}
    wrapped = {norm: norm.replace(" ", "[ L]") for norm in ids}
    known = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    any_known = "|".join(wrapped[n] for n in sorted(ids, key=len, reverse=True))
    found = F.regexp_extract_all(marked(text), F.lit(f"(?<=[LS])(?=({any_known})[LS])"), 1)
    heads = [n for n in sorted(ids, key=len) if any(m.startswith(f"{n} ") for m in ids)]

    def own(s: Column) -> Column:
        shorter = [F.when(s.rlike(f"^{wrapped[n]}L"), F.lit(ids[n])) for n in heads]
        return F.array(*shorter, F.try_element_at(known, F.translate(s, "L", " ")))

    return F.filter(F.flatten(F.transform(found, own)), lambda i: i.isNotNull())


def holds_in_order(ids: Column, steps: tuple[str, ...]) -> Column:
    """Whether the steps come in this order: each identifier moves on by one step if it is the next."""
    wanted = F.array(*map(F.lit, steps))
    done = F.aggregate(ids, F.lit(0), lambda at, i: at + F.when(F.get(wanted, at) == i, 1).otherwise(0))
    return done == len(steps)


def licence_scan(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: dict[str, str] = SENTENCES,
    rules: tuple[tuple[str, str, tuple[str, ...]], ...] = RULES,
) -> DataFrame:
    """One row per row of ``df`` whose text fulfils a rule: doc_id, licences, rules, sentence_ids, n_sentences.

    Licences and rules are sorted and comma-joined; sentence_ids holds the identifiers of the known
    sentences in the order of the text. NULL and empty texts fulfil nothing; repeated rows yield a
    row each; a NULL id stays NULL; other columns are not read.
    """
    found = df.select(F.col(id_col).alias("doc_id"), sentence_ids(text_or_empty(text_col), sentences).alias("ids"))
    found = found.filter(F.size("ids") > 0)
    hit = [
        F.when(holds_in_order(F.col("ids"), steps), F.struct(F.lit(licence).alias("l"), F.lit(rule).alias("r")))
        for licence, rule, steps in rules
    ]
    found = found.withColumn("hits", F.filter(F.array(*hit), lambda h: h.isNotNull())).filter(F.size("hits") > 0)
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["l"]))), ",").alias("licences"),
        F.array_join(F.array_sort(F.transform("hits", lambda h: h["r"])), ",").alias("rules"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.size("ids").cast("bigint").alias("n_sentences"),
    )


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(documents(spark, sf_dir))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql() -> str:
    """The scan in DuckDB SQL: rules as patterns over the joined identifiers."""
    known = ", ".join(f"({_quoted(n)}, {_quoted(i)})" for n, i in known_sentences(SENTENCES).items())
    rules = ", ".join(
        f"({_quoted(lic)}, {_quoted(rule)}, {_quoted('(^|,)' + ',(.*,)?'.join(steps) + '(,|$)')})" for lic, rule, steps in RULES
    )
    return rf"""
WITH known(norm, id) AS (VALUES {known}), rules(licence, rule, pattern) AS (VALUES {rules}),
cut AS (
  SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), '[\n\r]+') AS s
  FROM documents),
each AS (
  SELECT doc_id, generate_subscripts(s, 1) AS pos, trim(regexp_replace(lower(unnest(s)), '[^a-z0-9]+', ' ', 'g')) AS norm FROM cut),
ids AS (
  SELECT doc_id, string_agg(id, ',' ORDER BY pos) AS sentence_ids, count(*) AS n_sentences
  FROM each JOIN known USING (norm) GROUP BY doc_id)
SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, string_agg(rule, ',' ORDER BY rule) AS rules,
       sentence_ids, n_sentences
FROM ids JOIN rules ON regexp_matches(sentence_ids, pattern)
GROUP BY doc_id, sentence_ids, n_sentences
"""
