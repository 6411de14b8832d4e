"""Licence scans by recognised sentences.

Texts are cut into sentences, the sentences normalised (lower case, runs of other
characters than letters and digits as one space), and looked up among known licence
sentences, by themselves and as runs of neighbours, so that a sentence is known however its lines are
wrapped or marked as comments. A sentence within a longer known one doesn't count. The identifiers of a text's known sentences, in their order, are then matched
against rules, each an ordered sequence of identifiers; the longest rule that begins at a
sentence is taken. DataFrame and SQL functions only.

Defined results: null and empty texts, and those without a known sentence, give no rows; rows with the same
doc_id and text count once, those with the same doc_id and different texts each by themselves; null doc_ids
are kept; other columns are ignored. The catalogue is configuration: more than ``MAX_SENTENCES``
is an error, which bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_column

MAX_SENTENCES = 100_000
SENTENCES: Mapping[str, str] = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-notice-you": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "mit-notice": "Released under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0",
    "all-rights": "All rights reserved",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "cc0-notice": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-bsd-2-clause": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-bsd-3-clause": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-isc": "SPDX-License-Identifier: ISC",
    "spdx-zlib": "SPDX-License-Identifier: Zlib",
    "spdx-bsl-1.0": "SPDX-License-Identifier: BSL-1.0",
    "spdx-mpl-2.0": "SPDX-License-Identifier: MPL-2.0",
    "spdx-epl-2.0": "SPDX-License-Identifier: EPL-2.0",
    "spdx-unlicense": "SPDX-License-Identifier: Unlicense",
    "spdx-cc0-1.0": "SPDX-License-Identifier: CC0-1.0",
    "spdx-gpl-2.0-only": "SPDX-License-Identifier: GPL-2.0-only",
    "spdx-gpl-2.0-or-later": "SPDX-License-Identifier: GPL-2.0-or-later",
    "spdx-gpl-3.0-only": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-gpl-3.0-or-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-lgpl-2.1-only": "SPDX-License-Identifier: LGPL-2.1-only",
    "spdx-lgpl-2.1-or-later": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "spdx-lgpl-3.0-only": "SPDX-License-Identifier: LGPL-3.0-only",
    "spdx-lgpl-3.0-or-later": "SPDX-License-Identifier: LGPL-3.0-or-later",
    "spdx-agpl-3.0-only": "SPDX-License-Identifier: AGPL-3.0-only",
    "spdx-agpl-3.0-or-later": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "spdx-cc-by-4.0": "SPDX-License-Identifier: CC-BY-4.0",
    "spdx-cc-by-sa-4.0": "SPDX-License-Identifier: CC-BY-SA-4.0",
    "spdx-cc-by-nc-4.0": "SPDX-License-Identifier: CC-BY-NC-4.0",
}
#: Licence, and the identifiers in order.
RULES: Sequence[tuple[str, tuple[str, ...]]] = (
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-notice-you",)),
    ("Apache-2.0", ("apache-notice-you", "apache-copy", "apache-warranty", "apache-see")),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-grant", "mit-keep", "mit-as-is")),
    ("MIT", ("mit-grant",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("Proprietary", ("all-rights",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("Unlicense", ("unlicense",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("Apache-2.0", ("spdx-apache-2.0",)),
    ("MIT", ("spdx-mit",)),
    ("BSD-2-Clause", ("spdx-bsd-2-clause",)),
    ("BSD-3-Clause", ("spdx-bsd-3-clause",)),
    ("ISC", ("spdx-isc",)),
    ("Zlib", ("spdx-zlib",)),
    ("BSL-1.0", ("spdx-bsl-1.0",)),
    ("MPL-2.0", ("spdx-mpl-2.0",)),
    ("EPL-2.0", ("spdx-epl-2.0",)),
    ("Unlicense", ("spdx-unlicense",)),
    ("CC0-1.0", ("spdx-cc0-1.0",)),
    ("GPL-2.0-only", ("spdx-gpl-2.0-only",)),
    ("GPL-2.0-or-later", ("spdx-gpl-2.0-or-later",)),
    ("GPL-3.0-only", ("spdx-gpl-3.0-only",)),
    ("GPL-3.0-or-later", ("spdx-gpl-3.0-or-later",)),
    ("LGPL-2.1-only", ("spdx-lgpl-2.1-only",)),
    ("LGPL-2.1-or-later", ("spdx-lgpl-2.1-or-later",)),
    ("LGPL-3.0-only", ("spdx-lgpl-3.0-only",)),
    ("LGPL-3.0-or-later", ("spdx-lgpl-3.0-or-later",)),
    ("AGPL-3.0-only", ("spdx-agpl-3.0-only",)),
    ("AGPL-3.0-or-later", ("spdx-agpl-3.0-or-later",)),
    ("CC-BY-4.0", ("spdx-cc-by-4.0",)),
    ("CC-BY-SA-4.0", ("spdx-cc-by-sa-4.0",)),
    ("CC-BY-NC-4.0", ("spdx-cc-by-nc-4.0",)),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that goes on in lower case is one sentence with the line before.
WRAPPED = r"[ \t]*\r?\n[ \t]*([a-z])"
END = r"[.!?]+(?:\s|\z)|[\r\n]+"


def sentences(text: Column) -> Column:
    """The sentences as they stand, those without letters and digits left out."""
    return F.filter(F.split(F.regexp_replace(text, WRAPPED, " $1"), END), lambda s: s.rlike("[A-Za-z0-9]"))


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))


def scan(docs: DataFrame, known: Mapping[str, str] = SENTENCES, rules: Sequence = RULES) -> DataFrame:
    """doc_id, license, sentence (place among the text's sentences, from 0), sentences (of the rule), for each place where a rule begins."""
    if len(known) > MAX_SENTENCES or len(rules) > MAX_SENTENCES:
        raise ValueError(f"more than {MAX_SENTENCES} sentences or rules")
    spark = docs.sparkSession
    catalogue = spark.createDataFrame(list(known.items()), "id string, sentence string").select("id", normal(F.col("sentence")).alias("known"))
    catalogue = catalogue.withColumn("word", F.substring_index("known", " ", 1))
    begin = sorted({r.word for r in catalogue.select("word").distinct().collect()})
    # each part has a word, so that no known sentence has more parts
    most = max((len(v.split()) + sum(not c.isalnum() for c in v) for v in known.values()), default=0) + 1
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    # bound once as a variable of the outer transform; "|" stands where a part ends
    runs = lambda parts: F.filter(
        F.transform(parts, lambda x, i: F.struct(i.alias("at"), F.when(F.substring_index(x, " ", 1).isin(begin), F.array_join(F.slice(parts, i + 1, F.lit(most)), "|")).alias("run"))),
        lambda x: x["run"].isNotNull(),
    )
    found = F.transform(F.array(F.transform(sentences(F.col("text")), normal)), runs)[0]
    parts = own.select("doc_id", F.xxhash64("text").alias("h"), F.inline(found))
    parts = parts.withColumn("word", F.regexp_extract("run", "^[a-z0-9]+", 0))
    size = F.length("known")
    whole = F.translate("run", "|", " ").startswith(F.col("known")) & F.substring(F.col("run"), size + 1, F.lit(1)).isin("", "|")
    hits = parts.join(F.broadcast(catalogue), "word").where(whole)
    hits = hits.select("doc_id", "h", "at", "id", (F.col("at") + size - F.length(F.translate(F.substring(F.col("run"), F.lit(1), size), "|", ""))).alias("last")).distinct()
    text = Window.partitionBy("doc_id", "h")
    before = F.max("last").over(text.orderBy("at").rangeBetween(Window.unboundedPreceding, -1))
    same = F.max("last").over(Window.partitionBy("doc_id", "h", "at"))
    hits = hits.withColumn("before", before).withColumn("same", same).where("last = same and (before is null or before < last)")
    inorder = hits.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("at", "id"))).alias("ids"))
    table = spark.createDataFrame([(name, list(ids), ids[0], len(ids)) for name, ids in rules], "license string, rule array<string>, first string, n int")
    begun = inorder.select("doc_id", "h", "ids", F.posexplode("ids").alias("k", "s")).select("doc_id", "h", "ids", "k", "s.at", F.col("s.id").alias("first"))
    fits = begun.join(F.broadcast(table), "first").where("slice(ids.id, k + 1, n) = rule")
    best = fits.groupBy("doc_id", "h", "at").agg(F.max_by(F.struct("license", "n"), F.struct("n", "license")).alias("x"))
    return best.select("doc_id", F.col("x.license").alias("license"), F.col("at").cast("int").alias("sentence"), F.col("x.n").alias("sentences"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The scan where each text has one rule sentence a place; sequences are checked rule by rule."""
    norm = lambda c: f"trim(regexp_replace(translate({c}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    known = ", ".join(f"({_quoted(k)}, {norm(_quoted(v))})" for k, v in SENTENCES.items())
    rules = ", ".join(f"({_quoted(name)}, [{', '.join(map(_quoted, ids))}])" for name, ids in RULES)
    return rf"""
with known(id, sentence) as (values {known}), rules(license, ids) as (values {rules}),
d as (select distinct doc_id, regexp_replace(coalesce(text, ''), '[ \t]*\r?\n[ \t]*([a-z])', ' \1', 'g') as text from documents),
s as (select doc_id, text, list_filter(regexp_split_to_array(text, '[.!?]+(?:[\t\n\v\f\r ]|\z)|[\r\n]+'), lambda x: regexp_matches(x, '[A-Za-z0-9]')) as parts from d),
e as (select doc_id, text, unnest(parts) as part, unnest(range(len(parts))) as "at" from s),
h as (select doc_id, text, "at", id from e join known on {norm('part')} = known.sentence),
o as (select doc_id, text, list(id order by "at") as ids, list("at" order by "at") as places from h group by all),
b as (select doc_id, text, ids, places, unnest(range(len(ids))) as k from o),
f as (select doc_id, text, places[k + 1] as "at", license, len(rules.ids) as n from b join rules on list_slice(b.ids, k + 1, k + len(rules.ids)) = rules.ids),
w as (select *, row_number() over (partition by doc_id, text, "at" order by n desc, license desc) as r from f)
select doc_id, license, cast("at" as integer) as sentence, cast(n as integer) as sentences from w where r = 1
"""
