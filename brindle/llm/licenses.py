"""Licence recognition by sentences: known sentences become identifiers, rules match their sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

# Sentences of public licences and notices, normalised, with our identifiers.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT_GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT_NOTICE",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MIT_AS_IS",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MIT_LIABILITY",
    "released under the mit license": "MIT_REF",
    "licensed under the mit license": "MIT_REF",
    "this project is licensed under the mit license": "MIT_REF",
    "this software is released under the mit license": "MIT_REF",
    "spdx license identifier mit": "MIT_SPDX",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_GRANT",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISC_AS_IS",
    "licensed under the isc license": "ISC_REF",
    "spdx license identifier isc": "ISC_SPDX",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD_GRANT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD_SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD_BINARY",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD_ENDORSE",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSD_AS_IS",
    "licensed under the bsd license": "BSD_REF",
    "released under the bsd license": "BSD_REF",
    "licensed under the bsd 3 clause license": "BSD3_REF",
    "released under the bsd 3 clause license": "BSD3_REF",
    "licensed under the bsd 2 clause license": "BSD2_REF",
    "released under the bsd 2 clause license": "BSD2_REF",
    "spdx license identifier bsd 3 clause": "BSD3_SPDX",
    "spdx license identifier bsd 2 clause": "BSD2_SPDX",
    "licensed under the apache license version 2 0": "APACHE_REF",
    "licensed under the apache license version 2 0 the license": "APACHE_HEAD",
    "you may not use this file except in compliance with the license": "APACHE_COMPLY",
    "you may obtain a copy of the license at": "APACHE_COPY",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "APACHE_COPY",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APACHE_AS_IS",
    "see the license for the specific language governing permissions and limitations under the license": "APACHE_LIMITS",
    "released under the apache license version 2 0": "APACHE_REF",
    "licensed under the apache license 2 0": "APACHE_REF",
    "spdx license identifier apache 2 0": "APACHE_SPDX",
    "this work is licensed under the gnu general public license version 3": "GPL3_REF",
    "licensed under the gnu general public license version 3": "GPL3_REF",
    "licensed under the gnu general public license version 2": "GPL2_REF",
    "this work is licensed under the gnu general public license version 2": "GPL2_REF",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3_OR_LATER",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2_OR_LATER",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPL_NO_WARRANTY",
    "see the gnu general public license for more details": "GPL_DETAILS",
    "you should have received a copy of the gnu general public license along with this program": "GPL_COPY",
    "spdx license identifier gpl 3 0 only": "GPL3_SPDX",
    "spdx license identifier gpl 3 0 or later": "GPL3_LATER_SPDX",
    "spdx license identifier gpl 2 0 only": "GPL2_SPDX",
    "licensed under the gnu lesser general public license version 3": "LGPL3_REF",
    "licensed under the gnu affero general public license version 3": "AGPL3_REF",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2_HEAD",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MPL2_COPY",
    "licensed under the mozilla public license version 2 0": "MPL2_REF",
    "licensed under cc by 4 0": "CC_BY_REF",
    "licensed under cc by sa 4 0": "CC_BY_SA_REF",
    "licensed under cc by nc 4 0": "CC_BY_NC_REF",
    "licensed under cc by nd 4 0": "CC_BY_ND_REF",
    "licensed under cc by nc sa 4 0": "CC_BY_NC_SA_REF",
    "licensed under cc by nc nd 4 0": "CC_BY_NC_ND_REF",
    "this work is licensed under a creative commons attribution 4 0 international license": "CC_BY_REF",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CC_BY_SA_REF",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CC_BY_NC_REF",
    "this is free and unencumbered software released into the public domain": "UNLICENSE",
    "this work is released into the public domain": "PUBLIC_DOMAIN",
    "all rights reserved": "ALL_RIGHTS",
}

#: Sentences with a variable part, by their normalised start.
STARTS = {"copyright ": "COPYRIGHT"}

#: Ordered rules: (licence, identifiers in sequence). An earlier rule takes its sentences first.
RULES = [
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS", "MIT_LIABILITY")),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS")),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE")),
    ("ISC", ("ISC_GRANT", "ISC_AS_IS")),
    ("BSD-3-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE", "BSD_AS_IS")),
    ("BSD-3-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE")),
    ("BSD-2-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_AS_IS")),
    ("BSD-2-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY")),
    ("Apache-2.0", ("APACHE_HEAD", "APACHE_COMPLY", "APACHE_COPY", "APACHE_AS_IS", "APACHE_LIMITS")),
    ("Apache-2.0", ("APACHE_HEAD", "APACHE_COMPLY")),
    ("GPL-3.0-or-later", ("GPL3_OR_LATER", "GPL_NO_WARRANTY", "GPL_DETAILS", "GPL_COPY")),
    ("GPL-3.0-or-later", ("GPL3_OR_LATER",)),
    ("GPL-2.0-or-later", ("GPL2_OR_LATER", "GPL_NO_WARRANTY", "GPL_DETAILS", "GPL_COPY")),
    ("GPL-2.0-or-later", ("GPL2_OR_LATER",)),
    ("MPL-2.0", ("MPL2_HEAD", "MPL2_COPY")),
    ("MIT", ("MIT_REF",)),
    ("MIT", ("MIT_SPDX",)),
    ("ISC", ("ISC_REF",)),
    ("ISC", ("ISC_SPDX",)),
    ("BSD-3-Clause", ("BSD3_REF",)),
    ("BSD-3-Clause", ("BSD3_SPDX",)),
    ("BSD-2-Clause", ("BSD2_REF",)),
    ("BSD-2-Clause", ("BSD2_SPDX",)),
    ("BSD-unspecified", ("BSD_REF",)),
    ("Apache-2.0", ("APACHE_REF",)),
    ("Apache-2.0", ("APACHE_SPDX",)),
    ("GPL-3.0-only", ("GPL3_REF",)),
    ("GPL-3.0-only", ("GPL3_SPDX",)),
    ("GPL-3.0-or-later", ("GPL3_LATER_SPDX",)),
    ("GPL-2.0-only", ("GPL2_REF",)),
    ("GPL-2.0-only", ("GPL2_SPDX",)),
    ("LGPL-3.0-only", ("LGPL3_REF",)),
    ("AGPL-3.0-only", ("AGPL3_REF",)),
    ("MPL-2.0", ("MPL2_HEAD",)),
    ("MPL-2.0", ("MPL2_REF",)),
    ("CC-BY-4.0", ("CC_BY_REF",)),
    ("CC-BY-SA-4.0", ("CC_BY_SA_REF",)),
    ("CC-BY-NC-4.0", ("CC_BY_NC_REF",)),
    ("CC-BY-ND-4.0", ("CC_BY_ND_REF",)),
    ("CC-BY-NC-SA-4.0", ("CC_BY_NC_SA_REF",)),
    ("CC-BY-NC-ND-4.0", ("CC_BY_NC_ND_REF",)),
    ("Unlicense", ("UNLICENSE",)),
    ("Public-Domain", ("PUBLIC_DOMAIN",)),
    ("All-Rights-Reserved", ("COPYRIGHT", "ALL_RIGHTS")),
    ("All-Rights-Reserved", ("ALL_RIGHTS",)),
]

#: Every known sentence holds one of these, so a text without any has none (tested).
CUES = "mozilla|licen|copyright|reserved|warrant|permission|redistribut|domain|liab|compliance"
#: Where a sentence may end: at the end of a line, or after a stop within one.
ENDS = r"\n|[.!?;:][ \t\r\f\x0b]+"
#: A known sentence between two ends; it may run over single ends, but not over a blank line.
FOUND = r"(?<=\|)(?:{}|copyright [^|]+)(?=\|)".format("|".join(x.replace(" ", "[ |]") for x in sorted(SENTENCES, key=len, reverse=True)))


def sentence_ids(text: Column) -> Column:
    """Identifiers of a text's known sentences, in order; wrapped lines and comment marks are joined."""
    known = F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))

    def identify(s: Column) -> Column:
        found = known[F.replace(s, F.lit("|"), F.lit(" "))]
        for start, name in STARTS.items():
            found = F.coalesce(found, F.when(s.startswith(start), F.lit(name)))
        return found

    s = F.translate(F.lower(text), "\x01\x02", "  ")
    s = F.regexp_replace(s, r"(?m)^[^a-z0-9\n]*(?:dnl|rem)\b", "")
    s = F.regexp_replace(s, r"\n[^a-z0-9\n]*\n[^a-z0-9]*", "\x02")
    s = F.regexp_replace(s, ENDS, "\x01")
    s = F.regexp_replace(s, r"[^a-z0-9\x01\x02]+", " ")
    s = F.regexp_replace(s, r"[ \x01\x02]*\x02[ \x01\x02]*", "||")
    s = F.regexp_replace(s, r"[ \x01]*\x01[ \x01]*", "|")
    s = F.concat(F.lit("|"), F.btrim(s), F.lit("|"))
    return F.array_compact(F.transform(F.regexp_extract_all(s, F.lit(FOUND), F.lit(0)), identify))


def match_rules(ids: Column) -> Column:
    """struct(licenses, rest): licences by ordered rules, and the identifiers no rule took.

    Identifiers stand in angle brackets side by side; a rule takes its sequence wherever that
    stands, and leaves a bar so that what was apart does not become adjacent.
    """
    start = F.concat(F.lit(""), F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{x}>" for x in seq)).alias("seq")) for name, seq in RULES))
    zero = F.struct(start.alias("s"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["s"], rule["seq"])
        return F.struct(
            F.when(hit, F.replace(acc["s"], rule["seq"], F.lit("|"))).otherwise(acc["s"]).alias("s"),
            F.when(hit, F.array_union(acc["names"], F.array(rule["name"]))).otherwise(acc["names"]).alias("names"),
        )

    return F.aggregate(rules, zero, step)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_license_sentences, licenses (in rule order) and unmatched.

    Null and empty texts have no sentence. Only texts with a cue are split; the rest are told
    by one pass of a regex, so no row is left out. A text of any length is read whole. Rows are
    independent: repeated rows, ties and null ids pass through.
    """
    df = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("t"))
    none = F.array().cast("array<string>")
    df = df.select("doc_id", F.when(F.lower("t").rlike(CUES), sentence_ids(F.col("t"))).otherwise(none).alias("ids"))
    empty = F.struct(F.lit("").alias("s"), none.alias("names"))
    df = df.withColumn("m", F.when(F.size("ids") > 0, match_rules(F.col("ids"))).otherwise(empty))
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_license_sentences"),
        F.array_join("m.names", ",").alias("licenses"),
        F.regexp_replace("m.s", r"\|+", "").alias("unmatched"),
    )


def scan_sql() -> str:
    """The same scan for DuckDB, whose regular expressions know no look-around."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in SENTENCES.items())
    starts = " ".join(f"WHEN starts_with(n.s, {quoted(k)}) THEN {quoted(v)}" for k, v in STARTS.items())
    steps, names = ["ids AS s0"], []
    for i, (name, seq) in enumerate(RULES):
        pattern = quoted("".join(f"<{x}>" for x in seq))
        steps.append(f"replace(s{i}, {pattern}, '|') AS s{i + 1}")
        names.append(f"CASE WHEN contains(s{i}, {pattern}) THEN {quoted(name)} END")
    # every end is written '><', so that a sentence has its own two and matches take nothing else's
    known = "|".join(x.replace(" ", "(?: |><)") for x in sorted(SENTENCES, key=len, reverse=True))
    starts_too = "|".join(f"{x}[^<>]+" for x in STARTS)
    return f"""
WITH known(s, id) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS r, doc_id, translate(lower(text), chr(1) || chr(2), '  ') AS t FROM documents),
joined AS (SELECT r, doc_id, regexp_replace(regexp_replace(t, '(?m)^[^a-z0-9\\n]*(?:dnl|rem)\\b', '', 'g'), '\\n[^a-z0-9\\n]*\\n[^a-z0-9]*', chr(2), 'g') AS t FROM docs),
ended AS (SELECT r, doc_id, regexp_replace(regexp_replace(t, '\\n|[.!?;:][ \\t\\r\\f\\x0b]+', chr(1), 'g'), '[^a-z0-9\\x01\\x02]+', ' ', 'g') AS t FROM joined),
marked AS (SELECT r, doc_id, regexp_replace(regexp_replace(t, '[ \\x01\\x02]*\\x02[ \\x01\\x02]*', '><><', 'g'), '[ \\x01]*\\x01[ \\x01]*', '><', 'g') AS t FROM ended),
lines AS (SELECT r, doc_id, regexp_extract_all('<' || trim(t) || '>', '<(?:{known}|{starts_too})>') AS ss FROM marked),
n AS (SELECT r, unnest(ss) AS m, generate_subscripts(ss, 1) AS k FROM lines),
parts AS (SELECT r, k, replace(m[2:-2], '><', ' ') AS s FROM n),
found AS (SELECT n.r, n.k, coalesce(known.id, CASE {starts} END) AS id FROM parts n LEFT JOIN known ON n.s = known.s),
ids AS (SELECT r, count(id) AS c, string_agg('<' || id || '>', '' ORDER BY k) AS ids FROM found WHERE id IS NOT NULL GROUP BY r),
base AS (SELECT doc_id, coalesce(c, 0) AS c, coalesce(ids, '') AS ids FROM lines LEFT JOIN ids USING (r)),
s AS (SELECT *, {", ".join(steps)} FROM base)
SELECT doc_id, c AS n_license_sentences,
       array_to_string(list_distinct_ordered, ',') AS licenses,
       replace(s{len(RULES)}, '|', '') AS unmatched
FROM (SELECT *, [x FOR x, i IN named IF x IS NOT NULL AND list_position(named, x) = i] AS list_distinct_ordered
      FROM (SELECT *, [{", ".join(names)}] AS named FROM s))
"""
