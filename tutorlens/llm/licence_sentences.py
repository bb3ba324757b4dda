"""Licence scan by sentence rules. DataFrame functions only.

Texts are normalised (lower case, runs of other characters than letters and digits become one space, so that line breaks
and comment marks go) and known licence sentences are found in them wherever they stand, the longest first; titles count
only where a line or sentence begins and ends. Rules name a licence and the identifiers that must follow each other; others may
stand between and stay for later rules. Rules are tried in order and a match uses its identifiers up, so a longer licence
goes before one that is part of it. Equal identifiers in a row count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Identifiers and normalised sentences of public licence texts and notices.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-title": "apache license version 2 0",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-notice": "released under the mit license",
    "mit-notice-2": "licensed under the mit license",
    "mit-title": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc0": "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "boost": "distributed under the boost software license version 1 0",
}
# Rules in the order they are tried: licence, identifiers in sequence.
RULES = [
    ("Apache-2.0", ("apache-notice", "apache-use", "apache-copy", "apache-basis")), ("Apache-2.0", ("apache-notice",)), ("Apache-2.0", ("apache-title",)),
    ("MIT", ("mit-title", "mit-grant", "mit-keep", "mit-as-is")), ("MIT", ("mit-grant", "mit-keep", "mit-as-is")), ("MIT", ("mit-grant",)), ("MIT", ("mit-notice",)), ("MIT", ("mit-notice-2",)), ("MIT", ("mit-title",)),
    ("ISC", ("isc-grant", "isc-as-is")), ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is")), ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0", ("gpl-free", "gpl-hope")), ("GPL-2.0", ("gpl2-free", "gpl-hope")), ("GPL-3.0", ("gpl-free",)), ("GPL-2.0", ("gpl2-free",)), ("GPL-3.0", ("gpl3-notice",)), ("LGPL-2.1", ("lgpl-free",)),
    ("MPL-2.0", ("mpl-notice",)), ("CC-BY-NC-4.0", ("cc-by-nc",)), ("CC-BY-NC-4.0", ("cc-by-nc-long",)), ("CC-BY-SA-4.0", ("cc-by-sa",)), ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-4.0", ("cc-by",)), ("CC-BY-4.0", ("cc-by-long",)), ("CC0-1.0", ("cc0",)), ("Unlicense", ("unlicense",)), ("BSL-1.0", ("boost",)),
]
# The same for the search in texts; the SQL form has the ones above only.
FURTHER = {
    "apache-title-date": "apache license version 2 0 january 2004",
    "apache-copy-https": "you may obtain a copy of the license at https www apache org licenses license 2 0",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
    "lgpl2-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl3-free-2": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
}
FURTHER_RULES = [
    ("Apache-2.0", ("apache-title-date",)), ("Apache-2.0", ("apache-use", "apache-copy", "apache-basis")), ("Apache-2.0", ("apache-copy-https",)), ("GPL-2.0", ("gpl2-only",)),
    ("LGPL-2.0", ("lgpl2-free",)), ("LGPL-3.0", ("lgpl3-free",)), ("LGPL-3.0", ("lgpl3-free-2",)), ("AGPL-3.0", ("agpl-free",)),
]
#: Short enough to be part of other prose ("compatible with the Apache License, version 2.0").
TITLES = ("apache-title", "mit-title")
#: Every known sentence has one of these, so other texts need no splitting; and where sentences end.
CUE, SENTENCE_END = "licen|permi|redistrib|warrant|public domain|provided", r"[.!?;:]+[ \t\r\n]+|\n[ \t\r]*\n"


def _search() -> str:
    """Matches a known sentence in a stream of words with | where a line or sentence ends."""
    known = sorted(((v, k) for k, v in (SENTENCES | FURTHER).items()), key=lambda x: -len(x[0]))
    words = [v.replace(" ", r" (?:\| )?") for v, _ in known]
    return r"(?<= )(?<! (?:not|nor|never) )(?:" + "|".join(rf"(?<=\| ){w}(?= \|)" if k in TITLES else w for w, (_, k) in zip(words, known, strict=True)) + ")(?= )"


def _known(lower: Column) -> Column:
    """Identifiers of the known sentences in a lower-case text, in order."""
    bare = F.regexp_replace(lower, r"(?m)^[ \t]*(?:dnl|rem)(?=[ \t])", "")
    stream = F.concat(F.lit("|"), F.regexp_replace(bare, rf"{SENTENCE_END}|\n", "|"), F.lit("|"))
    stream = F.regexp_replace(F.regexp_replace(stream, "[^a-z0-9|]+", " "), r" ?\|[ |]*", " | ")
    names = F.create_map(*[F.lit(x) for k, v in (SENTENCES | FURTHER).items() for x in (v, k)])
    return F.transform(F.regexp_extract_all(stream, F.lit(_search()), F.lit(0)), lambda s: names[F.replace(s, F.lit(" |"), F.lit(""))])


#: One character for each identifier, so that a rule is a pattern over characters.
CODES = {k: chr(0xE000 + i) for i, k in enumerate(SENTENCES | FURTHER)}


def pattern(identifiers: tuple[str, ...]) -> str:
    """Matches the identifiers' characters in sequence; those between are kept by the groups. The first of each is the
    right one, so nothing is tried twice, and no step recurses."""
    return CODES[identifiers[0]] + "".join(f"(?>(.*?){CODES[x]})" for x in identifiers[1:])


def kept(identifiers: tuple[str, ...]) -> str:
    return "".join(f"${i}" for i in range(1, len(identifiers)))


def licences(docs: DataFrame) -> DataFrame:
    """(doc_id, sentences, found) of docs (doc_id, text), a row a row: identifiers met, in order,
    and licences in the order of RULES and FURTHER_RULES, each once. Null, empty and
    other texts without a known sentence have empty arrays."""
    lower = docs.select("doc_id", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("li_text"))
    none = F.array().cast("array<string>")
    split = lower.select("doc_id", F.coalesce(F.when(F.col("li_text").rlike(CUE), _known(F.col("li_text"))), none).alias("sentences"))
    rules = F.array(*[
        F.struct(F.lit(name).alias("name"), F.array(*[F.lit(CODES[x]) for x in sequence]).alias("all"), F.lit(pattern(sequence)).alias("pattern"), F.lit(kept(sequence)).alias("kept"))
        for name, sequence in RULES + FURTHER_RULES
    ])
    code = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    once = F.filter("sentences", lambda s, i: (i == 0) | (s != F.get("sentences", i - 1)))
    start = F.struct(F.array_join(F.transform(once, lambda s: code[s]), "").alias("left"), none.alias("found"))

    def applied(acc: Column, rule: Column) -> Column:
        hit = F.forall(rule["all"], lambda c: acc["left"].contains(c)) & F.regexp_like(acc["left"], rule["pattern"])
        return F.when(hit, F.struct(F.regexp_replace(acc["left"], rule["pattern"], rule["kept"]).alias("left"), F.array_union(acc["found"], F.array(rule["name"])).alias("found"))).otherwise(acc)

    return split.select("doc_id", "sentences", F.when(F.size("sentences") > 0, F.aggregate(rules, start, applied, lambda acc: acc["found"])).otherwise(none).alias("found"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_sentences, sentences, licences), a row a row of documents. Null and empty texts have none; an empty table
    gives no rows."""
    found = licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join("found", ",").alias("licences"))


def _oracle() -> str:
    """The scan for DuckDB, of whole sentences and lines only (equal on texts whose notices are such); the fold over the rules is written out as nested steps."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(quote(v) for v in SENTENCES.values())
    names = f"map([{known}], [{', '.join(quote(k) for k in SENTENCES)}])"
    longest = max(map(len, SENTENCES.values())) * 2
    def part(regex: str) -> str:
        return (
            f"list_transform(list_filter(list_transform(list_filter(string_split_regex(t, '{regex}'), lambda s: length(s) <= {longest} AND regexp_matches(s, '{CUE}')), "
            f"lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), lambda s: s IN ({known})), lambda s: {names}[s])"
        )
    codes = f"map([{', '.join(quote(k) for k in SENTENCES)}], [{', '.join(quote(CODES[k]) for k in SENTENCES)}])"
    steps = [f"s0 AS (SELECT doc_id, sentences, array_to_string(list_transform(list_filter(sentences, lambda s, i: i = 1 OR s <> sentences[i - 1]), lambda s: {codes}[s]), '') AS l, CAST([] AS VARCHAR[]) AS f FROM joined)"]
    for i, (name, sequence) in enumerate(RULES):
        p = "(.*?)".join(CODES[x] for x in sequence)
        between = "".join(f"\\{k}" for k in range(1, len(sequence)))
        steps.append(f"s{i + 1} AS (SELECT doc_id, sentences, regexp_replace(l, '{p}', '{between}', 'g') AS l, CASE WHEN regexp_matches(l, '{p}') AND NOT list_contains(f, '{name}') THEN list_append(f, '{name}') ELSE f END AS f FROM s{i})")
    return (
        "WITH lowered AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), "
        f"parts AS (SELECT doc_id, CASE WHEN regexp_matches(t, '{CUE}') THEN {part(SENTENCE_END)} ELSE [] END AS a, CASE WHEN regexp_matches(t, '{CUE}') THEN {part(chr(92) + 'n')} ELSE [] END AS b FROM lowered), "
        "joined AS (SELECT doc_id, list_concat(a, list_filter(b, lambda s: NOT list_contains(a, s))) AS sentences FROM parts), "
        + ", ".join(steps)
        + f" SELECT doc_id, CAST(len(sentences) AS BIGINT) AS n_sentences, array_to_string(sentences, ',') AS sentences, array_to_string(f, ',') AS licences FROM s{len(RULES)}"
    )


ORACLE = _oracle()
