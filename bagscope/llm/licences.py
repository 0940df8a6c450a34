"""Licence scan by sentence rules, in built-in expressions only.

Normalised sentences are mapped to identifiers of known licence sentences; the sequence of identifiers of a
document is matched against ordered licence rules. A text never leaves its scan.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence names as they are written, normalised, with their identifiers.
NAMES = {
    "mit license": "MIT",
    "apache license version 2 0": "Apache-2.0",
    "apache license 2 0": "Apache-2.0",
    "gnu general public license version 2": "GPL-2.0",
    "gnu general public license version 3": "GPL-3.0",
    "gnu lesser general public license version 2 1": "LGPL-2.1",
    "gnu lesser general public license version 3": "LGPL-3.0",
    "gnu affero general public license version 3": "AGPL-3.0",
    "mozilla public license version 2 0": "MPL-2.0",
    "bsd 2 clause license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause",
    "isc license": "ISC",
    "cc by 4 0": "CC-BY-4.0",
    "cc by sa 4 0": "CC-BY-SA-4.0",
    "cc by nc 4 0": "CC-BY-NC-4.0",
    "cc by nd 4 0": "CC-BY-ND-4.0",
}
OPENINGS = ["released under", "licensed under", "distributed under", "available under", "this work is licensed under", "this software is released under", "this project is licensed under"]

# Sentences of the licence texts and their usual notices, normalised.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-grant": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-grant-3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-grant-2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-grant-2.1": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-grant-3": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-grant-3": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "unlicense-grant": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc0-waiver": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
}

# Where a sentence names somebody or something, any words may stand. The first matching pattern's part of a
# normalised sentence is put as the known sentence has it; a name may hold a stop, so what stands before it may be cut off.
SLOTS = [
    ("^(.* )?nor the names? of (its|any|other|the|his|her|their) contributors may be used ", "neither the name of the copyright holder nor the names of its contributors may be used "),
    ("^(.* )?the names? of .* may not be used to endorse ", "neither the name of the copyright holder nor the names of its contributors may be used to endorse "),
    ("^.* is free software you can ", "this program is free software you can "),
    ("^.* is distributed in the hope that ", "this program is distributed in the hope that "),
    ("^to the extent possible under law .* has waived ", "to the extent possible under law the author has waived "),
]

# Ordered rules. A rule holds where its sentences occur in this order, other sentences between them or not.
TEXT_RULES = [
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-grant", "apache-copy", "apache-as-is"]),
    ("GPL-3.0", ["gpl-grant-3", "gpl-warranty"]),
    ("GPL-2.0", ["gpl-grant-2", "gpl-warranty"]),
    ("LGPL-2.1", ["lgpl-grant-2.1", "gpl-warranty"]),
    ("LGPL-3.0", ["lgpl-grant-3", "gpl-warranty"]),
    ("AGPL-3.0", ["agpl-grant-3", "gpl-warranty"]),
    ("MPL-2.0", ["mpl-form", "mpl-copy"]),
    ("Unlicense", ["unlicense-domain", "unlicense-grant"]),
    ("CC0-1.0", ["cc0-waiver"]),
]
# The parts that SENTENCE_END cuts the usual notices into, normalised. Notices differ in their marks ("free
# software: you", "free software; you"; "Foundation, either", "Foundation; either"), so whole and cut ones stand here. Within
# comments a line of nothing but the comment's mark is no blank line, and the address stays between two sentences.
_APACHE_AT = [f"{SENTENCES['apache-copy']} {scheme} www apache org licenses license 2 0" for scheme in ("http", "https")]
_GPL_FREE, _GPL_TERMS = "this program is free software", "you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation"
_GPL_VERSION = "either version {} of the license or at your option any later version"
GPL_FAMILY = {"gpl": ("", ("2", "3")), "lgpl": ("lesser ", ("2.1", "3")), "agpl": ("affero ", ("3",))}
_TERMS = {family: _GPL_TERMS.format(word) for family, (word, _) in GPL_FAMILY.items()}
_VERSIONS = {n: _GPL_VERSION.format(n.replace(".", " ")) for n in ("2", "2.1", "3")}
PARTS = {
    "licensed under the apache license version 2 0 the license": "apache-grant:1",
    "you may not use this file except in compliance with the license": "apache-grant:2",
    **{at: "apache-copy" for at in _APACHE_AT},
    **{f"{at} {SENTENCES['apache-as-is']}": "apache-copy-as-is" for at in _APACHE_AT},
    **{terms: f"{family}-terms" for family, terms in _TERMS.items()},
    **{f"{_GPL_FREE} {terms}": f"{family}-terms" for family, terms in _TERMS.items()},
    **{version: f"gpl-version-{n}" for n, version in _VERSIONS.items()},
    **{f"{_TERMS[family]} {_VERSIONS[n]}": f"{family}-terms-{n}" for family, (_, versions) in GPL_FAMILY.items() for n in versions},
    **{f"if a copy of the mpl was not distributed with this file you can obtain one at {scheme} mozilla org mpl 2 0": "mpl-copy" for scheme in ("http", "https", "http www", "https www")},
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-warranty:1",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty:2",
}

# The ordered rules over whole and cut notices: each way to write a grant before each way to write what follows.
PART_RULES = [
    ("Apache-2.0", grant + rest)
    for grant, rest in product((["apache-grant"], ["apache-grant:1", "apache-grant:2"]), (["apache-copy", "apache-as-is"], ["apache-copy-as-is"]))
] + [
    (f"{family.upper()}-{n if '.' in n else n + '.0'}", grant + rest)
    for family, (_, versions) in GPL_FAMILY.items()
    for n in versions
    for grant, rest in product(
        ([f"{family}-grant-{n}"], [f"{family}-terms-{n}"], [f"{family}-terms", f"gpl-version-{n}"]), (["gpl-warranty"], ["gpl-warranty:1", "gpl-warranty:2"])
    )
]
#: Where the first of these rules holds, the second, a part of it, is not reported.
COVERS = [("BSD-3-Clause", "BSD-2-Clause")]

#: Every known sentence holds one of these, so a text without any needs no splitting.
TRIGGER = r"(?i)licens|permission|warrant|redistribut|copy[^a-z0-9]+of|(distributed|available|released)[^a-z0-9]+under|unencumbered|free[^a-z0-9]+to[^a-z0-9]+copy|waived"
SENTENCE_END = r"[.!?;:]+[ \t\r\n]+|[ \t\r]*\n[ \t\r]*\n[ \t\r\n]*"
LINE_END = r"[ \t\r]*\n[ \t\r]*"


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier: the fixed sentences, and each opening before each licence name."""
    known = {text: name for name, text in SENTENCES.items()}
    for opening, article, (name, licence) in product(OPENINGS, ("", "the "), NAMES.items()):
        known[f"{opening} {article}{name}"] = f"grant:{licence}"
    for licence in sorted(set(NAMES.values())):
        known["spdx license identifier " + licence.lower().replace("-", " ").replace(".", " ")] = f"grant:{licence}"
    return known


def rules() -> list[tuple[str, list[str]]]:
    """The ordered rules; a licence named by several holds where any of them does."""
    return TEXT_RULES + PART_RULES + [(licence, [f"grant:{licence}"]) for licence in sorted(set(NAMES.values()))]


def normalised(sentence: Column) -> Column:
    out = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    for pattern, known in SLOTS:
        out = F.regexp_replace(out, pattern, known)
    return out


def rule_pattern(ids: list[str]) -> str:
    quoted = [i.replace(".", "[.]") for i in ids]
    return r"[|]" + r"[|](.*[|])?".join(quoted) + r"[|]"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order.

    A sentence ends at a stop before white space or at a blank line. One that is not known is looked up
    again line by line, for texts whose lines are sentences without a stop.
    """
    table = F.create_map(*[F.lit(x) for pair in sorted((known_sentences() | PARTS).items()) for x in pair])
    lookup = lambda s: F.try_element_at(table, normalised(s))
    by_sentence = F.transform(
        F.filter(F.split(text, SENTENCE_END), lambda s: s.rlike(TRIGGER)),
        lambda s: F.when(lookup(s).isNotNull(), F.array(lookup(s))).otherwise(
            F.transform(F.filter(F.split(s, LINE_END), lambda line: line.rlike(TRIGGER)), lookup)
        ),
    )
    found = F.filter(F.flatten(by_sentence), lambda x: x.isNotNull())
    return F.when(text.rlike(TRIGGER), found).otherwise(F.array().cast("array<string>"))


def scan(documents: DataFrame) -> DataFrame:
    """``documents`` with ``sentence_ids`` and ``licences``, sorted and each named once.

    Null and empty texts have none. Columns of these names are replaced; rows, repeats included, are kept.
    """
    own = documents.drop("sentence_ids", "licences", "_sequence")
    found = own.withColumn("sentence_ids", sentence_ids(F.coalesce(F.col("text"), F.lit(""))))
    found = found.withColumn("_sequence", F.concat(F.lit("|"), F.array_join("sentence_ids", "||"), F.lit("|")))
    held = {}
    for licence, ids in rules():
        test = F.col("_sequence").rlike(rule_pattern(ids))
        held[licence] = held[licence] | test if licence in held else test
    for larger, smaller in COVERS:
        by_name = F.col("_sequence").rlike(rule_pattern([f"grant:{smaller}"]))
        held[smaller] = held[smaller] & (~held[larger] | by_name)
    named = F.array_compact(F.array(*[F.when(held[licence], licence) for licence in sorted(held)]))
    empty = F.array().cast("array<string>")
    return found.withColumn("licences", F.when(F.size("sentence_ids") > 0, named).otherwise(empty)).drop("_sequence")


def licences(documents: DataFrame) -> DataFrame:
    """doc_id, n_known (known sentences), sentence_ids and licences, both comma-joined, of every document."""
    found = scan(documents.select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("sentence_ids").alias("n_known"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences")
    )


def _sql() -> str:
    known = ",\n".join(f"('{text}', '{name}')" for text, name in sorted((known_sentences() | PARTS).items()))
    held: dict[str, str] = {}
    for licence, ids in rules():
        test = f"regexp_matches(sequence, '{rule_pattern(ids)}')"
        held[licence] = f"{held[licence]} OR {test}" if licence in held else test
    for larger, smaller in COVERS:
        held[smaller] = f"({held[smaller]}) AND (NOT ({held[larger]}) OR regexp_matches(sequence, '{rule_pattern([f'grant:{smaller}'])}'))"
    cases = ", ".join(f"CASE WHEN {held[licence]} THEN '{licence}' END" for licence in sorted(held))
    clean = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    for pattern, text in SLOTS:
        clean = f"regexp_replace({clean}, '{pattern}', '{text}')"
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
numbered AS MATERIALIZED (SELECT doc_id, text, row_number() OVER () AS rid FROM documents),
sentences AS (
    SELECT doc_id, rid, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS s
    FROM (SELECT doc_id, rid, regexp_split_to_array(coalesce(text, ''), '{SENTENCE_END}') AS parts FROM numbered)
), first AS (
    SELECT t.*, k.id FROM sentences t LEFT JOIN known k ON {clean.format("t.sentence")} = k.sentence
), lines AS (
    SELECT doc_id, rid, s, unnest(parts) AS line, generate_subscripts(parts, 1) AS l
    FROM (SELECT *, regexp_split_to_array(sentence, '{LINE_END}') AS parts FROM first WHERE id IS NULL AND regexp_matches(sentence, '{TRIGGER}'))
), found AS (
    SELECT rid, s, 0 AS l, id FROM first WHERE id IS NOT NULL
    UNION ALL
    SELECT rid, s, l, k.id FROM lines JOIN known k ON {clean.format("line")} = k.sentence
), joined AS (
    SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY s, l) AS ids, '|' || string_agg(id, '||' ORDER BY s, l) || '|' AS sequence FROM found GROUP BY rid
)
SELECT d.doc_id, coalesce(n, 0)::INT AS n_known, coalesce(ids, '') AS sentence_ids, coalesce(concat_ws(',', {cases}), '') AS licences
FROM numbered d LEFT JOIN joined j ON d.rid = j.rid
"""


SQL = _sql()
