"""License scans by sentence rules.

Texts are cut into pieces at line ends and stops, pieces are normalised (lower case, words and numbers only), and
successive pieces that together are a known licence sentence, wrapped or not, become its identifier; a line without
words, blank or of comment marks, ends a sentence, but for blank lines right behind a stop. The identifiers of a text in order are matched against ordered rules: a
rule holds if its sentences stand in the text in that order, other text between them or not. Of the rules of one
licence the longest that holds is reported.

Defined results: null, empty and unlicensed texts give no row; a sentence said twice counts once for a rule;
repeated rows give repeated rows; a text of any length is read whole; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.host_rules import let

#: Known sentences of public licences, as normalised, with their identifiers.
SENTENCES = {
    "mit-name": "mit license",
    "mit-the": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-short": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "apache-short": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-may": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "gpl3-name": "gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "apache-title": "apache license version 2 0 january 2004",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "mpl-title": "mozilla public license version 2 0",
    "lgpl3-name": "gnu lesser general public license version 3",
    "lgpl21-name": "gnu lesser general public license version 2 1",
    "agpl3-name": "gnu affero general public license version 3",
    "lgpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
}
#: Other wordings of those sentences.
WORDINGS = {"the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "as-is"}
#: SPDX identifiers and the licence that a rule names.
SPDX = {
    "MIT": "MIT",
    "Apache-2.0": "Apache-2.0",
    "GPL-3.0-only": "GPL-3.0",
    "GPL-3.0-or-later": "GPL-3.0",
    "GPL-2.0-only": "GPL-2.0",
    "GPL-2.0-or-later": "GPL-2.0",
    "LGPL-3.0-only": "LGPL-3.0",
    "LGPL-3.0-or-later": "LGPL-3.0",
    "LGPL-2.1-only": "LGPL-2.1",
    "LGPL-2.1-or-later": "LGPL-2.1",
    "AGPL-3.0-only": "AGPL-3.0",
    "AGPL-3.0-or-later": "AGPL-3.0",
    "BSD-3-Clause": "BSD-3-Clause",
    "BSD-2-Clause": "BSD-2-Clause",
    "ISC": "ISC",
    "MPL-2.0": "MPL-2.0",
    "Unlicense": "Unlicense",
    "CC-BY-4.0": "CC-BY-4.0",
    "CC-BY-SA-4.0": "CC-BY-SA-4.0",
    "CC0-1.0": "CC0-1.0",
}
#: Fixed values: (rule, licence, sentences in order).
RULES = [
    ("mit-full", "MIT", ["mit-grant", "mit-notice", "as-is", "mit-liable"]),
    ("mit-grant-notice", "MIT", ["mit-grant", "mit-notice"]),
    ("mit-name", "MIT", ["mit-name"]),
    ("mit-the", "MIT", ["mit-the"]),
    ("mit-short", "MIT", ["mit-short"]),
    ("mit-licensed", "MIT", ["mit-licensed"]),
    ("apache-2.0-header", "Apache-2.0", ["apache-header", "apache-may", "apache-copy", "apache-unless"]),
    ("apache-2.0-compliance", "Apache-2.0", ["apache-header", "apache-may"]),
    ("apache-2.0-short", "Apache-2.0", ["apache-short"]),
    ("gpl-3.0-notice", "GPL-3.0", ["gpl-free", "gpl-hope"]),
    ("gpl-3.0-short", "GPL-3.0", ["gpl3-short"]),
    ("gpl-3.0-name", "GPL-3.0", ["gpl3-name"]),
    ("gpl-2.0-notice", "GPL-2.0", ["gpl2-free", "gpl-hope"]),
    ("bsd-3-clause", "BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd-2-clause", "BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("isc", "ISC", ["isc-grant", "as-is"]),
    ("mpl-2.0", "MPL-2.0", ["mpl-form"]),
    ("unlicense", "Unlicense", ["unlicense"]),
    ("cc-by-nc-4.0", "CC-BY-NC-4.0", ["cc-by-nc"]),
    ("cc-by-4.0", "CC-BY-4.0", ["cc-by"]),
    ("cc-by-sa-4.0", "CC-BY-SA-4.0", ["cc-by-sa"]),
    ("cc0-1.0", "CC0-1.0", ["cc0"]),
    ("apache-2.0-title", "Apache-2.0", ["apache-title"]),
    ("gpl-3.0-title", "GPL-3.0", ["gpl3-title"]),
    ("gpl-2.0-title", "GPL-2.0", ["gpl2-title"]),
    ("lgpl-3.0-title", "LGPL-3.0", ["lgpl3-title"]),
    ("lgpl-3.0-name", "LGPL-3.0", ["lgpl3-name"]),
    ("lgpl-3.0-notice", "LGPL-3.0", ["lgpl3-free", "gpl-hope"]),
    ("lgpl-2.1-title", "LGPL-2.1", ["lgpl21-title"]),
    ("lgpl-2.1-name", "LGPL-2.1", ["lgpl21-name"]),
    ("lgpl-2.1-notice", "LGPL-2.1", ["lgpl21-free", "lgpl-hope"]),
    ("agpl-3.0-title", "AGPL-3.0", ["agpl3-title"]),
    ("agpl-3.0-name", "AGPL-3.0", ["agpl3-name"]),
    ("agpl-3.0-notice", "AGPL-3.0", ["agpl3-free", "gpl-hope"]),
    ("mpl-2.0-title", "MPL-2.0", ["mpl-title"]),
] + [(f"spdx-{spdx.lower()}", lic, [f"spdx-{spdx.lower()}"]) for spdx, lic in SPDX.items()]
#: Fixed value: a text without these letters has no known sentence.
TRIGGER = "(?i)licen[sc]e|permission|redistribut|free software|this program|copyright|provided|liable|public domain"
ORDER = list(SENTENCES)
KNOWN = {said: name for name, said in SENTENCES.items()} | WORDINGS | {"spdx license identifier " + re.sub("[^a-z0-9]+", " ", spdx.lower()): f"spdx-{spdx.lower()}" for spdx in SPDX}
#: The words that known sentences begin with, and the words of the longest: it cannot have more pieces.
FIRST = "^(?:" + "|".join(sorted({said.split()[0] for said in KNOWN})) + r")\b"
LONGEST = max(len(said.split()) for said in KNOWN)


def sentences(text: Column) -> Column:
    """Pieces end at a line end, or at a full stop, question mark, semicolon or colon before white space."""
    return F.split(F.regexp_replace(text, r"([.?;:])\s+", "$1\n"), "\n")


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def identifiers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids``: the known sentences of each text in order; texts without any are left out."""
    known = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair))
    rows = df.filter(F.col(text_col).rlike(TRIGGER)).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def begun(pieces: Column, i: Column) -> Column:
        """The known sentences that begin with piece ``i``."""
        runs = F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.size(pieces) - i)), lambda n: F.try_element_at(known, F.array_join(F.slice(pieces, i + 1, n), " ")))
        return F.filter(runs, lambda x: x.isNotNull())

    ids = let(F.transform(sentences(F.col("text")), normal), lambda pieces: F.flatten(F.transform(pieces, lambda s, i: F.when(s.rlike(FIRST), begun(pieces, i)).otherwise(F.array().cast("array<string>")))))
    return rows.select("doc_id", ids.alias("ids")).filter(F.size("ids") > 0)


def match(ids: DataFrame) -> DataFrame:
    """doc_id, license, rule and n_sentences of the longest rule that holds for each licence."""
    said = F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" "))
    held = [F.when(said.like("%" + "%".join(f" {s} " for s in need) + "%"), F.struct(F.lit(lic).alias("license"), F.lit(len(need)).alias("n_sentences"), F.lit(name).alias("rule"))) for name, lic, need in RULES]
    found = F.filter(F.array(*held), lambda r: r.isNotNull())
    longest = F.filter(found, lambda r: ~F.exists(found, lambda o: (o["license"] == r["license"]) & ((o["n_sentences"] > r["n_sentences"]) | ((o["n_sentences"] == r["n_sentences"]) & (o["rule"] < r["rule"])))))
    return ids.select("doc_id", F.explode(longest).alias("r")).select("doc_id", "r.license", "r.rule", F.col("r.n_sentences").cast("long").alias("n_sentences"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return match(identifiers(df, id_col, text_col))


def oracle() -> str:
    """The same in DuckDB: runs of pieces from every piece that begins as a known sentence does."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(said)}, {quote(name)})" for said, name in KNOWN.items())
    rules = ", ".join(f"({quote(name)}, {quote(lic)}, {len(need)}, {quote('%' + '%'.join(f' {s} ' for s in need) + '%')})" for name, lic, need in RULES)
    return f"""
WITH known(said, name) AS (VALUES {known}),
heads AS (SELECT split_part(said, ' ', 1) AS head, max(len(string_split(said, ' '))) AS longest FROM known GROUP BY 1),
rules(rule, license, n, pattern) AS (VALUES {rules}),
cut AS (SELECT row_number() OVER () AS r, doc_id, list_transform(string_split(regexp_replace(text, '([.?;:])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda p: trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g'))) AS parts FROM documents),
begun AS (SELECT r, doc_id, parts, i, unnest(range(1, least(longest, len(parts) - i + 1) + 1)) AS n FROM (SELECT r, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut) x JOIN heads ON split_part(parts[i], ' ', 1) = head),
named AS (SELECT r, doc_id, i, n, name FROM begun JOIN known ON array_to_string(parts[i:i + n - 1], ' ') = said),
ids AS (SELECT r, doc_id, ' ' || string_agg(name, '  ' ORDER BY i, n) || ' ' AS ids FROM named GROUP BY r, doc_id),
held AS (SELECT r, doc_id, license, rule, n, row_number() OVER (PARTITION BY r, license ORDER BY n DESC, rule) AS k FROM ids JOIN rules ON ids LIKE pattern)
SELECT doc_id, license, rule, CAST(n AS BIGINT) AS n_sentences FROM held WHERE k = 1"""
