"""Licence recognition by sentence rules, in DataFrame functions alone.

A text is normalised (lower case, letters and digits) but for its breaks: line breaks, and
the ends of sentences. A known licence sentence is found where its words lie between two
breaks, whatever breaks, blank lines or comment signs lie among them; the longest counts. A licence rule is an ordered list of
sentence identifiers; it matches where they follow one another among the text's
identifiers, whatever unknown sentences lie between. The tables are constants, so the
whole scan is one projection: nothing is shuffled, however skewed the rows are.

Defined results: a null or empty text matches nothing; repeated rows match each; an empty
table gives an empty table; several rules may match one text, but of two whose sentences one holds all of the
other's the longer alone; columns besides the key
and the text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences by identifier.
SENTENCES = {
    1: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    2: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    3: "Released under the MIT License.",
    4: "Licensed under the MIT License.",
    10: "Licensed under the Apache License, Version 2.0.",
    11: "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    12: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    20: "This work is licensed under the GNU General Public License, version 3.",
    21: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    22: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    30: "Licensed under CC BY-NC 4.0.",
    31: "Licensed under CC BY 4.0.",
    32: "Licensed under CC BY-SA 4.0.",
    23: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    24: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    25: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    26: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    27: "Licensed under the GNU General Public License, version 2.",
    28: "Licensed under the BSD 3-Clause License.",
    29: "Licensed under the BSD 2-Clause License.",
    33: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    34: "Distributed under the Boost Software License, Version 1.0.",
    35: "This is free and unencumbered software released into the public domain.",
    36: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    37: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    38: "This software is provided 'as-is', without any express or implied warranty.",
    39: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    40: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    41: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    42: "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    43: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    44: "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    45: "You just DO WHAT THE FUCK YOU WANT TO.",
    46: "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    47: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    48: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    49: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    50: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}
#: Licences whose ``SPDX-License-Identifier`` line is known; their sentences follow from 100 on.
SPDX = (
    "MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later "
    "BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD ISC Zlib MPL-2.0 BSL-1.0 EPL-2.0 Unlicense WTFPL CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0"
).split()
SENTENCES |= {100 + i: f"SPDX-License-Identifier: {name}" for i, name in enumerate(SPDX)}
#: Rules: name, licence, identifiers in order.
RULES = [
    ("mit-notice", "MIT", [3]),
    ("mit-notice-licensed", "MIT", [4]),
    ("mit-text", "MIT", [1, 2]),
    ("apache-2-notice", "Apache-2.0", [10]),
    ("apache-2-header", "Apache-2.0", [11, 12]),
    ("gpl-3-notice", "GPL-3.0-only", [20]),
    ("gpl-3-header", "GPL-3.0-or-later", [21, 22]),
    ("cc-by-nc-4-notice", "CC-BY-NC-4.0", [30]),
    ("cc-by-4-notice", "CC-BY-4.0", [31]),
    ("cc-by-sa-4-notice", "CC-BY-SA-4.0", [32]),
    ("bsd-2-text", "BSD-2-Clause", [40]),
    ("bsd-3-text", "BSD-3-Clause", [40, 41]),
    ("bsd-4-text", "BSD-4-Clause", [40, 42]),
    ("bsd-4-text-names", "BSD-4-Clause", [40, 42, 41]),
    ("bsd-3-notice", "BSD-3-Clause", [28]),
    ("bsd-2-notice", "BSD-2-Clause", [29]),
    ("gpl-2-notice", "GPL-2.0-only", [27]),
    ("gpl-2-header", "GPL-2.0-or-later", [23, 22]),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", [24]),
    ("lgpl-3-header", "LGPL-3.0-or-later", [26]),
    ("agpl-3-header", "AGPL-3.0-or-later", [25, 22]),
    ("mpl-2-header", "MPL-2.0", [33]),
    ("boost-1-header", "BSL-1.0", [34]),
    ("unlicense-text", "Unlicense", [35, 36]),
    ("isc-text", "ISC", [37]),
    ("zlib-text", "Zlib", [38, 39]),
    ("epl-2-header", "EPL-2.0", [43]),
    ("wtfpl-text", "WTFPL", [44, 45]),
    ("cc0-notice", "CC0-1.0", [46]),
    ("0bsd-text", "0BSD", [47]),
    ("cc-by-4-work", "CC-BY-4.0", [48]),
    ("cc-by-sa-4-work", "CC-BY-SA-4.0", [49]),
    ("cc-by-nc-4-work", "CC-BY-NC-4.0", [50]),
    *[(f"spdx-{name.lower()}", name, [100 + i]) for i, name in enumerate(SPDX)],
]


def normal(sentence: str) -> str:
    """Lower case, with one space for what is no letter a to z and no digit."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def _chain(ids: list[int]) -> str:
    return "".join(f"<{i}>" for i in ids)


def _longer(rule: list[int]) -> list[str]:
    """Chains of the rules that hold all of ``rule`` in a row and more: where one matches, the longest wins."""
    return [_chain(ids) for _, _, ids in RULES if ids != rule and _chain(rule) in _chain(ids)]


def identifiers(text: Column) -> Column:
    """The known sentences of a text as one string ``<id><id>...``, in order."""
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (normal(s), f"<{i}>")])
    # all breaks as one line break each, all else that is no letter or digit as one space
    lines = F.regexp_replace(F.concat(F.lit("\n"), text, F.lit("\n")), r"([.!?:])[ \t\r\n]+", "$1\n")
    lines = F.regexp_replace(F.regexp_replace(F.lower(lines), "[^a-z0-9\n]+", " "), " ?\n[ \n]*", "\n")
    each = "|".join(sorted((normal(s).replace(" ", "[ \n]") for s in SENTENCES.values()), key=len, reverse=True))
    own = F.regexp_extract_all(lines, F.lit(f"(?<=\n)({each})(?=\n)"), F.lit(1))
    ids = F.transform(own, lambda s: F.element_at(known, F.translate(s, "\n", " ")))
    return F.array_join(ids, "")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each rule that a row's text matches: key, license, rule, sentences."""
    found = docs.select(F.col(key), identifiers(F.col(text).cast("string")).alias("sentences")).where("sentences != ''")
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(lic).alias("license"), F.lit(_chain(ids)).alias("chain"), F.array(*[F.lit(c) for c in _longer(ids)]).cast("array<string>").alias("longer")) for n, lic, ids in RULES])
    own = F.col("sentences")
    hit = F.explode(F.filter(rules, lambda r: F.contains(own, r["chain"]) & ~F.exists(r["longer"], lambda c: F.contains(own, c))))
    return found.select(key, "sentences", hit.alias("hit")).select(key, "hit.license", "hit.rule", "sentences")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql() -> str:
    """The scan of ``documents`` in DuckDB's SQL."""
    known = ", ".join(f"({_quoted(normal(s))}, '<{i}>')" for i, s in SENTENCES.items())
    rules = ", ".join(f"({_quoted(n)}, {_quoted(lic)}, '{_chain(ids)}')" for n, lic, ids in RULES)
    return f"""
        WITH known(sentence, id) AS (VALUES {known}), rules(rule, license, chain) AS (VALUES {rules}),
        docs AS (SELECT row_number() OVER () AS r, doc_id,
                        string_split(regexp_replace(text, '([.!?:])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)) AS lines
                 FROM documents),
        lines AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM docs),
        found AS (SELECT r, doc_id, string_agg(id, '' ORDER BY place) AS sentences
                  FROM lines JOIN known ON trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) = sentence
                  GROUP BY r, doc_id)
        SELECT doc_id, license, rule, sentences FROM found JOIN rules r ON contains(sentences, chain)
        WHERE NOT EXISTS (SELECT 1 FROM rules q WHERE q.chain <> r.chain AND contains(q.chain, r.chain) AND contains(found.sentences, q.chain))"""
