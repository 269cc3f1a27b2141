"""Licence scans by sentence rules, in DataFrame expressions only.

Sentences are normalised to lower-case words; known ones, some with slots for
names and years, map to identifiers and all others to one that says unknown. A
document is then a sequence of identifiers, and ordered rules (longest first)
claim runs of that sequence, in which few unknown sentences may stand between
known ones. Everything happens inside the row: no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unknown sentences that may stand between two sentences of a run: numbers of clauses, and the ends of sentences with abbreviations.
GAP = 3
# Sentences as their licences print them, by identifier.
PRINTED = {
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-project": "This project is licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-free": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "isc-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "apache-2-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-2-asf": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    "apache-2-asf-header": 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-2-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2-copy-safe": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache-2-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mpl-2-terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v",  # the sentence as it is split: "v. 2.0."
    "mpl-2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-2-copy-safe": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-hope-library": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "epl-2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-2-distribute": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-v20.html",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights": "All rights reserved.",
}
# The GNU licences' names, versions, and the words that their notices call a work.
GNU = {"gpl": ("GNU General Public License", ("2", "3")), "lgpl": ("GNU Lesser General Public License", ("2.1", "3")), "agpl": ("GNU Affero General Public License", ("3",))}
WORKS = ("program", "library")
# The Creative Commons elements, their names, and the versions' ports.
CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
PORTS = {"3.0": "Unported", "4.0": "International"}
# Names of licences that an SPDX line states.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
# Sentences with slots, as patterns over normal forms.
SLOTS = {
    "bsd-names": "^neither the name of .+ nor the names of (its|their) contributors may be used to endorse or promote products derived from this software without specific (prior )?written permission$",
    "cc0-by": "^to the extent possible under law .+ ha(s|ve) waived all copyright and related or neighboring rights to .+$",
    "copyright": "^copyright (c )?[0-9]{4} .+$",
    "spdx-other": "^spdx license identifier .+$",
}

#: Slots that run to the end of a line.
ON_ONE_LINE = ("copyright", "spdx-other")


def _sentences() -> dict[str, str]:
    """All known sentences: the printed ones and those that follow from names, versions and works."""
    out = dict(PRINTED)
    for family, (name, versions) in GNU.items():
        out[f"{family}-details"] = f"See the {name} for more details."
        for v in versions:
            out[f"{family}-{v}-licensed"] = f"This work is licensed under the {name}, version {v}."
            for work in WORKS:
                start = f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation,"
                out[f"{family}-{v}-{work}-later"] = f"{start} either version {v} of the License, or (at your option) any later version."
                out[f"{family}-{v}-{work}-only"] = f"{start} version {v} of the License."
    for element, name in CC.items():
        for v, port in PORTS.items():
            out[f"cc-{element}-{v}"] = f"Licensed under CC {element.upper()} {v}."
            out[f"cc-{element}-{v}-work"] = f"This work is licensed under a Creative Commons {name} {v} {port} License."
    return out | {f"spdx-{name}": f"SPDX-License-Identifier: {name}" for name in SPDX}


def _rules() -> list[tuple[str, tuple[str, ...]]]:
    """Ordered rules: the licence that a run of identifiers states."""
    rules = [
        ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
        ("MIT", ("mit-grant", "mit-notice")),
        ("BSD-4-Clause", ("bsd-conditions", "bsd-source", "bsd-binary", "bsd-advertising")),
        ("BSD-3-Clause", ("bsd-conditions", "bsd-source", "bsd-binary", "bsd-names")),
        ("BSD-2-Clause", ("bsd-conditions", "bsd-source", "bsd-binary")),
        ("ISC", ("isc-grant", "isc-warranty", "isc-liability")),
        ("ISC", ("isc-grant-and", "isc-warranty", "isc-liability")),
        ("0BSD", ("isc-grant-free", "isc-warranty", "isc-liability")),
        ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")),
        ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ]
    for start in ("apache-2-header", "apache-2-asf-header"):
        for copy in ("apache-2-copy", "apache-2-copy-safe"):
            rules += [("Apache-2.0", (start, copy, "apache-2-as-is", "apache-2-see")), ("Apache-2.0", (start, copy, "apache-2-as-is")), ("Apache-2.0", (start, copy))]
    rules += [("MPL-2.0", ("mpl-2-terms", "mpl-2-copy")), ("MPL-2.0", ("mpl-2-terms", "mpl-2-copy-safe"))]
    gnu = [(family, v, work, late) for family, (_, versions) in GNU.items() for v in versions for work in WORKS for late in ("later", "only")]
    title = lambda family, v, late: f"{family.upper()}-{v if '.' in v else v + '.0'}-{'or-later' if late == 'later' else 'only'}"
    hope = {"program": "gpl-hope", "library": "gpl-hope-library"}
    rules += [(title(f, v, late), (f"{f}-{v}-{work}-{late}", hope[work], f"{f}-details")) for f, v, work, late in gnu]
    rules += [(title(f, v, late), (f"{f}-{v}-{work}-{late}",)) for f, v, work, late in gnu]
    singles = {
        "apache-2-header": "Apache-2.0", "apache-2-asf-header": "Apache-2.0", "apache-2-licensed": "Apache-2.0", "mit-grant": "MIT", "mit-released": "MIT", "mit-licensed": "MIT", "mit-project": "MIT",
        "isc-grant": "ISC", "isc-grant-and": "ISC", "isc-grant-free": "0BSD", "bsd-conditions": "BSD-style", "bsd-source": "BSD-style", "mpl-2-terms": "MPL-2.0", "unlicense-free": "Unlicense", "zlib-grant": "Zlib",
        "boost-notice": "BSL-1.0", "boost-grant": "BSL-1.0", "epl-2-terms": "EPL-2.0", "epl-2-distribute": "EPL-2.0", "cc0": "CC0-1.0", "cc0-by": "CC0-1.0",
    }
    rules += [(licence, (k,)) for k, licence in singles.items()]
    rules += [(title(f, v, "only"), (f"{f}-{v}-licensed",)) for f, (_, versions) in GNU.items() for v in versions]
    rules += [(f"CC-{e.upper()}-{v}", (f"cc-{e}-{v}{form}",)) for e in CC for v in PORTS for form in ("", "-work")]
    return rules + [(name, (f"spdx-{name}",)) for name in SPDX] + [("SPDX-expression", ("spdx-other",)), ("all-rights-reserved", ("all-rights",))]


SENTENCES = _sentences()
RULES = _rules()
# Where sentences end: closing punctuation and white space, and every line break, or every empty line (of comment marks at most) and colon before a line break. Each of the latter is one of the former.
_BY_LINE = r"[.!?][\x09-\x0D\x20]+|\n"
_BY_BLOCK = r"[.!?][\x09-\x0D\x20]+|:[\x09\x20]*\n|\n[\x09\x0B-\x0D\x20#*/;%!-]*\n"


def normal(sentence: str) -> str:
    """Lower-case ASCII words, single spaces, from the first letter on: numbers of clauses go."""
    return re.sub("[^a-z0-9]+", " ", re.sub("^[^a-z]+", "", sentence.lower())).strip()


def _cue() -> str:
    """A pattern for the first two words of any known sentence, in lower case."""
    starts: dict[str, set[str]] = {"neither": {"the"}, "to": {"the"}, "copyright": {""}}
    for s in SENTENCES.values():
        first, second = normal(s).split(" ")[:2]
        starts.setdefault(first, set()).add(second)
    return "^[^a-z]*(?:" + "|".join(f"{first}[^a-z0-9]+(?:{'|'.join(sorted(rest))})" for first, rest in sorted(starts.items())) + ")"


def _marks(text: Column) -> Column:
    """The identifier of each sentence in order, "?" for an unknown one, "" for none.

    A block that is a known sentence as a whole gives that one; any other block
    gives those of its lines. Only sentences that start like a known one are
    normalised.
    """
    known = F.create_map(*(F.lit(x) for k, s in SENTENCES.items() for x in (normal(s), k)))

    def identifier(s: Column) -> Column:
        n = F.trim(F.regexp_replace(F.regexp_replace(s, "^[^a-z]+", ""), "[^a-z0-9]+", " "))
        slot = F.coalesce(*(F.when(n.rlike(pattern) & (~F.contains(s, F.lit("\n")) if k in ON_ONE_LINE else F.lit(True)), F.lit(k)) for k, pattern in SLOTS.items()))
        return F.when(s.rlike(_cue()), F.coalesce(F.try_element_at(known, n), slot))

    def line(s: Column) -> Column:
        return F.coalesce(identifier(s), F.when(s.rlike("[a-z0-9]"), F.lit("?")).otherwise(F.lit("")))

    blocks = F.transform(F.split(F.lower(text), _BY_BLOCK), lambda b: F.struct(b.alias("block"), identifier(b).alias("whole")))
    return F.flatten(F.transform(blocks, lambda b: F.when(b["whole"].isNotNull(), F.array(b["whole"])).otherwise(F.transform(F.split(b["block"], _BY_LINE), line))))


def _pattern(run: tuple[str, ...]) -> str:
    """What a rule claims in the joined sequence."""
    return rf"\?{{0,{GAP}}}".join(f"<{k}>" for k in run)


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: the columns of keep, n_sentences, sentence_ids and licenses.

    sentence_ids: identifiers of the known sentences in order, those that stand on
    one line and those that are wrapped over the lines of a paragraph. licenses:
    names of the rules that claimed a run, in rule order, each once; a claimed run is
    gone for later rules, and more than GAP unknown sentences end a run. Null and
    empty texts have no sentence; a text of any length is read whole; rows that
    repeat give equal rows; an empty table gives an empty result. Only keep and text
    are read, so extra columns cannot clash.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    count = F.size(F.filter(F.split(F.lower(body), _BY_LINE), lambda s: s.rlike("[a-z0-9]")))
    rows = df.select(*keep, count.cast("long").alias("n_sentences"), _marks(body).alias("_marks"))
    ids = F.filter("_marks", lambda k: ~k.isin("", "?"))
    rows = rows.select(*keep, "n_sentences", ids.alias("sentence_ids"), F.when(F.size(ids) > 0, F.array_join(F.transform(F.filter("_marks", lambda k: k != ""), lambda k: F.when(k == "?", k).otherwise(F.concat(F.lit("<"), k, F.lit(">")))), "")).alias("_left"))
    # a claim leaves its rule's number, so one expression carries the sequence from rule to rule
    claimed = F.aggregate(
        F.array(*(F.struct(F.lit(_pattern(run)).alias("p"), F.lit(f"|{i}|").alias("mark")) for i, (_, run) in enumerate(RULES))),
        F.col("_left"), lambda left, r: F.regexp_replace(left, r["p"], r["mark"]),
    )
    names = F.array(*(F.lit(name) for name, _ in RULES))
    order = F.array_sort(F.transform(F.regexp_extract_all(claimed, F.lit(r"\|([0-9]+)\|")), lambda i: i.cast("int")))
    found = F.when(F.col("_left").isNotNull(), F.array_distinct(F.transform(order, lambda i: F.get(names, i)))).otherwise(F.array().cast("array<string>"))
    return rows.select(*keep, "n_sentences", "sentence_ids", found.alias("licenses"))


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for scan() with the lists comma-joined."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quote(normal(s))}: {quote(k)}" for k, s in SENTENCES.items()) + "}"
    plain = lambda s: f"trim(regexp_replace(regexp_replace({s}, '^[^a-z]+', ''), '[^a-z0-9]+', ' ', 'g'))"
    line_only = lambda k, s: f" AND NOT contains({s}, chr(10))" if k in ON_ONE_LINE else ""
    slots = lambda s: " ".join(f"WHEN regexp_matches({plain(s)}, {quote(p)}){line_only(k, s)} THEN {quote(k)}" for k, p in SLOTS.items())
    identifier = lambda s: f"coalesce(known[{plain(s)}], CASE {slots(s)} END)"
    line = f"coalesce({identifier('s')}, CASE WHEN regexp_matches(s, '[a-z0-9]') THEN '?' ELSE '' END)"
    steps, names, left = [], [], "seq0"
    for i, (name, run) in enumerate(RULES):
        names.append(f"CASE WHEN regexp_matches({left}, {quote(_pattern(run))}) THEN {quote(name)} END")
        steps.append(f"s{i + 1} AS (SELECT doc_id, n_sentences, ids, regexp_replace(seq{i}, {quote(_pattern(run))}, '|', 'g') AS seq{i + 1}, list_append(names, {names[-1]}) AS names FROM s{i})")
        left = f"seq{i + 1}"
    return f"""
        WITH k AS (SELECT {known} AS known),
        a AS (SELECT doc_id, known, lower(coalesce(text, '')) AS body FROM {table}, k),
        l AS (SELECT doc_id, len(list_filter(string_split_regex(body, '{_BY_LINE}'), lambda s: regexp_matches(s, '[a-z0-9]')))::BIGINT AS n_sentences, known, unnest(string_split_regex(body, '{_BY_BLOCK}')) AS block, generate_subscripts(string_split_regex(body, '{_BY_BLOCK}'), 1) AS i FROM a),
        m AS (SELECT doc_id, n_sentences, i, CASE WHEN {identifier('block')} IS NOT NULL THEN [{identifier('block')}] ELSE list_transform(string_split_regex(block, '{_BY_LINE}'), lambda s: {line}) END AS marks FROM l),
        f AS (SELECT doc_id, n_sentences, list_filter(flatten(list(marks ORDER BY i)), lambda x: x <> '') AS marks FROM m GROUP BY doc_id, n_sentences),
        s0 AS (SELECT doc_id, n_sentences, list_filter(marks, lambda x: x <> '?') AS ids, array_to_string(list_transform(marks, lambda x: CASE WHEN x = '?' THEN x ELSE '<' || x || '>' END), '') AS seq0, []::VARCHAR[] AS names FROM f),
        {", ".join(steps)},
        n AS (SELECT doc_id, n_sentences, ids, list_filter(names, lambda x: x IS NOT NULL) AS names FROM s{len(RULES)})
        SELECT doc_id, n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ',') AS licenses FROM n"""
