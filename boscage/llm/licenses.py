"""Licence scans (operator 9): sentence-rule recognition with DataFrame functions only.

A text is normalised (A-Z lowered, all but letters, digits, dots and pluses to single spaces, so that line breaks and
comment leaders vanish) and known licence sentences are looked up in it as runs of words, over wrapped lines and signs as
well, of those that begin at a word the longest.  What is found is a sequence of identifiers (several wordings may share
one), and ordered rules match runs of it whose sentences lie at most GAP_WORDS words apart; identifiers that a rule doesn't
name may stand between.  Places are numbered by pieces, which end at line breaks and at sentence signs before white space.
A match inside a longer one of the same text is dropped.  Rows are worked on one by one, without a shuffle or Python; the
few texts' sequences are written to the shared folder between lookup and rules.

Edge cases: null and empty texts match nothing; texts of any length are scanned whole; a sentence that repeats matches
each time; repeated rows give repeated matches; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boscage.llm._common import shared_dir, written

#: Between two sentences of a rule at most so many words may stand, however they are wrapped; the MIT text has 54, titles stand before names of holders.
GAP_WORDS = 200
#: Sentences of licences as their authors published them, and short statements of them.
TEXTS = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header-1": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-2.0-header-2": "you may not use this file except in compliance with the License",
    "apache-2.0-header-3": "You may obtain a copy of the License at",
    "apache-2.0-header-4": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-2.0-title": "Apache License Version 2.0, January 2004",
    "mit-short": "released under the MIT License",
    "mit-licensed": "licensed under the MIT License",
    "mit-title": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "mit-grant/whole": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-0-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all",
    "mit-notice/whole": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-notice/next": "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR',
    "mit-warranty/whole": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "isc-title": "ISC License",
    "isc-short": "licensed under the ISC License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant/and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without",
    "bsd-redistribution/whole": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice",
    "bsd-source/whole": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-name/organization": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-2-short": "licensed under the BSD 2-Clause License",
    "bsd-3-short": "licensed under the BSD 3-Clause License",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License version 3",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "gpl-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl-3.0-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl-3.0-version": "Version 3, 29 June 2007",
    "gpl-free": "This program is free software",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-2.0-only-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-2.0-title": "Mozilla Public License Version 2.0",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "epl-2.0-title": "Eclipse Public License v 2.0",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0",
    "bsl-1.0-title": "Boost Software License Version 1.0 August 17th, 2003",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc0-law": "To the extent possible under law",
    "cc0-waived": "has waived all copyright and related or neighboring rights to",
    "cc0-title": "CC0 1.0 Universal",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "reserved": "All rights reserved",
}
#: The Creative Commons licences' names by code; 3.0 was Unported.
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: Licence identifiers of SPDX, and those that begin with another's words but have no rule.
SPDX = ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "WTFPL", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
OTHERS = ("MIT-0", "MIT-advertising", "MIT-CMU", "MIT-enna", "MIT-feh", "MIT-Festival", "MIT-Khronos-old", "MIT-Modern-Variant", "MIT-open-group", "MIT-STK", "MIT-testregex", "MIT-Wu")
#: Licence and the sentence identifiers that state it, in order.
RULES = (
    ("Apache-2.0", ("apache-2.0-short",)),
    ("Apache-2.0", ("apache-2.0-header-1", "apache-2.0-header-2", "apache-2.0-header-3", "apache-2.0-header-4")),
    ("Apache-2.0", ("apache-2.0-header-1", "apache-2.0-header-2", "apache-2.0-header-3")),
    ("Apache-2.0", ("apache-2.0-header-1",)),
    ("Apache-2.0", ("apache-2.0-title",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-title", "isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-short",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-redistribution", "bsd-source")),
    ("BSD", ("bsd-redistribution",)),
    ("BSD-2-Clause", ("bsd-2-short",)),
    ("BSD-3-Clause", ("bsd-3-short",)),
    ("GPL-3.0", ("gpl-3.0-short",)),
    ("GPL-3.0", ("gpl-title", "gpl-3.0-version")),
    ("GPL-2.0", ("gpl-2.0-title",)),
    ("GPL-3.0", ("gpl-3.0-title",)),
    ("LGPL-2.1", ("lgpl-2.1-title",)),
    ("LGPL-3.0", ("lgpl-3.0-title",)),
    ("AGPL-3.0", ("agpl-3.0-title",)),
    ("GPL", ("gpl-free",)),
    *((lic, (name, *more)) for lic, name in (("GPL-2.0", "gpl-2.0-notice"), ("GPL-2.0", "gpl-2.0-only-notice"), ("GPL-3.0", "gpl-3.0-notice"), ("LGPL-2.1", "lgpl-2.1-notice"), ("LGPL-3.0", "lgpl-3.0-notice"), ("AGPL-3.0", "agpl-3.0-notice")) for more in ((), ("gpl-warranty",))),
    ("MPL-2.0", ("mpl-2.0",)),
    ("MPL-2.0", ("mpl-2.0-title",)),
    ("EPL-2.0", ("epl-2.0",)),
    ("EPL-2.0", ("epl-2.0-title",)),
    ("BSL-1.0", ("bsl-1.0",)),
    ("BSL-1.0", ("bsl-1.0-title",)),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0-law", "cc0-waived")),
    ("CC0-1.0", ("cc0-title",)),
    ("WTFPL", ("wtfpl-title",)),
    *((f"CC-{c}-{v}", (f"cc-{c.lower()}-{v}{kind}",)) for c in CREATIVE for v in ("3.0", "4.0") for kind in ("", "-short")),
    *((re.sub("-(only|or-later)$", "", x), (f"spdx-{x.lower()}",)) for x in SPDX),
    ("Proprietary", ("reserved",)),
)
#: Every known sentence holds one of these, so a text without any needs no cutting.
ANCHORS = ("licen", "reserved", "copyright", "permission", "compliance", "warrant", "version 3", "free software", "redistribution", "public domain", "cc0", "under law")
#: Patterns that Java and RE2 read alike.
CUT, OTHER = r"[.;:!?]+(?:[ \t\n\r\f]|\z)|[\n\r\f]", r"[^a-z0-9.+]+"


def _plain(sentence: str) -> str:
    return " ".join(w.rstrip(".") for w in re.sub(OTHER, " ", sentence.lower()).split())


_ALL = {
    **TEXTS,
    **{f"cc-{c.lower()}-{v}": f"This work is licensed under a Creative Commons {name} {v} {area} License" for c, name in CREATIVE.items() for v, area in (("3.0", "Unported"), ("4.0", "International"))},
    **{f"cc-{c.lower()}-{v}-short": f"licensed under CC {c} {v}" for c in CREATIVE for v in ("3.0", "4.0")},
    **{f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in SPDX + OTHERS},
}
#: Known sentences, normalised, by name; what follows a slash in a name tells wordings of one identifier apart.
SENTENCES: dict[str, str] = {}
for _name, _text in _ALL.items():
    if (_words := _plain(_text)) not in SENTENCES.values():
        SENTENCES[_name] = _words
assert all(any(a in s for a in ANCHORS) for s in SENTENCES.values())
RULES = tuple(x for x in RULES if all(n in SENTENCES for n in x[1]))
_CODES = {name: i for i, name in enumerate(SENTENCES, 1)}
#: The code of the identifier that a wording stands for.
_SAME = {code: _CODES[name.split("/")[0]] for name, code in _CODES.items() if "/" in name}
_GAP, _END = r"\.*[ |]+", r"(?=\.*[ |])"


def _pattern(sentences: list[list[str]]) -> str:
    """A pattern of the sentences as a tree of their words, the longest that fits."""
    heads: dict[str, list[list[str]]] = {}
    for s in sentences:
        heads.setdefault(s[0], []).append(s[1:])
    out = []
    for word, rests in heads.items():
        more = [r for r in rests if r]
        ends = len(more) < len(rests)
        tail = f"{_GAP}{_pattern(more)}" if more else ""
        out.append(re.sub(r"([.+])", r"\\\1", word) + (f"(?:{tail}|{_END})" if more and ends else tail or _END))
    return f"(?:{'|'.join(out)})"


#: A known sentence wherever it stands, over any cuts; of those that begin at a word the longest.
KNOWN = r"(?<=[ |])" + _pattern([s.split(" ") for s in SENTENCES.values()])


def known_sentences(text: Column) -> Column:
    """array<struct<pos, last, at, to, code>>: pieces and words where the text's known sentences begin and end, in order."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), CUT, "\n"), r"[^a-z0-9.+\n]+", " ")
    marked = F.concat(F.lit(" "), F.regexp_replace(plain, "\n", " | "), F.lit(" "))
    numbers = F.create_map(*[F.lit(x) for name, s in SENTENCES.items() for x in (s, _CODES[name])])
    bars, words = lambda x: F.regexp_count(x, F.lit(r"\|")), lambda x: F.regexp_count(x, F.lit("[^ |]+"))
    size = lambda x: F.struct(bars(x).alias("bars"), words(x).alias("words"))
    hit = lambda g, m: F.struct(size(g).alias("gap"), size(m).alias("own"), F.element_at(numbers, F.regexp_replace(m, r"\.*[ |]+", " ")).alias("code"))
    hits = F.zip_with(F.split(marked, KNOWN), F.regexp_extract_all(marked, F.lit(KNOWN), F.lit(0)), lambda g, m: F.when(m.isNotNull(), hit(g, m)))
    none = F.array().cast("array<struct<pos:int,last:int,at:int,to:int,code:int>>")

    def add(acc: Column, x: Column) -> Column:
        pos, at = acc["bars"] + x["gap"]["bars"], acc["words"] + x["gap"]["words"]
        last, to = pos + x["own"]["bars"], at + x["own"]["words"]
        found = F.struct(pos.alias("pos"), last.alias("last"), at.alias("at"), to.alias("to"), x["code"].alias("code"))
        return F.struct(last.alias("bars"), to.alias("words"), F.concat(acc["seen"], F.array(found)).alias("seen"))

    start = F.struct(F.lit(0).alias("bars"), F.lit(0).alias("words"), none.alias("seen"))
    return F.aggregate(F.filter(hits, lambda x: x.isNotNull()), start, add, lambda acc: acc["seen"])


def anchored(text: Column) -> Column:
    """Whether a text holds the first word of an anchor, without which it holds no known sentence."""
    return reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(a.split(" ")[0])) for a in ANCHORS))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, license, first_sentence, last_sentence: a row for each match."""
    same = F.create_map(*[F.lit(x) for pair in _SAME.items() for x in pair])
    one = lambda x: x.withField("code", F.coalesce(F.element_at(same, x["code"]), x["code"]))
    # written, so that the many references to `seen` below read a column and don't cut the text again
    seen = written(docs.where(anchored(F.col("text"))).select("doc_id", F.transform(known_sentences(F.col("text")), one).alias("seen")).where(F.size("seen") > 0), f"{shared_dir(docs.sparkSession)}/seen")
    none = F.array().cast("array<struct<license:string,first_sentence:int,last_sentence:int,at:int,to:int>>")

    def matches(license: str, names: tuple[str, ...]) -> Column:
        n, codes = len(names), [_CODES[x] for x in names]

        def runs(own: Column) -> Column:
            at = lambda i: F.get(own, i)
            fits = lambda i: reduce(lambda a, b: a & b, [at(i + k)["code"] == c for k, c in enumerate(codes)] + [at(i + k)["at"] - at(i + k - 1)["to"] <= GAP_WORDS for k in range(1, n)])
            found = F.filter(F.transform(own, lambda _, i: i), fits)
            return F.transform(found, lambda i: F.struct(F.lit(license).alias("license"), at(i)["pos"].alias("first_sentence"), at(i + n - 1)["last"].alias("last_sentence"), at(i)["at"].alias("at"), at(i + n - 1)["to"].alias("to")))

        # other licences' sentences may stand between those of a rule; without its first sentence there is no match
        return F.when(F.exists("seen", lambda x: x["code"] == codes[0]), runs(F.filter("seen", lambda x: x["code"].isin(codes)))).otherwise(none)

    every = seen.select("doc_id", F.concat(*[matches(*r) for r in RULES]).alias("m"))
    inside = lambda x, y: (y["at"] <= x["at"]) & (y["to"] >= x["to"]) & (y["to"] - y["at"] > x["to"] - x["at"])
    return every.select("doc_id", F.filter("m", lambda x: ~F.exists("m", lambda y: inside(x, y))).alias("m")).select("doc_id", F.inline("m")).drop("at", "to")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORACLE = f"""
WITH RECURSIVE known(sentence, code, same) AS (VALUES {", ".join(f"({_quoted(s)}, {_CODES[n]}, {_SAME.get(_CODES[n], _CODES[n])})" for n, s in SENTENCES.items())}),
sentence AS (SELECT string_split(sentence, ' ') AS ws, same AS code FROM known),
rule(id, license, k, code, n) AS (VALUES {", ".join(f"({i}, {_quoted(lic)}, {k}, {_CODES[x]}, {len(names)})" for i, (lic, names) in enumerate(RULES) for k, x in enumerate(names))}),
docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '{CUT}', chr(10), 'g'), '[^a-z0-9.+' || chr(10) || ']+', ' ', 'g'), chr(10), ' | ', 'g'), ' +', ' ', 'g')), ' ') AS ts
         FROM documents WHERE {" OR ".join(f"contains(lower(text), {_quoted(a.split(' ')[0])})" for a in ANCHORS)}),
piece AS (SELECT r, k, t, count(*) FILTER (t = '|') OVER (PARTITION BY r ORDER BY k) AS pos FROM (SELECT r, unnest(ts) AS t, generate_subscripts(ts, 1) AS k FROM docs)),
word AS MATERIALIZED (SELECT *, lead(w) OVER (PARTITION BY r ORDER BY i) AS after FROM (SELECT r, row_number() OVER (PARTITION BY r ORDER BY k) AS i, rtrim(t, '.') AS w, pos FROM piece WHERE t NOT IN ('|', ''))),
of_sentence AS (SELECT id, code, ws[j] AS w, ws[2] AS after, len(ws) AS n, j FROM (SELECT row_number() OVER () AS id, code, ws, unnest(range(1, len(ws) + 1)) AS j FROM sentence)),
begun AS MATERIALIZED (SELECT a.r, a.i, s.id, s.code, s.n FROM word a JOIN of_sentence s ON s.j = 1 AND a.w = s.w AND a.after = s.after),
every AS (SELECT a.r, a.i, a.code, a.n FROM begun a JOIN of_sentence t ON t.id = a.id
          JOIN word b ON b.r = a.r AND b.i = a.i + t.j - 1 AND b.w = t.w GROUP BY a.r, a.i, a.id, a.code, a.n HAVING count(*) = a.n),
longest AS (SELECT r, i, max(n) AS n, arg_max(code, n) AS code FROM every GROUP BY r, i),
kept(r, i, til) AS (SELECT r, min(i), arg_min(i + n, i) FROM longest GROUP BY r
                    UNION ALL SELECT y.r, min(y.i), arg_min(y.i + y.n, y.i) FROM kept x JOIN longest y ON y.r = x.r AND y.i >= x.til GROUP BY y.r),
seen AS (SELECT x.r, x.code, x.i AS beg, x.i + x.n AS til, a.pos AS pos, b.pos AS last FROM longest x JOIN kept USING (r, i) JOIN word a ON a.r = x.r AND a.i = x.i JOIN word b ON b.r = x.r AND b.i = x.i + x.n - 1),
owned AS (SELECT s.*, c.id, row_number() OVER w AS i, beg - lag(til) OVER w AS gap FROM seen s JOIN (SELECT DISTINCT id, code FROM rule) c ON s.code = c.code
       WINDOW w AS (PARTITION BY s.r, c.id ORDER BY beg)),
hits AS (SELECT f.r, rule.id, any_value(rule.license) AS license, min(f.pos) AS first_sentence, max(f.last) AS last_sentence, min(f.beg) AS beg, max(f.til) AS til
         FROM owned f JOIN rule ON f.id = rule.id AND f.code = rule.code GROUP BY f.r, rule.id, f.i - rule.k
         HAVING count(*) = any_value(rule.n) AND count_if(rule.k > 0 AND gap > {GAP_WORDS}) = 0)
SELECT doc_id, license, CAST(first_sentence AS INTEGER) AS first_sentence, CAST(last_sentence AS INTEGER) AS last_sentence FROM hits x JOIN docs USING (r)
WHERE NOT EXISTS (SELECT 1 FROM hits y WHERE y.r = x.r AND y.beg <= x.beg AND y.til >= x.til AND y.til - y.beg > x.til - x.beg)
"""
