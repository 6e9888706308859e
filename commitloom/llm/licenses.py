"""Licences of documents by sentence rules: known sentences become identifiers, their sequences licences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised licence sentences (lower case, runs of anything but a-z and 0-9 are one blank)
#: and the identifiers they stand for.
SENTENCES = {
    "released under the mit license": "MITref",
    "licensed under the mit license": "MITref",
    "this project is licensed under the mit license": "MITref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITperm",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "licensed under the apache license version 2 0": "Apache2ref",
    "licensed under the apache license version 2 0 the license": "Apache2ref",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "this work is licensed under the gnu general public license version 3": "GPL3ref",
    "this work is licensed under the gnu general public license version 2": "GPL2ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2later",
    "you should have received a copy of the gnu general public license along with this program": "GPLcopy",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDendorse",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2ref",
    "licensed under cc by 4 0": "CCBY4ref",
    "licensed under cc by sa 4 0": "CCBYSA4ref",
    "licensed under cc by nc 4 0": "CCBYNC4ref",
    "licensed under cc by nd 4 0": "CCBYND4ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "CCBY4ref",
    "all rights reserved": "AllRights",
}
#: Ordered rules. The first one whose identifiers follow each other takes them.
RULES = (
    (("MITperm", "MITnotice"), "MIT"),
    (("Apache2ref", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee"), "Apache-2.0"),
    (("Apache2ref", "ApacheUse", "ApacheCopy"), "Apache-2.0"),
    (("GPL3later", "GPLcopy"), "GPL-3.0-or-later"),
    (("GPL2later", "GPLcopy"), "GPL-2.0-or-later"),
    (("BSDsource", "BSDbinary", "BSDendorse"), "BSD-3-Clause"),
    (("BSDsource", "BSDbinary"), "BSD-2-Clause"),
    (("MITref",), "MIT"),
    (("MITperm",), "MIT"),
    (("Apache2ref",), "Apache-2.0"),
    (("GPL3ref",), "GPL-3.0"),
    (("GPL2ref",), "GPL-2.0"),
    (("GPL3later",), "GPL-3.0-or-later"),
    (("GPL2later",), "GPL-2.0-or-later"),
    (("MPL2ref",), "MPL-2.0"),
    (("CCBY4ref",), "CC-BY-4.0"),
    (("CCBYSA4ref",), "CC-BY-SA-4.0"),
    (("CCBYNC4ref",), "CC-BY-NC-4.0"),
    (("CCBYND4ref",), "CC-BY-ND-4.0"),
    (("AllRights",), "Proprietary"),
)
#: Further sentences and rules.
FURTHER_SENTENCES = {
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "GPL2only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL3later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or any later version": "AGPL3later",
    "you should have received a copy of the gnu affero general public license along with this program": "AGPLcopy",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "LGPL21later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL3later",
    "you should have received a copy of the gnu lesser general public license along with this library": "LGPLcopy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCperm",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CCBYSA4ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CCBYNC4ref",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "CCBYND4ref",
}
FURTHER_RULES = (
    (("AGPL3later", "AGPLcopy"), "AGPL-3.0-or-later"),
    (("LGPL21later", "LGPLcopy"), "LGPL-2.1-or-later"),
    (("LGPL3later", "LGPLcopy"), "LGPL-3.0-or-later"),
    (("GPL2only", "GPLcopy"), "GPL-2.0"),
    (("AGPL3later",), "AGPL-3.0-or-later"),
    (("LGPL21later",), "LGPL-2.1-or-later"),
    (("LGPL3later",), "LGPL-3.0-or-later"),
    (("GPL2only",), "GPL-2.0"),
    (("GPLcopy",), "GPL"),
    (("AGPLcopy",), "AGPL"),
    (("LGPLcopy",), "LGPL"),
    (("ISCperm",), "ISC"),
    (("Unlicense",), "Unlicense"),
)
FURTHER_RESTRICTED = ("AGPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "GPL", "AGPL", "LGPL")
FURTHER_STEMS = ("unencumbered",)
#: Licences that forbid or bind reuse.
RESTRICTED = ("GPL-3.0", "GPL-2.0", "GPL-3.0-or-later", "GPL-2.0-or-later", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "Proprietary")
#: Every known sentence has one of these stems.
STEMS = ("licen", "permission", "redistribut", "rights")


_KNOWN = SENTENCES | FURTHER_SENTENCES
#: A known sentence, the longest first, its words apart by blanks, line breaks (\n), or a semicolon or blank line (\2).
_FIND = (
    r"(?<=[ \n\x01\x02])(?<!\bnot[ \n])(?<!\bnever[ \n])(?:"
    + "|".join(s.replace(" ", r"[ \n\x02]{1,6}") for s in sorted(_KNOWN, key=len, reverse=True))
    + r")(?= ?[\n\x01\x02])"
)


def marked(text: Column) -> Column:
    """The text in lower case with blanks for all but a-z and 0-9; sentence ends are \\1, semicolons and blank lines \\2.

    Comment marks at the start of lines are left out. A sentence ends at . ! or ? before white space, but not after v (v. 2.0).
    """
    lines = F.regexp_replace(F.lower(text), r"\r\n?", "\n")
    bare = F.regexp_replace(lines, r"(?m)^[ \t]*(?:#+|//+|/?\*+/?|--+|;+|%+|<!--|>+|\||(?:rem|dnl)(?=\s))", "")
    ends = F.regexp_replace(bare, r"(?<!\bv)[.!?](?=[\"')\]*]{0,3}(?:\s|$))", "\x01")
    soft = F.regexp_replace(F.regexp_replace(ends, r";(?=\s|$)", "\x02"), r"\n\s*\n", "\x02")
    words = F.regexp_replace(soft, r"[^a-z0-9\n\x01\x02]+", " ")
    return F.concat(F.lit("\x01"), F.regexp_replace(words, r"\bhttps\b", "http"), F.lit("\x01"))


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order. Texts without any stem are not searched.

    A sentence may be wrapped anywhere, stand in comments and have words before it (but not ``not``); it ends with a
    sentence or a line.
    """
    known = F.create_map(*(F.lit(x) for pair in _KNOWN.items() for x in pair))
    found = F.regexp_extract_all(marked(text), F.lit(_FIND), F.lit(0))
    ids = F.transform(found, lambda s: F.element_at(known, F.regexp_replace(s, "[^a-z0-9]+", " ")))
    stem = reduce(lambda a, b: a | b, [F.lower(text).contains(s) for s in (*STEMS, *FURTHER_STEMS)])
    return F.when(stem, ids).otherwise(F.array().cast("array<string>"))


def licences(ids: Column) -> Column:
    """Licences of an identifier sequence, in the order of the rules; each identifier is used once."""
    rest = F.concat(F.lit("|"), F.array_join(F.transform(ids, lambda i: F.concat(i, F.lit("|"))), "|"))
    found = []
    for pattern, licence in (*RULES, *FURTHER_RULES):
        run = "|" + "||".join(pattern) + "|"
        found.append(F.when(F.contains(rest, F.lit(run)), F.lit(licence)))
        rest = F.replace(rest, F.lit(run), F.lit("|/|"))
    return F.array_distinct(F.array_compact(F.array(*found)))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with sentence_ids and licences (arrays) and restricted (boolean).

    Row-local, no shuffle. Texts that are null, empty or without a known sentence have empty arrays and are not
    restricted; repeated sentences are repeated identifiers but one licence. Repeated rows and null keys stay;
    columns with the names of results are replaced. An empty table gives no rows.
    """
    found = docs.withColumn("sentence_ids", F.coalesce(identifiers(F.col(f"`{text}`")), F.array().cast("array<string>")))
    found = found.withColumn("licences", licences(F.col("sentence_ids")))
    return found.withColumn("restricted", F.arrays_overlap("licences", F.array(*map(F.lit, RESTRICTED + FURTHER_RESTRICTED))))


def scan_sql() -> str:
    """DuckDB SQL for doc_id, sentence_ids, licences (joined by commas) and restricted of ``documents``.

    It knows the same sentences and rules. Its patterns cannot look around, so capitals, doubled, stand between words of the text in
    lower case: SS for a line end, a semicolon or a blank line, which a sentence may go on beyond, and EE for the end of a sentence.
    """
    every = sorted(_KNOWN, key=len, reverse=True)
    ids = ", ".join(f"'{s}': '{_KNOWN[s]}'" for s in every)
    stems = " OR ".join(f"contains(lower(text), '{s}')" for s in (*STEMS, *FURTHER_STEMS))
    sentence = "|".join(s.replace(" ", "(?: |SS)") for s in every)
    marks = (
        (r"\r\n?", "\n"),
        (r"(?m)^[ \t]*(?:#+|//+|/?\*+/?|--+|;+|%+|<!--|>+|\|)", ""),
        (r"(?m)^[ \t]*(?:rem|dnl)(\s)", r"\1"),
        (r"\bhttps\b", "http"),
        (r"\bv[.!?]", "v,"),
        (r"[.!?]([\"')\]*]{0,3})(\s|\z)", r"E\1\2"),
        (r";(\s|\z)", r"S\1"),
        (r"\n\s*\n", "S"),
        (r"\n", "S"),
        (r"[^a-z0-9ES]+", " "),
        (r"[ S]*E[ SE]*", "EE"),
        (r" *S[ S]*", "SS"),
    )
    text = "lower(text)"
    for pattern, by in marks:
        pattern, by = (x.replace("'", "''") for x in (pattern, by))
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    steps, columns, last = [], [], "seq"
    for n, (pattern, licence) in enumerate((*RULES, *FURTHER_RULES)):
        run = "|" + "||".join(pattern) + "|"
        steps.append(f"r{n} AS (SELECT *, replace(rest, '{run}', '|/|') AS next_rest, CASE WHEN contains(rest, '{run}') THEN '{licence}' END AS l{n} FROM {last})")
        steps.append(f"s{n} AS (SELECT * EXCLUDE (rest, next_rest), next_rest AS rest FROM r{n})")
        columns.append(f"l{n}")
        last = f"s{n}"
    named = [(c, name) for c, (_, name) in zip(columns, (*RULES, *FURTHER_RULES))]
    first = {licence: [c for c, name in named if name == licence] for _, licence in named}
    once = ", ".join(f"coalesce({', '.join([*c, 'NULL'])})" for c in first.values())
    listed = f"list_filter([{once}], lambda x: x IS NOT NULL)"
    restricted = ", ".join(f"'{name}'" for name in RESTRICTED + FURTHER_RESTRICTED)
    return f"""
WITH marked AS (
  SELECT doc_id, CASE WHEN {stems} THEN 'EE' || {text} || 'EE' ELSE '' END AS words FROM documents),
found AS (
  SELECT doc_id, list_filter(regexp_extract_all(words, '[ SE](?:(?:not|never)(?: |SS))?(?:{sentence})[SE]'),
    lambda m: NOT regexp_matches(m, '^[ SE](not|never)[ S]')) AS found FROM marked),
seq AS (
  SELECT doc_id, ids, '|' || array_to_string(list_transform(ids, lambda i: i || '|'), '|') AS rest FROM
    (SELECT doc_id, coalesce(list_transform(found, lambda m: MAP {{{ids}}}[trim(regexp_replace(m, '[^a-z0-9]+', ' ', 'g'))]), []) AS ids FROM found)),
{", ".join(steps)}
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, coalesce(array_to_string({listed}, ','), '') AS licences,
  coalesce(len(list_filter({listed}, lambda x: x IN ({restricted}))) > 0, false) AS restricted
FROM {last}"""
