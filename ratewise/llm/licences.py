"""Licences recognised by sentence rules.

A text is normalised (A-Z to a-z, everything but letters and digits to single
blanks, so comment marks go too), and known licence sentences are mapped to
their identifiers. A sentence starts and ends at line ends, after . ! ? ;
before a blank or line end, or at a colon. A single line end or a colon may also
stand inside, so notices may be wrapped; a blank line or a sentence end may not.
The sequence of a text's identifiers, in order, is then matched against ordered
rules: a rule holds where its identifiers stand next to each other in the
sequence (other sentences may stand between them). Rules are tried from the
longest; what a rule has used no later rule sees, so a full text is not also
reported as its own short notice.

Only column expressions of one row: no shuffle, no Python. Null and empty texts
have no identifiers and no licences. Extra columns pass through; columns named
like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices, normalised, with our identifiers.
SENTENCES = {
    "all rights reserved": "reserved",
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "licensed under cc by 4 0": "cc-by-4",
    "licensed under cc by sa 4 0": "cc-by-sa-4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this work is licensed under the gnu general public license version 2": "gpl-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-free",
    "this program is free software": "gpl-free-start",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-redistribute",
    "either version 3 of the license or at your option any later version": "gpl-3-later",
    "either version 2 of the license or at your option any later version": "gpl-2-later",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under the apache license version 2 0 the license": "apache-2-head",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "see the license for the specific language governing permissions and limitations under the license": "apache-language",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "the mit license mit": "mit-title",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
# A licence, and the identifiers that say it, in order.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("Apache-2.0", ["apache-2-head", "apache-comply", "apache-copy", "apache-language"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free-start", "gpl-redistribute", "gpl-3-later"]),
    ("GPL-2.0-or-later", ["gpl-free-start", "gpl-redistribute", "gpl-2-later"]),
    ("MIT", ["mit-title", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-notice", "mit-warranty"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-copy"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-3.0-only", ["gpl-3"]),
    ("GPL-2.0-only", ["gpl-2"]),
    ("Apache-2.0", ["apache-2-head"]),
    ("Apache-2.0", ["apache-2"]),
    ("MIT", ["mit"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("Unlicense", ["unlicense"]),
    ("all-rights-reserved", ["reserved"]),
]


def stream(text: Column) -> Column:
    """The text normalised, with three marks: H ends a sentence, C is a colon
    before a blank, and a line end may be a wrap."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, r"[.!?;][ \t]+|[.!?;:][ \t\r]*\n", "H")
    t = F.regexp_replace(t, r":[ \t]+", "C")
    t = F.regexp_replace(t, r"[^a-z0-9\nHC]+", " ")
    return F.trim(F.regexp_replace(t, r" ?([\nHC]) ?", "$1"))


def identifiers(text: Column, known: dict[str, str] = SENTENCES) -> Column:
    """The identifiers of the known sentences, in order. Where several start at a place,
    a whole line comes before a wrapped sentence, and the longest first."""
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    longest = sorted(known, key=len, reverse=True)
    end = "(?![a-z0-9 ])"
    any_ = f"(?:{'|'.join(longest)}){end}|(?:{'|'.join(s.replace(' ', r'[ \nC]') for s in longest)}){end}"
    found = F.regexp_extract_all(stream(text), F.lit(f"(?<![a-z0-9 ])(?:{any_})"), F.lit(0))
    return F.transform(found, lambda s: table[F.translate(s, "\nC", "  ")])


def _sequence(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def scan(docs: DataFrame, text: str = "text", known: dict[str, str] = SENTENCES, rules=None) -> DataFrame:
    """Adds ``sentence_ids`` and ``licences`` (both arrays; licences by name, once each)."""
    rules = sorted(RULES if rules is None else rules, key=lambda r: -len(r[1]))
    joined = F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    # the sequence as a string; each rule takes its part out before the next looks
    state = F.struct(joined.alias("left"), F.array().cast("array<string>").alias("found"))
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_sequence(ids)).alias("ids")) for name, ids in rules])
    end = F.aggregate(table, state, lambda at, rule: F.struct(
        F.replace(at["left"], rule["ids"], F.lit("|")).alias("left"),
        F.when(at["left"].contains(rule["ids"]), F.array_append(at["found"], rule["name"])).otherwise(at["found"]).alias("found")))
    return (docs.withColumn("sentence_ids", identifiers(F.col(text), known))
            .withColumn("licences", F.array_sort(F.array_distinct(end["found"]))))
