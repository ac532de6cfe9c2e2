"""Licence scans by sentence rules (native: DataFrame functions only, no shuffle).

A text is cut into sentences, also around SPDX tags and before lines that begin with a dated
copyright; each is normalised (lower case, everything but letters and digits to one space) and gives
the identifiers of all known licence sentences in it.  Where known sentences overlap, the first of the
list counts.  Each operand of an SPDX expression is read as a tag of its own.  The identifiers, in the
order of the text, are matched against ordered rules: a rule takes the sentences it matches, so that a
later, weaker rule cannot use them again.

Only sentences with one of ``WORDS`` are normalised; every known sentence has one.  A word is letters
only, so it stands in the raw text exactly where it stands in the normalised one.

Defined cases: null or empty text has no sentences and no licences; repeated rows are scanned
each; a null doc_id is carried through; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every known sentence contains one of these words.
WORDS = ("licen", "copyright", "warrant", "redistribut", "permission", "reserved", "spdx", "domain", "cc", "commons")

#: The prefilter of the SQL text, which is kept as it was.
TRIGGERS = ("licen", "copyright", "warrant", "redistribut", "permission", "rights reserved", "spdx", "public domain")

#: Identifiers of licence sentences and what their normalised text contains.
SENTENCES = (
    ("SPDX_MIT", "spdx licen[sc]e identifier mit( |$)"),
    ("SPDX_APACHE2", "spdx licen[sc]e identifier apache 2 0"),
    ("SPDX_GPL3", "spdx licen[sc]e identifier gpl 3 0"),
    ("SPDX_GPL2", "spdx licen[sc]e identifier gpl 2 0"),
    ("SPDX_BSD3", "spdx licen[sc]e identifier bsd 3 clause"),
    ("SPDX_BSD2", "spdx licen[sc]e identifier bsd 2 clause"),
    ("MIT_GRANT", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("MIT_NOTICE", "the above copyright notice and this permission notice shall be included"),
    ("MIT_REF", "(released|licen[sc]ed|distributed|available|provided)( [a-z]+)? under the( terms of the)? mit licen[sc]e"),
    ("ISC_GRANT", "permission to use copy modify and or distribute this software for any purpose"),
    ("ISC_NOTICE", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSD_GRANT", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("BSD_SOURCE", "redistributions of source code must retain the above copyright notice"),
    ("BSD_BINARY", "redistributions in binary form must reproduce the above copyright notice"),
    ("BSD_ENDORSE", "to endorse or promote products derived from this software without specific prior written permission"),
    ("APACHE2_REF", "licen[sc]ed under the apache licen[sc]e version 2 0"),
    ("APACHE2_COMPLY", "you may not use this file except in compliance with the licen[sc]e"),
    ("APACHE2_COPY", "you may obtain a copy of the licen[sc]e at"),
    ("APACHE2_LIMITS", "see the licen[sc]e for the specific language governing permissions and limitations"),
    ("LGPL_REF", "gnu (lesser|library) general public licen[sc]e"),
    ("AGPL_REF", "gnu affero general public licen[sc]e"),
    ("GPL3_REF", "gnu general public licen[sc]e( as published by the free software foundation)?( either)? version 3"),
    ("GPL2_REF", "gnu general public licen[sc]e( as published by the free software foundation)?( either)? version 2"),
    ("GPL_WARRANTY", "without even the implied warranty of merchantability or fitness"),
    ("GPL_COPY", "you should have received a copy of the gnu general public licen[sc]e"),
    ("GPL_REF", "gnu general public licen[sc]e"),
    ("MPL2_REF", "mozilla public licen[sc]e v(ersion)? ?2 0"),
    ("CCBYNCSA_REF", "(licen[sc]ed|released|available) under( a| the)? (cc by nc sa|creative commons attribution noncommercial sharealike)"),
    ("CCBYNC_REF", "(licen[sc]ed|released|available) under( a| the)? (cc by nc|creative commons attribution noncommercial)( |$)"),
    ("CCBYSA_REF", "(licen[sc]ed|released|available) under( a| the)? (cc by sa|creative commons attribution sharealike)"),
    ("CCBY_REF", "(licen[sc]ed|released|available) under( a| the)? (cc by|creative commons attribution)( |$)"),
    ("PUBLIC_DOMAIN", "(dedicated|released|placed) (to|into|in) the public domain"),
    ("AS_IS", "software is provided as is without warranty"),
    ("RESERVED", "all rights reserved"),
    ("COPYRIGHT", "^copyright( c)? [0-9]{4}"),
)

#: Licences and the identifier sequences that show them, strongest first.
#: Other licence sentences may not stand between the parts of a rule; "*" marks an optional part.
RULES = (
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "AS_IS*")),
    ("BSD-3-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE", "AS_IS*")),
    ("BSD-2-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "AS_IS*")),
    ("ISC", ("ISC_GRANT", "ISC_NOTICE*", "AS_IS*")),
    ("Apache-2.0", ("APACHE2_REF", "APACHE2_COMPLY*", "APACHE2_COPY*", "APACHE2_LIMITS*")),
    ("Apache-2.0", ("SPDX_APACHE2",)),
    ("AGPL-3.0", ("AGPL_REF", "GPL_WARRANTY*", "AGPL_REF*")),
    ("LGPL", ("LGPL_REF", "GPL_WARRANTY*", "LGPL_REF*")),
    ("GPL-3.0", ("GPL3_REF", "GPL_WARRANTY*", "GPL_COPY*")),
    ("GPL-3.0", ("SPDX_GPL3",)),
    ("GPL-2.0", ("GPL2_REF", "GPL_WARRANTY*", "GPL_COPY*")),
    ("GPL-2.0", ("SPDX_GPL2",)),
    ("GPL", ("GPL_REF", "GPL_WARRANTY*", "GPL_COPY*")),
    ("MPL-2.0", ("MPL2_REF",)),
    ("MIT", ("MIT_REF", "AS_IS*")),
    ("MIT", ("SPDX_MIT",)),
    ("BSD-3-Clause", ("SPDX_BSD3",)),
    ("BSD-2-Clause", ("SPDX_BSD2",)),
    ("CC-BY-NC-SA", ("CCBYNCSA_REF",)),
    ("CC-BY-NC", ("CCBYNC_REF",)),
    ("CC-BY-SA", ("CCBYSA_REF",)),
    ("CC-BY", ("CCBY_REF",)),
    ("Public-Domain", ("PUBLIC_DOMAIN",)),
    ("All-Rights-Reserved", ("COPYRIGHT*", "RESERVED")),
)

#: SPDX tags of the other licences of RULES ("all rights reserved" has none).  They stand
#: apart because SENTENCES and RULES are also the SQL text.
SPDX_SENTENCES = tuple((name, f"spdx licen[sc]e identifier {tag}") for name, tag in (
    ("SPDX_ISC", "isc( |$)"),
    ("SPDX_AGPL3", "agpl 3 0"),
    ("SPDX_LGPL", "lgpl [23] [01]"),
    ("SPDX_GPL1", "gpl 1 0"),
    ("SPDX_MPL2", "mpl 2 0"),
    ("SPDX_CCBYNCSA", "cc by nc sa( |$)"),
    ("SPDX_CCBYNC", "cc by nc( [0-9]|$)"),
    ("SPDX_CCBYSA", "cc by sa( |$)"),
    ("SPDX_CCBY", "cc by( [0-9]|$)"),
    ("SPDX_PUBLIC", "(cc0|cc pddc|cc pdm|unlicense)( |$)"),
))
SPDX_RULES = (
    ("ISC", ("SPDX_ISC",)),
    ("AGPL-3.0", ("SPDX_AGPL3",)),
    ("LGPL", ("SPDX_LGPL",)),
    ("GPL", ("SPDX_GPL1",)),
    ("MPL-2.0", ("SPDX_MPL2",)),
    ("CC-BY-NC-SA", ("SPDX_CCBYNCSA",)),
    ("CC-BY-NC", ("SPDX_CCBYNC",)),
    ("CC-BY-SA", ("SPDX_CCBYSA",)),
    ("CC-BY", ("SPDX_CCBY",)),
    ("Public-Domain", ("SPDX_PUBLIC",)),
)

#: An SPDX tag with its expression, what stands between two operands, and a line of a dated copyright.
_OPERATOR = r"(?:[^a-z0-9.+\x01-]+(?:or|and|with)[^a-z0-9.+\x01-]+|[\x20\x09(]*[,/|&]+[\x20\x09(]*)"
_SPDX = r"spdx[^a-z0-9\x01]+licen[sc]e[^a-z0-9\x01]+identifier[^a-z0-9\x01]+"
_NAME = "(?!spdx[^a-z0-9])[a-z0-9]+(?:[.+:-]+[a-z0-9]+)*[+]?"
_TAG = rf"{_SPDX}{_NAME}(?:\)*{_OPERATOR}{_NAME})*"
_COPYRIGHT_LINE = r"[\r\n]([^a-z0-9\r\n\x01]*copyright[^a-z0-9\r\n\x01]+(?:c[^a-z0-9\r\n\x01]+)?[0-9]{4})"


def rule_pattern(parts: tuple[str, ...]) -> str:
    """Regular expression over the identifiers, each written as <ID>."""
    return "".join(f"(<{p[:-1]}>)?" if p.endswith("*") else f"<{p}>" for p in parts)


def _possible(text: Column) -> Column:
    found = F.lit(False)
    for w in WORDS:
        found = found | F.contains(text, F.lit(w))
    return found


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, licenses, sentence_ids, n_unmatched``: licences in rule order, the identifiers in
    the order of the text, and how many identifiers no rule has used."""

    def identify(sentence: Column) -> Column:
        # a sentence that is found becomes its mark, which no later pattern can match
        norm = F.btrim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))
        for name, pattern in SENTENCES + SPDX_SENTENCES:
            norm = F.regexp_replace(norm, pattern, f" <{name}> ")
        return F.regexp_extract_all(norm, F.lit("<([A-Z0-9_]+)>"), F.lit(1))

    def operands(piece: Column) -> Column:
        tag = F.lit("\u0001spdx license identifier ")
        return F.when(piece.rlike(f"^{_SPDX}"), F.split(F.regexp_replace(piece, _OPERATOR, tag), "\u0001", -1)) \
            .otherwise(F.array(piece))

    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    cut = F.regexp_replace("low", r"([.!?;])[\x20\x09-\x0D]+", "$1\u0001")
    cut = F.regexp_replace(F.regexp_replace(cut, _TAG, "\u0001$0\u0001"), _COPYRIGHT_LINE, "\u0001$1")
    kept = F.filter(F.split(cut, "\u0001", -1), _possible)
    ids = F.flatten(F.transform(F.flatten(F.transform(kept, operands)), identify))
    out = docs.select("doc_id", low.alias("low")) \
        .select("doc_id", F.when(_possible(F.col("low")), ids).otherwise(F.array().cast("array<string>"))
                .alias("sentence_ids"))
    out = out.withColumn("state", F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""))
    hits = []
    for k, (name, parts) in enumerate(RULES + SPDX_RULES):
        pattern = rule_pattern(parts)
        # a used rule leaves a mark, so that sentences on both sides of it do not become neighbours
        out = out.withColumn(f"hit{k}", F.when(F.col("state").rlike(pattern), F.lit(name))) \
            .withColumn("state", F.regexp_replace("state", pattern, "|"))
        hits.append(f"hit{k}")
    licenses = F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))
    left = F.char_length("state") - F.char_length(F.replace("state", F.lit("<"), F.lit("")))
    return out.select("doc_id", licenses.alias("licenses"), "sentence_ids", left.cast("long").alias("n_unmatched"))
