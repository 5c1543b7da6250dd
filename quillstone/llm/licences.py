"""Licences by sentence rules.

Texts are normalised; known sentences, on one line or wrapped, become
identifiers, all others are dropped.  A document's sequence of identifiers is
then matched against rules, which are ordered sequences of identifiers: longer
rules first, and what a rule has matched is used up.  All of it is a narrow
chain of column expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentences of published licences and notices, normalised, with their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0 the license": "ApacheGrant",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at http www.apache.org licenses license 2.0": "ApacheCopy",
    "you may obtain a copy of the license at https www.apache.org licenses license 2.0": "ApacheCopy",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "AsIs",
    "the software is provided as is without warranty of any kind": "AsIs",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "ZeroBsdGrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "IscAsIs",
    "this software is provided as is without any express or implied warranty": "ZlibAsIs",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZlibLiable",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "this program is free software": "FreeSoftware",
    "this library is free software": "FreeSoftware",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GplTerms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LgplTerms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "AgplTerms",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "Gpl2Only",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Lgpl3Terms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Agpl3Terms",
    "either version 3 of the license or at your option any later version": "V3OrLater",
    "either version 2.1 of the license or at your option any later version": "V21OrLater",
    "either version 2 of the license or at your option any later version": "V2OrLater",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "Mpl2Terms",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "Mpl2Terms",
    "this is free and unencumbered software released into the public domain": "UnlicenseGrant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BoostGrant",
    "distributed under the boost software license version 1.0": "BoostTerms",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0": "Epl2Terms",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution and is available at http www.eclipse.org legal epl v10.html": "Epl1Terms",
    "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed": "Artistic2Terms",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "WtfplTerms",
    "all rights reserved": "AllRights",
}
#: Licences as one-line references name them, normalised, with their identifiers.
NAMES = {
    "apache license version 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0", "mit license": "MIT", "isc license": "ISC", "zlib license": "Zlib",
    "gnu general public license version 3": "GPL-3.0-only", "gnu general public license v3.0": "GPL-3.0-only", "gnu general public license version 2": "GPL-2.0-only",
    "gnu lesser general public license version 3": "LGPL-3.0-only", "gnu lesser general public license version 2.1": "LGPL-2.1-only", "gnu affero general public license version 3": "AGPL-3.0-only",
    "bsd 2 clause license": "BSD-2-Clause", "bsd 3 clause license": "BSD-3-Clause", "mozilla public license version 2.0": "MPL-2.0", "mozilla public license 2.0": "MPL-2.0",
    "boost software license 1.0": "BSL-1.0", "eclipse public license 2.0": "EPL-2.0", "artistic license 2.0": "Artistic-2.0", "unlicense": "Unlicense",
}
#: How a reference begins.
LEADS = ("licensed under the", "released under the", "distributed under the", "this project is licensed under the", "this work is licensed under the", "this software is licensed under the")
#: Conditions of the Creative Commons licences.
CONDITIONS = {"by": "attribution", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc": "attribution noncommercial", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}


def _references() -> dict[str, str]:
    """Sentence -> identifier of its licence, for references by name."""
    out = {f"{lead} {name}": licence for lead in LEADS for name, licence in NAMES.items()}
    for version in ("3.0", "4.0"):
        kind = {"3.0": "unported", "4.0": "international"}[version]
        for short, long in CONDITIONS.items():
            licence = f"CC-{short.replace(' ', '-').upper()}-{version}"
            for lead in ("licensed under", "released under", "this work is licensed under"):
                out |= {f"{lead} cc {short} {version}": licence, f"{lead} a creative commons {long} {version} {kind} license": licence, f"{lead} the creative commons {long} {version} {kind} license": licence}
    return out | {f"{lead} cc0 1.0": "CC0-1.0" for lead in ("licensed under", "released under", "this work is licensed under")}


REFERENCES = _references()
#: Rules, ordered sequences of identifiers, with the licences they stand for; longer ones first.
RULES = (
    (("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"), "BSD-3-Clause"),
    (("FreeSoftware", "GplTerms", "V3OrLater"), "GPL-3.0-or-later"),
    (("FreeSoftware", "GplTerms", "V2OrLater"), "GPL-2.0-or-later"),
    (("FreeSoftware", "LgplTerms", "V3OrLater"), "LGPL-3.0-or-later"),
    (("FreeSoftware", "LgplTerms", "V21OrLater"), "LGPL-2.1-or-later"),
    (("FreeSoftware", "AgplTerms", "V3OrLater"), "AGPL-3.0-or-later"),
    (("BsdGrant", "BsdSource", "BsdBinary"), "BSD-2-Clause"),
    (("ApacheGrant", "ApacheComply", "ApacheCopy"), "Apache-2.0"),
    (("MitGrant", "MitNotice", "AsIs"), "MIT"),
    (("ZlibAsIs", "ZlibLiable", "ZlibGrant"), "Zlib"),
    (("FreeSoftware", "Gpl3Terms"), "GPL-3.0-or-later"),
    (("FreeSoftware", "Gpl2Terms"), "GPL-2.0-or-later"),
    (("FreeSoftware", "Lgpl3Terms"), "LGPL-3.0-or-later"),
    (("FreeSoftware", "Agpl3Terms"), "AGPL-3.0-or-later"),
    (("FreeSoftware", "Gpl2Only"), "GPL-2.0-only"),
    (("FreeSoftware", "GplTerms"), "GPL"),
    (("MitGrant", "MitNotice"), "MIT"),
    (("ApacheGrant", "ApacheComply"), "Apache-2.0"),
    (("IscGrant", "IscAsIs"), "ISC"),
    (("ZeroBsdGrant", "IscAsIs"), "0BSD"),
    (("ApacheGrant",), "Apache-2.0"),
    (("MitGrant",), "MIT"),
    (("IscGrant",), "ISC"),
    (("ZeroBsdGrant",), "0BSD"),
    (("Mpl2Terms",), "MPL-2.0"),
    (("UnlicenseGrant",), "Unlicense"),
    (("BoostGrant",), "BSL-1.0"),
    (("BoostTerms",), "BSL-1.0"),
    (("Epl2Terms",), "EPL-2.0"),
    (("Epl1Terms",), "EPL-1.0"),
    (("Artistic2Terms",), "Artistic-2.0"),
    (("WtfplTerms",), "WTFPL"),
    (("AllRights",), "Proprietary"),
)
#: First sentences of notices, which may follow a title and a copyright on the same line.
_FIRST = (
    "permission is hereby granted free of charge to any person", "licensed under the apache license version 2.0 the license", "permission to use copy modify and",
    "this software is provided as is without any express", "redistribution and use in source and binary forms", "this program and the accompanying materials", "this source code form is subject",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word that every known sentence has.
HINT = r"licens|copyright|permi|redistribut|software|warrant|rights|endorse|version|program|released"
#: Sentences end at semicolons, at . ! ? : before white space or the end (not at "v."), and at lines without a letter or digit.
#: A known sentence may also begin and end with a line; line ends within it are white space.
_STOP, _OTHER = r"(?<!\bv)[.!?:](?=[\t\r\n ]|$)|\n[^a-z0-9\n]*(?=\n)", r"[^a-z0-9.;\n]+"


def _pattern(sentences) -> str:
    """A regular expression of the known sentences between their bounds, longer ones first; an address is an end."""
    def gaps(s: str) -> str:
        # The published Apache notice has an empty line before its address.
        return s.replace(".", r"\.").replace(" ", r"[ \n]+").replace(r"at[ \n]+http", r"at[ ;\n]+http")

    known = "|".join(gaps(s) for s in sorted(sentences, key=len, reverse=True))
    return rf"(?:(?:^|[;\n])[ .]*+|(?<= )(?={'|'.join(map(gaps, _FIRST))}))({known})(?=[ .]*+(?:[;\n]|$)|(?<=licenses license 2\.0|legal epl 2\.0|legal epl v10\.html) )"


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, sentences array<string> (identifiers in order), licences array<string> (sorted, distinct).

    One row per row of `docs` (doc_id, text; other columns are ignored), from
    built-in functions only and without a shuffle.  Known sentences are found on
    one line and hard-wrapped, also behind comment signs.  Null and empty texts have
    empty arrays; doc_ids are carried along, null or repeated; no rows give no
    rows.
    """
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    sentences = SENTENCES | REFERENCES
    known = F.create_map(*(F.lit(x) for pair in sentences.items() for x in pair))
    plain = F.regexp_replace(F.regexp_replace(text, _STOP, ";"), _OTHER, " ")
    likely = F.when(text.rlike(HINT), F.regexp_extract_all(plain, F.lit(_pattern(sentences)), F.lit(1))).otherwise(F.array().cast("array<string>"))
    found = F.transform(likely, lambda s: F.element_at(known, F.regexp_replace(s, r"[ ;\n]+", " ")))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("sentences"))
    # Identifiers are kept as "<a><b>", so a rule is a substring; what it matched becomes "|".
    line = F.array_join(F.transform("sentences", lambda s: F.concat(F.lit("<"), s, F.lit(">"))), "")
    out = out.withColumn("_line", line).withColumn("_found", F.lit("").cast("string"))
    for sequence, name in RULES:
        rule = "".join(f"<{s}>" for s in sequence)
        hit = F.contains(F.col("_line"), F.lit(rule))
        out = out.select("doc_id", "sentences", F.when(hit, F.replace(F.col("_line"), F.lit(rule), F.lit("|"))).otherwise(F.col("_line")).alias("_line"), F.when(hit, F.concat("_found", F.lit(name + "\n"))).otherwise(F.col("_found")).alias("_found"))
    # The identifier of a reference is its licence.
    named = F.filter("sentences", lambda s: s.isin(*sorted(set(REFERENCES.values()))))
    licences = F.array_sort(F.array_distinct(F.concat(F.filter(F.split("_found", "\n"), lambda x: x != ""), named)))
    return out.select("doc_id", "sentences", licences.alias("licences"))
