"""License scans by sentence rules, in DataFrame functions only.

Sentences are normalised and mapped to identifiers of known licence sentences; the sequence of identifiers of a text is then
matched against ordered rules, the first that fits a place taking it. A known sentence may run over cuts: wrapped lines, or
marks inside it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowered

#: Known licence sentences, normalised (ASCII lower case, anything but a-z, 0-9 and + as one blank).
SENTENCES = {
    "mit-title": "the mit license",
    "mit-title-short": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-2-header": "licensed under the apache license version 2 0 the license",
    "apache-2-compliance": "you may not use this file except in compliance with the license",
    "apache-2-obtain": "you may obtain a copy of the license at",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-free-2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2-terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache-2-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2-limits": "see the license for the specific language governing permissions and limitations under the license",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "lgpl-3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-2-1-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl-3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl-2-obtain": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "epl-2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "zero-bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}

#: How texts name a licence, and what stands in front of the name.
NAMED = {
    "MIT": ("the mit license", "the mit licence", "mit", "the expat license"),
    "Apache-2.0": ("the apache license version 2 0", "the apache license 2 0", "the apache 2 0 license", "apache 2 0"),
    "GPL-2.0": ("the gnu general public license version 2", "the gnu gpl v2", "the gplv2", "gpl 2 0"),
    "GPL-3.0": ("the gnu general public license version 3", "the gnu gpl v3", "the gplv3", "gpl 3 0"),
    "LGPL-2.1": ("the gnu lesser general public license version 2 1", "lgpl 2 1"),
    "LGPL-3.0": ("the gnu lesser general public license version 3", "lgpl 3 0"),
    "AGPL-3.0": ("the gnu affero general public license version 3", "the agplv3", "agpl 3 0"),
    "MPL-2.0": ("the mozilla public license version 2 0", "the mozilla public license 2 0", "mpl 2 0"),
    "EPL-2.0": ("the eclipse public license 2 0", "epl 2 0"),
    "BSD-2-Clause": ("the bsd 2 clause license", "the simplified bsd license", "bsd 2 clause"),
    "BSD-3-Clause": ("the bsd 3 clause license", "the new bsd license", "bsd 3 clause"),
    "ISC": ("the isc license", "isc"),
    "BSL-1.0": ("the boost software license version 1 0", "bsl 1 0"),
    "Zlib": ("the zlib license",),
    "EUPL-1.2": ("the european union public licence version 1 2", "eupl 1 2"),
    "Unlicense": ("the unlicense",),
    "CC0-1.0": ("cc0 1 0", "the creative commons zero 1 0 license"),
    "CC-BY-4.0": ("cc by 4 0", "a creative commons attribution 4 0 international license", "the creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "a creative commons attribution sharealike 4 0 international license", "the creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "a creative commons attribution noncommercial 4 0 international license", "the creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "a creative commons attribution noderivatives 4 0 international license"),
}
FORMS = ("licensed under", "released under", "distributed under", "available under", "this work is licensed under", "this project is licensed under", "this software is licensed under")
SENTENCES |= {f"{licence}/{name}/{form}": f"{form} {name}" for licence, names in NAMED.items() for name in names for form in FORMS}

#: Rules in order: licence, and the identifiers that follow each other. A longer sequence stands before its parts.
RULES = [
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-title-short", "mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache-2-header", "apache-2-compliance", "apache-2-obtain")),
    ("LGPL-3.0-or-later", ("lgpl-3-free",)),
    ("LGPL-2.1-or-later", ("lgpl-2-1-free",)),
    ("AGPL-3.0-or-later", ("agpl-3-free",)),
    ("Zlib", ("zlib-grant", "zlib-origin")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-grant",)),
    ("EPL-2.0", ("epl-2-terms",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-free-2", "gpl-hope")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("zero-bsd-grant",)),
    ("MPL-2.0", ("mpl-2-terms", "mpl-2-obtain")),
    ("MPL-2.0", ("mpl-2-terms",)),
    ("Unlicense", ("unlicense-free",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl-free-2",)),
    ("Apache-2.0", ("apache-2-header",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-title-short",)),
]
RULES += [(name.split("/")[0], (name,)) for name in SENTENCES if "/" in name]

#: A sentence ends at a line's end, or at . ! ? ; : before white space.
SPLIT = r"\n|[.!?;:](?=[\x20\x09-\x0D]|$)"
#: A piece that numbers a clause ("1." in front of it) and is no sentence.
NUMBER = r"^[0-9]{1,2}$"
#: Each known sentence holds one of these; a text without any of them needs no look at its sentences.
HINTS = ("licen", "permi", "software", "warrant", "redistribution", "mozilla", "compliance", " under ")


def identifiers(sentences: dict[str, str]) -> dict[str, int]:
    return {text: k for k, text in enumerate(sentences.values(), 1)}


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(lowered(sentence), "[^a-z0-9+]+", " "))


def license_scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list = RULES, hints: tuple = HINTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_known (known sentences in the text), licenses (of the rules that fit, sorted, each once), n_matches.

    Sentences follow each other if no other sentence stands between them; empty ones (nothing but marks) and bare list numbers
    do not count. A known sentence is found from cut to cut, however many cuts lie between its words; of two that share words
    the earlier is taken, and of two that begin together the longer. A sentence belongs to the first rule that fits. Null and empty texts have none. Rows that repeat are each scanned; null ids
    stay. Nothing is shuffled, and other columns are not read.
    """
    ids = identifiers(sentences)
    if any(not any(h in text for h in hints) for text in sentences.values()):
        raise ValueError("a known sentence holds none of the hints")
    text = F.coalesce(docs[text_col], F.lit(""))
    found = F.filter(F.transform(F.split(text, SPLIT), normalised), lambda s: (s != "") & ~s.rlike(NUMBER))
    # The pieces between line feeds. One pattern of all known sentences, long ones first, in which any blank may be a cut; what
    # it finds comes between marks that no piece holds, and is looked up by its words.
    pieces = F.concat(F.lit("\n"), F.array_join(found, "\n"), F.lit("\n"))
    known = sorted(ids, key=lambda x: (-len(x.split()), x))
    pattern = "\n(" + "|".join("[ \n]".join(map(re.escape, x.split())) for x in known) + ")(?=\n)"
    tokens = F.regexp_extract_all(F.regexp_replace(pieces, pattern, "\n\x01$1\x02"), F.lit("\x01[^\x02]*\x02|[^\n\x01\x02]+"), F.lit(0))
    numbered = F.create_map(*[F.lit(x) for text, k in ids.items() for x in (text, k)])
    numbers = F.transform(tokens, lambda s: F.when(s.startswith("\x01"), F.try_element_at(numbered, F.translate(s, "\n\x01\x02", " "))).otherwise(0))
    hinted = text.rlike("(?i)" + "|".join(h.replace(" ", "[^a-z0-9+]+") for h in hints))
    given = docs.select(docs[id_col].alias("doc_id"), F.when(hinted, numbers).otherwise(F.array().cast("array<int>")).alias("looked"))
    looked = given["looked"]
    # The sequence as text: each number between commas; rules of several sentences are replaced by marks that no later rule can
    # touch, in their order, and what numbers are left belong to the first rule of that one sentence.
    line = F.concat(F.lit(","), F.array_join(F.transform(looked, lambda k: F.concat(k.cast("string"), F.lit(","))), ","), F.lit(","))
    by_name = {name: k for k, name in enumerate(sentences, 1)}
    names: dict[str, str] = {}
    for r, (name, sequence) in enumerate(rules):
        if len(sequence) > 1:
            if any(str(by_name[x]) in names for x in sequence):
                raise ValueError("a rule of one sentence stands before a longer one that holds it")
            line = F.replace(line, F.lit(f",{',,'.join(str(by_name[x]) for x in sequence)},"), F.lit(f",L{r},"))
            names[f"L{r}"] = name
        else:
            names.setdefault(str(by_name[sequence[0]]), name)
    named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    matched = F.filter(F.transform(F.regexp_extract_all(F.col("line"), F.lit(r"L?\d+"), F.lit(0)), lambda m: F.try_element_at(named, m)), lambda x: x.isNotNull())
    held = given.select("doc_id", F.size(F.filter(looked, lambda k: k > 0)).alias("n_known"), line.alias("line")).select("doc_id", "n_known", matched.alias("matched"))
    return held.select("doc_id", "n_known", F.array_sort(F.array_distinct("matched")).alias("licenses"), F.size("matched").alias("n_matches"))
