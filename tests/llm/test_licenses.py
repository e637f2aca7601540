import textwrap

from strandlake.llm.licenses import SENTENCES, license_scan

GRANT, NOTICE, AS_IS = (SENTENCES[f"mit-{x}"].capitalize() for x in ("grant", "notice", "as-is"))


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.n_known, r.licenses, r.n_matches) for r in license_scan(df).collect()}


def test_rules_and_order(spark):
    got = scan(
        spark,
        [
            "Some prose.\nReleased under the MIT License.\nMore prose.",
            "Licensed under the Apache License, Version 2.0.",
            "# This work is licensed under the GNU General Public License, version 3.",
            "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nReleased under the MIT License.",
            f"The MIT License\n\n{GRANT}:\n\n{NOTICE}.\n\n{AS_IS}.",
            f"{GRANT}: {NOTICE}. Other words. {AS_IS}.",
            f"{NOTICE}. {GRANT}.",
            "The licence is not a known sentence; permission and software neither.",
            None,
            "",
            "Prose without anything. " * 5000,
        ],
    )
    assert got[0] == (1, ["MIT"], 1)
    assert got[1] == (1, ["Apache-2.0"], 1)
    assert got[2] == (1, ["GPL-3.0"], 1)
    assert got[3] == (3, ["CC-BY-NC-4.0", "MIT"], 3)
    assert got[4] == (4, ["MIT"], 1)
    assert got[5] == (3, ["MIT"], 1)
    assert got[6] == (2, [], 0)
    assert all(got[k] == (0, [], 0) for k in (7, 8, 9, 10))


def test_every_single_sentence_rule_is_reached(spark):
    from strandlake.llm.licenses import RULES

    rules = [r for r in RULES]
    got = scan(spark, [". ".join(SENTENCES[x] for x in seq) + "." for _, seq in rules])
    assert all(got[k] == (len(seq), [name], 1) for k, (name, seq) in enumerate(rules))


def test_empty_table(spark):
    assert scan(spark, ["x"])[0] == (0, [], 0)
    assert license_scan(spark.createDataFrame([], "doc_id long, text string, line int")).collect() == []


#: The licences' own words.
MIT = '''Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'''
GPL = """This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{1} either version {2} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
ENDORSE = """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0'


def test_own_words_wrapped_and_not(spark):
    known = [(MIT, "MIT", 3), (GPL.format(":", ",", 3), "GPL-3.0-or-later", 2), (GPL.format(";", ";", 2), "GPL-2.0-or-later", 2), (BSD, "BSD-2-Clause", 3), (BSD + ENDORSE, "BSD-3-Clause", 4), (ISC, "ISC", 1), (MPL, "MPL-2.0", 1), (APACHE, "Apache-2.0", 3)]
    texts, want = [], []
    for text, name, n in known:
        for width, mark in ((10_000, ""), (80, ""), (70, "# "), (30, " * ")):
            wrapped = "\n\n".join(textwrap.fill(x, width) for x in text.split("\n\n"))
            texts.append("Copyright (c) Some Body\n\n" + "\n".join(mark + x for x in wrapped.split("\n")) + "\n\nMore words.")
            want.append((n, [name], 1))
    got = scan(spark, texts)
    assert [got[k] for k in range(len(texts))] == want


def test_words_between_and_around(spark):
    got = scan(spark, ["We are released\nunder the MIT License.", "Released under\nour MIT License.", "Licensed under the Apache\nLicense, Version 2.0\n(the \"License\");", "Released under the\nMIT License.\nReleased under\nCC0 1.0."])
    assert [got[k] for k in range(4)] == [(0, [], 0), (0, [], 0), (1, ["Apache-2.0"], 1), (2, ["CC0-1.0", "MIT"], 2)]


def test_nulls_and_repeated_rows(spark):
    rows = [(1, "Licensed under the MIT License."), (1, "Licensed under the MIT License."), (None, "Released under\nApache 2.0"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' licenses", "1 line")
    got = sorted(((r.doc_id, r.n_known, r.licenses, r.n_matches) for r in license_scan(docs).collect()), key=str)
    assert got == sorted([(1, 1, ["MIT"], 1)] * 2 + [(None, 1, ["Apache-2.0"], 1), (2, 0, [], 0), (3, 0, [], 0)], key=str)
