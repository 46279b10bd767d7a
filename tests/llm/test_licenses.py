import random

import pytest

from quarry.llm import licenses as L
from quarry.llm import registry
from quarry.llm.tables import table


@pytest.fixture(scope="module")
def model():
    plain = [f"ordinary words of number {i} that say nothing of the kind and go on for a while" for i in range(300)]
    return L.fit_sample([*plain, "Released under the MIT License."])


def test_templates_and_unknown(model):
    for family, texts in L.TEMPLATES.items():
        for t in texts:
            assert L.classify(t.capitalize() + ".", model)[::3] == (family, True), t
    for t in ("an ordinary line of words", "the license of the car was under the seat", "public version general", ""):
        family, _, _, confirmed = L.classify(t, model)
        assert family == L.UNKNOWN or not confirmed, t
    assert L.classify("Copyright 2020. This text is released under the MIT license, see file.", model)[0] == "MIT"


def test_edge_rows(spark, model):
    data = [(1, None), (2, ""), (3, "x\n\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."), (3, "plain"), (None, "Released under the MIT License.")]
    docs = spark.createDataFrame([(*r, "clash") for r in data], "doc_id long, text string, license string")
    got = [(r.doc_id, r.license, r.n_confirmed) for r in L.scan_licenses(docs, model).collect()]
    assert sorted(got, key=str) == sorted([(1, None, 0), (2, None, 0), (3, "CC-BY-NC+MIT", 2), (3, None, 0), (None, "MIT", 1)], key=str)
    assert L.scan_licenses(docs.limit(0), model).count() == 0 and L.background(docs.limit(0), "text").count() == 0
    fitted = L.fit_licenses(L.background(docs, "text"))
    assert fitted["families"] == model["families"] and L.classify("Released under the MIT License.", fitted)[::3] == ("MIT", True)


#: The notices in the documents, and their families.
NOTICES = {
    "All rights reserved.": "Proprietary",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL",
}


def test_query_against_plain_search(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = registry.op6_licenses(spark, sf).collect()
    expected = {i: "+".join(sorted({f for n, f in NOTICES.items() if n in t})) or None for i, t in texts.items()}
    assert {r.doc_id: r.license for r in rows} == expected and any(expected.values())


def test_notice_in_the_middle_of_a_long_line():
    rnd = random.Random(3)
    vocabulary = [f"word{i}" for i in range(400)]
    line = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    model = L.fit_sample([" ".join(line(30)) for _ in range(500)])
    for notice, family in NOTICES.items():
        for at in (2490, 2500, 2511):
            words = line(5000)
            found = L.scan_texts([" ".join([*words[:at], notice, *words[at:]])], model)[0]
            assert {f[1] for f in found if f[4]} == {family}, (notice, found)
    assert L.scan_texts([" ".join(line(5000)), None, ""], model) == [[], [], []]


def test_notice_of_words_that_ordinary_lines_use():
    rnd = random.Random(4)
    ordinary = "the rights of others are reserved for all who read the software source in a public place".split()
    model = L.fit_sample([" ".join(rnd.sample(ordinary, 12)) for _ in range(500)])
    assert L.classify("All rights reserved.", model)[::3] == ("Proprietary", True)


APACHE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
"""
WRAPPED = """Some title

This program is free software: you can
redistribute it and/or modify it under
the terms of the GNU General Public
License as published by others.
"""


def test_texts_tags_and_denials(model):
    assert L.classify(APACHE, model)[::3] == ("Apache-2.0", True)
    assert L.classify(WRAPPED, model)[::3] == ("GPL", True)
    for family, tags in L.SPDX.items():
        for tag in tags:
            assert L.classify(f"// SPDX-License-Identifier: {tag}", model)[::3] == (family, True), tag
    for text in (
        "This is not released under the MIT license at all.",
        "The work was never licensed under the Apache License, Version 2.0.",
        "This text is not licensed under CC BY-NC 4.0",
        "SPDX-License-Identifier: Zlib",
    ):
        assert not L.classify(text, model)[3], text


def test_a_long_text_and_repeated_notices(spark, model):
    long = "plain words of no meaning here\n" * 40_000 + "Released under the MIT License."
    docs = spark.createDataFrame([(1, long), (2, "Released under the MIT License.\nReleased under the MIT License.")], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.n_confirmed, [x.line for x in r.paragraphs]) for r in L.scan_licenses(docs, model).collect()}
    assert got == {1: ("MIT", 1, [40_000]), 2: ("MIT", 2, [0, 1])}


HEADER = """This {what} is free software: you can redistribute it and/or modify
it under the terms of the GNU {name}General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version."""
#: Short forms, titles and headers, and their families.
FORMS = {
    HEADER.format(what="program", name="Affero "): "AGPL",
    HEADER.format(what="library", name="Lesser "): "LGPL",
    HEADER.format(what="program", name=""): "GPL",
    "This program is free software: you can redistribute it ... GNU Affero General Public License": "AGPL",
    "MIT License": "MIT",
    "The MIT License (MIT)": "MIT",
    'license = "MIT"': "MIT",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED': "MIT",
    "GNU GPL v2": "GPL",
    "License: GPLv3": "GPL",
    "License: LGPLv3": "LGPL",
    "GNU AGPL v3": "AGPL",
    "Apache License 2.0": "Apache-2.0",
    "BSD 3-Clause License": "BSD",
    "Creative Commons Attribution 3.0 Unported License": "CC-BY",
    "Creative Commons Attribution-ShareAlike 3.0 Unported": "CC-BY-SA",
}


def test_headers_titles_and_short_forms(model):
    for text, family in FORMS.items():
        assert {x[1] for x in L.scan_texts([text], model)[0] if x[4]} == {family}, text
    for text in ("all seats reserved; all rights of way reserved", "MIT is a university with a license plate", "the mit press", "Boost Software License 1.0", "Eclipse Public License", "Not under the MIT License.", "is not GPL v2", "he lost his license"):
        assert not any(x[4] for x in L.scan_texts([text], model)[0]), text
