"""Licence notices: wrapped, commented, on one line, in new wordings, and of licences without a family.

LONG are the standard notices, whose words the training has too; SHORT, UNSEEN and PLAIN are other wordings, but the training
was changed after looking at cases that failed here. FRESH was written and measured once after the last change of the
training; its names of licences are in the training, its sentences are not.
"""

import textwrap

import pytest

from panelspark.llm import licenses

GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
LONG = [
    ("gpl-2.0", GNU.format("program", "General Public License", "2")), ("gpl-3.0", GNU.format("program", "General Public License", "3")),
    ("lgpl-2.1", GNU.format("library", "Lesser General Public License", "2.1")), ("lgpl-3.0", GNU.format("library", "Lesser General Public License", "3")),
    ("lgpl-3.0", GNU.format("program", "Lesser General Public License", "3")), ("agpl-3.0", GNU.format("program", "Affero General Public License", "3")),
    ("mit", MIT), ("bsd", BSD), ("apache-2.0", APACHE), ("mpl-2.0", MPL), ("isc", ISC),
]
SHORT = [
    ("mit", "This package is open source under the MIT License."), ("mit", "Code: MIT licensed, see LICENSE.txt"), ("apache-2.0", "Our work is shared under the terms of the Apache License, Version 2.0."),
    ("apache-2.0", "Everything here is under an Apache 2.0 license."), ("bsd", "Made available under a BSD 2-Clause License."), ("gpl-2.0", "You can use it under the GNU General Public License version 2."),
    ("gpl-3.0", "The plugin is published under the GNU GPL v3."), ("gpl-3.0", "Shared under the terms of the GNU General Public License, version 3 or later."), ("agpl-3.0", "The server is covered by the GNU Affero General Public License version 3."),
    ("lgpl-2.1", "The bindings use the GNU Lesser General Public License version 2.1."), ("cc-by-4.0", "Photos: Creative Commons Attribution 4.0 International"), ("cc-by-nc-4.0", "All figures are under a CC BY-NC 4.0 license."),
    ("cc-by-sa-4.0", "Reuse is allowed under the Creative Commons Attribution-ShareAlike 4.0 International License."), ("cc0-1.0", "The tables are in the public domain under CC0 1.0."), ("mpl-2.0", "The extension is under the Mozilla Public License version 2.0."),
    ("isc", "Published under an ISC license."), ("unlicense", "We put it out under the Unlicense."), ("bsl-1.0", "Use it under the Boost Software License, Version 1.0."), ("epl-2.0", "This plug-in is under the Eclipse Public License 2.0."),
]
FRESH = [
    ("mit", "Feel free to reuse these scripts; the MIT License applies."),
    ("mit", "License: MIT License"),
    ("mit", "The theme comes with the MIT license, so do as you please."),
    ("apache-2.0", "Source and examples fall under the Apache License 2.0."),
    ("apache-2.0", "License: Apache License, Version 2.0"),
    ("apache-2.0", "We chose the Apache License, Version 2.0 for all modules."),
    ("bsd", "License: BSD 3-Clause License"),
    ("bsd", "The driver ships with a BSD 2-Clause License."),
    ("bsd", "We use the New BSD License for this kit."),
    ("gpl-2.0", "License: GNU General Public License version 2"),
    ("gpl-2.0", "The kernel module falls under the GNU GPL v2."),
    ("gpl-2.0", "Our patches carry the GNU General Public License, version 2."),
    ("gpl-3.0", "License: GNU General Public License version 3"),
    ("gpl-3.0", "The game falls under the GNU GPL version 3."),
    ("agpl-3.0", "License: GNU Affero General Public License version 3"),
    ("agpl-3.0", "Hosting this service means following the GNU AGPL version 3."),
    ("lgpl-2.1", "License: GNU Lesser General Public License version 2.1"),
    ("lgpl-2.1", "Linking is allowed by the GNU LGPL version 2.1."),
    ("lgpl-3.0", "License: GNU Lesser General Public License version 3"),
    ("lgpl-3.0", "The codec falls under the GNU LGPL v3."),
    ("cc-by-4.0", "Text and tables: CC BY 4.0 license"),
    ("cc-by-4.0", "Slides are shared with a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Music: Creative Commons Attribution-NonCommercial 4.0 International"),
    ("cc-by-nc-4.0", "The recordings carry the CC BY-NC 4.0 license."),
    ("cc-by-sa-4.0", "Maps: CC BY-SA 4.0 license"),
    ("cc-by-sa-4.0", "Articles carry the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "The icons are given away as CC0 1.0 Universal."),
    ("mpl-2.0", "License: Mozilla Public License 2.0"),
    ("mpl-2.0", "Parts fall under the Mozilla Public License, v. 2.0."),
    ("isc", "License: ISC License"),
    ("unlicense", "We apply The Unlicense to this code."),
    ("epl-2.0", "License: Eclipse Public License 2.0"),
    ("bsl-1.0", "The headers fall under the Boost Software License 1.0."),
    ("zlib", "Textures and code use the zlib license."),
]
UNSEEN = ["Licensed under the Quokka Public License, version 3.", "Copyright 2021 by Harbor Films. All rights reserved.", "This firmware is licensed under the terms of the Vendor Source Agreement.", "This game is proprietary and confidential and may not be copied without written permission of the publisher."]
PLAIN = ["The warden gave a license to every fisher in the bay, version or no version.", "Any person who wants a copy of the map may ask in the library.", "She sold the software and the rights to use it for a small fee.", "The general public was free to use the terms of the deal."]


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark)


def wrapped(text: str, width: int, mark: str) -> str:
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_notices_in_all_forms(spark, model):
    prose = "The river rose in the night and the mill stood still.\nNobody came until noon."
    cases = [(family, text) for family, text in SHORT + LONG] + [(family, wrapped(text, width, mark)) for family, text in LONG for width, mark in ((76, " * "), (60, "# "), (44, "// "))]
    rows = [(i, f"{prose}\n\n{text}\n\n{prose}") for i, (_, text) in enumerate(cases)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    wrong = [(family, text, got[i].families) for i, (family, text) in enumerate(cases) if got[i].families != [family]]
    assert len(cases) >= 30 and len(wrong) <= len(cases) // 10, wrong
    # Headers come out right in every form.
    assert not [w for w in wrong if w[1] not in [t for _, t in SHORT]], wrong
    assert all(r.n_paragraphs == 3 for r in got.values())


def test_fresh_wordings(spark, model):
    got = {r.doc_id: r.families for r in licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(FRESH)], "doc_id long, text string"), model).collect()}
    right = sum(got[i] == [family] for i, (family, _) in enumerate(FRESH))
    assert len(FRESH) >= 30 and right >= 0.9 * len(FRESH)


def test_unknown_and_plain(spark, model):
    rows = [(i, text) for i, text in enumerate(UNSEEN + PLAIN)]
    got = {r.doc_id: r.families for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(len(rows))] == [["unknown"]] * len(UNSEEN) + [[]] * len(PLAIN)


def test_scan_reads_what_classify_reads(spark, model):
    """The evidence found through flags gives the verdicts of all n-grams."""
    texts = [t for _, t in SHORT + LONG] + UNSEEN + PLAIN
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole = {r.line: (r.family, round(r.probability, 9), round(r.containment, 9)) for r in licenses.classify(frame.withColumnRenamed("text", "line"), model).collect()}
    got = {r.doc_id: [(s.family, round(s.probability, 9), round(s.containment, 9)) for s in r.spans] for r in licenses.scan(frame, model).collect()}
    assert got == {i: [whole[t]] if whole[t][0] != "none" else [] for i, t in enumerate(texts)}


def test_paragraph_and_line_spans(spark, model):
    texts = [
        (1, "Word one here.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
        (2, wrapped(MIT, 50, "# ") + "\n#\n" + wrapped(BSD, 40, "# ")),
        (3, "\n\n---\n***\n"),
        (4, ("x y z\n" * 3000) + "Released under the MIT License.\n" + "free software " * 20000),
        (None, "Released under the MIT License."), (None, None),
    ]
    got = sorted(((r.doc_id or 0, r.n_paragraphs, [(s.first_line, s.last_line, s.family) for s in r.spans]) for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()), key=str)
    first, second = len(textwrap.wrap(MIT, 50)), len(textwrap.wrap(BSD, 40))
    want = [(1, 1, [(1, 1, "apache-2.0"), (2, 2, "mit")]), (2, 2, [(0, first - 1, "mit"), (first + 1, first + second, "bsd")]), (3, 0, []), (4, 1, [(3000, 3000, "mit")]), (0, 1, [(0, 0, "mit")]), (0, 0, [])]
    assert got == sorted(want, key=str)


def test_one_training_serves_a_session(spark, monkeypatch):
    """A second scan in a session uses the model of the first and finds the same."""
    calls, real = [], licenses.train
    monkeypatch.setattr(licenses, "train", lambda session: calls.append(session) or real(session))
    monkeypatch.setattr(licenses, "_kept", [])
    docs = spark.createDataFrame([(1, "# SPDX-License-Identifier: MIT"), (2, "nothing here")], "doc_id long, text string")
    first, second = (sorted(map(str, licenses.scan(docs).collect())) for _ in range(2))
    assert first == second and "mit" in first[0]
    assert calls == [spark]
