import math
import os
import re

import pytest

from tessera.llm import license as lic
from tessera.llm.queries import op9_licenses

SF = "/root/testdata/sf0.01"
PHRASES = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under CC BY 4.0.": "cc-by", "licensed under the GNU Lesser General Public License": "lgpl", "Licensed under the Mozilla Public License, Version 2.0": "mpl-2.0", "SPDX-License-Identifier: MIT": "mit"}
CLEAN = ["He lost his driving licence in May.", "All about MIT and Apache", "Copyright 2020 by us", "a permission to enter", "words without any"]


def test_expressions_against_plain_version(spark):
    m = lic.model()
    texts = [*PHRASES, *CLEAN, None, "", "one\nReleased under the MIT License.\n\nand the licence fee", "license " * 5000, "\n".join(["Licensed under CC BY-NC 4.0."] * 3), "ünder the MIT License — free"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").selectExpr("*", "1 as paragraphs")
    for r in lic.scan(df).collect():
        want = [(n, *m.classify(line)) for n, line in enumerate((r.text or "").split("\n")) if re.search(m.cues, line.lower())]
        assert [(p.line, p.family, round(p.probability, 9), p.confirmed) for p in r.paragraphs] == [(n, f, round(p, 9), c) for n, f, p, c in want], r.text
    for t, family in PHRASES.items():
        assert m.classify(t)[0] == family and m.classify(t)[2], t
        assert m.classify("of the " + t + " and more of it")[0] == family
    assert all(m.classify(t)[0] == lic.UNKNOWN or not m.classify(t)[2] for t in CLEAN)
    assert lic.scan(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_finds_planted_lines(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op9_licenses(spark, SF).collect():
        want = {f for t, f in list(PHRASES.items())[:4] if t in texts[r.doc_id].split("\n")}
        assert want <= set(r.licenses.split(",")) if want else True, r
        assert r.licenses == "" or re.search("licen", texts[r.doc_id], re.I)


def test_gate_is_sound():
    """Without the gate's words all weights together make no family probable enough, and everyday words have none."""
    m = lic.model()
    assert (m.reach(set(m.gate)) < math.log(m.least / (1 - m.least))).all()
    assert not set(m.gate) & lic.EVERYDAY and not [g for g in m.weights if set(g.split(" ")) <= lic.EVERYDAY]


def test_held_out_wordings():
    """The templates are in no wording that the model is fitted to; the model names what is made from them."""
    m = lic.model()
    assert not {t for own in lic.TEMPLATES.values() for t in own} & ({t for own in lic.NOTICES.values() for t in own} | {f.format(n) for own in lic.NAMES.values() for n in own for f in lic.FRAMES})
    assert m.recall > 0.9 and 0.4 <= m.least < 0.9


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_gate_loses_nothing(spark, monkeypatch):
    """Over all documents, classifying every line and window confirms the same notices."""
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    sure = lambda: {r.doc_id: [p for p in r.paragraphs if p.confirmed and p.family != lic.UNKNOWN] for r in lic.scan(df).collect()}
    gated = sure()
    monkeypatch.setattr(lic.model(), "cues", "")
    assert sure() == gated and sum(map(len, gated.values())) > 30


def gpl(version, mark=""):
    lines = ["This program is free software; you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", f"the Free Software Foundation; either version {version} of the License, or", "(at your option) any later version."]
    return "\n".join(mark + x for x in lines)


LGPL = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."
WRAPPED = {
    LGPL: "lgpl",
    LGPL.replace("Lesser", "Affero").replace("2.1", "3"): "agpl-3.0",
    "Apache License\nVersion 2.0\n\nLicensed under the Apache License,\nVersion 2.0 (the License)": "apache-2.0",
    "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0": "epl-2.0",
    "Licensed under the GNU General Public License,\nversion 3 or later.": "gpl-3.0",
    "Licensed under the GNU General Public License, version 2.": "gpl-2.0",
    "Distributed under the Boost Software\nLicense, Version 1.0.": "bsl-1.0",
    "Released under the\nMIT License.": "mit",
    "# Licensed under a Creative Commons\n# Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
    "This work is available under Creative\nCommons Attribution": "cc-by",
    " * Licensed under the Apache\n * License, Version 2.0": "apache-2.0",
    "This work is licensed under the GNU General\nPublic License, version 3.": "gpl-3.0",
    "\n".join("Released under the MIT License.".split()): "mit",
    "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software": "mit",
    gpl(2): "gpl-2.0",
    gpl(3, " * "): "gpl-3.0",
    "a title\n\n" + gpl(2, "// ") + "\n\nReleased under the\nMIT License.": "gpl-2.0,mit",
    "Released under the MIT License.\nLicensed under CC BY 4.0.": "cc-by,mit",
    "under the terms of the GNU Lesser General Public License\nReleased under the MIT License.": "lgpl,mit",
    "Released under the\n\nMIT License.": "mit",
    "He lost his driving\nlicence in May at MIT\nand Apache": "",
}


def test_wrapped_notices(spark, tmp_path):
    spark.createDataFrame(list(enumerate(WRAPPED)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.licenses for r in op9_licenses(spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(len(WRAPPED))] == list(WRAPPED.values())


#: Written before the model was run on any of them, and in no list that it is fitted to or calibrated on.
HELD_OUT = {
    "Distributed under the terms of the Apache License 2.0.": "apache-2.0", "SPDX-License-Identifier: BSD-3-Clause": "bsd", "SPDX-License-Identifier: MPL-2.0": "mpl-2.0", "Available under the terms of the GNU GPL version 2.": "gpl-2.0",
    "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.": "bsd", "This work uses the GPLv3.": "gpl-3.0", "code is available under MIT": "mit", "The library is provided under the MIT licence.": "mit",
    "All example code in this book is MIT-licensed (MIT License).": "mit", "Everything here is free software under the GNU GPL, version 3 or newer.": "gpl-3.0", "You may redistribute this under the GNU Lesser General Public License.": "lgpl", "Copyright 2019 the authors, Apache License, Version 2.0": "apache-2.0",
    "This dataset is published under CC BY-SA 3.0.": "cc-by-sa", "Photos: Creative Commons Attribution-NonCommercial 2.0": "cc-by-nc", "Text may be reused under the Creative Commons Attribution License.": "cc-by", "Published under CC0 1.0 Universal.": "cc0",
    "Covered by the Eclipse Public License.": "epl-2.0", "The Mozilla Public License 2.0 applies to these files.": "mpl-2.0", "Released to the public under the Unlicense.": "unlicense", "This crate is under the ISC license.": "isc",
    "Boost Software License 1.0 governs this header.": "bsl-1.0", "zlib License, see the header for the terms": "zlib", "Licence: EUPL 1.2": "eupl-1.2", "Server code: GNU Affero GPL version 3": "agpl-3.0", "WTFPL applies": "wtfpl", "under the CDDL, version 1.0": "cddl-1.0",
    "Licensed under LGPL-2.1": "lgpl", "GNU General Public License, version 2": "gpl-2.0", "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
}
NO_NOTICE = [
    "He lost his driving licence in May.", "All about MIT and Apache", "Copyright 2020 by us", "a permission to enter", "The museum opens to the general public on Sunday.", "Students at MIT built a robot.", "An Apache helicopter was seen.",
    "Software prices rose in version 2.0 of the plan.", "The fishing license fee is due.", "Terms of the contract were made public.", "The boost came late.", "The European Union published a report.", "She was granted permission to work from home.",
    "Mozilla and Google disagree.", "An eclipse of the sun is expected.", "Creative people use common sense.", "The source of the river is in the north.", "His license plate was stolen.", "The warranty is void.", "Please copy the files to the server.",
    "Redistribution of land was debated.", "The bar lost its liquor license.", "No rights were violated.", "A general election will be held by June.", "The gnu is an antelope.",
]


def test_notices_and_prose_of_another_hand():
    m = lic.model()
    got = {t: (f if sure else lic.UNKNOWN) for t in [*HELD_OUT, *NO_NOTICE] for f, _, sure in [m.classify(t)]}
    missed = {t: m.classify(t) for t, f in HELD_OUT.items() if got[t] != f}
    wrong = {t: m.classify(t) for t in NO_NOTICE if got[t] != lic.UNKNOWN}
    assert len(missed) <= 0.1 * len(HELD_OUT), missed
    assert len(wrong) <= 1, wrong
