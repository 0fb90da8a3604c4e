import hashlib
import os
import textwrap
from collections import Counter

import duckdb
import pytest

from evenkeel.llm import licences


def test_equal_after_normalising(spark):
    mit = licences.TEXTS["MIT"]
    rows = [(1, "Copyright (c) 2020 Somebody\n\n" + mit, "k"), (2, mit.upper().replace(" ", "  ").replace("SUBLICENSE", "SUB-LICENCE"), "k"), (3, mit + " more", "k"),
            (4, "x\nLicensed under the  Apache Licence, version 2.0\nand Released under the MIT License.\nreleased under the mit license", "k"), (5, None, "k"), (5, None, None), (6, "", "k"), (None, mit, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = licences.scan_licences(df).collect()
    assert sorted((r.doc_id, r.licence) for r in got if r.doc_id) == [(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (5, None), (6, None)]
    assert next(r for r in got if r.doc_id is None).licence == "MIT"
    four = next(r for r in got if r.doc_id == 4)
    assert (four.n_notices, four.notices) == (2, "Apache-2.0,MIT")
    assert len({r.digest for r in got if r.doc_id in (5, 6)}) == 1
    assert licences.scan_licences(df.limit(0)).count() == 0


PUBLISHED = {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "MPL-2.0": "MPL-2.0"}
HEADS = {"MIT": ["MIT License", "The MIT License (MIT)"], "ISC": ["ISC License"], "0BSD": ["BSD Zero Clause License"], "Zlib": ["zlib License"], "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"], "BSD-3-Clause": ["BSD 3-Clause License"]}


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(x, width) for x in text.split("\n"))


def test_files_in_published_form_and_at_wrap_widths(spark):
    rows = [(f"{name} {head} {width}", f"{head}\n\nCopyright (c) 2020, Some Holder\n{mark}\n\n{wrapped(text, width)}\n")
            for name, text in list(licences.TEXTS.items()) + licences.MORE_TEXTS for head in ["", *HEADS[name]] for width in (30, 50, 65, 72, 79, 100, 10_000) for mark in ("", "All rights reserved.")]
    assert any(line.lower().startswith("copyright holders be liable") for _, t in rows for line in t.split("\n"))
    for name, path in PUBLISHED.items():
        if os.path.exists(f"/usr/share/common-licenses/{path}"):
            text = open(f"/usr/share/common-licenses/{path}").read()
            rows += [(f"{name} file", text), (f"{name} http", text.replace("https:", "http:")), (f"{name} filled", text.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 A. Holder"))]
            rows += [(f"{name} without heading", text[text.index(x) :]) for x in ("TERMS AND CONDITIONS FOR USE", "Everyone is permitted to copy", "\n1. Definitions") if text.count(x) == 1]
    rows += [("None all the same", "MIT License\n\nPermission is not granted."), ("None heading alone", "MIT License")]
    got = licences.scan_licences(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == len(rows) and [r.doc_id for r in got if r.doc_id.split()[0] != str(r.licence)] == []
    assert {r.reserved for r in got if r.licence == "ISC"} == {True, False}


def test_notices_that_go_on_and_rights_reserved(spark):
    rows = [(1, ' * Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file'), (2, "# SPDX-License-Identifier: MIT-0"), (3, "// SPDX-License-Identifier: GPL-3.0-or-later"),
            (4, "Copyright 2020 Somebody. All rights reserved.\nText"), (5, "all rights reserved by law"), (6, "Copyright holders be liable")]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i].n_notices, got[i].notices, got[i].reserved) for i in range(1, 6)] == [(1, "Apache-2.0", False), (0, "", False), (1, "GPL-3.0", False), (0, "", True), (0, "", False)]
    assert got[6].digest == hashlib.sha256(b"copyright holders be liable").hexdigest()


def test_given_documents_give_the_rows_of_the_sql(spark):
    from evenkeel.llm import queries

    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = duck.execute(licences.oracle())
    cols = [c[0] for c in want.description]
    got = queries.op6_licence_digests(spark, sf)
    assert sorted(got.columns) == sorted(cols)
    assert Counter(tuple(r) for r in got.select(cols).collect()) == Counter(want.fetchall())


COMMON = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no licence texts on this machine")
def test_published_texts_at_several_widths(spark):
    files = {"GPL-2.0": "GPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "CC0-1.0": "CC0-1.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "GFDL-1.3": "GFDL-1.3", "Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3"}
    rows = []
    for name, f in files.items():
        text = open(f"{COMMON}/{f}", encoding="utf-8").read()
        rows += [(name, text), (name, text.upper()), (name, text.replace("\n", "\r\n")), (None, text + "\nOne clause more.")]
    for name, text in (("Unlicense", licences._UNLICENSE + licences._UNLICENSE_END.format("https", "/")), ("BSL-1.0", licences._BSL)):
        for width in (40, 76, 5000):
            rows.append((name, "\n\n".join(textwrap.fill(p, width) for p in text.split("\n"))))
    df = spark.createDataFrame([(i, t, n) for i, (n, t) in enumerate(rows)], "doc_id long, text string, want string")
    got = {r.doc_id: r.licence for r in licences.scan_licences(df).collect()}
    assert got == {i: n for i, (n, _) in enumerate(rows)}
