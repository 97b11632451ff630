from __future__ import annotations

import pkgutil

from edge_cases import ROWS, documents
from pyspark.sql import functions as F

from stratalith.llm import license_scans, license_texts
from stratalith.llm.license_scans import TEMPLATES, ancestors, directory, scan

MIT, APACHE, GPL = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."


def files(spark, rows):
    return spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(rows)], "file_id long, path string, text string")


def test_paths(spark):
    rows = {"a/b/c.txt": ("a/b", ["", "a", "a/b"]), "c.txt": ("", [""]), "/a/c": ("/a", ["", "", "/a"])}
    got = spark.createDataFrame([(p,) for p in rows], "p string").select("p", directory(F.col("p")).alias("d"), ancestors(directory(F.col("p"))).alias("a")).collect()
    assert {r.p: (r.d, r.a) for r in got} == rows


def test_every_template_finds_itself(spark):
    got = scan(files(spark, [(f"d{k}/LICENSE", t) for k, (_, t) in enumerate(TEMPLATES)]))
    assert {r.file_id: r.license for r in got.collect()} == {k: name for k, (name, _) in enumerate(TEMPLATES)}


def test_inheritance(spark):
    rows = [
        ("r/LICENSE", MIT), ("r/a.py", "code"), ("r/x/b.py", "code"), ("r/x/COPYING.txt", GPL), ("r/x/y/c.py", "code"), ("r/x/own.py", "# " + APACHE + "\ncode " * 50),
        ("other/a.py", "code"), ("rx/a.py", "code"), ("r/x/y/NOTICE", "nothing of the kind"), (None, "code"),
    ]
    got = {r.path: (r.license, r.origin, r.license_path) for r in scan(files(spark, rows)).collect()}
    assert got["r/LICENSE"] == ("MIT", "file", "r/LICENSE")
    assert got["r/a.py"] == ("MIT", "inherited", "r/LICENSE")
    assert got["r/x/b.py"] == got["r/x/y/c.py"] == got["r/x/y/NOTICE"] == ("GPL-3.0-only", "inherited", "r/x/COPYING.txt")
    assert got["r/x/own.py"] == ("Apache-2.0", "own", "r/x/own.py")
    assert got["other/a.py"] == got["rx/a.py"] == got[None] == (None, "none", None)


def test_shuffled_templates_agree(spark, monkeypatch):
    rows = files(spark, [("a/LICENSE", MIT), ("a/b", "x"), ("c/d", "Copyright someone, all rights reserved. " + GPL)])
    one = sorted(scan(rows).collect(), key=str)
    monkeypatch.setattr(license_scans, "MAX_TEMPLATE_WORDS", 0)
    assert sorted(scan(rows).collect(), key=str) == one


def test_edges(spark):
    docs = documents(spark).drop("id").withColumnsRenamed({"doc_id": "file_id"}).withColumn("path", F.concat_ws("/", "source", F.col("file_id").cast("string")))
    assert scan(docs).count() == len(ROWS)
    assert scan(docs.filter("false")).count() == 0


def test_native(spark):
    plan = scan(files(spark, [("a", MIT)]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_passages_decide_alone(spark):
    """Neither code that names licences nor lines without a cue keep a notice from being found."""
    code = "".join(f"    license_check_{k} = load(license_file_{k})\n" for k in range(10))
    wrapped = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles, to deal in the Software without restriction.\nMIT License.\n"
    comment = "".join("# " + x + "\n" for x in wrapped.splitlines())
    rows = [
        ("a/code.py", "# " + APACHE + "\nimport x\n" + code), ("b/header.py", comment + "import x\n" + code), ("c/text.txt", "words of prose\n" * 50 + "\n" + wrapped + "\nmore prose about a licence"),
        ("d/LICENSE", wrapped), ("e/both.py", "# All rights reserved.\n# " + APACHE + "\n" + "code\n" * 50), ("f/none.py", code), ("g/LICENSE", "nothing of the kind"),
    ]
    got = {r.path: (r.license, r.score, r.origin) for r in scan(files(spark, rows)).collect()}
    assert got["a/code.py"] == ("Apache-2.0", 100, "own")
    assert got["b/header.py"] == got["c/text.txt"] == ("MIT", 100, "own")
    assert got["d/LICENSE"] == ("MIT", 100, "file")
    assert got["e/both.py"][0] == "Apache-2.0"
    assert got["f/none.py"] == got["g/LICENSE"] == (None, None, "none")


def test_notices_among_other_words(spark):
    """A licence file that is a notice among other words has the notice's score; a full text goes before the notices that it quotes."""
    gpl = pkgutil.get_data("stratalith.llm", "licenses/GPL-3.0-only.txt").decode()
    rows = [("a/COPYING.1", "A.\nAll rights reserved."), ("b/LICENSE", "Licensed under CC BY-NC 4.0.\nOf haesly edhest."), ("c/LICENSE", "Of haesly edhest relyre threst.\nAll rights reserved."), ("d/LICENSE", gpl + "\n\n" + MIT)]
    got = {r.path: (r.license, r.score, r.origin) for r in scan(files(spark, rows)).collect()}
    assert got["a/COPYING.1"] == got["c/LICENSE"] == ("Proprietary", 100, "file")
    assert got["b/LICENSE"] == ("CC-BY-NC-4.0", 100, "file")
    assert got["d/LICENSE"][0] == "GPL-3.0-only"


def test_long_runs_take_no_stack(spark):
    rows = [("a/x.py", "# license\n" * 50_000), ("b/LICENSE", "a-1." * 50_000 + "license"), ("c/y", "\n-- \n" * 50_000 + APACHE)]
    assert {r.path: r.license for r in scan(files(spark, rows)).collect()}["c/y"] == "Apache-2.0"


def test_real_headers(spark):
    """Headers, SPDX lines and full texts as projects have them, not as the templates word them."""
    gpl = "{0} This program is free software; you can redistribute it and/or modify\n{0} it under the terms of the GNU General Public License as published by\n{0} the Free Software Foundation; either version {1} of the License, or\n{0} (at your option) any later version.\n{0}\n{0} This program is distributed in the hope that it will be useful,\n{0} but WITHOUT ANY WARRANTY; without even the implied warranty of\n{0} MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n{0} GNU General Public License for more details.\n"
    apache = '// Copyright 2015 The Authors. All rights reserved.\n//\n// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n//     http://www.apache.org/licenses/LICENSE-2.0\n//\n// Unless required by applicable law or agreed to in writing, software\n// distributed under the License is distributed on an "AS IS" BASIS,\n// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n// See the License for the specific language governing permissions and\n// limitations under the License.\n'
    bodies = {k: pkgutil.get_data("stratalith.llm", f"licenses/{k}.txt").decode() for k in license_texts.FULL}
    named = {k: v.replace("<year>", "2019").replace("<holder>", "Jane Doe and others <jane@example.org>") for k, v in bodies.items()}
    code = "import os\n" * 80
    rows = [(f"{k}/LICENSE", v, k) for k, v in named.items()]
    rows += [(f"{k}.c", "/*\n" + "".join(f" * {x}\n" for x in named[k].splitlines()) + " */\n" + code, k) for k in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause")]
    rows += [(f"{k}.py", f"# SPDX-License-Identifier: {k}\n" + code, k) for k in license_texts.IDS]
    rows += [("old.h", "/* SPDX-License-Identifier: GPL-2.0 */\n" + code, "GPL-2.0-only"), ("plus.h", "// SPDX-License-Identifier: GPL-2.0+\n" + code, "GPL-2.0-or-later")]
    rows += [("g3.py", gpl.format("#", 3) + code, "GPL-3.0-or-later"), ("g2.c", gpl.format(" *", 2) + code, "GPL-2.0-or-later"), ("a.go", apache + code, "Apache-2.0")]
    rows += [("m.py", "# Copyright (c) 2020 Jane Doe\n# Released under the MIT License.\n" + code, "MIT"), ("p.py", "# Copyright (c) 2020 Acme. All rights reserved.\n" + code, "Proprietary"), ("n.py", "# Copyright (c) 2020 Acme\n" + code, None), ("u.py", "# SPDX-License-Identifier: Foo-1.0\n" + code, None)]
    want = {f"r{k}/{p}": w for k, (p, _, w) in enumerate(rows)}
    got = {r.path: r.license for r in scan(files(spark, [(f"r{k}/{p}", t) for k, (p, t, _) in enumerate(rows)])).collect()}
    assert {p: got[p] for p in got if got[p] != want[p]} == {}
