import difflib
import random
import re
import textwrap
import time

import pyspark.sql.functions as F
import pytest

from quillspark.llm import licenses

from .conftest import words


@pytest.mark.parametrize("name,notice", licenses.TEMPLATES)
def test_every_template_is_found_exactly(name, notice):
    got = licenses.Scanner().scan_block(f"  {notice}  ")
    assert name in {x["license"] for x in got} and all(x["missing"] + x["extra"] == 0 for x in got)


def test_versions_and_near_wordings():
    s = licenses.Scanner()
    ids = lambda t: [x["license"] for x in s.scan_block(t)]
    assert ids("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert ids("This work is licenced under the GNU General Public License version 3") == ["GPL-3.0"]
    assert ids("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"]
    assert ids("A license to kill was granted to the agent by the crown.") == []
    assert ids("Licensed under the Apache License, Version 1.1.") == []


def test_scan_gives_spans(make):
    text = "première ligne\nReleased under the MIT License.\nmore\n\nLicensed under CC BY 4.0."
    rows = make([(1, text), (2, "no such words"), (3, None)])
    got = {r.doc_id: r for r in licenses.scan(rows.withColumn("licenses", F.lit(1))).collect()}
    raw = text.encode()
    assert [(x.license, raw[x.start : x.end].decode()) for x in got[1].licenses] == [("MIT", "Released under the MIT License."), ("CC-BY-4.0", "Licensed under CC BY 4.0.")]
    assert got[2].licenses == [] and got[3].n_blocks == 0


FILLER = "the river runs past old mills and quiet gardens towards the sea "


@pytest.mark.parametrize("text,names", [
    ("This file is part of the example project, which is\nreleased under the MIT License.", {"MIT"}),
    (FILLER * 3 + "Released under the MIT License. " + FILLER * 3, {"MIT"}),
    (FILLER * 400 + "Licensed under CC BY 4.0. " + FILLER * 400, {"CC-BY-4.0"}),
    ("Copyright 2024 Example Corp. All rights reserved.", {"Proprietary"}),
    ("Copyright (c) 2020 the project's contributors.\nReleased under the MIT License.", {"MIT"}),
    (" * Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated\n * documentation files (the \"Software\"), to deal in the\n * Software without restriction", {"MIT"}),
    ("# All rights\n# reserved.", {"Proprietary"}),
    ("\n".join(t for _, t in licenses.TEMPLATES), {n for n, _ in licenses.TEMPLATES} - {"Proprietary"}),
    ("Licensed under the MIT License.\nThis Source Code Form is subject to the terms of Mozilla Public License, v. 2.0.", {"MIT", "MPL-2.0"}),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", {"LGPL-3.0"}),
])
def test_notices_inside_and_across_lines(make, text, names):
    got = licenses.scan(make([(1, text)])).collect()[0].licenses
    assert {x.license for x in got} == names and len(got) == len(names)


MIT = next(t for n, t in licenses.TEMPLATES if n == "MIT" and "AS IS" in t)
GPL = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0-or-later")
BSD = next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause" and "Neither" in t)


def wrapped(text, mark="", width=64):
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def altered(text, seed, n):
    """n words left out or put in, but for numbers and license words"""
    rng, w = random.Random(seed), text.split()
    for _ in range(n):
        i = rng.randrange(3, len(w) - 3)
        if rng.random() < 0.5 and w[i].isalpha() and "icens" not in w[i].lower():
            del w[i]
        else:
            w.insert(i, "indeed")
    return " ".join(w)


@pytest.mark.parametrize("text,names", [
    ("MIT License\n\nCopyright (c) 2021 Jane Roe\n\n" + wrapped(MIT), ["MIT"]),
    ("/*\n * Copyright 2019\n *\n" + wrapped(MIT, " * ") + "\n */\nint x;", ["MIT"]),
    (FILLER * 20 + "\n" + wrapped(GPL, "# ", 40) + "\n" + FILLER * 20, ["GPL-3.0-or-later"]),
    ("// SPDX-License-Identifier: MIT\nint main() {}", ["MIT"]),
    ("# SPDX-License-Identifier: GPL-3.0-or-later", ["GPL-3.0-or-later"]),
    (wrapped(BSD, "; "), ["BSD-3-Clause"]),
    (altered(MIT, 1, 9), ["MIT"]),
    (wrapped(altered(BSD, 2, 6), "# "), ["BSD-3-Clause"]),
    (wrapped(MIT) + "\n\n" + wrapped(BSD) + "\n\n" + wrapped(GPL), ["BSD-3-Clause", "GPL-3.0-or-later", "MIT"]),
    (FILLER * 300 + MIT + " " + FILLER * 300 + GPL + FILLER * 300 + "Released under CC0 1.0 Universal.", ["CC0-1.0", "GPL-3.0-or-later", "MIT"]),
])
def test_whole_notices(make, text, names):
    got = licenses.scan(make([(1, text)])).collect()[0].licenses
    assert sorted(x.license for x in got) == names


def everywhere(text):
    """The notices that stand in a text as some template has them, up to a tenth of missing and of added
    words: each template at each place, by difflib and the rules as the module's docstring says them"""
    w = [x.lower() for x in re.findall(r"\w+(?:\.\w+)*", text)]
    found = set()
    for name, notice in licenses.TEMPLATES:
        want = [x.lower() for x in re.findall(r"\w+(?:\.\w+)*", notice)]
        some = len(want) // 10
        firm = {x for x in want if x in licenses.APART or re.search(r"\d", x)}
        for i in range(len(w)):
            here = w[i : i + len(want) + some]
            if here[:1] and here[0] not in want[: some + 1]:
                continue
            if sum(min(here.count(x), want.count(x)) for x in set(want)) < len(want) - some:
                continue
            blocks = [b for b in difflib.SequenceMatcher(None, want, here, autojunk=False).get_matching_blocks() if b.size]
            same = sum(b.size for b in blocks)
            first, end = blocks[0].b, blocks[-1].b + blocks[-1].size
            lost = [x for k, x in enumerate(want) if not any(b.a <= k < b.a + b.size for b in blocks)]
            new = [x for k, x in enumerate(here) if first <= k < end and not any(b.b <= k < b.b + b.size for b in blocks)]
            if len(want) - same <= some and len(new) <= some and not firm & set(lost) and not licenses.APART & set(new):
                found.add((i + first, i + end, name, len(want), len(lost), len(new)))
    kept = []
    for x in sorted(found, key=lambda x: (-(x[3] - x[4] - 2 * (x[4] + x[5])), x[0], x[2], x[4], x[5], x[1])):
        if all(x[1] <= y[0] or y[1] <= x[0] for y in kept):
            kept.append(x)
    return sorted((x[2], x[4], x[5]) for x in kept)


def test_ranking_loses_nothing_of_a_plain_search_at_all_places():
    s, rng, n = licenses.Scanner(), random.Random(8), 0
    for seed in range(110):
        _, text = rng.choice([t for t in licenses.TEMPLATES if "GPL-2" not in t[0] and "GPL-3.0" != t[0]])
        parts = [altered(text, seed, rng.randint(0, len(text.split()) // 12)) if len(text.split()) > 9 else text for _ in range(rng.randint(1, 3))]
        mark = rng.choice(["", " * ", "# ", "// "])
        whole = words(seed, rng.randint(0, 60)) + "\n" + "\n".join(wrapped(p, mark, rng.choice([30, 60, 200])) + " " + words(seed + 500, rng.randint(0, 9)) for p in parts) + "\n" + FILLER * rng.randint(0, 4)
        want = everywhere(whole)
        assert sorted((x["license"], x["missing"], x["extra"]) for x in s.finds(whole)) == want, whole
        n += len(want)
    assert n > 150


AGPL, LGPL, LGPL21, GPL2 = (next(t for n, t in licenses.TEMPLATES if n == name) for name in ("AGPL-3.0-or-later", "LGPL-3.0-or-later", "LGPL-2.1-or-later", "GPL-2.0-only"))


@pytest.mark.parametrize("text,names", [
    (wrapped(AGPL, " * "), ["AGPL-3.0-or-later"]),
    (wrapped(LGPL), ["LGPL-3.0-or-later"]),
    (wrapped(LGPL21, "# "), ["LGPL-2.1-or-later"]),
    (wrapped(GPL2), ["GPL-2.0-only"]),
    (wrapped(GPL), ["GPL-3.0-or-later"]),
    ("Copyright (c) 2020, Jane Roe. All rights reserved.\n\n" + wrapped(BSD), ["BSD-3-Clause"]),
    ("// SPDX-License-Identifier: Apache-2.0 OR MIT\n", ["Apache-2.0", "MIT"]),
    ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) AND BSD-3-Clause */", ["BSD-3-Clause", "GPL-2.0-only"]),
    ("# SPDX-License-Identifier: LGPL-2.1-or-later", ["LGPL-2.1-or-later"]),
    ("SPDX-License-Identifier: GPL-2.0+", ["GPL-2.0-or-later"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", ["CC-BY-NC-ND-4.0"]),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
    ("MIT License\n\nCopyright (c) 2024 Jane Roe\n", ["MIT"]),
    ("The MIT License\n", ["MIT"]),
    ("This text says something about the MIT License and its history.", []),
    ("This is not released under the MIT License.", []),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", ["GPL-3.0"]),
    ("This work is licensed under the GNU General Public License, version 2, or (at your option) any later version.", ["GPL-2.0-or-later"]),
    ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)", ["BSL-1.0"]),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", ["EPL-2.0"]),
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", ["Zlib"]),
    ("Copyright 2024 Example Corp. All rights reserved.", ["Proprietary"]),
])
def test_the_right_license_is_named(make, text, names):
    got = licenses.scan(make([(1, text)])).collect()[0].licenses
    assert sorted(x.license for x in got) == names


def test_dense_texts_take_time_in_proportion():
    rng, s = random.Random(9), licenses.Scanner()
    w = [x for _, t in licenses.TEMPLATES for x in t.split()]
    dense = lambda n: " ".join(rng.choice(w) for _ in range(n)) + "\n" + MIT
    took = []
    for n in (4_000, 32_000):
        text = dense(n)
        began = time.process_time()
        assert "MIT" in {x["license"] for x in s.finds(text)}
        took.append(time.process_time() - began)
    assert took[1] <= 16 * took[0] + 1 and took[1] <= 20


def test_blocks_against_brute_force(make):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["license", "Copyright", "word", "é" * rng.randint(1, 300), "x" * rng.randint(1, 700)]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    got = {r.doc_id: r.n_blocks for r in licenses.digest(make(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        at = [(m.start(), m.end()) for m in re.finditer(b"license|copyright", t.lower().encode())]
        assert got[i] == sum(k == 0 or a - at[k - 1][1] > licenses.GAP for k, (a, _) in enumerate(at))


def test_clashing_columns(make):
    docs = make([(1, "Released under the MIT License.")]).withColumns({"license": F.lit("mine"), "start": F.lit(3), "n_blocks": F.lit("old")})
    r = licenses.scan(docs).collect()[0]
    assert (r.license, r.start, r.n_blocks, r.licenses[0].license) == ("mine", 3, 1, "MIT")


def test_odd_rows(odd, none):
    assert licenses.digest(odd).count() == odd.count() and licenses.digest(none).collect() == []
