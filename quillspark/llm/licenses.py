"""License scans by conditional compression, confirmed by wording.

License words that stand near each other make a candidate block.  Its words, with those around it,
are cut into overlapping stretches of each template's scale; every stretch with a license word is
compressed with and without the template as a zstandard raw dictionary.  Stretches and templates are
ranked by how much of the template's own size reduction they show; all above a share of it are
confirmed, best first, by exact wording differences, so ranking decides the order and not the number.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textvec as tv

#: The largest share of a template's words that may be missing, and that may be added.
MOST_MISSING = 0.1
#: The least share of a template's own size reduction that a stretch must show to be compared.
LEAST_GAIN = 0.35
#: License words no further apart in bytes are of one block.
GAP = 512

# Notices and opening terms of public licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.0-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]
# The licenses of Creative Commons, by their short and long names.
_CREATIVE = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
TEMPLATES += [("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."), *((f"CC-{short}-4.0", f"This work is licensed under a Creative Commons {long} 4.0 International License.") for short, long in _CREATIVE)]
#: Names that stand for a license where they head a text: alone on their line, or with a version.
TITLES = [
    ("MIT", "MIT License"), ("ISC", "ISC License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("Apache-2.0", "Apache License Version 2.0"), ("MPL-2.0", "Mozilla Public License Version 2.0"), ("GPL-3.0", "GNU General Public License Version 3"),
    ("GPL-2.0", "GNU General Public License Version 2"), ("LGPL-3.0", "GNU Lesser General Public License Version 3"), ("LGPL-2.1", "GNU Lesser General Public License Version 2.1"), ("AGPL-3.0", "GNU Affero General Public License Version 3"), ("BSL-1.0", "Boost Software License Version 1.0"), ("EPL-2.0", "Eclipse Public License v 2.0"),
]
#: Words that tell licenses of a family apart: none of them is ever missing from a notice or added to it.
APART = frozenset("affero lesser library sharealike noncommercial noderivatives noderivs sa nc nd only not".split())
#: Words before a short notice that deny it.
DENIED = frozenset("not never nor neither isn wasn aren weren without".split())
#: Words of a notice from which a denial before it no longer counts.
SHORT = 12
_EXPRESSION = re.compile(r"SPDX-License-Identifier:[ \t]*([(A-Za-z0-9][A-Za-z0-9.+\-() \t]*)", re.I)
_ANCHOR = re.compile(rb"licen[cs]e|copyright|spdx|redistribut|permission[\s*#/;]+(?:is|to)|public[\s*#/;]+domain|all[\s*#/;]+rights[\s*#/;]+reserved|cc[\s*#/;]+by|cc0|creative[\s*#/;]+commons")
_WORD = re.compile(r"\w+(?:\.\w+)*")
_LATER = re.compile(r"(of the (gnu )?license )?or (at your option )?(any )?later")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def identifiers(expression: str) -> list[str]:
    """The licenses of an SPDX expression: its words but for operators and exceptions."""
    out, w = [], re.findall(r"[A-Za-z0-9.+-]+", expression)
    for i, x in enumerate(w):
        if x.upper() in ("OR", "AND", "WITH") or (i and w[i - 1].upper() == "WITH"):
            continue
        if i and w[i - 1].upper() not in ("OR", "AND"):
            break  # the text goes on behind the expression
        out.append(x[:-1] + "-or-later" if x.endswith("+") else x.rstrip("."))
    return [x for x in out if x]


def _common(want: list[str], have: list[str]) -> int:
    """Length of the longest common subsequence, by a bit for each word of ``want``."""
    at: dict[str, int] = {}
    for i, x in enumerate(want):
        at[x] = at.get(x, 0) | 1 << i
    whole = rest = (1 << len(want)) - 1
    for x in have:
        met = rest & at.get(x, 0)
        rest = (rest + met | rest - met) & whole
    return len(want) - rest.bit_count()


class Scanner:
    """Holds a compressor for each template."""

    def __init__(self, templates=None):
        given = list(templates or TEMPLATES)
        titles = [] if templates else TITLES
        self.templates = [(name, _words(text)) for name, text in given + titles]
        self.title = [False] * len(given) + [True] * len(titles)
        self.needs = [Counter(want) for _, want in self.templates]
        #: Words that a notice never lacks, and how many others it may lack.
        self.firm = [sorted(w for w in set(want) if w in APART or any(c.isdigit() for c in w)) for _, want in self.templates]
        self.spare = [int(MOST_MISSING * len(want)) for _, want in self.templates]
        params = {"level": 3, "write_content_size": False, "write_checksum": False}
        self.params = params
        self.plain = zstandard.ZstdCompressor(**params)
        joined = [" ".join(want).encode() for _, want in self.templates]
        self.given = [self._with(t) for t in joined]
        self.most = [max(1, len(self.plain.compress(t)) - len(g.compress(t))) for t, g in zip(joined, self.given)]
        #: Bytes looked at before and behind a block: twice the longest template.
        self.reach = 2 * max(map(len, joined))

    def _with(self, raw: bytes):
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **self.params)

    def gain(self, words: list[str], k: int) -> float:
        """Size reduction of words by a template."""
        raw = " ".join(words).encode()
        return 1 - len(self.given[k].compress(raw)) / len(self.plain.compress(raw))

    def confirm(self, have: list[str], k: int) -> tuple[int, int, int, int] | None:
        """(missing, extra, first, end) of the words that match the template, or None if too much is
        missing or added, or if a number or a word of ``APART`` differs."""
        want = self.templates[k][1]
        found = [m for m in difflib.SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks() if m.size]
        if not found:
            return None
        missing = len(want) - sum(m.size for m in found)
        first, end = found[0].b, found[-1].b + found[-1].size
        extra = end - first - sum(m.size for m in found)
        if missing > self.spare[k] or extra > self.spare[k]:
            return None
        held = {i for m in found for i in range(m.a, m.a + m.size)}
        used = {i for m in found for i in range(m.b, m.b + m.size)}
        lost = {want[i] for i in range(len(want)) if i not in held}
        added = {have[i] for i in range(first, end) if i not in used}
        if lost & set(self.firm[k]) or added & APART:
            return None
        return missing, extra, first, end

    def sure(self, where: dict[str, list[int]], k: int) -> list[int]:
        """Places of words one of which is in every notice like the template: of its firm words, or of
        one more than may be missing, those that are rarest in this text."""
        if self.firm[k]:
            return where.get(min(self.firm[k], key=lambda w: len(where.get(w, ()))), [])
        rare = sorted(self.needs[k], key=lambda w: (len(where.get(w, ())), w))
        out, more = [], self.spare[k] + 1
        for w in rare:
            out += where.get(w, [])
            more -= self.needs[k][w]
            if more <= 0:
                break
        return sorted(out)

    def ranked(self, have: list[str], where: dict[str, list[int]]) -> list[tuple[float, int, int, int]]:
        """(share of the template's own reduction, template, first word, end) of the stretches that are
        to be compared, best first.

        A stretch holds twice a template's words and those that may be added, and the next one
        begins a template's length later, so each notice lies whole in one of them.  Stretches
        without any of the template's sure words hold no such notice."""
        out = []
        sizes: dict[tuple[int, int], int] = {}
        for k, (_, want) in enumerate(self.templates):
            n = len(want)
            size = 2 * n + self.spare[k]
            for s in sorted({s for a in self.sure(where, k) for s in range(max(0, -(-(a - size + 1) // n) * n), a + 1, n)}):
                raw = " ".join(have[s : s + size]).encode()
                if (s, size) not in sizes:
                    sizes[s, size] = len(self.plain.compress(raw))
                share = (sizes[s, size] - len(self.given[k].compress(raw))) / self.most[k]
                if share >= LEAST_GAIN:
                    out.append((share, k, s, min(s + size, len(have))))
        return sorted(out, key=lambda x: (-x[0], -len(self.templates[x[1]][1]), x[1:]))

    def compared(self, have: list[str], k: int, first: int, end: int) -> list[tuple[int, int, int, int, int]]:
        """(template, missing, extra, first word, end) at all places in a stretch that are confirmed.

        The words that a window shares with the template are counted as it moves on; order and wording
        are looked at where they are enough."""
        want, need, spare, out = self.templates[k][1], self.needs[k], self.spare[k], []
        begins, width = set(want[: spare + 1]), len(want) + spare
        held: Counter = Counter()
        shared, stop, skip = 0, first, first
        for i in range(first, end):
            while stop < min(i + width, len(have)):
                w = have[stop]
                if w in need:
                    held[w] += 1
                    shared += held[w] <= need[w]
                stop += 1
            if i >= skip and shared >= len(want) - spare and have[i] in begins:
                window = have[i : i + width]
                if _common(want, window) >= len(want) - spare:
                    found = self.confirm(window, k)
                    if found:
                        out.append((k, found[0], found[1], i + found[2], i + found[3]))
                        if found[0] + found[1] == 0:
                            skip = i + found[3]
            w = have[i]
            if w in need:
                shared -= held[w] <= need[w]
                held[w] -= 1
        return out

    def finds(self, text: str) -> list[dict]:
        """All confirmed stretches (license, gain, missing, extra, from, to) of a text, in order.

        Of stretches that share words the one with the most words of its template counts, each
        difference taking off two.  Stretches are compared in the order of their rank; where a notice
        is confirmed word for word, shorter templates that it covers aren't compared any more."""
        spans = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        have = [text[a:b].lower() for a, b in spans]
        where: dict[str, list[int]] = {}
        for i, w in enumerate(have):
            where.setdefault(w, []).append(i)
        found, exact = set(), []
        sure = {}
        for _, k, s, e in self.ranked(have, where):
            n = len(self.templates[k][1])
            at = sure.setdefault(k, self.sure(where, k))
            inside = at[bisect_left(at, s) : bisect_left(at, e)]
            if all(any(a <= p < b and size > n for a, b, size in exact) for p in inside):
                continue
            for x in self.compared(have, k, s, e):
                if self._counts(x, text, spans, have):
                    found.add(x)
                    if x[1] + x[2] == 0:
                        exact.append((x[3], x[4], n))
        return self._apart(found, spans, have, self._expressions(text, spans))

    def _counts(self, x: tuple, text: str, spans: list, have: list[str]) -> bool:
        """Whether a stretch isn't denied by the words before it and, if it is a title, heads its line."""
        k, _, _, first, end = x
        n = len(self.templates[k][1])
        if n <= SHORT and DENIED & set(have[max(0, first - 3) : first]):
            return False
        if not self.title[k]:
            return True
        before = _words(text[text.rfind("\n", 0, spans[first][0]) + 1 : spans[first][0]])
        stop = text.find("\n", spans[end - 1][1])
        behind = _words(text[spans[end - 1][1] : stop if stop >= 0 else len(text)])
        return before in ([], ["the"]) and (not behind or bool(self.firm[k]))

    def _expressions(self, text: str, spans: list) -> list[dict]:
        """Each license of the SPDX lines, confirmed by their wording, with its size reduction."""
        out = []
        for m in _EXPRESSION.finditer(text):
            for name in dict.fromkeys(identifiers(m[1])):
                raw = " ".join(_words(m[0])).encode()
                gain = 1 - len(self._with(" ".join(_words(f"SPDX-License-Identifier: {name}")).encode()).compress(raw)) / len(self.plain.compress(raw))
                out.append({"license": name, "gain": round(gain, 6), "missing": 0, "extra": 0, "from": m.start(), "to": m.start() + len(m[0].rstrip())})
        return out

    def _apart(self, found: set, spans: list, have: list[str], said: list[dict] = ()) -> list[dict]:
        def worth(x):
            k, missing, extra, _, _ = x
            return len(self.templates[k][1]) - missing - 2 * (missing + extra)

        out, begins, stops = list(said), [], []
        for x in sorted(found, key=lambda x: (-worth(x), x[3], self.templates[x[0]][0], x)):
            k, missing, extra, first, end = x
            at = bisect_left(begins, first)  # accepted stretches are apart, so both lists are in order
            if (at and stops[at - 1] > first) or (at < len(begins) and begins[at] < end):
                continue
            begins.insert(at, first)
            stops.insert(at, end)
            name = self.templates[k][0]
            if name.split("-")[0] in ("GPL", "LGPL", "AGPL") and name[-1].isdigit() and _LATER.match(" ".join(have[end : end + 9])):
                name += "-or-later"
            out.append({"license": name, "gain": round(self.gain(have[first:end], k), 6), "missing": missing, "extra": extra, "from": spans[first][0], "to": spans[end - 1][1]})
        return sorted(out, key=lambda x: (x["from"], x["to"], x["license"]))

    def scan_block(self, block: str) -> list[dict]:
        """Confirmed licenses of a block, each once with its fewest differences."""
        return _each_once(self.finds(block))


def _each_once(finds: list[dict]) -> list[dict]:
    """Each license once; reserved rights say nothing beside a license."""
    best: dict[str, dict] = {}
    if any(x["license"] != "Proprietary" for x in finds):
        finds = [x for x in finds if x["license"] != "Proprietary"]
    for x in sorted(finds, key=lambda x: (x["missing"] + x["extra"], -x["gain"])):
        if x["license"] in best:
            best[x["license"]]["places"] += 1
        else:
            best[x["license"]] = {**x, "places": 1}
    return sorted(best.values(), key=lambda x: (x.get("start", x.get("from")), x["license"]))


def _edge(raw: bytes, at: int) -> int:
    """The first start of a character at or behind ``at``."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def _licenses(scanner: Scanner, raw: bytes, start: int, end: int) -> list[dict]:
    """The block's licenses: stretches whose first license word it holds.  Spans go to the white
    space around the stretch."""
    left, right = _edge(raw, max(0, start - scanner.reach)), _edge(raw, min(len(raw), end + scanner.reach))
    around = raw[left:right].decode("utf-8", "ignore")
    mine = []
    for x in scanner.finds(around):
        a, b = x["from"], x["to"]
        while a and not around[a - 1].isspace():
            a -= 1
        while b < len(around) and not around[b].isspace():
            b += 1
        own = {**{c: x[c] for c in ("license", "gain", "missing", "extra")}, "start": left + len(around[:a].encode()), "end": left + len(around[:b].encode())}
        word = _ANCHOR.search(raw[own["start"] : own["end"]].lower())
        if start <= own["start"] + (word.start() if word else 0) < end:
            mine.append(own)
    return _each_once(mine)


def _blocks(low: bytes):
    """(start, end) of runs of license words with at most ``GAP`` bytes between neighbours."""
    last = None
    for m in _ANCHOR.finditer(low):
        if last and m.start() - last[1] <= GAP:
            last = (last[0], m.end())
            continue
        if last:
            yield last
        last = (m.start(), m.end())
    if last:
        yield last


_FOUND = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gain", pa.float64()), ("missing", pa.int64()), ("extra", pa.int64()), ("places", pa.int64())])
_SPARK = "array<struct<license:string,start:bigint,end:bigint,gain:double,missing:bigint,extra:bigint,places:bigint>>"


def scan(docs: DataFrame, *, text: str = "text", name: str = "licenses") -> DataFrame:
    """``docs`` with ``n_blocks`` (candidate blocks) and an array column ``licenses``: each license
    of a block once, with the byte span of the place of the fewest differences, size reduction,
    missing and extra words there, and the number of its places in the block.

    Columns of these names are replaced, all others kept.  Null and empty texts have no blocks;
    texts are read whole, however long.  Blocks stand in text order; equal blocks in one text are
    each listed; repeated rows are scanned each.
    """
    names = [c for c in docs.columns if c not in (name, "n_blocks")]
    out = docs.select(*names).withColumn("n_blocks", F.lit(0).cast("bigint")).withColumn(name, F.lit(None).cast(_SPARK))

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            data, offsets = tv.buffers(batch.column(names.index(text)))
            found, counts = [], []
            for i in range(batch.num_rows):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                low = raw.lower()
                got, n = [], 0
                for start, end in _blocks(low):
                    n += 1
                    got += _licenses(scanner, raw, start, end)
                found.append(got)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(np.array(counts, np.int64)), pa.array(found, pa.list_(_FOUND))], [*names, "n_blocks", name])

    return out.mapInArrow(run, out.schema)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_blocks, n_licenses, license_names (sorted, comma-joined), n_exact
    (licenses without wording differences), best_gain (0 without licenses).

    Null and empty texts have none; repeated rows and null ids keep their rows; texts are read whole."""
    f = F.col("licenses")
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", "n_blocks", F.size(f).cast("bigint").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct(F.transform(f, lambda x: x.license))), ",").alias("license_names"),
        F.size(F.filter(f, lambda x: (x.missing + x.extra) == 0)).cast("bigint").alias("n_exact"), F.coalesce(F.array_max(F.transform(f, lambda x: x.gain)), F.lit(0.0)).alias("best_gain"),
    )
