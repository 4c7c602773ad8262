import re

from lorewell.llm import licences as L

from .cases import ROWS, clashing, docs, empty

TEXTS = [
    "Prose of no interest.\nLicensed under the Apache License, Version 2.0.\nMore prose.", "Released under the MIT License", "RELEASED!! UNDER!! THE!! MIT!! LICENSE.!!", "We talked about licences under the sun.",
    "Licensed under CC BY-NC 4.0.\n\nThis work is licensed under the GNU General Public License, version 3.", "", None, "license", "x " * 50_000 + "\nLicensed under CC BY 4.0.",
]


# Licence notices as files have them.
REAL = {
    "MIT": """The MIT License (MIT)

Copyright (c) 2013-2019 Some Author, http://example.org

Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to
the following conditions:
""",
    "GPL-3.0": """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
int main(void) { return 0; }
""",
    "ISC": """Copyright 2020 Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
    "Apache-2.0": """# Copyright 2021 Some Company
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     https://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os
""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
   * Neither the name of Example Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\nlet a;",
    "LGPL-2.1": """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * Lesser General Public License for more details.
""",
    "Zlib": """  This software is provided 'as-is', without any express or implied
  warranty.  In no event will the authors be held liable for any damages
  arising from the use of this software.

  Permission is granted to anyone to use this software for any purpose,
  including commercial applications, and to alter it and redistribute it
  freely, subject to the following restrictions:

  1. The origin of this software must not be misrepresented; you must not
     claim that you wrote the original software. If you use this software
     in a product, an acknowledgment in the product documentation would be
     appreciated but is not required.
  2. Altered source versions must be plainly marked as such, and must not be
     misrepresented as being the original software.
  3. This notice may not be removed or altered from any source distribution.
""",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.\n",
    "BSL-1.0": "// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt or copy at\n// https://www.boost.org/LICENSE_1_0.txt)",
    "CC-BY-4.0": "All pictures are mine. This work is licensed under a Creative Commons\nAttribution 4.0 International License. Do ask.",
}
INNER = "The tool is small and fast. Released under the MIT License. See the documents for more, and write to us."


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def grams(t):
    w = words(t) if not isinstance(t, list) else t
    return {(a, b) for a, b in zip(w, w[1:])}


def brute(t):
    best, n, starts = None, 0, set()
    for s in dict.fromkeys([*(t or "").split("\n"), *re.split(r"\n\s*\n", t or ""), t or ""]):
        g, own = grams(s), None
        for i, (name, template) in enumerate(L.TEMPLATES):
            k = grams(template)
            d = 2 * len(g & k) / (len(g) + len(k)) if g else 0
            if d >= 0.8 and (own is None or (d, -i) > own[:2]):
                own = (d, -i, name)
        if own:
            n += 1
            best = own if best is None or own[:2] > best[:2] else best
    w = words(t)
    for i, (name, template) in enumerate(L.TEMPLATES):
        k, m = grams(template), words(template)
        for o in range(min(L.HEADS, len(m) - 1)):
            if m[o : o + 2] in [m[j : j + 2] for j in range(o)]:
                continue
            for p in range(len(w) - 1):
                if w[p : p + 2] == m[o : o + 2] and p >= o:
                    g = grams(w[p - o : p - o + len(m)])
                    d = 2 * len(g & k) / (len(g) + len(k))
                    if d >= 0.8:
                        starts.add(p - o)
                        if best is None or (d, -i) > best[:2]:
                            best = (d, -i, name)
    return (best[2], round(best[0], 6), n, len(starts)) if best else (None, None, 0, 0)


def test_matches_brute_force(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS + [INNER, *REAL.values()] + [t for _, t in L.TEMPLATES])]
    got = {r.doc_id: (r.licence, r.dice, len(r.matches), len({w.start for w in r.windows})) for r in L.licences(docs(spark, rows)).collect()}
    assert got == {i: brute(t) for i, t, _ in rows}
    assert got[0][0] == "Apache-2.0" and got[1][0] == "MIT" and got[2][0] == "MIT" and got[3][0] is None


def test_real_notices_are_found(spark):
    rows = [(i, t, "s") for i, t in enumerate([INNER, *REAL.values()])]
    got = {r.doc_id: r.licence for r in L.licences(docs(spark, rows)).collect()}
    assert got == dict(enumerate(["MIT", *REAL]))
    plain = [(i, t, "s") for i, t in enumerate(["We asked for permission to use the source.", "The software is free, and so are you. All rights.", "x = 1  # subject to the following conditions"])]
    assert {r.licence for r in L.licences(docs(spark, plain)).collect()} == {None}


def test_awkward_rows(spark):
    assert L.licences(clashing(docs(spark))).count() == len(ROWS)
    assert L.licences(empty(spark)).collect() == []
