"""Licence notices: sparse word n-gram logistic regression over paragraphs, an unknown class, and template confirmation.

The main path is DataFrame expressions alone. Training, on the fixed sentences below, runs on the driver.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

UNKNOWN = "unknown"

# Sentences by which public licences are granted or named.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
        "This project is MIT licensed.",
        "License: MIT",
        "Distributed under the terms of the MIT licence.",
    ],
    "Apache-2.0": [
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
        "Apache-2.0",
        "License: Apache 2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0",
        "Published under the GNU GPL v3.",
        "License: GPLv3",
        "GNU General Public License Version 3, 29 June 2007",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0",
        "Published under the GNU GPL v2.",
        "License: GPLv2",
        "GNU General Public License Version 2, June 1991",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "Published under the GNU LGPL.",
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "SPDX-License-Identifier: AGPL-3.0",
        "Published under the GNU AGPL v3.",
        "GNU Affero General Public License Version 3, 19 November 2007",
    ],
    "BSD": [
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES',
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Licensed under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS',
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License Version 2.0",
        "License: MPL 2.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "https://creativecommons.org/licenses/by-nc/4.0/",
        "Creative Commons Attribution-NonCommercial 4.0 International",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "This text is under CC BY 4.0.",
        "https://creativecommons.org/licenses/by/4.0/",
        "Creative Commons Attribution 4.0 International",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
        "CC0 1.0 Universal",
        "Dedicated to the public domain under CC0.",
        "https://creativecommons.org/publicdomain/zero/1.0/",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Creative Commons Attribution-ShareAlike 4.0 International",
        "https://creativecommons.org/licenses/by-sa/4.0/",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Creative Commons Attribution-NoDerivatives 4.0 International",
        "https://creativecommons.org/licenses/by-nd/4.0/",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ],
    "CC-BY-NC-SA": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "https://creativecommons.org/licenses/by-nc-sa/4.0/",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    ],
    "CC-BY-NC-ND": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "https://creativecommons.org/licenses/by-nc-nd/4.0/",
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
        "Released under the Unlicense.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "Zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "Released under the zlib License.",
        "SPDX-License-Identifier: Zlib",
    ],
    "BUSL-1.1": [
        "Licensed under the Business Source License 1.1",
        "Business Source License 1.1",
        "SPDX-License-Identifier: BUSL-1.1",
    ],
    "EUPL-1.2": [
        "Licensed under the European Union Public Licence, version 1.2.",
        "Licensed under the EUPL",
        "SPDX-License-Identifier: EUPL-1.2",
    ],
    "OFL-1.1": [
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "SIL Open Font License Version 1.1",
        "SPDX-License-Identifier: OFL-1.1",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
# Sentences that speak of such things without granting a licence.
OTHERS: list[str] = [
    "You need a driving license to rent a car.", "The permission of the owner was not asked.", "The software was released last year.",
    "This version of the work is free.", "The source code of the program was modified.", "A copy of the letter may be obtained at the office.",
    "Public transport is free of charge for any person under ten.", "The general public was not admitted.", "We reserved a table for all.",
    "Human rights in the world today.", "The foundation published its terms in the spring.", "He works for the public library, version two of it.",
    "The following conditions are met by few products.", "Creative people work in common rooms.", "The international attribution of the painting is in doubt.",
    "Restrictions without notice are prohibited by law.", "The files and the documentation of the program.", "Its contributors promote the name of the holder.",
    "The restaurant lost its license to sell beer.", "Commercial use of the building is under review.", "The binary forms of the word.", "All of it.",
    "You should have received a copy of the GNU General Public License along with this program. If not, see the web page.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "Copyright by the authors of the book.", "The copyright of the letters lies with the family.", "Permission to park is granted by the town.", "The warranty on the oven runs out in May.",
    "The redistribution of land was the aim of the law.", "Mozilla and Apache are names of projects.", "A licence to fish is sold at the harbour.", "Driving without a license is prohibited.",
    "The GNU is an animal of the plains.", "Rights of way are marked on the map.", "The letter is confidential.", "House of Commons, second reading.", "Licensed under the Blue Barn License.", "Released under the terms of the Harbour Data License, version 3.", "Licensed under a commercial agreement.", "All rights reserved for the King.", "The agreement gives no license to use the mark.",
]
# Words too common to point to a licence; an n-gram of these alone is no feature.
COMMON = frozenset("2 3 a above all and any are as at be by can code copy do either file files following following form forms free from general has http if in is it its law may met mit name names no nor not of on or other people person possible program public published related source that the them these this to under universal use used v version via was will with without work you your".split())

# N-grams by which a family is told from those with like notices. A short template confirms only together
# with one of its family's; so do long ones of the families in VERSIONED, whose notices differ in these alone.
NEEDS: dict[str, list[str]] = {
    "MIT": ["mit license", "mit licence", "mit licensed", "license mit", "licence mit", "spdx-license-identifier mit"],
    "Apache-2.0": ["apache license", "apache licence", "apache-2.0", "apache 2.0", "licenses license-2.0"],
    "GPL-3.0": ["version 3", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "gpl v3", "gplv3", "gpl 3.0", "gpl-3"],
    "GPL-2.0": ["version 2", "gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl v2", "gplv2", "gpl 2.0", "gpl-2"],
    "LGPL": ["lesser general public", "library general public", "lgpl", "gnu lgpl", "lgpl-2.1-or-later", "lgpl-2.1-only", "lgpl-3.0-only", "lgpl-3.0-or-later", "lgpl-2.1", "lgpl-3.0", "lgplv2", "lgplv2.1", "lgplv3"],
    "AGPL-3.0": ["affero general public", "agpl", "agpl-3.0-only", "agpl-3.0-or-later", "agpl-3.0", "agplv3"],
    "BSD": ["bsd license", "bsd licence", "bsd-style license", "bsd 3-clause", "bsd 2-clause", "bsd-3-clause", "bsd-2-clause"],
    "ISC": ["isc license", "isc licence", "spdx-license-identifier isc"],
    "MPL-2.0": ["mozilla public license", "mpl-2.0", "mpl 2.0"],
    "CC-BY-NC": ["cc by-nc", "cc-by-nc", "cc-by-nc-4.0", "commons attribution-noncommercial", "licenses by-nc 4.0", "licenses by-nc 3.0"],
    "CC-BY": ["cc by", "cc-by", "cc-by-4.0", "cc-by-3.0", "commons attribution", "licenses by 4.0", "licenses by 3.0"],
    "CC0": ["cc0", "cc0 1.0", "cc0-1.0", "publicdomain zero 1.0"],
    "CC-BY-SA": ["cc by-sa", "cc-by-sa", "cc-by-sa-4.0", "commons attribution-sharealike", "licenses by-sa 4.0", "licenses by-sa 3.0"],
    "CC-BY-ND": ["cc by-nd", "cc-by-nd", "cc-by-nd-4.0", "commons attribution-noderivatives", "commons attribution-noderivs", "licenses by-nd 4.0", "licenses by-nd 3.0"],
    "CC-BY-NC-SA": ["cc by-nc-sa", "cc-by-nc-sa", "cc-by-nc-sa-4.0", "commons attribution-noncommercial-sharealike", "licenses by-nc-sa 4.0", "licenses by-nc-sa 3.0"],
    "CC-BY-NC-ND": ["cc by-nc-nd", "cc-by-nc-nd", "cc-by-nc-nd-4.0", "commons attribution-noncommercial-noderivatives", "licenses by-nc-nd 4.0", "licenses by-nc-nd 3.0"],
    "Unlicense": ["unlicense", "unencumbered software"],
    "EPL-2.0": ["eclipse public license", "epl-2.0"],
    "BSL-1.0": ["boost software license", "bsl-1.0"],
    "Zlib": ["zlib license", "spdx-license-identifier zlib"],
    "BUSL-1.1": ["business source license", "busl-1.1"],
    "EUPL-1.2": ["european union public", "eupl", "eupl-1.2"],
    "OFL-1.1": ["open font license", "ofl-1.1"],
    "Proprietary": ["all rights reserved", "unauthorized copying", "proprietary and confidential"],
}
VERSIONED = frozenset(["GPL-2.0", "GPL-3.0", "LGPL", "AGPL-3.0"])
# N-grams with which a paragraph is not of a family, whatever else it holds; and of none at all.
BARS: dict[str, list[str]] = {
    "GPL-3.0": ["affero general public", "lesser general public", "library general public"],
    "GPL-2.0": ["affero general public", "lesser general public", "library general public"],
    "CC-BY": ["commons attribution share", "commons attribution non", "commons attribution no", "commons attribution sharealike", "commons attribution noncommercial", "commons attribution noderivatives", "attribution share alike", "attribution non commercial", "attribution no derivatives"],
    "Proprietary": ["rights reserved for", "rights reserved to"],
}
DENIALS = [
    "not licensed", "not released under", "not published under", "not available under", "not distributed under", "not under the", "not under a", "not covered by", "not offered under", "no longer licensed", "no longer under", "no longer released",
    "never licensed", "never released under", "t licensed", "t released under", "t covered by", "t available under", "t under the", "cannot be licensed", "neither licensed",
]

#: n-grams up to this length; words are runs of letters and digits (with + . - inside), A-Z lowered.
MOST_WORDS = 3
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
#: n-grams that count though all their words are common.
NAMED = frozenset(g for grams in (*NEEDS.values(), *BARS.values(), DENIALS) for g in grams)
#: A template of this many n-grams is told by its own text.
LONG = 25
#: Parts of an SPDX expression.
SPDX, OPERATOR = r"(?i)spdx-license-identifier:[ \t]*", r"(?i)[ \t]+(?:or|and)[ \t]+|[()]+"
#: What begins a line of a comment, and the blank lines between paragraphs.
LEADER = r"(?md)^[ \t\r\x0b\x0c]*+(?:(?:[/*#;%>!|\"'<-]++|@?(?:dnl|rem|REM)(?=[ \t\r\n]))[ \t\r\x0b\x0c]*+)*+"
BREAK = r"\n(?:[ \t\r\x0b\x0c]*+\n)+"


def ngrams(text: str) -> set[str]:
    words = re.findall(WORD, text.translate({c: c + 32 for c in range(65, 91)}))
    grams = (" ".join(words[i : i + n]) for n in range(1, MOST_WORDS + 1) for i in range(len(words) - n + 1))
    return {g for g in grams if g in NAMED or any(w not in COMMON for w in g.split(" "))}


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the last is UNKNOWN
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float
    templates: tuple[tuple[int, frozenset], ...]
    gate: tuple[str, ...]  # words of which a paragraph that is to be confirmed has one at least

    def logits(self, grams: set[str]) -> list[float]:
        out = list(self.bias)
        for g in grams:
            for k, w in enumerate(self.weights.get(g, ())):
                out[k] += w
        return [x / self.temperature for x in out]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def examples(seed: int) -> list[tuple[set[str], int]]:
    """(n-grams, class) of the paragraphs above and of seeded variants of them.

    A variant loses a few words, or stands between sentences that grant nothing. The unknown class also has the words
    of licences in any order, a few of them among other words, nothing at all, and short notices that lost their name.
    """
    rng, families, out, unknown = random.Random(seed), (*TEMPLATES, UNKNOWN), [], len(TEMPLATES)
    for k, name in enumerate(families):
        for text in TEMPLATES.get(name, OTHERS):
            words = text.split()
            for turn in range(10):
                kept = [w for w in words if turn == 0 or len(words) < 5 or rng.random() > 0.03 * turn]
                around = [rng.choice(OTHERS) if turn % 3 == 1 else "", rng.choice(OTHERS) if turn > 6 else ""]
                grams = ngrams(" ".join([around[0], *kept, around[1]]))
                out.append((grams, k if k == unknown or told_by_itself(ngrams(text), name) or grams & set(NEEDS[name]) else unknown))
                if k < unknown and turn < 4:
                    some = rng.sample(words, max(1, len(words) // (turn + 1)))
                    mixed = ngrams(" ".join([*some, rng.choice(OTHERS)] if turn else some)) if len(some) > 3 else set()
                    if not mixed & NAMED:
                        out.append((mixed, unknown))
    rng.shuffle(out)
    return out


@lru_cache(maxsize=4)
def train(seed: int = 3, steps: int = 250, decay: float = 1e-3) -> Model:
    """Softmax regression by gradient descent over ``examples``; a feature is an n-gram of a paragraph above.

    Every fifth example is set aside: on these the temperature is chosen that gives the true class, unknown too, its
    best likelihood.
    """
    families, shown = (*TEMPLATES, UNKNOWN), examples(seed)
    vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for g in ngrams(t)} | NAMED)
    place = {g: i for i, g in enumerate(vocabulary)}
    x, y = np.zeros((len(shown), len(vocabulary) + 1)), np.array([k for _, k in shown])
    x[:, -1] = 1
    for i, (grams, _) in enumerate(shown):
        x[i, [place[g] for g in grams if g in place]] = 1
    aside = np.arange(len(shown)) % 5 == 0
    own, want = x[~aside], np.eye(len(families))[y[~aside]]
    scale = np.linalg.norm(own, axis=1).max() ** 2 / 8  # steps as long as the largest example allows
    w, pace = np.zeros((x.shape[1], len(families))), np.zeros((x.shape[1], len(families)))
    for _ in range(steps):
        ahead = w + 0.9 * pace
        pull = own.T @ (_softmax(own @ ahead) - want) / len(own) + decay * ahead / scale
        pace = 0.9 * pace - pull / scale * 8
        w = w + pace
    loss = lambda t: -np.log(np.maximum(1e-12, _softmax(x[aside] @ w / t)[np.arange(aside.sum()), y[aside]])).mean()
    temperature = min((0.25, 0.35, 0.5, 0.7, 0.85, 1.0, 1.25, 1.5, 2.0, 3.0), key=loss)
    shapes = tuple((k, frozenset(ngrams(t))) for k, name in enumerate(TEMPLATES) for t in TEMPLATES[name])
    weights = {g: tuple(round(float(v), 6) for v in w[i]) for g, i in place.items()}
    return Model(families, weights, tuple(round(float(v), 6) for v in w[-1]), temperature, shapes, tuple(gate(shapes, families)))


def told_by_itself(shape: frozenset, family: str) -> bool:
    return len(shape) >= LONG and family not in VERSIONED


def gate(shapes: tuple[tuple[int, frozenset], ...], families: tuple[str, ...], confirm: float = 0.6) -> list[str]:
    """Words such that no paragraph without one of them can be confirmed; they follow from the templates, none is chosen by hand.

    A template that is told by itself has to be held by ``confirm`` of its n-grams: its words are taken one by one,
    those that stand in most of the n-grams first, until what is left is less than that. Any other needs one of its
    family's n-grams, so one word of each, the longest, will do.
    """
    words = {max(g.split(" "), key=lambda w: (w not in COMMON, len(w), w)) for grams in NEEDS.values() for g in grams}
    for k, shape in shapes:
        if not told_by_itself(shape, families[k]):
            continue
        left = {g for g in shape if not words & set(g.split(" "))}
        while len(left) >= confirm * len(shape):
            counts = {w: sum(w in g.split(" ") for g in left) for g in left for w in g.split(" ") if w not in COMMON and len(w) > 5}
            words.add(max(counts, key=lambda w: (counts[w], w)))
            left = {g for g in left if not words & set(g.split(" "))}
    return sorted(words)


def gate_pattern(words: tuple[str, ...]) -> str:
    """A pattern for any of the words as a whole, branching letter by letter so that most places fail at once."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def branch(node: dict) -> str:
        tails = [re.escape(c) + branch(rest) for c, rest in sorted(node.items()) if c]
        inner = tails[0] if len(tails) == 1 and "" not in node else "(?:" + "|".join(tails) + ")" if tails else ""
        return inner + "?" if "" in node and tails else inner

    return r"(?i)(?<![a-z0-9])" + branch(tree) + r"(?![a-z0-9])"


def _words(paragraph: Column) -> Column:
    lowered = F.translate(paragraph, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _grams(words: str) -> Column:
    parts = [words] + [f"if(size({words}) >= {n}, transform(sequence(1, size({words}) - {n - 1}), i -> array_join(slice({words}, i, {n}), ' ')), array())" for n in range(2, MOST_WORDS + 1)]
    return F.expr(f"array_distinct(concat({', '.join(parts)}))")


def classify(paragraphs: DataFrame, model: Model | None = None, confirm: float = 0.6, unsure: float = 0.5) -> DataFrame:
    """(paragraph) -> paragraph, family, probability, containment, confirmed; distinct paragraphs with a gate word and a feature.

    ``family`` is the likeliest class (of equal ones the first in TEMPLATES), or unknown where its probability is
    below ``unsure``, where the paragraph holds none of the n-grams the family needs nor ``confirm`` of a text that is
    told by itself, or where it denies a licence. ``containment`` is the largest share of a template of that family
    (its n-grams) found in the paragraph; ``confirmed`` asks for ``confirm``. Paragraphs left out are unknown, whatever
    their other words. The weights (a row for each n-gram of the fixed templates, some 4,000) are broadcast.
    """
    model = model or train()
    spark, k = paragraphs.sparkSession, len(model.families)
    place = {name: f for f, name in enumerate(model.families)}
    every = (1 << k) - 1
    mask = lambda table, g: sum(1 << place[name] for name, grams in table.items() if g in grams)
    units = shared.columns_only(paragraphs, "paragraph").filter(F.col("paragraph").rlike(gate_pattern(model.gate))).distinct()
    units = shared.cut(units.withColumn("unit", F.monotonically_increasing_id()))
    ids = {g: i for i, g in enumerate(model.weights)}
    names = F.broadcast(spark.createDataFrame(list(ids.items()), "gram string, id int"))
    hits = shared.cut(units.withColumn("words", _words(F.col("paragraph"))).select("unit", F.explode(_grams("words")).alias("gram")).join(names, "gram").select("unit", "id"))
    facts = spark.createDataFrame([(ids[g], list(w), mask(NEEDS, g), every if g in DENIALS else mask(BARS, g)) for g, w in model.weights.items()], "id int, weights array<double>, needs long, bars long")
    shares = spark.createDataFrame([(ids[g], f, told_by_itself(shape, model.families[f]), t, 1.0 / len(shape)) for t, (f, shape) in enumerate(model.templates) for g in shape], "id int, family int, alone boolean, template int, part double")
    sums = [F.sum(F.col("weights")[j]).alias(f"z{j}") for j in range(k)]
    scored = hits.join(F.broadcast(facts), "id").groupBy("unit").agg(*sums, F.bit_or("needs").alias("needs"), F.bit_or("bars").alias("bars"))
    z = F.array(*[(F.col(f"z{j}") + model.bias[j]) / model.temperature for j in range(k)])
    scored = scored.select("unit", "needs", "bars", z.alias("z")).withColumn("top", F.array_max("z")).withColumn("best", (F.array_position("z", F.col("top")) - 1).cast("int"))
    scored = scored.withColumn("p", 1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    held = hits.join(F.broadcast(shares), "id").groupBy("unit", "family", "template", "alone").agg(F.sum("part").alias("share"))
    held = held.groupBy("unit", F.col("family").alias("best")).agg(F.max("share").alias("within"), F.coalesce(F.max(F.when(F.col("alone"), F.col("share"))), F.lit(0.0)).alias("alone"))
    full = scored.join(held, ["unit", "best"], "left").withColumn("within", F.coalesce("within", F.lit(0.0))).withColumn("alone", F.coalesce("alone", F.lit(0.0)))
    bit = lambda c: F.expr(f"(shiftright({c}, best) & 1) = 1")
    # n-grams are summed in any order, so a share may miss the bound by a rounding
    told = bit("needs") | (F.col("alone") >= confirm - 1e-9)
    name = F.element_at(F.array(*[F.lit(f) for f in model.families]), F.col("best") + 1)
    family = F.when((F.col("p") < unsure) | ~told | bit("bars"), UNKNOWN).otherwise(name)
    return units.join(full, "unit").select(
        "paragraph", family.alias("family"), F.round("p", 6).alias("probability"), F.round("within", 6).alias("containment"),
        ((family != UNKNOWN) & (F.when(bit("needs"), F.col("within")).otherwise(F.col("alone")) >= confirm - 1e-9)).alias("confirmed"),
    )


def scan(docs: DataFrame, model: Model | None = None, confirm: float = 0.6) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_paragraphs, n_signal, n_licence, families (sorted, comma-joined), top_probability.

    Paragraphs lie between blank lines; what begins the lines of a comment is left out, and a line of such marks alone
    is blank. A paragraph is classified whole, so that wrapped notices are found, and each of its lines too, so that a
    notice of one line is found next to prose; of an SPDX expression each part by itself. It is confirmed if any of
    these is. Only paragraphs with a gate word (n_signal), without which none is confirmed, leave their document; the
    table is read once, and each distinct text is classified once, however many documents hold it. n_licence counts the
    confirmed ones. Null and empty texts have no paragraphs, texts of any length are read whole; repeated rows keep a row
    each; other columns are left behind; an empty table gives no rows.
    """
    model = model or train()
    blank, word = F.lit(" \t\r\n\x0b\x0c"), gate_pattern(model.gate)
    blocks = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), LEADER, ""), BREAK), lambda x: F.length(F.btrim(x, blank)) > 0)
    cutup = shared.columns_only(docs, "doc_id", "text").withColumn("hit", F.coalesce(F.col("text").rlike(word), F.lit(False))).select("doc_id", "hit", blocks.alias("blocks"))
    kept = F.when(F.col("hit"), F.filter("blocks", lambda x: x.rlike(word))).otherwise(F.array().cast("array<string>"))
    rows = shared.cut(cutup.select("doc_id", F.monotonically_increasing_id().alias("row"), F.size("blocks").cast("bigint").alias("n_paragraphs"), kept.alias("kept")))
    held = rows.select("row", F.explode("kept").alias("block")).withColumn("key", F.md5("block"))
    lines = F.split("block", "\n")
    parts = F.transform(F.filter(lines, lambda x: x.rlike(SPDX)), lambda x: F.transform(F.split(F.regexp_replace(x, "^.*?" + SPDX, ""), OPERATOR), lambda y: F.concat(F.lit("SPDX-License-Identifier: "), y)))
    texts = F.array_distinct(F.concat(F.array("block"), lines, F.flatten(parts)))
    units = shared.cut(held.groupBy("key").agg(F.first("block").alias("block")).select("key", F.explode(texts).alias("paragraph")).filter(F.col("paragraph").rlike(word)))
    known = shared.cut(classify(units, model, confirm).filter("confirmed"))
    sure = units.join(known, "paragraph").groupBy("key").agg(F.collect_set("family").alias("names"), F.max("probability").alias("probability"))
    found = held.select("row", "key").join(sure, "key").groupBy("row").agg(
        F.count(F.lit(1)).alias("licence"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), ",").alias("families"), F.max("probability").alias("top")
    )
    return rows.select("doc_id", "row", "n_paragraphs", F.size("kept").cast("bigint").alias("n_signal")).join(found, "row", "left").select(
        "doc_id", "n_paragraphs", "n_signal", F.coalesce("licence", F.lit(0)).cast("bigint").alias("n_licence"), F.coalesce("families", F.lit("")).alias("families"), F.col("top").alias("top_probability")
    )
